"""SHA-256 column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hex digits 1 to 60 of a row digest are read as four 60-bit numbers, each summed as
# three 20-bit limbs; digits 61 to 64 are left for the bucket. BIGINT sums hold 2**43 rows a bucket; beyond, they turn NULL
# whatever the ANSI setting, so an overflow cannot pass for a fingerprint.
NUMBER_STARTS = (1, 16, 31, 46)
NUMBER_DIGITS = 15
LIMB_BITS = 20
LIMB_MASK = (1 << LIMB_BITS) - 1
BUCKET_START = 61


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def schema_text(schema: T.StructType) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}:{str(f.nullable).lower()}" for f in schema.fields)


def schema_fingerprint(df: DataFrame) -> Column:
    """Digest of the positional ``name:type:nullable`` text; differs when a table's schema drifts."""
    return F.sha2(F.lit(schema_text(df.schema)).cast("binary"), 256)


def digest_numbers(row_sha256: str) -> list[Column]:
    """The row digest in a column as four non-negative BIGINT numbers."""
    return [
        F.expr(f"CAST(conv(substring({row_sha256}, {start}, {NUMBER_DIGITS}), 16, 10) AS BIGINT)")
        for start in NUMBER_STARTS
    ]


def limb_sums(numbers: list[str]) -> list[Column]:
    """Twelve BIGINT sums over the 20-bit limbs of the digest numbers."""
    return [
        F.expr(f"try_sum((shiftright({number}, {shift}) & {LIMB_MASK}L))")
        for number in numbers
        for shift in (0, LIMB_BITS, 2 * LIMB_BITS)
    ]
