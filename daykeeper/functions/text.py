"""Display text and lenient number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daykeeper.contracts import DURATION_UNITS


def human_bytes(size: Column) -> Column:
    """B to TB with base 1024 and one decimal, ties to even."""
    value = size.cast("double")
    steps = [("B", 0), ("KB", 1), ("MB", 2), ("GB", 3)]
    shown = None
    for unit, power in steps:
        scaled = value / float(1024**power)
        text = F.format_string(f"%.1f {unit}", F.bround(scaled.cast("decimal(38,16)"), 1).cast("double"))
        fits = scaled < 1024
        shown = F.when(fits, text) if shown is None else shown.when(fits, text)
    scaled = value / float(1024**4)
    return shown.otherwise(F.format_string("%.1f TB", F.bround(scaled.cast("decimal(38,16)"), 1).cast("double")))


def human_duration(seconds: Column) -> Column:
    total = F.greatest(seconds.cast("bigint"), F.lit(0).cast("bigint"))
    sec, minute, hour = DURATION_UNITS["second"], DURATION_UNITS["minute"], DURATION_UNITS["hour"]
    minutes = F.floor(total / 60)
    return (
        F.when(total < 60, F.concat_ws(" ", total.cast("string"), F.lit(sec)))
        .when(total < 3600, F.concat_ws(" ", minutes.cast("string"), F.lit(minute), (total % 60).cast("string"), F.lit(sec)))
        .otherwise(
            F.concat_ws(
                " ",
                F.floor(total / 3600).cast("string"),
                F.lit(hour),
                F.floor((total % 3600) / 60).cast("string"),
                F.lit(minute),
            )
        )
    )


def compact_text(text: Column, limit: int = 40) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 3)), F.lit("...")))


def safe_int(value: Column, default: int | Column = 0) -> Column:
    """Integer text to BIGINT; anything else becomes the default."""
    fallback = F.lit(default).cast("bigint") if isinstance(default, int) else default
    text = value.cast("string")
    return F.coalesce(F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("bigint")), fallback)


def label(table: dict[str, str], value: Column, otherwise: Column | None = None) -> Column:
    """Lookup in a small fixed table; unknown values show themselves."""
    keys = list(table)
    chain = F.when(value == keys[0], F.lit(table[keys[0]]))
    for key in keys[1:]:
        chain = chain.when(value == key, F.lit(table[key]))
    return chain.otherwise(value if otherwise is None else otherwise)
