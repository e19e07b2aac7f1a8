"""Archived objects of any size: row groups become payload bytes in tasks of their own, one task chains them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daykeeper.contracts import BUSINESS_KIND, EMPTY_SHA256
from daykeeper.functions.canonical import payload_rows
from daykeeper.operators.reconcile import OBJECT
from daykeeper.session import durable
from daykeeper.sources.named import arrow_uri
from daykeeper.sources.tables import OBJECTS_TOGETHER, observe_objects, spread_objects

#: Bytes of a piece of the chain; a longer row is a piece of its own.
PIECE_BYTES = 1 << 20

_KEYS = [(name, pa.string()) for name in OBJECT]
_GROUP = pa.schema([*_KEYS, ("uri", pa.string()), ("row_group", pa.int32())])
_PIECE = pa.schema([*_KEYS, ("row_group", pa.int32()), ("piece", pa.int32()), ("data", pa.binary()), ("reason", pa.string())])
_CHAINED = pa.schema([*_KEYS, ("content_sha256", pa.string()), ("reason", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "STRING", pa.int32(): "INT", pa.binary(): "BINARY"}
    return ", ".join(f"{field.name} {names[field.type]}" for field in schema)


def content_by_row_group(objects: DataFrame) -> DataFrame:
    """The contract's content digest of each Parquet file: OBJECT, content_sha256, reason.

    ``objects``: OBJECT and ``uri``, one row per object. Row groups are decoded and encoded apart from each
    other, in as many tasks as their number asks for; a row group's length-prefixed payloads leave in pieces of about ``PIECE_BYTES``. Pieces are shuffled by
    object and sorted (with spill), and one task per object only hashes them, one Arrow batch after the
    other, whose bytes Spark bounds. The chain itself is sequential by contract. A NaN, an infinity or a
    row group that cannot be decoded gives a NULL digest and the first such reason in file order.
    """

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with _opened(row["uri"]) as table:
                        found = [{**row, "row_group": g} for g in range(table.num_row_groups)]
                except pa.ArrowInvalid:
                    # Its one task finds the same, and says so.
                    found = [{**row, "row_group": 0}]
                yield pa.RecordBatch.from_pylist(found, schema=_GROUP)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key = {name: row[name] for name in (*OBJECT, "row_group")}
                for number, (data, reason) in enumerate(_payload_pieces(row["uri"], row["row_group"])):
                    yield pa.RecordBatch.from_pylist([{**key, "piece": number, "data": data, "reason": reason}], schema=_PIECE)

    # Footers alone are short work; a row group is decoded and encoded row by row.
    found = spread_objects(objects.select(*OBJECT, "uri"), [*OBJECT], 16 * OBJECTS_TOGETHER).mapInArrow(groups, _ddl(_GROUP))
    made = spread_objects(found, [*OBJECT, "row_group"]).mapInArrow(pieces, _ddl(_PIECE))
    ordered = made.repartition(*OBJECT).sortWithinPartitions(*OBJECT, "row_group", "piece")
    chained = ordered.mapInArrow(_chain, _ddl(_CHAINED)).withColumn("_found", F.lit(True))
    # A file without row groups has the digest of no bytes.
    return objects.select(*OBJECT).join(chained, OBJECT, "left").select(
        *OBJECT, F.when(F.col("_found").isNull(), F.lit(EMPTY_SHA256)).otherwise(F.col("content_sha256")).alias("content_sha256"), "reason"
    )


def _opened(uri: str):
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    filesystem, path = pafs.FileSystem.from_uri(arrow_uri(uri))
    return pq.ParquetFile(filesystem.open_input_file(path))


def _payload_pieces(uri: str, group: int) -> Iterator[tuple[bytes | None, str | None]]:
    held = bytearray()
    try:
        with _opened(uri) as table:
            for batch in table.iter_batches(batch_size=10_000, row_groups=[group]):
                rows = payload_rows(batch)
                if rows is None:
                    yield None, "non_finite"
                    return
                for data in rows:
                    held += len(data).to_bytes(8, "big") + data
                    if len(held) >= PIECE_BYTES:
                        yield bytes(held), None
                        held.clear()
    except (OSError, pa.ArrowInvalid) as error:
        # What the store refuses is tried again; what is no Parquet is a finding.
        if isinstance(error, OSError) and error.errno is not None:
            raise
        yield None, f"unreadable: {type(error).__name__}"
        return
    yield bytes(held), None


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, digest, broken = None, hashlib.sha256(), None

    def done() -> pa.RecordBatch:
        fact = {**dict(zip(OBJECT, current)), "content_sha256": None if broken else digest.hexdigest(), "reason": broken}
        return pa.RecordBatch.from_pylist([fact], schema=_CHAINED)

    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(OBJECT)))))
        data, reasons = batch.column("data"), batch.column("reason")
        for k, key in enumerate(keys):
            if key != current:
                if current is not None:
                    yield done()
                current, digest, broken = key, hashlib.sha256(), None
            if broken is None:
                broken = reasons[k].as_py()
                if broken is None:
                    digest.update(data[k].as_buffer())
    if current is not None:
        yield done()


def observe_large_objects(objects: DataFrame) -> DataFrame:
    """The facts of ``observe_objects``, for objects of which one may hold most rows of the archive.

    Bytes, rows and schema come first, one task per object, and are kept; only business objects whose
    facts agree with the manifest (where ``objects`` has what it says) are read again for their content,
    row group by row group. One row per object is expected.
    """
    facts = durable(observe_objects(objects.withColumn("kind", F.lit(None).cast("string"))).drop("content_sha256"))
    said = [n for n in ("size_bytes", "sha256", "row_count", "schema_sha256") if n in objects.columns]
    named = objects.where(F.col("kind") == BUSINESS_KIND).select(*OBJECT, "uri", *[F.col(n).alias(f"_{n}") for n in said])
    fine = named.join(facts, OBJECT).where(F.col("reason").isNull())
    for name in said:
        fine = fine.where(F.col(f"_{name}").isNull() | (F.col(f"_{name}") == F.col(name)))
    content = content_by_row_group(fine).select(*OBJECT, "content_sha256", F.col("reason").alias("_reason"))
    joined = facts.join(content, OBJECT, "left")
    return joined.withColumn("reason", F.coalesce("reason", "_reason")).select(
        *OBJECT, "size_bytes", "sha256", "row_count", "schema_sha256", "content_sha256", "reason"
    )
