"""Archived Parquet objects: day tables, listings and object observation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daykeeper.contracts import BUSINESS_KIND
from daykeeper.functions.canonical import payload_rows
from daykeeper.session import durable
from daykeeper.sources.named import arrow_uri
from daykeeper.sources.tree import list_tree

_HASH_CHUNK = 8 * 1024 * 1024
#: Files up to this size are read once and held while they are observed; longer ones are read twice.
_HELD_BYTES = 64 * 1024 * 1024
#: Objects, or row groups of objects, that one task opens.
OBJECTS_TOGETHER = 16


def scan_day_tables(spark: SparkSession, root: str, dates: list[str] | None = None) -> DataFrame:
    """Rows of a root of ``collector=/date=`` folders, with file path and row index for file order.

    ``collector`` and ``date`` are text, as the folders spell them: ``007`` stays ``007``. ``dates``
    becomes a partition filter, so other days are not listed for reading.
    """
    df = read_partitioned(spark, root, ["collector", "date"])
    if dates is not None:
        df = df.where(F.col("date").isin(dates))
    # row_index is only produced when asked for beside the data columns.
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.row_index").alias("row_index"),
    )


def read_partitioned(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """A partitioned Parquet table whose partition columns are text instead of inferred types."""
    inferred = spark.read.option("basePath", root).parquet(root).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name in keys else f for f in inferred.fields]
    return spark.read.option("basePath", root).schema(T.StructType(fields)).parquet(root)


def list_objects(spark: SparkSession, root: str, name_glob: str | None = None) -> DataFrame:
    """Flat listing below ``root``: key, size, modified. File contents are not read; folders are listed in tasks."""
    return list_tree(spark, root, name_glob)


OBSERVED = (
    "collector STRING, archive_date STRING, relative_key STRING, size_bytes BIGINT, sha256 STRING, "
    "row_count BIGINT, schema_sha256 STRING, content_sha256 STRING, reason STRING"
)


def spread_objects(named: DataFrame, keys: list[str], together: int = OBJECTS_TOGETHER) -> DataFrame:
    """Rows that name what a task is to read, in tasks of about ``together``. The names are a few bytes each: shuffled
    by size alone, thousands of objects would meet in one task. They are kept, as counting them must not make them twice."""
    kept = durable(named)
    return kept.repartition(max(1, -(-kept.count() // together)), *keys)


def observe_objects(objects: DataFrame, tasks: int | None = None) -> DataFrame:
    """Observed facts of Parquet files, in the contract's exact form.

    ``objects`` has collector, archive_date, relative_key, kind and ``uri``. Rows are spread by object over
    ``tasks``, or over as many as their number asks for; a file of up to 64 MB is read once, a longer one is streamed once for its digest and once
    in row batches, so memory stays bounded for files of any size. Only business objects get a content digest.
    Where one object holds most rows, ``large_objects.observe_large_objects`` spreads its row groups.

    Where ``objects`` also has what the manifest says (size_bytes, sha256, row_count, schema_sha256), a
    file is read only up to its first fact that differs: later facts stay NULL, which ``verify_objects``
    never reaches. A file that is not there or is no Parquet is a finding; any other failure to read
    (refused, throttled, a scheme without a file system) fails the task, so that it is tried again.
    """

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fact = {name: row[name] for name in ("collector", "archive_date", "relative_key")}
                fact.update(_observe_file(row["uri"], row["kind"] == BUSINESS_KIND, {n: row[n] for n in said}))
                yield pa.RecordBatch.from_pylist([fact], schema=schema)

    schema = pa.schema(
        [
            ("collector", pa.string()),
            ("archive_date", pa.string()),
            ("relative_key", pa.string()),
            ("size_bytes", pa.int64()),
            ("sha256", pa.string()),
            ("row_count", pa.int64()),
            ("schema_sha256", pa.string()),
            ("content_sha256", pa.string()),
            ("reason", pa.string()),
        ]
    )
    said = [n for n in ("size_bytes", "sha256", "row_count", "schema_sha256") if n in objects.columns]
    slim = objects.select("collector", "archive_date", "relative_key", "kind", "uri", *said)
    keys = ["collector", "archive_date", "relative_key"]
    spread = slim.repartition(tasks, *keys) if tasks else spread_objects(slim, keys)
    return spread.mapInArrow(observe, OBSERVED)


def _observe_file(uri: str, with_content: bool, said: dict) -> dict:
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fact: dict = {}

    def differs(name: str) -> bool:
        return said.get(name) is not None and said[name] != fact[name]

    filesystem, path = pafs.FileSystem.from_uri(arrow_uri(uri))
    info = filesystem.get_file_info(path)
    if info.type != pafs.FileType.File:
        return {"reason": "missing"}
    fact["size_bytes"] = info.size
    if differs("size_bytes"):
        return fact
    digest = hashlib.sha256()
    held = None
    with filesystem.open_input_stream(path) as stream:
        if info.size <= _HELD_BYTES:
            held = stream.read_buffer()
            digest.update(held)
        else:
            while chunk := stream.read(_HASH_CHUNK):
                digest.update(chunk)
    fact["sha256"] = digest.hexdigest()
    if differs("sha256"):
        return fact
    with filesystem.open_input_file(path) if held is None else pa.BufferReader(held) as handle:
        try:
            table = pq.ParquetFile(handle)
            fact["row_count"] = table.metadata.num_rows
            fact["schema_sha256"] = hashlib.sha256(str(table.schema_arrow).encode("utf-8")).hexdigest()
            if with_content and not differs("row_count") and not differs("schema_sha256"):
                fact["content_sha256"], fact["reason"] = _content_chain(table)
        except (OSError, pa.ArrowInvalid) as error:
            # The bytes were read whole just now: what fails here is their form, unless the store says otherwise.
            if isinstance(error, OSError) and error.errno is not None:
                raise
            fact["reason"] = f"unreadable: {type(error).__name__}"
    return fact


def _content_chain(table) -> tuple[str | None, str | None]:
    digest = hashlib.sha256()
    for batch in table.iter_batches(batch_size=10_000):
        rows = payload_rows(batch)
        if rows is None:
            return None, "non_finite"
        for data in rows:
            digest.update(len(data).to_bytes(8, "big") + data)
    return digest.hexdigest(), None


def arrow_schema_digest(objects: DataFrame) -> DataFrame:
    """Digest of the exact Arrow schema text, reading only each file's footer."""

    def footer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            digests, counts = [], []
            for uri in batch.column(1).to_pylist():
                filesystem, path = pafs.FileSystem.from_uri(arrow_uri(uri))
                with filesystem.open_input_file(path) as handle:
                    table = pq.ParquetFile(handle)
                    counts.append(table.metadata.num_rows)
                    digests.append(hashlib.sha256(str(table.schema_arrow).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
                names=["relative_key", "row_count", "schema_sha256"],
            )

    slim = spread_objects(objects.select("relative_key", "uri"), ["relative_key"], 16 * OBJECTS_TOGETHER)
    return slim.mapInArrow(footer, "relative_key STRING, row_count BIGINT, schema_sha256 STRING")
