"""Documents written under exact names, which Spark's own file writers cannot choose."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrow_uri(uri: str) -> str:
    """A Hadoop URI in the form the Arrow file systems take."""
    if uri.startswith("/"):
        return "file://" + uri
    return re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/(?!/)", "file:///", uri))


def write_named(documents: DataFrame, root: str) -> None:
    """Writes ``content`` (binary) to ``root/name``, one file per row, inside the tasks.

    Each file is written beside its final name and then moved, so a reader never sees half a
    document, and a retried task replaces its files with the same bytes.
    """
    base = arrow_uri(root).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        filesystem, folder = pafs.FileSystem.from_uri(base)
        written = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{folder}/{name}"
                filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with filesystem.open_output_stream(path + ".tmp") as stream:
                    stream.write(content)
                filesystem.move(path + ".tmp", path)
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])

    rows = documents.select(F.col("name"), F.col("content").cast("binary").alias("content"))
    rows.mapInArrow(write, "written BIGINT").agg(F.sum("written")).collect()
