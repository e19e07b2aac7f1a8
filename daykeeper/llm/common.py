"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daykeeper.session import scratch_path


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], work, schema: str, most_bytes: int = 1_000_000) -> DataFrame:
    """``work(list of tuples) -> list of tuples`` over slices of bounded text size, by Arrow batches.

    ``columns`` are read by name, so that further columns of ``df`` never reach Python.
    """
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for rows in slices(batches, most_bytes):
            out = step(rows)
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, target)], names=names)

    return df.select(*columns).mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4_000_000, most_rows: int = 4_096) -> Iterator[list[tuple]]:
    """Rows of the batches as tuples, in lists of bounded size (a single larger row is a list of its own)."""
    for batch in batches:
        at = 0
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(most_rows, most_bytes // per_row))
        while at < batch.num_rows:
            part = batch.slice(at, step)
            yield list(zip(*(c.to_pylist() for c in part.columns)))
            at += step


def text_slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of ``column`` add up to at most ``most_bytes`` in each (a longer text is
    alone); cut by the texts' own lengths, so that a few long rows do not ride with thousands of short ones."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            before = int(total[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + most_bytes, "right")))
            yield batch.slice(at, end - at)
            at = end


def _arrow_schema(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so (upper or lower case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_of(value) -> int:
    return zlib.crc32(str(value).encode())


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage like a checkpoint, but carries
    no constraints of the plan along (in loops these grow until planning takes longer than the work)
    and tells the planner its size."""
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(vertices: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, label): the smallest id reachable over the undirected ``edges`` (a, b); ``vertices`` (id).

    Every round takes the smallest label among the neighbours (an aggregate with a map-side part) and
    then the label of the label, so the rounds grow with the logarithm of the diameter for chains and
    are two or three for stars. Joins meet stored tables on both sides, so adaptive execution can split
    the rows of a hub. Labels only fall, so the loop ends when their sum stays.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    both = stored(both.where("src <> dst"))
    labels = vertices.select("id", F.col("id").alias("label"))
    before = None
    for _ in range(max_rounds):
        offered = (
            both.join(labels, both.src == labels.id)
            .select(F.col("dst").alias("id"), "label")
            .unionByName(labels)
            .groupBy("id")
            .agg(F.min("label").alias("label"))
        )
        offered = stored(offered)
        total = offered.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return offered
        before = total
        roots = offered.select(F.col("id").alias("label"), F.col("label").alias("root"))
        labels = offered.join(roots, "label").select("id", "root").withColumnRenamed("root", "label")
    raise RuntimeError("components did not settle")
