"""Listing snapshots stored in buckets of their keys, and their comparison without a shuffle.

A snapshot is written once, bucketed and sorted by (keys, key). Any two snapshots with the same number
of buckets are compared bucket by bucket: a collector with most keys is spread over all buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daykeeper.operators.listing import drift_reason

BUCKETS = 256


def write_snapshot(listing: DataFrame, root: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Writes ``keys``, key, size_bytes of a listing below the new folder ``root`` and opens it.

    One shuffle when a snapshot is taken, none when it is compared. A NULL in a key column is an error:
    every listed object has a name.
    """
    by = [*keys, "key"]
    named = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a listing row has no {c}"))).otherwise(F.col(c)).alias(c) for c in by]
    rows = listing.select(*named, F.col("size_bytes").cast("bigint").alias("size_bytes"))
    name = _table()
    writer = rows.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", root)
    writer.saveAsTable(name, format="parquet")
    return listing.sparkSession.table(name)


def open_snapshot(spark: SparkSession, root: str, columns: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """A snapshot that another session wrote; ``columns`` are its DDL, ``buckets`` the number it was written with."""
    name, by = _table(), ", ".join(f"`{c}`" for c in [*keys, "key"])
    place = root.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(buckets)} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def _table() -> str:
    return f"snapshot_{uuid.uuid4().hex}"


def snapshot_drift(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """``listing_drift`` of two snapshots: each side is counted and both are merged inside their buckets.

    The plan has no exchange where both sides have the same number of buckets.
    """
    by = [*keys, "key"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias(f"_{tag}"), F.max("size_bytes").alias(f"{tag}_size"))
        return counted.hint("merge")

    merged = side(expected, "expected").join(side(observed, "observed"), by, "full_outer")
    none = F.lit(0).cast("bigint")
    drift = drift_reason(F.coalesce("_expected", none), F.coalesce("_observed", none))
    return merged.withColumn("drift", drift).where(F.col("drift").isNotNull()).drop("_expected", "_observed")
