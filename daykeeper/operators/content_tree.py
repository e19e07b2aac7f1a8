"""Trees of content digests kept for each replica, and the rows in which two of them differ.

A tree has three levels: key ranges (the values of ``keys``, such as a collector day), buckets of a range
(leading digits of a row's digest) and rows. Every node holds its row count and sums over the digests
below it. Two trees are compared from the top; what lies below equal nodes is not opened.

Below ``root``: ``rows/leaf=N`` holds the rows of the buckets that share folder N, ``buckets/shard=N`` the
bucket nodes of the ranges that share shard N, ``ranges`` the range nodes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daykeeper.functions.digests import BUCKET_START, digest_numbers, limb_sums, sha256
from daykeeper.session import durable

#: Folders of rows and of bucket nodes: a difference in few rows opens as many of them as rows differ.
LEAVES = 4096
SHARDS = 256
#: Hex digits of a row's digest that name its bucket: a range with most rows is spread over 256 nodes.
BUCKET_DIGITS = 2

_SUMS = [f"s{i}" for i in range(12)]
_OWN = {"row_sha256", "node_sha256", "bucket", "leaf", "shard", "copies", "row_count", "left_copies", "right_copies", *_SUMS}


_SUMMED = ", ".join(f"{name} BIGINT" for name in ["row_count", *_SUMS])
_LEVELS = {
    "rows": "row_sha256 STRING, copies BIGINT, node_sha256 STRING, bucket STRING, leaf INT",
    "buckets": f"bucket STRING, leaf INT, {_SUMMED}, shard INT",
    "ranges": f"shard INT, {_SUMMED}",
}


@dataclass(frozen=True)
class ContentTree:
    """Where a tree lies; ``key_types`` and ``id_types`` are the DDL of its columns."""

    root: str
    keys: tuple[str, ...]
    ids: tuple[str, ...]
    key_types: str
    id_types: str

    def level(self, spark: SparkSession, name: str) -> DataFrame:
        """A level with its own columns, also where it has no rows."""
        named = [self.key_types, self.id_types] if name == "rows" else [self.key_types]
        return spark.read.schema(", ".join([*named, _LEVELS[name]])).parquet(f"{self.root}/{name}")


def write_content_tree(
    df: DataFrame,
    keys: list[str],
    ids: list[str],
    root: str,
    payload: str = "payload",
    leaves: int = LEAVES,
    shards: int = SHARDS,
) -> ContentTree:
    """Writes the tree of ``df``; ``ids`` name a row within its range and may repeat.

    Equal rows are one line with their number of copies, combined before the shuffle, and folders take
    buckets, not ranges: neither a hot range nor a hot row gathers in one task. NULLs in any column are
    values of their own. ``root`` must be new.
    """
    clash = _OWN.intersection([*keys, *ids])
    if clash:
        raise ValueError(f"columns are named like the tree's own: {sorted(clash)}")
    spark = df.sparkSession
    ddl = lambda names: ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    tree = ContentTree(root.rstrip("/"), tuple(keys), tuple(ids), ddl(keys), ddl(ids))
    rows = df.select(*keys, *ids, sha256(F.col(payload)).alias("row_sha256"))
    counted = rows.groupBy(*keys, *ids, "row_sha256").agg(F.count(F.lit(1)).alias("copies"))
    whole = F.to_json(F.struct(*ids, "row_sha256", "copies"), {"ignoreNullFields": "false"})
    noded = counted.withColumn("node_sha256", sha256(whole)).withColumn(
        "bucket", F.substring("node_sha256", BUCKET_START, BUCKET_DIGITS)
    )
    placed = noded.withColumn("leaf", F.pmod(F.xxhash64(*keys, "bucket"), F.lit(leaves)).cast("int"))
    placed.hint("rebalance", "leaf").write.partitionBy("leaf").parquet(f"{tree.root}/rows")

    stored = tree.level(spark, "rows")
    numbered = stored.select(
        *keys, "bucket", "leaf", "copies", *[number.alias(f"_n{i}") for i, number in enumerate(digest_numbers("node_sha256"))]
    )
    sums = [total.alias(name) for total, name in zip(limb_sums([f"_n{i}" for i in range(4)]), _SUMS)]
    buckets = numbered.groupBy(*keys, "bucket", "leaf").agg(F.sum("copies").alias("row_count"), *sums)
    sharded = buckets.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int"))
    sharded.hint("rebalance", "shard").write.partitionBy("shard").parquet(f"{tree.root}/buckets")

    nodes = tree.level(spark, "buckets").groupBy(*keys, "shard").agg(
        F.sum("row_count").alias("row_count"), *[F.sum(name).alias(name) for name in _SUMS]
    )
    nodes.write.parquet(f"{tree.root}/ranges")
    return tree


def content_difference(spark: SparkSession, left: ContentTree, right: ContentTree) -> DataFrame:
    """Rows whose number of copies differs: keys, ids, row_sha256, left_copies, right_copies.

    Ranges are compared first, then the buckets of ranges that differ, then the rows of buckets that
    differ. The folders of the next level reach its scan as a broadcast of at most as many numbers as
    there are folders, by which Spark prunes partitions before a file is opened.
    """
    if (left.keys, left.ids, left.key_types, left.id_types) != (right.keys, right.ids, right.key_types, right.id_types):
        raise ValueError("the trees are of different columns")
    keys, ids = list(left.keys), list(left.ids)
    ranges = durable(_unequal(spark, left, right, "ranges", [*keys, "shard"]))
    below = lambda name, at, by, parents: tuple(
        _under(tree.level(spark, name), at, by, parents) for tree in (left, right)
    )
    buckets = durable(_unequal_nodes(*below("buckets", "shard", keys, ranges), [*keys, "bucket", "leaf"]))
    a, b = below("rows", "leaf", [*keys, "bucket"], buckets)
    row = [*keys, *ids, "row_sha256"]
    zero = F.lit(0).cast("bigint")
    sided = a.select(*row, F.col("copies").alias("left_copies"), zero.alias("right_copies")).unionByName(
        b.select(*row, zero.alias("left_copies"), F.col("copies").alias("right_copies"))
    )
    summed = sided.groupBy(*row).agg(F.sum("left_copies").alias("left_copies"), F.sum("right_copies").alias("right_copies"))
    return summed.where(F.col("left_copies") != F.col("right_copies"))


def _unequal(spark: SparkSession, left: ContentTree, right: ContentTree, name: str, by: list[str]) -> DataFrame:
    return _unequal_nodes(left.level(spark, name), right.level(spark, name), by)


def _unequal_nodes(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Nodes with another count or sum on either side; one tagged union, combined before the shuffle."""
    measures = ["row_count", *_SUMS]
    sides = [df.select(*by, *[(F.col(m) * sign).alias(m) for m in measures]) for df, sign in ((left, 1), (right, -1))]
    totals = sides[0].unionByName(sides[1]).groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])
    # A sum beyond a long is NULL in its node: such nodes count as unequal, and their rows decide.
    return totals.where(reduce(lambda x, y: x | y, [~F.col(m).eqNullSafe(F.lit(0)) for m in measures])).select(*by)


def _under(level: DataFrame, folder: str, by: list[str], parents: DataFrame) -> DataFrame:
    """Lines of a level below ``parents``, opening only the folders that hold some."""
    # The condition holds for every folder; partitions are pruned at run time only by a side with one.
    folders = parents.where(F.col(folder) >= 0).select(F.col(folder).alias("_folder")).distinct()
    held = level.join(F.broadcast(folders), F.col(folder) == F.col("_folder"), "left_semi")
    wanted = parents.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
    same: list[Column] = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return held.join(wanted, reduce(lambda x, y: x & y, same), "left_semi")
