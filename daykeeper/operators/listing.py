"""Flat listings: days, folders, removal targets and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daykeeper.contracts import REMOVAL_BATCH_KEYS
from daykeeper.functions.dates import strict_archive_date
from daykeeper.functions.paths import in_prefix, listed_day, target_uri
from daykeeper.functions.rules import first_reason
from daykeeper.operators.reconcile import DAY
from daykeeper.session import durable


def list_days(listing: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``date=YYYY-MM-DD/`` folders; pattern only, the calendar is not checked."""
    days = listing.select(*keys, listed_day(F.col("key")).alias("archive_date"))
    return days.where(F.col("archive_date").isNotNull()).distinct()


def recent_days(days: DataFrame, newest: int) -> DataFrame:
    """The newest valid days of each collector; invalid ones are kept apart by ``check_days``.

    Days are made distinct first, so a window holds one row per calendar day of a collector.
    """
    valid = days.select("collector", strict_archive_date(F.col("archive_date")).alias("archive_date"))
    distinct = valid.where(F.col("archive_date").isNotNull()).distinct()
    newest_first = Window.partitionBy("collector").orderBy(F.desc("archive_date"))
    ranked = distinct.withColumn("_rank", F.row_number().over(newest_first))
    return ranked.where(F.col("_rank") <= newest).drop("_rank")


def invalid_days(days: DataFrame) -> DataFrame:
    """Day texts that are reported and ignored."""
    return days.where(strict_archive_date(F.col("archive_date")).isNull()).select("collector", "archive_date").distinct()


def check_listing_entries(entries: DataFrame) -> DataFrame:
    """Name and size rules of raw listing entries (name, is_dir, size_bytes)."""
    name = F.regexp_replace(F.coalesce("name", F.lit("")), r"^/+|/+\z", "")
    bad_name = (name == "") | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\"))
    is_dir = F.coalesce("is_dir", F.lit(False))
    size = F.when(is_dir, F.lit(0)).otherwise(F.coalesce("size_bytes", F.lit(-1)))
    return entries.withColumn("reason", first_reason(("name", bad_name), ("size", size < 0)))


def browse(listing: DataFrame, directory: str) -> DataFrame:
    """Direct children of a directory: folders first, then by case-folded name."""
    return children(listing.where(in_prefix(F.col("key"), directory, True)), F.lit(directory.rstrip("/") + "/"), []).orderBy(
        F.desc("is_dir"), F.lower("name"), "name"
    )


def children(listing: DataFrame, base: Column, keys: list[str]) -> DataFrame:
    """Children of each row's base folder, as name, is_dir, size and modified."""
    rest = F.substring(F.col("key"), F.length(base) + 1, F.length("key"))
    split = listing.withColumn("_rest", rest).where(F.col("_rest") != "")
    name = F.split_part("_rest", F.lit("/"), F.lit(1))
    is_dir = F.contains(F.col("_rest"), F.lit("/"))
    grouped = split.select(*keys, name.alias("name"), is_dir.alias("is_dir"), "size_bytes", "modified")
    return grouped.groupBy(*keys, "name", "is_dir").agg(
        F.max(F.when(F.col("is_dir"), F.lit(0)).otherwise(F.col("size_bytes"))).alias("size_bytes"),
        F.max(F.when(~F.col("is_dir"), F.col("modified"))).alias("modified"),
    )


def removal_entries(listing: DataFrame, targets: DataFrame) -> DataFrame:
    """Exact key -> size rows of each removal target: the plan's child table.

    ``targets``: collector, target, is_dir. A directory takes keys below ``target/`` only, a file only
    the equal key. Listing rows meet targets by equal keys: each key offers itself and its ancestor
    folders, so there is no range or cross join.
    """
    wanted = targets.select("collector", F.regexp_replace("target", r"/+\z", "").alias("target"), "is_dir")
    # Only depths at which the collector has a target are offered: no row for every ancestor folder.
    depth = F.size(F.split("target", "/"))
    depths = wanted.groupBy("collector").agg(F.array_sort(F.collect_set(depth)).alias("_depths"))
    parts = F.split("key", "/")
    ancestors = F.transform(
        F.filter("_depths", lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    offered = listing.select("collector", "key", "size_bytes").join(depths, "collector").select(
        "collector", "key", "size_bytes", F.explode(ancestors).alias("target")
    )
    met = offered.join(wanted, ["collector", "target"])
    return met.where(F.when(F.col("is_dir"), F.col("key") != F.col("target")).otherwise(F.col("key") == F.col("target"))).select(
        "collector", "target", "is_dir", "key", "size_bytes"
    )


def removal_plan(listing: DataFrame, targets: DataFrame, bucket: str) -> DataFrame:
    """Count, bytes and URI per target; an empty target is an error row."""
    by_key = removal_entries(listing, targets).groupBy("collector", "target", "key").agg(
        F.max("size_bytes").alias("size_bytes"), F.min("size_bytes").alias("_least"), F.count(F.lit(1)).alias("_listed")
    )
    # A negative size or a key listed twice makes the listing unfit for a removal.
    counted = by_key.groupBy("collector", "target").agg(
        F.count(F.lit(1)).alias("object_count"),
        F.sum("size_bytes").alias("total_bytes"),
        F.count_if((F.col("_least") < 0) | (F.col("_listed") > 1)).alias("_bad"),
    )
    wanted = targets.select("collector", F.regexp_replace("target", r"/+\z", "").alias("target"), "is_dir")
    zero = F.lit(0).cast("bigint")
    return wanted.join(counted, ["collector", "target"], "left").select(
        "collector",
        "target",
        "is_dir",
        F.coalesce("object_count", zero).alias("object_count"),
        F.coalesce("total_bytes", zero).alias("total_bytes"),
        target_uri(bucket, F.col("target"), F.col("is_dir")).alias("uri"),
        first_reason(("empty", F.col("object_count").isNull()), ("invalid_object", F.col("_bad") > 0)).alias("reason"),
    )


def removal_documents(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Every plan with the key -> size map in its document.

    The contract's document holds the whole map, so each row is as large as its target.
    ``sources.large_documents.write_map_documents`` writes documents of any size as files; where only
    the entries are wanted, ``removal_entries`` has them as rows.
    """
    pairs = F.array_sort(F.collect_list(F.struct("key", "size_bytes")))
    return entries.groupBy(*keys).agg(F.map_from_entries(pairs).alias("expected_objects"))


def listing_drift(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Key -> size differences between plan and listing: ``added``, ``removed``, ``resized``, or
    ``duplicate`` for a key that either side names more than once.

    One shuffle of the tagged union; no row means no drift.
    """
    tagged = expected.select(*keys, "key", "size_bytes", F.lit(True).alias("_plan")).unionByName(
        observed.select(*keys, "key", "size_bytes", F.lit(False).alias("_plan"))
    )

    def size(planned: bool) -> Column:
        return F.max(F.when(F.col("_plan") == planned, F.col("size_bytes")))

    merged = tagged.groupBy(*keys, "key").agg(
        F.count_if("_plan").alias("_in_plan"),
        F.count_if(~F.col("_plan")).alias("_in_now"),
        size(True).alias("expected_size"),
        size(False).alias("observed_size"),
    )
    drift = drift_reason(F.col("_in_plan"), F.col("_in_now"))
    return merged.withColumn("drift", drift).where(F.col("drift").isNotNull()).drop("_in_plan", "_in_now")


def drift_reason(in_plan: Column, in_now: Column) -> Column:
    """How a key differs, from the times each side names it and the two sizes; NULL if it does not."""
    return first_reason(
        ("duplicate", (in_plan > 1) | (in_now > 1)),
        ("added", in_plan == 0),
        ("removed", in_now == 0),
        ("resized", ~F.col("expected_size").eqNullSafe(F.col("observed_size"))),
    )


def residual_after_removal(listing: DataFrame, targets: DataFrame) -> DataFrame:
    """How many objects of each target are still listed."""
    left = removal_entries(listing, targets).groupBy("collector", "target").agg(F.count(F.lit(1)).alias("remaining"))
    wanted = targets.select("collector", F.regexp_replace("target", r"/+\z", "").alias("target"))
    return wanted.join(left, ["collector", "target"], "left").withColumn(
        "remaining", F.coalesce("remaining", F.lit(0).cast("bigint"))
    )


def removal_batches(keys: DataFrame, groups: list[str], size: int = REMOVAL_BATCH_KEYS) -> DataFrame:
    """Sorted keys of each group in numbered batches of ``size``.

    Keys are range-partitioned by (group, key), so a group with most keys spreads over many tasks. A
    key's rank is its place in its partition plus the counts of the group's earlier partitions, of
    which there are at most as many as partitions. The ranged rows are checkpointed, so both uses see
    the same partition bounds.
    """
    ranged = durable(
        keys.select(*groups, "key")
        .repartitionByRange(*groups, "key")
        .sortWithinPartitions(*groups, "key")
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = ranged.withColumn("_part", F.shiftright("_id", 33))
    runs = placed.groupBy(*groups, "_part").agg(F.min("_id").alias("_start"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        *groups, "_part", "_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0).cast("bigint")).alias("_before")
    )
    rank = F.col("_before") + F.col("_id") - F.col("_start")
    return placed.join(offsets, [*groups, "_part"]).select(
        *groups, "key", F.floor(rank / size).cast("bigint").alias("batch")
    )


def day_entries(listing: DataFrame) -> DataFrame:
    """Listed entries per day and replica, for ``expected_entries``."""
    days = listing.withColumn("archive_date", listed_day(F.col("key"))).where(F.col("archive_date").isNotNull())
    return days.groupBy(*DAY, "replica").agg(F.count(F.lit(1)).alias("entries"))
