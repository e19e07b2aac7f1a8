"""Comparison of replicas, manifests and observed objects.

Two-sided comparisons are unions with a side tag, aggregated by key: one shuffle with map-side
combine instead of a join of two shuffled sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daykeeper.contracts import BUSINESS_KIND, PRIMARY_REPLICA, SECONDARY_REPLICA
from daykeeper.functions.rules import differs, first_reason

DAY = ["collector", "archive_date"]
OBJECT = ["collector", "archive_date", "relative_key"]


def _of(side: str, value: str) -> Column:
    return F.max(F.when(F.col("replica") == side, F.col(value)))


def replica_match(
    manifests: DataFrame, left: str = PRIMARY_REPLICA, right: str = SECONDARY_REPLICA, raw: bool = False
) -> DataFrame:
    """Per day whether both replicas' manifests are equal; NULL when either is absent.

    ``raw`` also compares the documents' bytes, for manifests that keep them.
    """
    columns = ["raw_sha256", "raw"] if raw else ["raw_sha256"]
    sides = manifests.select(*DAY, "replica", *columns).groupBy(*DAY).agg(
        *[_of(side, name).alias(f"{tag}_{name}") for tag, side in (("left", left), ("right", right)) for name in columns]
    )
    both = F.col("left_raw_sha256").isNotNull() & F.col("right_raw_sha256").isNotNull()
    same = reduce(lambda a, b: a & b, [F.col(f"left_{name}") == F.col(f"right_{name}") for name in columns])
    return sides.select(
        *DAY,
        F.col("left_raw_sha256").alias("left_sha256"),
        F.col("right_raw_sha256").alias("right_sha256"),
        F.when(both, same).alias("replicas_match"),
    )


def object_meta_match(objects: DataFrame, object_meta: DataFrame) -> DataFrame:
    """Size and digest of each object against the replica's metadata.

    A sidecar that is itself invalid or lies under another object's name counts for nothing. Where both
    sides name the replica, each replica's objects meet their own sidecars.
    """
    if "reason" in object_meta.columns:
        object_meta = object_meta.where(F.col("reason").isNull())
    keys = ["collector", *[c for c in ("replica",) if c in objects.columns and c in object_meta.columns], "relative_key"]
    meta = object_meta.select(
        *keys, F.col("size_bytes").alias("meta_size"), F.col("sha256").alias("meta_sha256"),
        F.lit(True).alias("_meta"),
    )
    joined = objects.join(meta, keys, "left")
    wrong = differs(F.coalesce("meta_size", F.lit(-1)), F.col("size_bytes")) | differs(F.col("meta_sha256"), F.col("sha256"))
    return joined.withColumn(
        "reason", first_reason(("meta_missing", F.col("_meta").isNull()), ("meta_mismatch", wrong))
    ).drop("_meta")


def verify_objects(objects: DataFrame, observed: DataFrame) -> DataFrame:
    """Each manifest entry against the observed object, first failed check in fixed order.

    What the observer says of a file counts: a missing one was not seen, and one that could not be read
    or holds non-finite numbers fails at the place where the check met it.
    """
    if "reason" in observed.columns:
        observed = observed.where(~F.col("reason").eqNullSafe(F.lit("missing"))).withColumn("_says", F.col("reason"))
    else:
        observed = observed.withColumn("_says", F.lit(None).cast("string"))
    seen = observed.select(
        *OBJECT,
        *[F.col(name).alias(f"seen_{name}") for name in ("size_bytes", "sha256", "row_count", "schema_sha256", "content_sha256")],
        F.lit(True).alias("_seen"),
        "_says",
    )
    joined = objects.join(seen, OBJECT, "left")
    says = F.coalesce("_says", F.lit(""))
    business = F.col("kind").eqNullSafe(F.lit(BUSINESS_KIND))
    reason = first_reason(
        ("missing", F.col("_seen").isNull()),
        ("size", differs(F.col("seen_size_bytes"), F.col("size_bytes"))),
        ("sha256", differs(F.col("seen_sha256"), F.col("sha256"))),
        ("unreadable", says.startswith("unreadable")),
        ("rows", differs(F.col("seen_row_count"), F.coalesce("row_count", F.lit(0).cast("bigint")))),
        ("schema", differs(F.col("seen_schema_sha256"), F.col("schema_sha256"))),
        ("content_absent", business & (F.coalesce(F.length("content_sha256"), F.lit(0)) != 64)),
        ("non_finite", business & (says == "non_finite")),
        ("content", business & differs(F.col("seen_content_sha256"), F.col("content_sha256"))),
    )
    return joined.withColumn("reason", reason).drop("_seen", "_says")


def replica_object_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entries that make two manifests differ: ``only_left``, ``only_right`` or ``changed``."""
    facts = ["size_bytes", "sha256", "row_count"]
    tagged = left.select(*OBJECT, *facts, F.lit(True).alias("_left")).unionByName(
        right.select(*OBJECT, *facts, F.lit(False).alias("_left"))
    )

    def side(name: str, is_left: bool) -> Column:
        return F.max(F.when(F.col("_left") == is_left, F.col(name)))

    merged = tagged.groupBy(*OBJECT).agg(
        F.bool_or("_left").alias("in_left"),
        F.bool_or(~F.col("_left")).alias("in_right"),
        *[side(name, True).alias(f"left_{name}") for name in facts],
        *[side(name, False).alias(f"right_{name}") for name in facts],
    )
    changed = reduce(lambda a, b: a | b, [differs(F.col(f"left_{name}"), F.col(f"right_{name}")) for name in facts])
    kind = first_reason(("only_left", ~F.col("in_right")), ("only_right", ~F.col("in_left")), ("changed", changed))
    return merged.withColumn("difference", kind).where(F.col("difference").isNotNull()).drop("in_left", "in_right")


def select_source(manifests: DataFrame, preferred: str = PRIMARY_REPLICA) -> DataFrame:
    """The preferred replica's manifest if valid, else the first by name, with a fallback flag.

    ``manifests`` has one row per day and replica with ``reason`` NULL when valid; days without a
    valid one are absent. The pick is an aggregate, so it combines on the map side instead of sorting
    each day.
    """
    rank = F.struct((F.col("replica") != preferred).alias("other"), F.col("replica"))
    valid = F.col("reason").isNull()
    picked = manifests.groupBy(*DAY).agg(F.min_by(F.struct("replica", "raw_sha256"), F.when(valid, rank)).alias("pick"))
    return picked.where(F.col("pick").isNotNull()).select(
        *DAY,
        F.col("pick.replica").alias("replica"),
        F.col("pick.raw_sha256").alias("raw_sha256"),
        (F.col("pick.replica") != preferred).alias("fell_back"),
    )


def compatible_sources(manifests: DataFrame, preferred: str = PRIMARY_REPLICA) -> DataFrame:
    """Sources whose manifest equals the selected one, selected first; warns when another differs.

    Takes the rows of ``select_source``. The list per day is as long as there are replicas.
    """
    rank = F.struct((F.col("replica") != preferred).alias("other"), F.col("replica"), F.col("raw_sha256"))
    valid = F.col("reason").isNull()
    grouped = manifests.groupBy(*DAY).agg(F.array_sort(F.collect_list(F.when(valid, rank))).alias("ranked"))
    chosen = F.get("ranked", F.lit(0))
    equal = F.filter("ranked", lambda entry: entry["raw_sha256"] == chosen["raw_sha256"])
    return grouped.where(F.size("ranked") > 0).select(
        *DAY,
        chosen["replica"].alias("selected"),
        F.transform(equal, lambda entry: entry["replica"]).alias("sources"),
        ((F.size("ranked") > 1) & (F.size(equal) == 1)).alias("other_differs"),
    )


def two_replica_gate(manifests: DataFrame, require_both: bool = True) -> DataFrame:
    """Per day whether the manifests admit a transfer, and how many replicas failed to load.

    ``manifests`` has one row per day and replica with ``reason`` NULL when valid.
    """
    ok = F.col("reason").isNull()
    counted = manifests.groupBy(*DAY).agg(
        F.count_if(ok).alias("valid_replicas"),
        F.count_if(~ok).alias("warnings"),
        F.min(F.when(ok, F.col("raw_sha256"))).alias("_low"),
        F.max(F.when(ok, F.col("raw_sha256"))).alias("_high"),
    )
    rules = [("no_replica", F.col("valid_replicas") == 0)]
    if require_both:
        rules = [
            ("replica_missing", F.col("valid_replicas") != 2),
            ("replicas_differ", F.col("_low") != F.col("_high")),
        ]
    return counted.withColumn("reason", first_reason(*rules)).drop("_low", "_high")


def catch_up_days(available: DataFrame, markers: DataFrame, day: str | Column | None = None) -> DataFrame:
    """What a catch-up does with each available day: ``fetch``, ``already_verified`` or ``conflict``.

    ``available`` has DAY and ``manifest_sha256`` of the selected manifest; ``markers`` one row per
    local day with ``status`` and ``manifest_sha256``. ``day`` limits to one day (the reader prunes).
    """
    if day is not None:
        available = available.where(F.col("archive_date") == day)
    local = markers.select(
        *DAY, F.col("status").alias("_status"), F.col("manifest_sha256").alias("_local"), F.lit(True).alias("_there")
    )
    joined = available.join(local, DAY, "left")
    same = (F.col("_status") == "verified") & (F.col("_local") == F.col("manifest_sha256"))
    action = (
        F.when(F.col("_there").isNull(), F.lit("fetch"))
        .when(F.coalesce(same, F.lit(False)), F.lit("already_verified"))
        .otherwise(F.lit("conflict"))
    )
    return joined.select(*available.columns, action.alias("action"))


def days_to_fetch(available: DataFrame, markers: DataFrame) -> DataFrame:
    """Only the days without any local copy, as an anti join."""
    return available.join(markers.select(*DAY), DAY, "left_anti")
