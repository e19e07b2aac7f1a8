"""Queries over what is kept between runs: content trees, listing snapshots, local manifests, transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daykeeper.contracts import PRIMARY_REPLICA, SECONDARY_REPLICA
from daykeeper.functions.digests import sha256
from daykeeper.operators import content_tree, evidence, rollup, telemetry
from daykeeper.operators.reconcile import DAY
from daykeeper.plans import catalog, views
from daykeeper.plans.catalog import joined, query
from daykeeper.session import scratch_path
from daykeeper.sources import snapshots

SIDES = (PRIMARY_REPLICA, SECONDARY_REPLICA)


@query
def content_difference(spark, sf):
    """Archived rows that one replica has and the other has not, by descent through both replicas' trees.

    Fewer folders than by default: the given tables are small, and folders only bound what is opened.
    """
    root = scratch_path(spark, "trees")
    trees = [
        content_tree.write_content_tree(views.event_rows(spark, sf, side), DAY, ["event_id"], f"{root}/{side}", leaves=32, shards=8)
        for side in SIDES
    ]
    return content_tree.content_difference(spark, *trees)


@query
def snapshot_drift(spark, sf):
    """``listing_drift`` of both replicas' listings, each stored in buckets and compared without a shuffle."""
    root, listed = scratch_path(spark, "snapshots"), views.listing(spark, sf)
    held = [
        snapshots.write_snapshot(listed.where(F.col("replica") == side), f"{root}/{side}", ["collector"], buckets=16) for side in SIDES
    ]
    return snapshots.snapshot_drift(held[0], held[1], ["collector"])


def local_documents(spark, sf) -> DataFrame:
    """The local manifest's bytes: those of the first replica, cut on days % 8, absent on days % 21."""
    raw = F.col("raw")
    cut = F.when(F.col("dom") % 8 == 0, F.substring(raw, F.lit(1), F.octet_length(raw) - 1)).otherwise(raw)
    days = views.as_documents(views.manifest_bodies(spark, sf, PRIMARY_REPLICA)).where("dom % 21 <> 0")
    return days.select(*DAY, cut.alias("raw"))


@views.shared
def held_locally(spark, sf):
    return evidence.local_snapshots(evidence.check_marker(views.markers(spark, sf)), local_documents(spark, sf))


@query
def local_snapshots(spark, sf):
    return held_locally(spark, sf)


@query
def removal_eligibility_local(spark, sf):
    """Eligibility with the local manifest's bytes read and judged by its marker."""
    return evidence.removal_eligibility(
        catalog.validated(spark, sf),
        evidence.check_retention(views.retention(spark, sf)),
        evidence.check_marker(views.markers(spark, sf)),
        catalog.verdicts(spark, sf),
        catalog.chained(spark, sf),
        held_locally(spark, sf),
    )


def object_attempts(spark, sf) -> DataFrame:
    """Up to two attempts for every object of days that are not divisible by 5."""
    held = views.objects(spark, sf).where("dom % 5 <> 0").withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    first: Column = F.col("attempt") == 1
    other = F.col("row_count") % 7 == 0
    ok = F.when(first, F.col("row_count") % 3 != 0).otherwise(F.lit(True))
    return held.select(
        *DAY,
        F.col("relative_key").alias("object_pos"),
        "relative_key",
        "attempt",
        F.when(first != other, F.lit(SECONDARY_REPLICA)).otherwise(F.lit(PRIMARY_REPLICA)).alias("source"),
        ok.alias("ok"),
        F.when(~ok, F.lit("timeout")).alias("error"),
        (F.col("size_bytes") * F.col("attempt")).alias("network_bytes"),
    )


@query
def transfer_report(spark, sf):
    """The verification report with what its run copied."""
    report = rollup.verification_report(
        catalog.verdicts(spark, sf),
        catalog.verified(spark, sf),
        views.manifests(spark, sf),
        transfers=telemetry.transfer_rollup(object_attempts(spark, sf)),
        verified_at=F.concat("archive_date", F.lit("T03:04:05Z")),
    )
    lists = {name: joined(F.col(name)) for name in ("download_sources_attempted", "download_sources_completed")}
    keys = F.transform("objects", lambda o: F.concat_ws(":", o["relative_key"], o["row_count"].cast("string")))
    return report.withColumns(lists).withColumn("objects", sha256(joined(keys)))
