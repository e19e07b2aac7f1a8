"""Day verdicts, coverage figures, usage and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daykeeper.contracts import (
    DEFAULT_CONTRACTS,
    FREE_ALLOWANCE_BYTES,
    PRIMARY_REPLICA,
    SECONDARY_REPLICA,
    SPACE_RESERVE_BYTES,
    Contracts,
)
from daykeeper.functions.labels import local_state
from daykeeper.functions.rules import first_reason
from daykeeper.operators.digest import EMPTY_TREE_SHA256, tree_digest
from daykeeper.operators.reconcile import DAY, replica_match


def zero(value: Column | str) -> Column:
    return F.coalesce(value, F.lit(0).cast("bigint"))


def verify_days(manifests: DataFrame, verified: DataFrame) -> DataFrame:
    """Rolls object verdicts up to days; days without objects stay.

    ``manifests``: DAY, manifest_sha256, object_count, row_count. ``verified``: verify_objects output.
    """
    failed = F.col("reason").isNotNull()
    rolled = verified.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("_objects"),
        F.sum("seen_row_count").alias("_rows"),
        F.count_if(failed).alias("_failed"),
        F.min_by(F.when(failed, F.col("reason")), F.when(failed, F.col("pos"))).alias("_first"),
    )
    trees = tree_digest(verified, DAY)
    joined = manifests.join(rolled, DAY, "left").join(trees, DAY, "left")
    reason = F.coalesce(
        "_first",
        first_reason(
            ("object_total", zero("_objects") != F.col("object_count")),
            ("row_total", zero("_rows") != F.col("row_count")),
        ),
    )
    return joined.select(
        *DAY,
        "manifest_sha256",
        zero("_objects").alias("object_count"),
        zero("_rows").alias("row_count"),
        zero("_failed").alias("failed_objects"),
        reason.alias("reason"),
        F.when(reason.isNull(), F.lit("verified")).otherwise(F.lit("failed")).alias("status"),
        F.when(reason.isNull(), F.coalesce("tree_sha256", F.lit(EMPTY_TREE_SHA256))).alias("tree_sha256"),
    )


def all_days(listed: DataFrame, local: DataFrame) -> DataFrame:
    """Union of days over replicas and local folders with presence flags.

    ``listed``: collector, replica, archive_date. ``local``: collector, archive_date.
    """
    tagged = listed.select(*DAY, "replica").unionByName(local.select(*DAY, F.lit("local").alias("replica")))

    def present(name: str) -> Column:
        return F.bool_or(F.col("replica") == name)

    return tagged.groupBy(*DAY).agg(
        present(PRIMARY_REPLICA).alias("in_drive"),
        present(SECONDARY_REPLICA).alias("in_r2"),
        present("local").alias("in_local"),
    )


def day_status(
    days: DataFrame,
    manifests: DataFrame,
    local: DataFrame,
    receipts: DataFrame,
    source_errors: DataFrame | None = None,
) -> DataFrame:
    """One row per day: state per replica and local, and whether the replicas match.

    ``days``: all_days output. ``manifests``: validated, ``reason`` NULL when fine. ``local``: the
    flags of ``local_state``. ``receipts``: days with a valid receipt chain. ``source_errors``:
    collector, replica of listings that failed.
    """
    valid = F.col("reason").isNull()

    def of(replica: str, value: Column) -> Column:
        return F.max(F.when(F.col("replica") == replica, value))

    verdicts = manifests.groupBy(*DAY).agg(
        of(PRIMARY_REPLICA, valid).alias("_drive_ok"),
        of(SECONDARY_REPLICA, valid).alias("_r2_ok"),
        of(PRIMARY_REPLICA, F.when(valid, F.col("raw_sha256"))).alias("_drive_sha"),
        of(SECONDARY_REPLICA, F.when(valid, F.col("raw_sha256"))).alias("_r2_sha"),
    )
    base = (
        days.join(verdicts, DAY, "left")
        .join(local, DAY, "left")
        .join(receipts.select(*DAY).distinct().withColumn("_cleaned", F.lit(True)), DAY, "left")
    )
    if source_errors is None:
        base = base.withColumns({"_drive_down": F.lit(None).cast("boolean"), "_r2_down": F.lit(None).cast("boolean")})
    else:
        down = source_errors.groupBy("collector").agg(
            F.bool_or(F.col("replica") == PRIMARY_REPLICA).alias("_drive_down"),
            F.bool_or(F.col("replica") == SECONDARY_REPLICA).alias("_r2_down"),
        )
        base = base.join(down, "collector", "left")

    def state(present: str, ok: str, is_down: str) -> Column:
        return (
            F.when(F.coalesce(is_down, F.lit(False)), F.lit("error"))
            .when(~F.col(present) & F.coalesce("_cleaned", F.lit(False)), F.lit("cleaned"))
            .when(~F.col(present), F.lit("missing"))
            .when(F.coalesce(ok, F.lit(False)), F.lit("verified"))
            .otherwise(F.lit("error"))
        )

    drive, r2 = state("in_drive", "_drive_ok", "_drive_down"), state("in_r2", "_r2_ok", "_r2_down")
    both = (drive == "verified") & (r2 == "verified")
    return base.select(
        *DAY,
        drive.alias("drive_state"),
        r2.alias("r2_state"),
        local_state().alias("local_state"),
        F.when(both, F.col("_drive_sha") == F.col("_r2_sha")).alias("replicas_match"),
    )


def storage_usage(listing: DataFrame, prefix: str) -> DataFrame:
    """Objects and bytes in total and below ``prefix`` per collector-independent bucket, one pass."""
    below = F.startswith(F.col("key"), F.lit(prefix.rstrip("/") + "/"))
    size = zero("size_bytes")
    return listing.groupBy("provider").agg(
        F.count(F.lit(1)).alias("bucket_objects"),
        F.sum(size).alias("bucket_bytes"),
        F.count_if(below).alias("archive_objects"),
        zero(F.sum(F.when(below, size))).alias("archive_bytes"),
        F.count_if(size < 0).alias("negative_sizes"),
    )


def account_usage(accounts: DataFrame) -> DataFrame:
    """Account figures with NULL as zero and a reason when one is negative."""
    names = ["total_bytes", "used_bytes", "free_bytes", "trashed_bytes"]
    cleaned = accounts.withColumns({name: zero(name) for name in names})
    return cleaned.withColumn("reason", first_reason(("negative", F.least(*names) < 0)))


def check_usage(listing: DataFrame) -> DataFrame:
    """Negative sizes per provider."""
    bad = F.count_if(F.col("size_bytes") < 0)
    return listing.groupBy("provider").agg(
        bad.alias("negative_sizes"), F.when(bad > 0, F.lit("negative_size")).alias("reason")
    )


def capacity_percent(used: Column, total: Column) -> Column:
    share = F.least(used / total * 100.0, F.lit(100.0))
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(share)


def dashboard_metrics(status: DataFrame, usage: DataFrame, allowance: int = FREE_ALLOWANCE_BYTES) -> DataFrame:
    """Verified days per replica and local, matched days, and capacity per collector.

    ``usage``: collector, drive_used, drive_total, r2_used, local_used, local_total (of the local disk).
    """
    counted = status.groupBy("collector").agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("drive_state") == "verified").alias("drive_days"),
        F.count_if(F.col("r2_state") == "verified").alias("r2_days"),
        F.count_if(F.col("local_state") == "verified").alias("local_days"),
        F.count_if(F.coalesce("replicas_match", F.lit(False))).alias("matched_days"),
    )
    return counted.join(usage, "collector", "left").select(
        *counted.columns,
        capacity_percent(zero("drive_used"), F.col("drive_total")).alias("drive_percent"),
        capacity_percent(zero("r2_used"), F.lit(allowance).cast("bigint")).alias("r2_percent"),
        capacity_percent(zero("local_used"), F.col("local_total")).alias("local_percent"),
    )


def batch_summary(requested: DataFrame, results: DataFrame) -> DataFrame:
    """Requested, new, existing and failed days and bytes per batch.

    ``requested``: batch_id, archive_date. ``results``: batch_id, archive_date, status, bytes, error.
    """
    asked = requested.groupBy("batch_id").agg(F.count(F.lit(1)).alias("requested"))
    ok = F.col("error").isNull()
    done = results.groupBy("batch_id").agg(
        F.count_if(ok & (F.col("status") != "already_verified")).alias("newly_verified"),
        F.count_if(ok & (F.col("status") == "already_verified")).alias("already_verified"),
        F.count_if(~ok).alias("failed"),
        zero(F.sum(F.when(ok, F.col("bytes")))).alias("bytes"),
    )
    names = [name for name in done.columns if name != "batch_id"]
    return asked.join(done, "batch_id", "left").select("batch_id", "requested", *[zero(n).alias(n) for n in names])


def run_outcome(results: DataFrame, keys: list[str]) -> DataFrame:
    """Success means at least one result and no failed one."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("results"),
        (F.coalesce(F.bool_and("success"), F.lit(False)) & (F.count(F.lit(1)) > 0)).alias("success"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated keys with their count; counts combine on the map side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def first_seen_flag(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Adds ``repeated``: false on the first occurrence of a key, true on later ones.

    The first position is an aggregate that combines on the map side, so a key with very many copies
    is not sorted in one task; AQE splits the join if its rows gather.
    """
    named = [F.col(key).alias(f"_key{i}") for i, key in enumerate(keys)]
    first = df.groupBy(*named).agg(F.min(pos).alias("_first"))
    same = [F.col(key).eqNullSafe(F.col(f"_key{i}")) for i, key in enumerate(keys)]
    return df.join(first, same, "left").select(*df.columns, (F.col(pos) > F.col("_first")).alias("repeated"))


def expected_entries(totals: DataFrame, listed: DataFrame) -> DataFrame:
    """Expected remote entries per day against the listing.

    With sidecars a replica holds two entries per object and manifest, without it holds one.
    ``listed``: DAY, replica, entries.
    """
    want = F.when(F.col("replica") == PRIMARY_REPLICA, 2 * (F.col("entries") + 1)).otherwise(F.col("entries") + 1)
    seen = listed.select(*DAY, "replica", F.col("entries").alias("listed_entries"))
    joined = totals.select(*DAY, "replica", want.alias("expected_entries")).join(seen, [*DAY, "replica"], "left")
    return joined.withColumn("listed_entries", zero("listed_entries")).withColumn(
        "complete", F.col("expected_entries") == F.col("listed_entries")
    )


def space_preflight(
    objects: DataFrame, existing: DataFrame, free: DataFrame, days: DataFrame | None = None
) -> DataFrame:
    """Bytes still needed per day plus the fixed reserve, against the free bytes of the collector.

    ``existing``: collector, archive_date, relative_key, existing_bytes. ``free``: collector, free_bytes.
    ``days`` (collector, archive_date of the manifests) keeps days without objects: they need nothing.
    """
    here = existing.groupBy(*DAY, "relative_key").agg(F.sum("existing_bytes").alias("_have"))
    need = objects.join(here, [*DAY, "relative_key"], "left").groupBy(*DAY).agg(
        F.sum(F.greatest(F.col("size_bytes") - zero("_have"), F.lit(0).cast("bigint"))).alias("additional_bytes")
    )
    if days is not None:
        need = days.select(*DAY).distinct().join(need, DAY, "left").select(*DAY, zero("additional_bytes").alias("additional_bytes"))
    reserve = F.when(F.col("additional_bytes") > 0, F.lit(SPACE_RESERVE_BYTES)).otherwise(F.lit(0)).cast("bigint")
    return (
        need.withColumn("reserve_bytes", reserve)
        .join(free, "collector", "left")
        .withColumn("fits", F.col("free_bytes") >= F.col("additional_bytes") + F.col("reserve_bytes"))
    )


def verification_report(
    days: DataFrame,
    verified: DataFrame,
    manifests: DataFrame,
    contracts: Contracts = DEFAULT_CONTRACTS,
    transfers: DataFrame | None = None,
    verified_at: Column | None = None,
) -> DataFrame:
    """The report of each verified day: header, replica digests and the object list.

    With ``transfers`` (``transfer_rollup`` output) also what the run copied: the source, or ``mixed``, the
    sources tried and those that gave an object, and the bytes moved; a day of which nothing was copied
    has a NULL source, empty lists and no bytes. With ``verified_at`` the time of the check.

    ``replicas_match`` is false, not NULL, when a replica is absent. The object list of a day is as
    long as its manifest, which is one document.
    """
    entry = F.struct(
        F.col("pos"),
        F.struct(
            "relative_key",
            "kind",
            "table_name",
            "size_bytes",
            "sha256",
            F.col("seen_row_count").alias("row_count"),
            F.col("seen_schema_sha256").alias("schema_sha256"),
            F.when(F.col("kind") == "business", F.col("seen_content_sha256")).alias("content_sha256"),
        ).alias("item"),
    )
    lists = verified.groupBy(*DAY).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["item"]).alias("objects")
    )
    # A verified day without objects has an empty list, as its manifest has.
    nothing = F.filter(F.array(F.col("objects")[0]), lambda _: F.lit(False))
    match = replica_match(manifests)
    passed = days.where(F.col("status") == "verified")
    report = (
        passed.join(lists, DAY, "left")
        .join(match, DAY, "left")
        .select(
            *DAY,
            F.lit(contracts.verification).alias("contract_version"),
            "status",
            "manifest_sha256",
            "object_count",
            "row_count",
            "tree_sha256",
            F.lit(False).alias("retention_delete_allowed"),
            F.col("left_sha256").alias("drive_manifest_sha256"),
            F.col("right_sha256").alias("r2_manifest_sha256"),
            F.coalesce("replicas_match", F.lit(False)).alias("replicas_match"),
            F.coalesce("objects", nothing).alias("objects"),
        )
    )
    if verified_at is not None:
        report = report.withColumn("verified_at", verified_at)
    if transfers is None:
        return report
    none = F.array().cast("array<string>")
    moved = transfers.select(
        *DAY,
        F.col("active_source").alias("download_replica"),
        F.col("sources_attempted").alias("download_sources_attempted"),
        F.col("sources_completed").alias("download_sources_completed"),
        F.col("network_bytes").alias("downloaded_bytes_this_run"),
    )
    return report.join(moved, DAY, "left").withColumns(
        {
            "download_sources_attempted": F.coalesce("download_sources_attempted", none),
            "download_sources_completed": F.coalesce("download_sources_completed", none),
            "downloaded_bytes_this_run": F.coalesce("downloaded_bytes_this_run", F.lit(0).cast("bigint")),
        }
    )
