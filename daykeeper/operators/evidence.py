"""Evidence documents and the decision tables that gate a removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daykeeper.contracts import DEFAULT_CONTRACTS, Contracts
from daykeeper.functions.rules import Rule, differs, first_reason
from daykeeper.operators.manifests import validate_manifests
from daykeeper.operators.reconcile import DAY
from daykeeper.sources.documents import manifest_columns

PROFILE_DAY = ["profile_id", "collector", "archive_date"]


def marker_rules(contracts: Contracts = DEFAULT_CONTRACTS, day: str = "archive_date") -> list[Rule]:
    """Local verification marker: contract, status, day."""
    return [
        ("contract", differs(F.col("contract_version"), F.lit(contracts.verification))),
        ("status", differs(F.col("status"), F.lit("verified"))),
        ("date", differs(F.col("doc_archive_date"), F.col(day))),
    ]


def retention_rules(contracts: Contracts = DEFAULT_CONTRACTS, day: str = "archive_date") -> list[Rule]:
    """Retention evidence: contract, dropped, day, a drop time, a partition list."""
    return [
        ("contract", differs(F.col("contract_version"), F.lit(contracts.retention))),
        ("status", differs(F.col("status"), F.lit("dropped"))),
        ("date", differs(F.col("doc_archive_date"), F.col(day))),
        ("dropped_at", F.coalesce("dropped_at", F.lit("")) == ""),
        ("partitions", F.col("partitions").isNull()),
    ]


def identity_rules(contract: str, status: str) -> list[Rule]:
    """Plan, checkpoint or receipt of the expected contract, status, profile, collector and day."""
    return [
        ("contract", differs(F.col("contract_version"), F.lit(contract))),
        ("status", differs(F.col("status"), F.lit(status))),
        ("profile", differs(F.col("doc_profile_id"), F.col("profile_id"))),
        ("collector", differs(F.col("doc_collector_id"), F.col("collector"))),
        ("date", differs(F.col("doc_archive_date"), F.col("archive_date"))),
    ]


def check_marker(markers: DataFrame, contracts: Contracts = DEFAULT_CONTRACTS) -> DataFrame:
    return markers.withColumn("reason", first_reason(*marker_rules(contracts)))


def check_retention(retention: DataFrame, contracts: Contracts = DEFAULT_CONTRACTS) -> DataFrame:
    return retention.withColumn("reason", first_reason(*retention_rules(contracts)))


def check_plan_identity(documents: DataFrame, contract: str, status: str) -> DataFrame:
    return documents.withColumn("reason", first_reason(*identity_rules(contract, status)))


def latest_valid_evidence(documents: DataFrame, keys: list[str]) -> DataFrame:
    """The newest document by file name among those without a reason.

    An aggregate, so the pick combines on the map side whatever the number of old documents.
    """
    payload = [name for name in documents.columns if name not in keys]
    valid = documents.where(F.col("reason").isNull())
    picked = valid.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col("file_name")).alias("_pick"))
    return picked.select(*keys, "_pick.*")


def checkpoint_for_plan(plans: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The newest valid checkpoint bound to each plan by the plan's file digest.

    Both sides have PROFILE_DAY; a plan without checkpoint keeps NULLs.
    """
    valid = checkpoints.where(F.col("reason").isNull()).select(
        *PROFILE_DAY, "plan_sha256", F.col("file_name").alias("checkpoint_file"), F.col("file_sha256").alias("checkpoint_sha256")
    )
    newest = valid.groupBy(*PROFILE_DAY, "plan_sha256").agg(
        F.max("checkpoint_file").alias("checkpoint_file"),
        F.max_by("checkpoint_sha256", "checkpoint_file").alias("checkpoint_sha256"),
    )
    bound = plans.select(*PROFILE_DAY, F.col("file_name").alias("plan_file"), F.col("file_sha256").alias("plan_sha256"))
    return bound.join(newest, [*PROFILE_DAY, "plan_sha256"], "left")


def receipt_chain(
    cleanup_markers: DataFrame, receipts: DataFrame, local_markers: DataFrame, contracts: Contracts = DEFAULT_CONTRACTS
) -> DataFrame:
    """Days whose cleanup marker and receipt agree in every link; a broken chain is absent.

    ``cleanup_markers``: PROFILE_DAY of the folder, document identity (doc_*), contract_version,
    status, receipt_file, receipt_sha256. ``receipts``: PROFILE_DAY, document identity, file_name,
    file_sha256, contract_version, status, manifest_sha256. ``local_markers``: DAY, manifest_sha256.
    """

    def own(doc: str) -> Column:
        return (
            (F.col("doc_profile_id") == F.col("profile_id"))
            & (F.col("doc_collector_id") == F.col("collector"))
            & (F.col("doc_archive_date") == F.col("archive_date"))
            & (F.col("contract_version") == doc)
            & (F.col("status") == "completed")
        )

    name = F.col("receipt_file")
    bare = (F.coalesce(name, F.lit("")) != "") & ~F.contains(name, F.lit("/")) & ~F.contains(name, F.lit("\\"))
    markers = cleanup_markers.where(own(contracts.cleanup_marker) & bare & (name != "..")).select(
        *PROFILE_DAY, F.col("receipt_file").alias("file_name"), F.col("receipt_sha256").alias("file_sha256")
    )
    good = receipts.where(own(contracts.cleanup_receipt)).select(*PROFILE_DAY, "file_name", "file_sha256", "manifest_sha256")
    chained = good.join(markers, [*PROFILE_DAY, "file_name", "file_sha256"], "left_semi")
    local = local_markers.select(*DAY, "manifest_sha256")
    return chained.join(local, [*DAY, "manifest_sha256"], "left_semi")


def removal_eligibility(
    manifests: DataFrame,
    retention: DataFrame,
    local_markers: DataFrame,
    verdicts: DataFrame,
    receipts: DataFrame,
    snapshots: DataFrame | None = None,
) -> DataFrame:
    """First reason per day why its remote copies may not be planned for removal, or NULL.

    ``manifests``: validated rows of both replicas. ``retention`` and ``local_markers``: checked rows
    (``reason``), one per day. ``verdicts``: verify_days output. ``receipts``: receipt_chain output.
    With ``snapshots`` (``local_snapshots`` output) the local manifest's bytes must also pass: a day
    without one, or with one that its marker does not describe, is blocked.
    """
    valid = F.col("reason").isNull()
    pairs = manifests.groupBy(*DAY).agg(
        F.count_if(valid).alias("_valid"),
        F.min(F.when(valid, F.col("raw_sha256"))).alias("_low"),
        F.max(F.when(valid, F.col("raw_sha256"))).alias("_high"),
    )
    kept = retention.select(
        *DAY,
        F.lit(True).alias("_retained"),
        F.col("reason").alias("_retention_reason"),
        F.col("verified_manifest_sha256").alias("_retention_sha"),
    )
    local = local_markers.select(
        *DAY,
        F.lit(True).alias("_local"),
        F.col("reason").alias("_local_reason"),
        F.col("manifest_sha256").alias("_local_sha"),
    )
    passed = verdicts.select(*DAY, F.col("status").alias("_verdict"))
    done = receipts.select(*DAY).distinct().withColumn("_done", F.lit(True))
    joined = pairs.join(kept, DAY, "left").join(local, DAY, "left").join(passed, DAY, "left").join(done, DAY, "left")
    read: list[Rule] = []
    if snapshots is not None:
        seen = snapshots.select(*DAY, F.lit(True).alias("_read"), F.col("reason").alias("_read_reason"))
        joined = joined.join(seen, DAY, "left")
        broken = F.col("_read").isNull() | F.col("_read_reason").isNotNull()
        read = [("local_manifest", broken)]
    reason = first_reason(
        ("already_cleaned", F.col("_done").isNotNull()),
        ("retention_missing", F.col("_retained").isNull()),
        ("retention_invalid", F.col("_retention_reason").isNotNull()),
        ("replicas_differ", (F.col("_valid") != 2) | differs(F.col("_low"), F.col("_high"))),
        ("retention_digest", differs(F.col("_retention_sha"), F.col("_low"))),
        ("local_marker", F.col("_local").isNull() | F.col("_local_reason").isNotNull()),
        *read,
        ("local_differs", differs(F.col("_local_sha"), F.col("_low"))),
        ("verification_failed", differs(F.col("_verdict"), F.lit("verified"))),
    )
    return joined.select(*DAY, F.col("_low").alias("manifest_sha256"), reason.alias("reason"))


def local_snapshots(markers: DataFrame, documents: DataFrame, contracts: Contracts = DEFAULT_CONTRACTS) -> DataFrame:
    """The local manifest of each marked day, judged by its marker: DAY, manifest_sha256, reason.

    ``markers``: rows of ``check_marker``, one per day. ``documents``: DAY and the bytes ``raw`` of the local
    manifest, at most one per day. The marker's own reason comes first, then a manifest that cannot be
    read, then the manifest's rules, with the marker's digest as the declared one.
    """
    said = markers.select(*DAY, F.col("manifest_sha256").alias("declared_sha256"), F.col("reason").alias("_marker"))
    found = said.join(documents.select(*DAY, "raw"), DAY, "left")
    held = found.withColumns({"replica": F.lit("local"), "declared_size": F.octet_length("raw").cast("bigint")})
    judged = validate_manifests(manifest_columns(held), contracts)
    reason = F.coalesce(
        F.when(F.col("_marker").isNotNull(), F.concat(F.lit("marker_"), "_marker")),
        F.when(F.col("raw").isNull(), F.lit("unreadable")),
        F.col("reason"),
    )
    return judged.select(*DAY, F.col("raw_sha256").alias("manifest_sha256"), reason.alias("reason"))


def cleanup_plan(
    eligible: DataFrame,
    totals: DataFrame,
    verdicts: DataFrame,
    retention: DataFrame,
    profile_id: Column,
    drive_root: str,
    bucket_root: str,
    contracts: Contracts = DEFAULT_CONTRACTS,
) -> DataFrame:
    """The removal plan of each eligible day: counts, tree digest, targets and expected entries.

    ``totals``: manifest_totals of one replica. ``drive_root`` and ``bucket_root`` are URIs that end
    before ``/collector=``.
    """
    days = eligible.where(F.col("reason").isNull()).drop("reason")
    sums = totals.select(*DAY, "entries", "entry_rows", "entry_bytes")
    trees = verdicts.select(*DAY, F.col("tree_sha256").alias("local_tree_sha256"))
    kept = retention.select(*DAY, F.col("file_sha256").alias("retention_sha256"), "dropped_at")
    joined = days.join(sums, DAY).join(trees, DAY).join(kept, DAY)
    place = F.concat(F.lit("/collector="), F.col("collector"), F.lit("/date="), F.col("archive_date"))
    return joined.select(
        *DAY,
        F.lit(contracts.cleanup_plan).alias("contract_version"),
        F.lit("ready").alias("status"),
        profile_id.alias("profile_id"),
        "manifest_sha256",
        F.col("entries").alias("object_count"),
        F.col("entry_rows").alias("row_count"),
        F.col("entry_bytes").alias("parquet_bytes"),
        "local_tree_sha256",
        "retention_sha256",
        "dropped_at",
        F.concat(F.lit(drive_root), place).alias("drive_target"),
        F.concat(F.lit(bucket_root), place, F.lit("/")).alias("r2_target"),
        (2 * (F.col("entries") + 1)).alias("drive_entries"),
        (F.col("entries") + 1).alias("r2_entries"),
    )


def cleanup_stage(plans: DataFrame, checkpoints: DataFrame, days: DataFrame, local: DataFrame, receipts: DataFrame) -> DataFrame:
    """Where each planned removal stands, first matching stage.

    ``plans``: PROFILE_DAY, file_name, file_sha256, manifest_sha256, local_tree_sha256.
    ``checkpoints``: checkpoint_for_plan output. ``days``: all_days output. ``local``: DAY,
    manifest_sha256, tree_sha256 of the local copy verified now. ``receipts``: receipt_chain output.
    """
    bound = checkpoints.select(*PROFILE_DAY, "plan_sha256", "checkpoint_file")
    now = local.select(*DAY, F.col("manifest_sha256").alias("_manifest"), F.col("tree_sha256").alias("_tree"))
    seen = days.select(*DAY, "in_drive", "in_r2")
    done = receipts.select(*DAY).distinct().withColumn("_done", F.lit(True))
    joined = (
        plans.withColumnRenamed("file_sha256", "plan_sha256")
        .join(bound, [*PROFILE_DAY, "plan_sha256"], "left")
        .join(now, DAY, "left")
        .join(seen, DAY, "left")
        .join(done, DAY, "left")
    )
    drive, r2 = F.coalesce("in_drive", F.lit(False)), F.coalesce("in_r2", F.lit(False))
    checked = F.col("checkpoint_file").isNotNull()
    stage = (
        F.when(F.col("_done").isNotNull(), F.lit("already_cleaned"))
        .when(differs(F.col("_manifest"), F.col("manifest_sha256")), F.lit("local_manifest_differs"))
        .when(differs(F.col("_tree"), F.col("local_tree_sha256")), F.lit("local_tree_differs"))
        .when(~checked & r2, F.lit("stage1_blocked"))
        .when(~checked & ~drive, F.lit("order_violation"))
        .when(~checked, F.lit("r2_absence_verified"))
        .when(r2, F.lit("r2_reappeared"))
        .when(drive, F.lit("stage2_blocked"))
        .otherwise(F.lit("completed"))
    )
    return joined.select(*PROFILE_DAY, "file_name", "plan_sha256", "checkpoint_file", stage.alias("stage"))


def removal_receipt(
    plan: DataFrame, planned: DataFrame, before: DataFrame, after: DataFrame, keys: list[str]
) -> DataFrame:
    """Receipt per plan: deleted objects and bytes when nothing drifted and nothing remains.

    ``plan``: keys. ``planned``: the plan's entries, ``before``: entries listed right before the
    removal, ``after``: entries still listed; all with keys, key, size_bytes.
    """
    from daykeeper.operators.listing import listing_drift

    drift = listing_drift(planned, before, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_drift"))
    sums = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("_objects"), F.sum("size_bytes").alias("_bytes"))
    left = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("_left"))
    joined = plan.select(*keys).join(drift, keys, "left").join(sums, keys, "left").join(left, keys, "left")
    reason = first_reason(
        ("empty", F.col("_objects").isNull()),
        ("drift", F.col("_drift").isNotNull()),
        ("remaining", F.col("_left").isNotNull()),
    )
    return joined.select(
        *keys,
        F.when(reason.isNull(), F.lit("completed")).otherwise(F.lit("blocked")).alias("status"),
        reason.alias("reason"),
        F.when(reason.isNull(), F.col("_objects")).alias("deleted_objects"),
        F.when(reason.isNull(), F.col("_bytes")).alias("deleted_bytes"),
    )
