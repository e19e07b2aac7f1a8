"""The documents of a two-phase removal: plan, checkpoint, receipt and marker of a day; plan and receipt of a target.

Each function gives rows whose columns are the document's fields, nested as the contract has them, beside
``name`` (the file to write). ``documents_text`` makes the canonical JSON of such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daykeeper.contracts import DEFAULT_CONTRACTS, Contracts
from daykeeper.functions.canonical import canonical_json
from daykeeper.operators.evidence import PROFILE_DAY
from daykeeper.operators.reconcile import DAY

# Texts of the removal documents.
ENTRIES_NOTE = "Drive 数量包含每个对象及 manifest 的元数据 sidecar"
DELETION_MODE = "manual_provider_console"
PROVIDER = "r2"


def documents_text(rows: DataFrame) -> DataFrame:
    """name and content (canonical JSON of all other columns)."""
    return rows.select("name", canonical_json(rows, sorted(c for c in rows.columns if c != "name")).alias("content"))


def _place(kind: str, stamp: Column) -> Column:
    return F.concat(F.lit("collector="), F.col("collector"), F.lit(f"/{kind}-"), F.col("archive_date"), F.lit("-"), stamp, F.lit(".json"))


def _identity(contract: str, status: str) -> list[Column]:
    return [
        F.lit(contract).alias("contract_version"), F.lit(status).alias("status"), F.col("profile_id"),
        F.col("collector").alias("collector_id"), F.col("archive_date"),
    ]


def cleanup_plan_documents(plans: DataFrame, retention: DataFrame, verified: DataFrame, at: Column, stamp: Column, contracts: Contracts = DEFAULT_CONTRACTS) -> DataFrame:
    """The nested plan of every row of ``evidence.cleanup_plan``.

    ``retention``: DAY, source_file, file_sha256, status, dropped_at, partitions,
    verified_manifest_sha256. ``verified``: DAY, verified_at of the local copy. ``at`` is when the plan
    is made, ``stamp`` the part of its file name that tells it from others of the day.
    """
    proof = F.struct("source_file", "file_sha256", "status", "dropped_at", "partitions", "verified_manifest_sha256").alias("retention_evidence")
    joined = plans.drop("status", "dropped_at").join(retention.select(*DAY, proof), DAY).join(verified.select(*DAY, "verified_at"), DAY)
    return joined.select(
        _place("plan", stamp).alias("name"),
        *_identity(contracts.cleanup_plan, "ready"),
        "manifest_sha256", "object_count", "row_count", "parquet_bytes", "local_tree_sha256", F.col("verified_at").alias("local_verified_at"),
        "retention_evidence",
        F.struct(F.col("drive_target").alias("google_drive"), F.col("r2_target").alias("cloudflare_r2")).alias("targets"),
        F.struct(F.col("drive_entries").alias("google_drive"), F.col("r2_entries").alias("cloudflare_r2"), F.lit(ENTRIES_NOTE).alias("note")).alias("expected_remote_entries"),
        at.alias("generated_at"), F.lit(DELETION_MODE).alias("deletion_mode"), F.lit(True).alias("client_credentials_remain_read_only"),
    )


def checkpoint_documents(stages: DataFrame, plans: DataFrame, confirmation: Column, at: Column, stamp: Column, contracts: Contracts = DEFAULT_CONTRACTS) -> DataFrame:
    """A checkpoint for each day of ``evidence.cleanup_stage`` that stands at ``r2_absence_verified``.

    ``plans``: the plans that the stages were found for (PROFILE_DAY, file_name, manifest_sha256,
    local_tree_sha256). The plan is named and digested as it was read.
    """
    held = plans.select(*PROFILE_DAY, "file_name", "manifest_sha256", "local_tree_sha256")
    rows = stages.where(F.col("stage") == "r2_absence_verified").join(held, [*PROFILE_DAY, "file_name"])
    return rows.select(
        _place("checkpoint-r2", stamp).alias("name"),
        *_identity(contracts.cleanup_checkpoint, "r2_absence_verified"),
        "manifest_sha256", "local_tree_sha256", F.col("file_name").alias("plan_file"), "plan_sha256",
        F.lit(True).alias("cloudflare_r2_absent"), F.lit(True).alias("google_drive_still_present"),
        F.trim(confirmation).alias("operator_confirmation"), at.alias("verified_at"),
    )


def receipt_documents(
    stages: DataFrame, plans: DataFrame, checkpoints: DataFrame, verified: DataFrame, confirmation: Column, at: Column, stamp: Column, contracts: Contracts = DEFAULT_CONTRACTS
) -> DataFrame:
    """A receipt for each day that stands at ``completed``. ``checkpoints``: the documents read (PROFILE_DAY,
    file_name, file_sha256, operator_confirmation), of which the stage names one."""
    held = plans.select(*PROFILE_DAY, "file_name", "manifest_sha256", "local_tree_sha256")
    confirmed = checkpoints.select(
        *PROFILE_DAY, F.col("file_name").alias("checkpoint_file"), F.col("file_sha256").alias("r2_checkpoint_sha256"), F.col("operator_confirmation").alias("_first")
    )
    rows = stages.where(F.col("stage") == "completed").join(held, [*PROFILE_DAY, "file_name"]).join(confirmed, [*PROFILE_DAY, "checkpoint_file"])
    rows = rows.join(verified.select(*DAY, "verified_at"), DAY)
    return rows.select(
        _place("receipt", stamp).alias("name"),
        *_identity(contracts.cleanup_receipt, "completed"),
        "manifest_sha256", "local_tree_sha256", F.col("verified_at").alias("local_verified_at"),
        F.col("file_name").alias("plan_file"), "plan_sha256", F.col("checkpoint_file").alias("r2_checkpoint_file"), "r2_checkpoint_sha256",
        F.struct(F.lit(True).alias("google_drive"), F.lit(True).alias("cloudflare_r2"), at.alias("verified_at")).alias("remote_absence"),
        F.struct(F.col("_first").alias("cloudflare_r2"), F.trim(confirmation).alias("google_drive")).alias("operator_confirmations"),
        F.lit(True).alias("google_drive_trash_emptied_attested"), at.alias("completed_at"),
    )


def marker_documents(receipts: DataFrame, contracts: Contracts = DEFAULT_CONTRACTS) -> DataFrame:
    """The marker beside each receipt that was read (PROFILE_DAY, file_name, file_sha256, manifest_sha256,
    completed_at): it names the receipt's file and digest."""
    return receipts.select(
        F.concat(F.lit("collector="), F.col("collector"), F.lit("/date="), F.col("archive_date"), F.lit("/cleanup.json")).alias("name"),
        *_identity(contracts.cleanup_marker, "completed"),
        "manifest_sha256", F.col("file_name").alias("receipt_file"), F.col("file_sha256").alias("receipt_sha256"), "completed_at",
    )


def delete_plan_heads(plans: DataFrame, profile_id: Column, at: Column, stamp: Column, contracts: Contracts = DEFAULT_CONTRACTS) -> DataFrame:
    """What the plan of each target says beside its map, for rows of ``listing.removal_plan`` without a reason.

    Beside the fields: collector and removal, the keys under which ``write_map_documents`` finds the
    entries, and the name.
    """
    return plans.where(F.col("reason").isNull()).select(
        "collector", F.col("target").alias("removal"),
        F.concat(F.lit("collector="), F.col("collector"), F.lit("/plan-r2-"), stamp, F.lit(".json")).alias("name"),
        F.lit(contracts.file_delete_plan).alias("contract_version"), F.lit("awaiting_confirmation").alias("status"),
        profile_id.alias("profile_id"), F.col("collector").alias("collector_id"), F.lit(PROVIDER).alias("provider"),
        F.col("target").alias("path"), "is_dir", "object_count", "total_bytes", F.col("uri").alias("target"), at.alias("generated_at"),
    )


def delete_receipt_documents(receipts: DataFrame, plans: DataFrame, written: DataFrame, at: Column, stamp: Column, contracts: Contracts = DEFAULT_CONTRACTS) -> DataFrame:
    """The receipt of each target whose removal is ``completed`` (``evidence.removal_receipt``).

    ``plans``: ``delete_plan_heads``; ``written``: what ``write_map_documents`` says of their files.
    """
    done = receipts.where(F.col("status") == "completed").select("collector", F.col("target").alias("removal"), "deleted_objects", "deleted_bytes")
    files = written.select("collector", "removal", F.element_at(F.split("name", "/"), -1).alias("plan_file"), F.col("file_sha256").alias("plan_sha256"))
    rows = plans.drop("contract_version", "status").join(done, ["collector", "removal"]).join(files, ["collector", "removal"])
    return rows.select(
        F.concat(F.lit("collector="), F.col("collector"), F.lit("/receipt-r2-"), stamp, F.lit(".json")).alias("name"),
        F.lit(contracts.file_delete_receipt).alias("contract_version"), F.lit("completed").alias("status"),
        "profile_id", "collector_id", "provider", "path", "is_dir", "deleted_objects", "deleted_bytes", "target", "plan_file", "plan_sha256", at.alias("completed_at"),
    )
