"""Queries over the documents of a removal: written as files, read back, and judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daykeeper.contracts import DEFAULT_CONTRACTS
from daykeeper.operators import digest, documents, evidence, listing
from daykeeper.operators.reconcile import DAY
from daykeeper.plans import catalog, views
from daykeeper.plans.catalog import query
from daykeeper.session import durable, scratch_path
from daykeeper.sources import documents as docs
from daykeeper.sources.folders import read_documents
from daykeeper.sources.large_documents import write_map_documents
from daykeeper.sources.named import write_named

MADE_AT = "2024-02-01T00:00:00Z"


def _stamp() -> Column:
    """The target as part of a file name."""
    return F.translate("target", "/=", "_-")


def delete_plans(spark, sf, targets: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """The heads of the delete plans, and what was written."""
    listed = catalog.r2_listing(spark, sf)
    plans = listing.removal_plan(listed, targets, "archive-bucket")
    heads = durable(documents.delete_plan_heads(plans, F.concat(F.lit("p-"), "collector"), F.lit(MADE_AT), _stamp()))
    entries = listing.removal_entries(listed, targets).withColumnRenamed("target", "removal")
    return heads, write_map_documents(heads, entries, ["collector", "removal"], root)


@query
def delete_plan_files(spark, sf):
    """Every delete plan as a file, with its whole map, read back."""
    root = scratch_path(spark, "delete-plans")
    _, written = delete_plans(spark, sf, catalog.removal_targets(spark, sf), root)
    files = read_documents(spark, root, "collector", "plan-r2-*.json")
    listed = F.map_keys(F.from_json(F.get_json_object(F.col("content").cast("string"), "$.expected_objects"), "map<string, bigint>"))
    read = files.select("collector", F.concat(F.lit("collector="), "collector", F.lit("/"), "name").alias("name"), F.sha2("content", 256).alias("read_sha256"), F.size(listed).cast("bigint").alias("listed"))
    return written.join(read, ["collector", "name"]).select("collector", F.col("removal").alias("path"), "entries", "total", "listed", "length", "file_sha256", "read_sha256", "reason")


@query
def delete_evidence(spark, sf):
    """Plan and receipt files of the folder targets whose removal is complete."""
    root = scratch_path(spark, "delete-evidence")
    targets = catalog.removal_targets(spark, sf).where("is_dir")
    heads, written = delete_plans(spark, sf, targets, root)
    receipts = catalog.removal_receipt(spark, sf)
    made = documents.delete_receipt_documents(receipts, heads, written, F.lit(MADE_AT), F.translate("path", "/=", "_-"))
    write_named(documents.documents_text(made), root)
    found = docs.read_reports(spark, root, prefix="receipt-r2-")
    value = lambda name, kind: F.try_variant_get("payload", f"$.{name}", kind).alias(name)
    return found.select(
        value("collector_id", "string"), value("path", "string"), value("deleted_objects", "bigint"), value("deleted_bytes", "bigint"), value("plan_sha256", "string"),
        F.sha2("raw", 256).alias("receipt_sha256"),
    )


def _keyed(found: DataFrame) -> DataFrame:
    """Evidence that was read, under the profile, collector and day it names."""
    own = {"doc_profile_id": F.col("profile_id"), "doc_collector_id": F.col("collector_id"), "doc_archive_date": F.col("archive_date")}
    return found.withColumn("collector", F.col("collector_id")).withColumns(own)


@query
def removal_evidence(spark, sf):
    """The two-phase removal of every eligible day over files: plan, checkpoint, receipt and marker are written,
    read back and judged in turn; one row per day whose chain holds, with the digests of its files."""
    root = scratch_path(spark, "removal-evidence")
    plans = catalog.cleanup_plan(spark, sf)
    # The manifests' digests are asked for in every phase: made once, as each time digests all events again.
    digests = durable(views.drive_digests(spark, sf))
    source = F.concat(F.lit("retention/"), "collector", F.lit("/"), "archive_date", F.lit(".json"))
    retention = evidence.check_retention(views.retention_of(digests)).withColumn("source_file", source)
    verified = digests.select(*DAY, F.concat("archive_date", F.lit("T06:00:00Z")).alias("verified_at"))
    made = documents.cleanup_plan_documents(plans, retention, verified, F.lit(MADE_AT), F.lit("1"))
    write_named(documents.documents_text(made), root)

    contracts = DEFAULT_CONTRACTS
    read = _keyed(docs.read_evidence(spark, root, "plan", prefix="plan-"))
    planned = durable(evidence.latest_valid_evidence(evidence.check_plan_identity(read, contracts.cleanup_plan, "ready"), evidence.PROFILE_DAY))
    now = durable(digests.join(digest.tree_digest(views.objects(spark, sf), DAY, "relative_key"), DAY))
    done = durable(evidence.receipt_chain(views.cleanup_markers(spark, sf), views.receipts_of(digests), views.markers_of(digests)))
    gone = lambda drive: planned.select(*DAY, F.lit(drive).alias("in_drive"), F.lit(False).alias("in_r2"))

    none = planned.limit(0).withColumn("plan_sha256", F.col("file_sha256"))
    first = evidence.cleanup_stage(planned, evidence.checkpoint_for_plan(planned, none), gone(True), now, done)
    made = documents.checkpoint_documents(first, planned, F.lit(" first copy removed "), F.lit(MADE_AT), F.lit("1"))
    write_named(documents.documents_text(made), root)

    read = _keyed(docs.read_evidence(spark, root, "checkpoint", prefix="checkpoint-r2-"))
    checkpoints = durable(evidence.check_plan_identity(read, contracts.cleanup_checkpoint, "r2_absence_verified"))
    second = evidence.cleanup_stage(planned, evidence.checkpoint_for_plan(planned, checkpoints), gone(False), now, done)
    made = documents.receipt_documents(second, planned, checkpoints, verified, F.lit("second copy removed"), F.lit(MADE_AT), F.lit("1"))
    write_named(documents.documents_text(made), root)

    receipts = durable(_keyed(docs.read_evidence(spark, root, "receipt", prefix="receipt-")))
    write_named(documents.documents_text(documents.marker_documents(receipts)), root)
    markers = _keyed(docs.read_evidence(spark, root, "cleanup_marker", "cleanup.json"))
    held = evidence.receipt_chain(markers, receipts, views.markers_of(digests))
    return (
        held.select(*DAY, F.col("file_name").alias("receipt_file"), F.col("file_sha256").alias("receipt_sha256"))
        .join(planned.select(*DAY, F.col("file_sha256").alias("plan_sha256")), DAY)
        .join(checkpoints.select(*DAY, F.col("file_sha256").alias("checkpoint_sha256")), DAY)
        .join(markers.select(*DAY, F.col("file_sha256").alias("marker_sha256")), DAY)
    )
