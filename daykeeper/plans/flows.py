"""The archive's three end-to-end flows over DataFrames, each one declarative plan for all collectors and days.

The flows take frames as the readers of ``sources`` give them, so they run on a real archive; the queries
below run them on the derived one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daykeeper.contracts import DEFAULT_CONTRACTS, Contracts
from daykeeper.functions import labels
from daykeeper.operators.listing import list_days, recent_days
from daykeeper.operators.manifests import manifest_objects, validate_manifests
from daykeeper.operators.reconcile import (
    DAY,
    OBJECT,
    catch_up_days,
    replica_match,
    select_source,
    two_replica_gate,
    verify_objects,
)
from daykeeper.operators.rollup import all_days, day_status, space_preflight, verify_days
from daykeeper.plans import views
from daykeeper.plans.catalog import chained, query, verdicts
from daykeeper.session import durable

#: Days shown of each collector; the archive's own setting is 45 unless its user says otherwise.
HISTORY_DAYS = 45


def audit(manifests: DataFrame, observed: DataFrame, replica: str, contracts: Contracts = DEFAULT_CONTRACTS) -> DataFrame:
    """One row per day of ``replica``'s valid manifests: the local copy's verdict, and whether the replicas agree.

    ``manifests``: rows of ``read_manifests`` with declared_sha256 and declared_size. ``observed``: rows of
    ``observe_objects`` of the local copy. They are judged once and kept, as three branches read them.
    """
    checked = durable(validate_manifests(manifests, contracts))
    own = checked.where((F.col("replica") == replica) & F.col("reason").isNull())
    days = own.select(
        *DAY,
        F.col("raw_sha256").alias("manifest_sha256"),
        F.col("object_count").cast("bigint").alias("object_count"),
        F.col("row_count").cast("bigint").alias("row_count"),
    )
    judged = verify_days(days, verify_objects(manifest_objects(own), observed))
    return agreed(judged, checked)


def agreed(judged: DataFrame, manifests: DataFrame) -> DataFrame:
    """Verdicts with the replicas' agreement beside them."""
    return judged.join(replica_match(manifests).select(*DAY, "replicas_match"), DAY, "left")


def scan_dashboard(
    listing: DataFrame,
    local: DataFrame,
    documents: DataFrame,
    receipts: DataFrame,
    history_days: int = HISTORY_DAYS,
    contracts: Contracts = DEFAULT_CONTRACTS,
) -> DataFrame:
    """The newest listed or local days of each collector with their states and labels.

    ``listing``: collector, replica, key of both replicas. ``local``: the flags of ``local_state``, has_root
    among them. ``documents``: manifests as ``read_manifests`` gives them. ``receipts``: ``receipt_chain``
    output. Days are found once and kept. What is shown is joined to the documents before they are
    validated: the optimizer would not move a limit below the manifest rules.
    """
    listed = list_days(listing, ["replica", "collector"])
    days = durable(all_days(listed, local.where("has_root").select(*DAY)))
    shown = recent_days(days, history_days)
    # At most ``history_days`` rows a collector.
    kept = durable(days.join(shown, DAY, "left_semi"))
    checked = validate_manifests(documents.join(kept.select(*DAY), DAY, "left_semi"), contracts)
    status = day_status(kept, checked, local, receipts)
    return status.select(
        *DAY, "drive_state", "r2_state", "local_state", "replicas_match", labels.day_severity().alias("severity")
    )


def plan_fetch(
    documents: DataFrame,
    markers: DataFrame,
    existing: DataFrame,
    free: DataFrame,
    require_both: bool = False,
    contracts: Contracts = DEFAULT_CONTRACTS,
) -> DataFrame:
    """What one catch-up run does per day: gate, source, action and space, over all collectors.

    ``documents``: manifests as ``read_manifests`` gives them, judged once and kept. ``markers``: local
    verification markers. ``existing``: OBJECT, existing_bytes of a partial copy. ``free``: collector,
    free_bytes. A day that the gate refuses has a gate_reason and is not to be fetched.
    """
    checked = durable(validate_manifests(documents, contracts))
    gate = two_replica_gate(checked, require_both=require_both).select(*DAY, "warnings", F.col("reason").alias("gate_reason"))
    chosen = select_source(checked)
    actions = catch_up_days(chosen.select(*DAY, "replica", F.col("raw_sha256").alias("manifest_sha256")), markers)
    entries = manifest_objects(checked.join(chosen.select(*DAY, "replica"), [*DAY, "replica"], "left_semi"))
    space = space_preflight(entries, existing, free).select(*DAY, "additional_bytes", "fits")
    return gate.join(actions, DAY, "left").join(space, DAY, "left").select(
        *DAY, "gate_reason", "warnings", "replica", "action", "additional_bytes", "fits"
    )


@query
def audit_days(spark: SparkSession, sf: str) -> DataFrame:
    """One row per day: verdict of the local copy and whether the replicas agree."""
    return agreed(verdicts(spark, sf), views.manifests(spark, sf))


@query
def dashboard_scan(spark: SparkSession, sf: str, history_days: int = HISTORY_DAYS) -> DataFrame:
    return scan_dashboard(
        views.listing(spark, sf), views.local_flags(spark, sf), views.manifests(spark, sf), chained(spark, sf), history_days
    )


@query
def fetch_plan(spark: SparkSession, sf: str) -> DataFrame:
    nothing = spark.createDataFrame([], "collector STRING, archive_date STRING, relative_key STRING, existing_bytes BIGINT")
    free = views.collector_days(spark, sf).groupBy("collector").agg((F.count(F.lit(1)) * 20_000_000).alias("free_bytes"))
    return plan_fetch(views.manifests(spark, sf), views.markers(spark, sf).where("dom % 5 <> 0"), nothing, free)


@query
def audit_valid_days(spark: SparkSession, sf: str) -> DataFrame:
    """The audit from the manifests' own entries, for days whose manifest is valid."""
    return audit(views.manifests(spark, sf), views.observed(spark, sf), views.PRIMARY_REPLICA)
