"""The flows over frames: a dashboard of few days, a gate that needs both replicas, an audit of nothing."""

import hashlib

from pyspark.sql import functions as F

from daykeeper.contracts import DEFAULT_CONTRACTS, PRIMARY_REPLICA, SECONDARY_REPLICA
from daykeeper.plans.flows import audit, plan_fetch, scan_dashboard
from daykeeper.sources.documents import manifest_columns


def body(day, status="verified"):
    return (
        f'{{"archive_date":"{day}","contract_version":"{DEFAULT_CONTRACTS.manifest}","object_count":0,"objects":[],'
        f'"retention_delete_allowed":true,"row_count":0,"status":"{status}"}}'
    ).encode()


def documents(spark, *rows):
    """(collector, day, replica, status) as manifests with their declared digest and size."""
    made = [(c, d, r, bytearray(body(d, s)), hashlib.sha256(body(d, s)).hexdigest(), len(body(d, s))) for c, d, r, s in rows]
    columns = "collector STRING, archive_date STRING, replica STRING, raw BINARY, declared_sha256 STRING, declared_size BIGINT"
    return manifest_columns(spark.createDataFrame(made, columns))


FLAGS = "collector STRING, archive_date STRING, has_root BOOLEAN, has_staging BOOLEAN, has_marker BOOLEAN, marker_is_json BOOLEAN, marker_status STRING"
DAYS = "collector STRING, archive_date STRING"


def test_dashboard_shows_the_newest_days(spark):
    days = [f"2024-01-0{k}" for k in range(1, 6)]
    listed = [("a", r, f"x/collector=a/date={d}/manifest.json") for d in days for r in (PRIMARY_REPLICA, SECONDARY_REPLICA)]
    listed += [("b", PRIMARY_REPLICA, "x/collector=b/date=2024-01-01/manifest.json")]
    listing = spark.createDataFrame(listed, "collector STRING, replica STRING, key STRING")
    listing = listing.withColumn("key", F.regexp_replace("key", "^x/collector=[ab]", "archive/v3/collector=a"))
    local = spark.createDataFrame([("a", "2024-01-06", True, False, True, True, "verified")], FLAGS)
    found = documents(
        spark,
        *[("a", d, r, "verified") for d in days for r in (PRIMARY_REPLICA, SECONDARY_REPLICA) if (d, r) != (days[4], SECONDARY_REPLICA)],
    )
    shown = {(r["collector"], r["archive_date"]): r for r in scan_dashboard(listing, local, found, spark.createDataFrame([], DAYS), 3).collect()}
    assert sorted(shown) == [("a", "2024-01-04"), ("a", "2024-01-05"), ("a", "2024-01-06"), ("b", "2024-01-01")]
    assert shown["a", "2024-01-04"]["replicas_match"] and shown["a", "2024-01-05"]["r2_state"] == "error"
    assert shown["a", "2024-01-06"]["local_state"] == "verified" and shown["a", "2024-01-06"]["drive_state"] == "missing"


def test_fetch_needs_both_replicas_where_told(spark):
    found = documents(
        spark, ("a", "2024-01-01", PRIMARY_REPLICA, "verified"), ("a", "2024-01-01", SECONDARY_REPLICA, "verified"),
        ("a", "2024-01-02", PRIMARY_REPLICA, "verified"), ("a", "2024-01-02", SECONDARY_REPLICA, "pending"),
    )
    none = spark.createDataFrame([], f"{DAYS}, manifest_sha256 STRING, status STRING")
    existing = spark.createDataFrame([], f"{DAYS}, relative_key STRING, existing_bytes BIGINT")
    free = spark.createDataFrame([("a", 1)], "collector STRING, free_bytes BIGINT")
    for both, expected in ((True, "replica_missing"), (False, None)):
        plan = {r["archive_date"]: r for r in plan_fetch(found, none, existing, free, require_both=both).collect()}
        assert plan["2024-01-01"]["gate_reason"] is None and plan["2024-01-01"]["action"] == "fetch"
        assert (plan["2024-01-02"]["gate_reason"] is None) == (expected is None), plan
        assert plan["2024-01-02"]["replica"] == PRIMARY_REPLICA and plan["2024-01-02"]["warnings"] == 1


def test_audit_of_days_without_objects(spark):
    found = documents(spark, ("a", "2024-01-01", PRIMARY_REPLICA, "verified"), ("a", "2024-01-01", SECONDARY_REPLICA, "pending"), ("a", "2024-01-02", PRIMARY_REPLICA, "x"))
    observed = spark.createDataFrame(
        [], f"{DAYS}, relative_key STRING, size_bytes BIGINT, sha256 STRING, row_count BIGINT, schema_sha256 STRING, content_sha256 STRING"
    )
    (row,) = audit(found, observed, PRIMARY_REPLICA).collect()
    assert (row["archive_date"], row["status"], row["object_count"], row["replicas_match"]) == ("2024-01-01", "verified", 0, False)
