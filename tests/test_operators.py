"""Reconciliation, listing, evidence and telemetry operators against brute force."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from daykeeper.contracts import Contracts
from daykeeper.functions.dates import utc_yesterday
from daykeeper.operators import evidence, listing, reconcile, rollup, telemetry
from daykeeper.operators.scans import chunked_running

OBJECT = "collector STRING, archive_date STRING, relative_key STRING, kind STRING, size_bytes BIGINT, sha256 STRING, row_count BIGINT, schema_sha256 STRING, content_sha256 STRING"
X, Y = "x" * 64, "y" * 64


def test_object_checks_come_in_order(spark):
    manifest = [("c", "d", name, kind, 1, "s", 2, "t", content) for name, kind, content in [
        ("missing", "raw", None), ("size", "raw", None), ("sha256", "raw", None), ("rows", "raw", None), ("schema", "raw", None),
        ("content_absent", "business", None), ("content", "business", X), ("fine", "business", X), ("fine raw", "raw", None)]]
    seen = {"size": (9, "?", 9, "?", Y), "sha256": (1, "?", 9, "?", Y), "rows": (1, "s", 9, "?", Y), "schema": (1, "s", 2, "?", Y),
            "content_absent": (1, "s", 2, "t", Y), "content": (1, "s", 2, "t", Y), "fine": (1, "s", 2, "t", X), "fine raw": (1, "s", 2, "t", Y)}
    observed = [("c", "d", name, "?", *facts) for name, facts in seen.items()]
    verified = reconcile.verify_objects(spark.createDataFrame(manifest, OBJECT), spark.createDataFrame(observed, OBJECT))
    got = {r["relative_key"]: r["reason"] for r in verified.collect()}
    assert got == {name: None if name.startswith("fine") else name for name in [row[2] for row in manifest]}


def test_days_without_objects_are_verified(spark):
    manifests = spark.createDataFrame([("c", "empty", "m", 0, 0), ("c", "short", "m", 1, 0)],
                                      "collector STRING, archive_date STRING, manifest_sha256 STRING, object_count BIGINT, row_count BIGINT")
    none = reconcile.verify_objects(spark.createDataFrame([], OBJECT + ", pos BIGINT"), spark.createDataFrame([], OBJECT))
    got = {r["archive_date"]: (r["status"], r["reason"], r["tree_sha256"]) for r in rollup.verify_days(manifests, none).collect()}
    assert got["empty"] == ("verified", None, rollup.EMPTY_TREE_SHA256)
    assert got["short"] == ("failed", "object_total", None)


MANIFEST = "collector STRING, archive_date STRING, replica STRING, raw_sha256 STRING, reason STRING"


def test_replicas_match_has_three_values(spark):
    df = spark.createDataFrame([("c", "1", "google_drive", "a", None), ("c", "1", "r2", "a", None), ("c", "2", "google_drive", "a", None),
                                ("c", "2", "r2", "b", None), ("c", "3", "r2", "b", None)], MANIFEST)
    assert {r["archive_date"]: r["replicas_match"] for r in reconcile.replica_match(df).collect()} == {"1": True, "2": False, "3": None}


def test_sources_and_gate(spark):
    df = spark.createDataFrame([
        ("c", "same", "google_drive", "a", None), ("c", "same", "r2", "a", None),
        ("c", "differ", "google_drive", "a", None), ("c", "differ", "r2", "b", None),
        ("c", "one", "google_drive", "a", "size"), ("c", "one", "r2", "b", None),
        ("c", "none", "google_drive", "a", "size"), ("c", "none", "r2", "b", "status")], MANIFEST)
    picked = {r["archive_date"]: (r["replica"], r["fell_back"]) for r in reconcile.select_source(df).collect()}
    assert picked == {"same": ("google_drive", False), "differ": ("google_drive", False), "one": ("r2", True)}
    sources = {r["archive_date"]: (r["sources"], r["other_differs"]) for r in reconcile.compatible_sources(df, "r2").collect()}
    assert sources == {"same": (["r2", "google_drive"], False), "differ": (["r2"], True), "one": (["r2"], False)}
    strict = {r["archive_date"]: r["reason"] for r in reconcile.two_replica_gate(df).collect()}
    assert strict == {"same": None, "differ": "replicas_differ", "one": "replica_missing", "none": "replica_missing"}
    relaxed = {r["archive_date"]: (r["reason"], r["warnings"]) for r in reconcile.two_replica_gate(df, False).collect()}
    assert relaxed == {"same": (None, 0), "differ": (None, 0), "one": (None, 1), "none": ("no_replica", 2)}


KEYS = "collector STRING, replica STRING, key STRING, size_bytes BIGINT, modified TIMESTAMP"
ROOT = "archive/v3/collector=a/"


def listed(spark, sizes):
    return spark.createDataFrame([("a", "r2", ROOT + key, size, None) for key, size in sizes.items()], KEYS)


def test_only_direct_children_are_listed(spark):
    df = listed(spark, {"date=2026-08-02/manifest.json": 100, "date=2026-08-03/manifest.json": 110, "Root-note.txt": 12, "a.txt": 3})
    got = [(r["name"], r["is_dir"], r["size_bytes"]) for r in listing.browse(df, ROOT).collect()]
    assert got == [("date=2026-08-02", True, 0), ("date=2026-08-03", True, 0), ("a.txt", False, 3), ("Root-note.txt", False, 12)]


def targets(spark, *rows):
    return spark.createDataFrame([("a", ROOT + path, is_dir) for path, is_dir in rows], "collector STRING, target STRING, is_dir BOOLEAN")


def test_file_removal_spares_its_sibling(spark):
    df = listed(spark, {"date=2026-08-02/manifest.json": 100, "date=2026-08-02/manifest.json.acme-metadata.json": 40})
    entries = listing.removal_entries(df, targets(spark, ("date=2026-08-02/manifest.json", False))).collect()
    assert [(r["key"], r["size_bytes"]) for r in entries] == [(ROOT + "date=2026-08-02/manifest.json", 100)]


def test_directory_removal_keeps_to_its_prefix_and_writes_plan_and_receipt(spark):
    df = listed(spark, {"date=2026-08-02/manifest.json": 100, "date=2026-08-02/business/data.parquet": 200, "date=2026-08-020/manifest.json": 300})
    wanted = targets(spark, ("date=2026-08-02", True), ("date=2026-08-09", True))
    plan = {r["target"][-2:]: (r["object_count"], r["total_bytes"], r["uri"], r["reason"]) for r in listing.removal_plan(df, wanted, "b").collect()}
    assert plan["02"] == (2, 300, f"s3://b/{ROOT}date=2026-08-02/", None)
    assert plan["09"][0] == 0 and plan["09"][3] == "empty"
    entries = listing.removal_entries(df, wanted)
    document = listing.removal_documents(entries, ["target"]).first()["expected_objects"]
    assert document == {ROOT + "date=2026-08-02/manifest.json": 100, ROOT + "date=2026-08-02/business/data.parquet": 200}
    many = spark.range(100_001).selectExpr("'t' AS target", "concat('t/', id) AS key", "id AS size_bytes")
    assert len(listing.removal_documents(many, ["target"]).first()["expected_objects"]) == 100_001
    receipt = evidence.removal_receipt(wanted.where("target LIKE '%-02'"), entries, entries, entries.where("false"), ["collector", "target"]).first()
    assert (receipt["status"], receipt["deleted_objects"], receipt["deleted_bytes"]) == ("completed", 2, 300)


def test_twice_listed_or_negative_objects_spoil_the_plan(spark):
    df = listed(spark, {"date=1/a": 1, "date=2/a": -1, "date=3/a": 1})
    df = df.unionByName(df.where("key LIKE '%date=3%'"))
    wanted = targets(spark, ("date=1", True), ("date=2/", True), ("date=3", True))
    plan = {r["target"][-1]: (r["reason"], r["object_count"]) for r in listing.removal_plan(df, wanted, "b").collect()}
    assert plan == {"1": (None, 1), "2": ("invalid_object", 1), "3": ("invalid_object", 1)}


def test_days_of_a_failed_listing_are_errors(spark):
    days = spark.createDataFrame([("a", "d", True, False, True), ("b", "d", False, False, True)],
                                 "collector STRING, archive_date STRING, in_drive BOOLEAN, in_r2 BOOLEAN, in_local BOOLEAN")
    manifests = spark.createDataFrame([("a", "d", "google_drive", "m", None)], MANIFEST)
    local = spark.createDataFrame([("a", "d", True, False, True, True, "verified"), ("b", "d", True, False, True, False, None)],
                                  "collector STRING, archive_date STRING, has_root BOOLEAN, has_staging BOOLEAN, has_marker BOOLEAN, marker_is_json BOOLEAN, marker_status STRING")
    receipts = spark.createDataFrame([("b", "d")], "collector STRING, archive_date STRING")
    down = spark.createDataFrame([("a", "r2")], "collector STRING, replica STRING")
    got = {r["collector"]: tuple(r)[2:] for r in rollup.day_status(days, manifests, local, receipts, down).collect()}
    assert got == {"a": ("verified", "error", "verified", None), "b": ("cleaned", "cleaned", "unverified", None)}


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Los_Angeles"])
def test_yesterday_is_utc_in_any_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        allowed = {(datetime.now(timezone.utc) - timedelta(days=1)).date().isoformat()}
        got = spark.range(1).select(utc_yesterday().alias("d")).first()["d"]
        allowed.add((datetime.now(timezone.utc) - timedelta(days=1)).date().isoformat())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got in allowed


def test_change_after_the_plan_blocks(spark):
    wanted = targets(spark, ("date=2026-08-02", True))
    planned = listing.removal_entries(listed(spark, {"date=2026-08-02/manifest.json": 100}), wanted)
    now = listing.removal_entries(listed(spark, {"date=2026-08-02/manifest.json": 100, "date=2026-08-02/new.parquet": 200}), wanted)
    drift = listing.listing_drift(planned, now, ["collector", "target"]).collect()
    assert [(r["key"], r["drift"]) for r in drift] == [(ROOT + "date=2026-08-02/new.parquet", "added")]
    receipt = evidence.removal_receipt(wanted, planned, now, now.where("false"), ["collector", "target"]).first()
    assert (receipt["status"], receipt["reason"], receipt["deleted_objects"]) == ("blocked", "drift", None)
    assert listing.listing_drift(planned, planned, ["collector"]).count() == 0


def test_batches_match_a_plain_sort_when_one_group_holds_most_keys(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"g{i % 4}", f"k{rng.random():.17f}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g STRING, key STRING")
    got = {(r["g"], r["key"]): r["batch"] for r in listing.removal_batches(df, ["g"], 100).collect()}
    want = {}
    for group in {g for g, _ in rows}:
        for rank, key in enumerate(sorted(k for g, k in rows if g == group)):
            want[(group, key)] = rank // 100
    assert got == want


def test_recent_days_drop_invalid_ones_before_the_limit(spark):
    df = spark.createDataFrame([("a", d) for d in ["2024-02-30", "2024-01-03", "2024-01-01", "2024-01-02", "2024-01-03"]], "collector STRING, archive_date STRING")
    assert sorted(r["archive_date"] for r in listing.recent_days(df, 2).collect()) == ["2024-01-02", "2024-01-03"]
    assert [r["archive_date"] for r in listing.invalid_days(df).collect()] == ["2024-02-30"]


def test_first_seen_treats_null_keys_as_equal(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", 3), (None, 4)], "k STRING, pos INT")
    assert {r["pos"]: r["repeated"] for r in rollup.first_seen_flag(df, ["k"]).collect()} == {1: False, 2: False, 3: True, 4: True}


def test_outcome_needs_a_result(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("c", None)], "run STRING, success BOOLEAN")
    assert {r["run"]: r["success"] for r in rollup.run_outcome(df, ["run"]).collect()} == {"a": False, "b": True, "c": False}
    assert rollup.run_outcome(df.where("false"), []).first()["success"] is False


C = Contracts("acme")
IDENTITY = ("p", "a", "d", "p", "a", "d")
ID_SCHEMA = "profile_id STRING, collector STRING, archive_date STRING, doc_profile_id STRING, doc_collector_id STRING, doc_archive_date STRING"


@pytest.mark.parametrize("broken", [None, "marker contract", "marker status", "marker day", "file name", "digest", "receipt contract", "receipt status", "profile", "local digest", "no local"])
def test_receipt_chain_breaks_at_every_link(spark, broken):
    m = [*IDENTITY, C.cleanup_marker, "completed", "receipt-d.json", "h1"]
    r = [*IDENTITY, C.cleanup_receipt, "completed", "m1", "receipt-d.json", "h1"]
    local = [("a", "d", "m1")]
    if broken == "marker contract":
        m[6] = "x"
    elif broken == "marker status":
        m[7] = "open"
    elif broken == "marker day":
        m[5] = "e"
    elif broken == "file name":
        m[8] = r[9] = "../receipt-d.json"
    elif broken == "digest":
        m[9] = "h2"
    elif broken == "receipt contract":
        r[6] = C.cleanup_plan
    elif broken == "receipt status":
        r[7] = None
    elif broken == "profile":
        r[3] = "q"
    elif broken == "local digest":
        local = [("a", "d", "m2")]
    elif broken == "no local":
        local = []
    chain = evidence.receipt_chain(
        spark.createDataFrame([tuple(m)], ID_SCHEMA + ", contract_version STRING, status STRING, receipt_file STRING, receipt_sha256 STRING"),
        spark.createDataFrame([tuple(r)], ID_SCHEMA + ", contract_version STRING, status STRING, manifest_sha256 STRING, file_name STRING, file_sha256 STRING"),
        spark.createDataFrame(local, "collector STRING, archive_date STRING, manifest_sha256 STRING"), C)
    assert chain.count() == (1 if broken is None else 0)


@pytest.mark.parametrize("stage,checkpoint,drive,r2,manifest,tree,done", [
    ("stage1_blocked", None, True, True, "m", "t", False), ("order_violation", None, False, False, "m", "t", False),
    ("r2_absence_verified", None, True, False, "m", "t", False), ("r2_reappeared", "c", True, True, "m", "t", False),
    ("stage2_blocked", "c", True, False, "m", "t", False), ("completed", "c", False, False, "m", "t", False),
    ("local_manifest_differs", "c", False, False, "x", "t", False), ("local_tree_differs", "c", False, False, "m", "x", False),
    ("already_cleaned", "c", False, False, "x", "x", True)])
def test_cleanup_stages(spark, stage, checkpoint, drive, r2, manifest, tree, done):
    day = "profile_id STRING, collector STRING, archive_date STRING"
    plans = spark.createDataFrame([("p", "a", "d", "plan.json", "h", "m", "t")], day + ", file_name STRING, file_sha256 STRING, manifest_sha256 STRING, local_tree_sha256 STRING")
    bound = spark.createDataFrame([("p", "a", "d", "plan.json", "h", checkpoint, None)], day + ", plan_file STRING, plan_sha256 STRING, checkpoint_file STRING, checkpoint_sha256 STRING")
    days = spark.createDataFrame([("a", "d", drive, r2)], "collector STRING, archive_date STRING, in_drive BOOLEAN, in_r2 BOOLEAN")
    local = spark.createDataFrame([("a", "d", manifest, tree)], "collector STRING, archive_date STRING, manifest_sha256 STRING, tree_sha256 STRING")
    receipts = spark.createDataFrame([("a", "d")] if done else [], "collector STRING, archive_date STRING")
    assert evidence.cleanup_stage(plans, bound, days, local, receipts).first()["stage"] == stage


def updates(seed: int, count: int):
    """Progress rows of three transfers, one with most of them, with bursts, gaps and decreases."""
    rng = random.Random(seed)
    at = {t: datetime(2024, 1, 1) for t in (1, 2, 3)}
    moved = dict.fromkeys(at, 0)
    rows = []
    for seq in range(count):
        t = 1 if rng.random() < 0.8 else rng.choice([2, 3])
        at[t] += timedelta(milliseconds=rng.choice([30, 90, 150, 399, 400, 900, 5000]))
        moved[t] = max(moved[t] + rng.choice([0, 500, 4000, -3000]), 0)
        stage = "switching" if rng.random() < 0.02 else "downloading"
        rows.append((t, f"o{rng.randrange(3)}", seq, at[t], moved[t], 20_000, rng.random() < 0.01, stage, 10_000 - moved[t]))
    return rows


PROGRESS = "transfer_id BIGINT, object_name STRING, seq BIGINT, ts TIMESTAMP_NTZ, bytes BIGINT, object_total BIGINT, completed BOOLEAN, stage STRING, remaining_bytes BIGINT"


def test_high_water_matches_a_plain_loop(spark):
    rows = updates(1, 1500)
    totals = spark.createDataFrame([(t, 20_000 * 5) for t in (1, 2, 3)], "transfer_id BIGINT, bytes_total BIGINT")
    got = {r["seq"]: (r["object_bytes"], r["bytes_completed"], r["overall"]) for r in telemetry.transfer_high_water(
        spark.createDataFrame(rows, PROGRESS).repartition(5), totals, chunk_seconds=60).collect()}
    held: dict = {}
    for t, name, seq, ts, moved, total, completed, *_ in sorted(rows, key=lambda row: (row[3], row[2])):
        high = max(held.get((t, name), 0), min(max(moved, 0), total))
        held[(t, name)] = total if completed else high
        whole = 20_000 * 5
        done = min(sum(v for (tt, _), v in held.items() if tt == t), whole)
        assert got[seq] == (held[(t, name)], done, int(done / whole * 7000))


def test_one_object_of_three_is_a_third(spark):
    entries = spark.createDataFrame([(1, 50), (1, 50), (1, 50), (2, 0)], "transfer_id BIGINT, size_bytes BIGINT")
    at = datetime(2024, 1, 1)
    rows = [(1, "a", 1, at, 50, 50, True, "downloading", 0), (2, "z", 2, at, 0, 0, False, "downloading", 0), (3, "n", 3, at, 5, 9, False, "downloading", 0)]
    out = telemetry.transfer_high_water(spark.createDataFrame(rows, PROGRESS), telemetry.planned_bytes(entries)).collect()
    assert {r["transfer_id"]: (r["bytes_completed"], r["bytes_total"], r["overall"]) for r in out} == {1: (50, 150, 2333), 2: (0, 0, 7000), 3: (None, None, None)}


def plain_speed(rows):
    out = {}
    for transfer in {row[0] for row in rows}:
        at = base = speed = None
        for _, _, seq, ts, moved, _, _, stage, _ in sorted((r for r in rows if r[0] == transfer), key=lambda r: (r[3], r[2])):
            if stage == "switching":
                at = speed = None
            elif at is None or moved < base:
                at, base = ts, moved
            elif (elapsed := (ts - at).total_seconds()) >= 0.4:
                if moved > base:
                    inst = (moved - base) / elapsed
                    speed = inst if speed is None else speed * 0.7 + inst * 0.3
                at, base = ts, moved
            out[seq] = speed
    return out


@pytest.mark.parametrize("switches", [True, False])
def test_speed_matches_a_plain_loop(spark, switches):
    rows = updates(2, 2000)
    if not switches:
        rows = [(*row[:7], "downloading", row[8]) for row in rows]
    df = spark.createDataFrame(rows, PROGRESS).withColumnRenamed("bytes", "network_bytes").repartition(6)
    got = {r["seq"]: (r["speed"], r["eta_seconds"]) for r in telemetry.transfer_speed(df, chunk_seconds=60).collect()}
    want = plain_speed(rows)
    remaining = {row[2]: row[8] for row in rows}
    assert got.keys() == want.keys()
    for seq, speed in want.items():
        if speed is None:
            assert got[seq] == (None, None)
        else:
            assert got[seq][0] == pytest.approx(speed, rel=1e-9)
            assert got[seq][1] == pytest.approx(max(remaining[seq], 0) / speed, rel=1e-9)


@pytest.mark.parametrize("kind", ["max", "sum", "last"])
def test_chunked_running_matches_a_plain_loop(spark, kind):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "b"]), i, i // 50, rng.choice([None, rng.randrange(100)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k STRING, at INT, chunk INT, v INT").repartition(5)
    got = {r["at"]: (r["out"], r["out_before"]) for r in chunked_running(df, ["k"], "chunk", ["at"], {"out": (kind, F.col("v"))}).collect()}
    held: dict = {}
    for key, at, _, value in rows:
        before = held.get(key)
        if value is not None:
            held[key] = value if before is None or kind == "last" else max(before, value) if kind == "max" else before + value
        assert got[at] == (held.get(key), before)


def test_fallback_and_rollup(spark):
    rows = [
        ("c", "d", 1, "o1", 1, "google_drive", True, None, 10), ("c", "d", 1, "o1", 2, "r2", True, None, 99),
        ("c", "d", 2, "o2", 1, "google_drive", False, "slow", 3), ("c", "d", 2, "o2", 2, "r2", True, None, 20),
        ("c", "e", 1, "o3", 1, "r2", False, "gone", 1), ("c", "e", 1, "o3", 2, "google_drive", False, "gone", 2)]
    df = spark.createDataFrame(rows, "collector STRING, archive_date STRING, object_pos INT, relative_key STRING, attempt INT, source STRING, ok BOOLEAN, error STRING, network_bytes BIGINT")
    done = {r["relative_key"]: (r["source"], r["attempted"], r["network_bytes"], r["status"]) for r in telemetry.object_source_fallback(df).collect()}
    assert done == {"o1": ("google_drive", ["google_drive"], 10, "completed"), "o2": ("r2", ["google_drive", "r2"], 23, "completed"),
                    "o3": (None, ["r2", "google_drive"], 3, "failed")}
    warnings = [(r["relative_key"], r["source"], r["fallback"]) for r in telemetry.fallback_warnings(df).orderBy("relative_key").collect()]
    assert warnings == [("o2", "google_drive", "r2"), ("o3", "r2", "google_drive")]
    days = {r["archive_date"]: r for r in telemetry.transfer_rollup(df).collect()}
    assert days["d"]["active_source"] == "mixed" and days["d"]["sources_attempted"] == ["google_drive", "r2"] and days["d"]["network_bytes"] == 33
    assert days["e"]["failed_objects"] == 1 and days["e"]["sources_completed"] is None
