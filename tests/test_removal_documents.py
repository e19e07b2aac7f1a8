"""Removal documents as files: maps of any size, and the chain of plan, checkpoint, receipt and marker."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from daykeeper.contracts import Contracts
from daykeeper.operators import documents, evidence
from daykeeper.sources.large_documents import map_segments, write_map_documents


def heads_of(spark, rows):
    return spark.createDataFrame(rows, "collector STRING, removal STRING, name STRING, status STRING, is_dir BOOLEAN, a STRING")


def test_maps_are_written_in_parts_and_read_back_equal(spark, tmp_path):
    maps = {("a", "big"): {f"k/{n:05}é\"\\{chr(n % 32)}": n for n in range(5_000)}, ("a", "one"): {"x": 7}, ("b", "big"): {f"z{n}": 0 for n in range(300)}, ("b", "none"): {}}
    heads = heads_of(spark, [(c, r, f"collector={c}/{r}.json", "ok", True, 'q"') for c, r in maps])
    entries = spark.createDataFrame([(c, r, k, v) for (c, r), m in maps.items() for k, v in m.items()], "collector STRING, removal STRING, key STRING, size_bytes BIGINT").repartition(5)
    pieces = map_segments(entries, ["collector", "removal"], str(tmp_path / "parts"), together=700)
    assert max(r["count"] for r in pieces.groupBy("document").count().collect()) >= 4 and pieces.agg(F.max("entries")).first()[0] < 3_000
    for together in (700, 10**6):
        got = {(r["collector"], r["removal"]): r for r in write_map_documents(heads, entries, ["collector", "removal"], str(tmp_path / str(together)), together=together).collect()}
        for (c, r), held in maps.items():
            raw = (tmp_path / str(together) / f"collector={c}/{r}.json").read_bytes()
            want = {"a": 'q"', "expected_objects": held, "is_dir": True, "status": "ok"}
            assert raw.decode() == json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            row = got[c, r]
            assert (row["file_sha256"], row["length"], row["entries"], row["total"], row["reason"]) == (hashlib.sha256(raw).hexdigest(), len(raw), len(held), sum(held.values()), None)
    assert not [p for p in tmp_path.rglob("*.tmp")]


def test_a_target_of_a_million_keys(spark, tmp_path):
    entries = spark.range(1_000_000).select(F.lit("a").alias("collector"), F.lit("t").alias("removal"), F.concat(F.lit("key/"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("key"), (F.col("id") % 10).alias("size_bytes"))
    row = write_map_documents(heads_of(spark, [("a", "t", "big.json", "ok", True, "")]), entries, ["collector", "removal"], str(tmp_path), together=100_000).first()
    raw = (tmp_path / "big.json").read_bytes()
    held = json.loads(raw)["expected_objects"]
    assert len(held) == 1_000_000 and list(held) == sorted(held) and held["key/0000019"] == 9
    assert (row["file_sha256"], row["total"]) == (hashlib.sha256(raw).hexdigest(), 4_500_000)


def test_a_key_listed_twice_gives_no_document(spark, tmp_path):
    entries = spark.createDataFrame([("a", "t", "x", 1), ("a", "t", "x", 2), ("a", "u", "y", 1)], "collector STRING, removal STRING, key STRING, size_bytes BIGINT")
    heads = heads_of(spark, [("a", "t", "t.json", "ok", True, ""), ("a", "u", "u.json", "ok", True, "")])
    got = {r["removal"]: (r["reason"], r["file_sha256"] is None) for r in write_map_documents(heads, entries, ["collector", "removal"], str(tmp_path)).collect()}
    assert got == {"t": ("duplicate", True), "u": (None, False)} and not (tmp_path / "t.json").exists() and (tmp_path / "u.json").exists()
    assert write_map_documents(heads.limit(0), entries.limit(0), ["collector", "removal"], str(tmp_path)).count() == 0


def test_removal_document_fields(spark):
    names = Contracts("acme")
    day = "profile_id STRING, collector STRING, archive_date STRING"
    plans = spark.createDataFrame([("p", "a", "2024-01-02", "plan-x.json", "s", "m", "t")], f"{day}, file_name STRING, file_sha256 STRING, manifest_sha256 STRING, local_tree_sha256 STRING")
    stage = lambda name, checkpoint: spark.createDataFrame([("p", "a", "2024-01-02", "plan-x.json", "s", checkpoint, name)], f"{day}, file_name STRING, plan_sha256 STRING, checkpoint_file STRING, stage STRING")
    made = documents.checkpoint_documents(stage("r2_absence_verified", None), plans, F.lit(" yes "), F.lit("now"), F.lit("7"), names)
    row = documents.documents_text(made).first()
    assert row["name"] == "collector=a/checkpoint-r2-2024-01-02-7.json"
    assert json.loads(row["content"]) == {
        "archive_date": "2024-01-02", "cloudflare_r2_absent": True, "collector_id": "a", "contract_version": "acme-windows-cloud-cleanup-checkpoint/v1", "google_drive_still_present": True, "local_tree_sha256": "t",
        "manifest_sha256": "m", "operator_confirmation": "yes", "plan_file": "plan-x.json", "plan_sha256": "s", "profile_id": "p", "status": "r2_absence_verified", "verified_at": "now",
    }
    for name in ("stage1_blocked", "order_violation", "completed", "local_tree_differs"):
        assert documents.checkpoint_documents(stage(name, None), plans, F.lit(""), F.lit(""), F.lit(""), names).count() == 0
    checkpoints = spark.createDataFrame([("p", "a", "2024-01-02", "c.json", "cs", "yes"), ("p", "a", "2024-01-02", "old.json", "os", "no")], f"{day}, file_name STRING, file_sha256 STRING, operator_confirmation STRING")
    verified = spark.createDataFrame([("a", "2024-01-02", "v")], "collector STRING, archive_date STRING, verified_at STRING")
    receipt = json.loads(documents.documents_text(documents.receipt_documents(stage("completed", "c.json"), plans, checkpoints, verified, F.lit("also "), F.lit("now"), F.lit("8"), names)).first()["content"])
    assert receipt["operator_confirmations"] == {"cloudflare_r2": "yes", "google_drive": "also"} and receipt["remote_absence"] == {"google_drive": True, "cloudflare_r2": True, "verified_at": "now"}
    assert (receipt["r2_checkpoint_file"], receipt["r2_checkpoint_sha256"], receipt["local_verified_at"]) == ("c.json", "cs", "v")
    assert documents.receipt_documents(stage("stage2_blocked", "c.json"), plans, checkpoints, verified, F.lit(""), F.lit(""), F.lit(""), names).count() == 0
    marker = json.loads(documents.documents_text(documents.marker_documents(plans.withColumn("completed_at", F.lit("now")), names)).first()["content"])
    assert (marker["receipt_file"], marker["receipt_sha256"], marker["contract_version"]) == ("plan-x.json", "s", "acme-cloud-cleanup-marker/v1")


@pytest.mark.parametrize("change", ["nothing", "receipt", "marker"])
def test_a_changed_file_breaks_the_chain(spark, tmp_path, change):
    """receipt_chain over files: a receipt or marker that is changed after it was written no longer chains."""
    from daykeeper.plans.removal import _keyed
    from daykeeper.sources.documents import read_evidence
    from daykeeper.sources.named import write_named

    names = Contracts("acme")
    receipt = spark.createDataFrame([("collector=a/receipt-2024-01-02-1.json", names.cleanup_receipt, "completed", "p", "a", "2024-01-02", "m", "now")], "name STRING, contract_version STRING, status STRING, profile_id STRING, collector_id STRING, archive_date STRING, manifest_sha256 STRING, completed_at STRING")
    write_named(documents.documents_text(receipt), str(tmp_path))
    read = lambda: _keyed(read_evidence(spark, str(tmp_path), "receipt", prefix="receipt-"))
    write_named(documents.documents_text(documents.marker_documents(read(), names)), str(tmp_path))
    markers = lambda: _keyed(read_evidence(spark, str(tmp_path), "cleanup_marker", "cleanup.json"))
    local = spark.createDataFrame([("a", "2024-01-02", "m")], "collector STRING, archive_date STRING, manifest_sha256 STRING")
    assert evidence.receipt_chain(markers(), read(), local, names).count() == 1
    path = {"receipt": tmp_path / "collector=a/receipt-2024-01-02-1.json", "marker": tmp_path / "collector=a/date=2024-01-02/cleanup.json"}.get(change)
    if path:
        path.write_text(path.read_text().replace('"now"', '"later"').replace("completed", "completed" if change == "receipt" else "open"))
    assert evidence.receipt_chain(markers(), read(), local, names).count() == (1 if change == "nothing" else 0)
