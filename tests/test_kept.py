"""Content trees compared by descent, listing snapshots without a shuffle, local manifests, transfer fields."""

import os
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from daykeeper.contracts import DEFAULT_CONTRACTS
from daykeeper.functions.digests import sha256
from daykeeper.operators import evidence, rollup
from daykeeper.operators.content_tree import content_difference, write_content_tree
from daykeeper.operators.listing import listing_drift
from daykeeper.sources.snapshots import open_snapshot, snapshot_drift, write_snapshot

ROWS = "collector STRING, archive_date STRING, id BIGINT, payload STRING"
KEYS = ["collector", "archive_date"]


def brute(left, right):
    a, b = Counter(left), Counter(right)
    return {row: (a[row], b[row]) for row in {*a, *b} if a[row] != b[row]}


def by_descent(spark, left, right):
    digests = {p: h for p, h in spark.createDataFrame([(r[3],) for r in left + right], "p STRING").select("p", sha256(F.col("p"))).collect()}
    trees = []
    for rows in (left, right):
        root = f"{spark.sparkContext.getCheckpointDir()}/tree-{random.getrandbits(60):x}"
        trees.append(write_content_tree(spark.createDataFrame(rows, ROWS), KEYS, ["id"], root, leaves=8, shards=4))
    found = content_difference(spark, *trees).collect()
    got = {(r["collector"], r["archive_date"], r["id"], r["row_sha256"]): (r["left_copies"], r["right_copies"]) for r in found}
    assert len(got) == len(found)
    return got, {(*row[:3], digests[row[3]]): n for row, n in brute(left, right).items()}


def test_descent_equals_the_full_comparison(spark):
    rng = random.Random(5)
    hot = [("c1", "2024-01-01", k, f"p{k % 40}") for k in range(300)]
    rows = hot + [(f"c{rng.randrange(4)}", f"2024-01-0{rng.randrange(1, 4)}", rng.randrange(50), f"p{rng.randrange(9)}") for _ in range(200)]
    rows += [(None, None, None, None), (None, "2024-01-01", 1, "x"), ("", "2024-01-01", 1, "x")] + [("c9", "2024-01-09", 7, "same")] * 60
    other = [r for r in rows if rng.random() > 0.02] + [("c7", "2024-01-01", 1, "new"), (None, None, None, "y"), (None, None, None, None)]
    got, expected = by_descent(spark, rows, other)
    assert got == expected and got
    # Only the number of copies differs; equal sides; one side empty; both empty.
    copies = [("c9", "2024-01-09", 7, "same")] * 3
    for left, right in ((copies, copies[:2]), (rows, list(reversed(rows))), (copies, []), ([], copies), ([], [])):
        got, expected = by_descent(spark, left, right) if left or right else ({}, {})
        assert got == expected


def test_columns_named_like_the_tree_are_refused(spark):
    with pytest.raises(ValueError):
        write_content_tree(spark.createDataFrame([("a", 1, "p")], "leaf STRING, id INT, payload STRING"), ["leaf"], ["id"], "/nowhere")


def test_few_changes_open_few_folders(spark, tmp_path):
    """All folders but those of changed rows are made unreadable, and the answer stays the same."""
    rows = spark.range(40_000).select(
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("collector"),
        F.concat(F.lit("2024-01-1"), (F.col("id") % 7).cast("string")).alias("archive_date"),
        "id",
        F.concat(F.lit("payload"), F.col("id").cast("string")).alias("payload"),
    )
    changed = rows.withColumn("payload", F.when(F.col("id") % 20_000 == 17, F.lit("other")).otherwise(F.col("payload")))
    trees = [
        write_content_tree(df, KEYS, ["id"], f"{tmp_path}/{name}", leaves=512, shards=32) for name, df in (("a", rows), ("b", changed))
    ]
    found = content_difference(spark, *trees)
    expected = sorted(tuple(r) for r in found.collect())
    assert sorted((r[2], r[4], r[5]) for r in expected) == [(17, 0, 1), (17, 1, 0), (20017, 0, 1), (20017, 1, 0)]
    needed = set()
    for tree, side in zip(trees, ("left", "right")):
        held = spark.read.parquet(f"{tree.root}/rows").where("id IN (17, 20017)").select("leaf", "bucket", *KEYS)
        needed |= {r["leaf"] for r in held.collect()}
    assert 1 <= len(needed) <= 4
    broken = total = 0
    for tree in trees:
        for folder in Path(f"{tree.root}/rows").glob("leaf=*"):
            total += 1
            if int(folder.name.split("=")[1]) not in needed:
                broken += 1
                for file in folder.glob("*.parquet"):
                    file.write_bytes(b"not parquet")
    assert total > 900 and (total - broken) / total < 0.01
    assert sorted(tuple(r) for r in content_difference(spark, *trees).collect()) == expected


LISTED = "collector STRING, key STRING, size_bytes BIGINT"


def test_snapshots_meet_without_a_shuffle(spark, tmp_path):
    rng = random.Random(3)
    names = [("hot", f"k{i}") for i in range(3000)] + [(f"c{i % 9}", f"k{i}") for i in range(500)]
    sides = []
    for _ in range(2):
        rows = [(c, k, rng.randrange(3) if rng.random() < 0.01 else 9) for c, k in names if rng.random() > 0.01]
        rows += rng.sample(rows, 5) + [("hot", "sizeless", None)]
        sides.append(spark.createDataFrame(rows, LISTED))
    held = [write_snapshot(df, f"{tmp_path}/{i}", ["collector"], buckets=4) for i, df in enumerate(sides)]
    drift = snapshot_drift(*held, ["collector"])
    expected = listing_drift(*sides, ["collector"])
    got = sorted(drift.collect(), key=repr)
    plan = drift._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert got == sorted(expected.select(*drift.columns).collect(), key=repr)
    assert {r["drift"] for r in got} == {"added", "removed", "resized", "duplicate"}
    # One file per bucket, and a hot collector lies in all of them.
    files = [f for f in os.listdir(f"{tmp_path}/0") if f.endswith(".parquet")]
    assert len({re.search(r"_(\d{5})\.", f).group(1) for f in files}) == len(files) == 4
    again = open_snapshot(spark, f"{tmp_path}/0", LISTED, ["collector"], buckets=4)
    reopened = snapshot_drift(again, held[1], ["collector"])
    assert "Exchange" not in reopened._jdf.queryExecution().executedPlan().toString()
    assert sorted(reopened.collect(), key=repr) == got
    empty = write_snapshot(spark.createDataFrame([], LISTED), f"{tmp_path}/none", ["collector"], buckets=4)
    assert snapshot_drift(empty, empty, ["collector"]).count() == 0
    assert {r["drift"] for r in snapshot_drift(empty, held[0], ["collector"]).collect()} == {"added", "duplicate"}


def test_a_nameless_row_is_no_snapshot(spark, tmp_path):
    with pytest.raises(Exception, match="no key"):
        write_snapshot(spark.createDataFrame([("c", None, 1)], LISTED), f"{tmp_path}/x", ["collector"], buckets=2)


def test_a_changed_local_manifest_blocks(spark):
    body = (
        '{"archive_date":"2024-01-01","contract_version":"%s","object_count":0,"objects":[],'
        '"retention_delete_allowed":true,"row_count":0,"status":"verified"}' % DEFAULT_CONTRACTS.manifest
    )
    import hashlib

    digest = hashlib.sha256(body.encode()).hexdigest()
    marks = [(c, "2024-01-01", DEFAULT_CONTRACTS.verification, status, "2024-01-01", digest) for c, status in (("a", "verified"), ("b", "verified"), ("c", "verified"), ("d", "failed"))]
    markers = spark.createDataFrame(
        marks, "collector STRING, archive_date STRING, contract_version STRING, status STRING, doc_archive_date STRING, manifest_sha256 STRING"
    )
    raw = [("a", "2024-01-01", bytearray(body.encode())), ("b", "2024-01-01", bytearray(body.encode() + b" ")), ("d", "2024-01-01", bytearray(body.encode()))]
    documents = spark.createDataFrame(raw, "collector STRING, archive_date STRING, raw BINARY")
    checked = evidence.check_marker(markers)
    snapshots = evidence.local_snapshots(checked, documents)
    assert {r["collector"]: r["reason"] for r in snapshots.collect()} == {"a": None, "b": "sha256", "c": "unreadable", "d": "marker_status"}
    days = markers.select(*KEYS)
    both = days.withColumns({"replica": F.explode(F.array(F.lit("x"), F.lit("y"))), "raw_sha256": F.lit(digest), "reason": F.lit(None).cast("string")})
    kept = days.withColumns({"reason": F.lit(None).cast("string"), "verified_manifest_sha256": F.lit(digest)})
    verdicts = days.withColumn("status", F.lit("verified"))
    judged = evidence.removal_eligibility(both, kept, checked, verdicts, days.limit(0), snapshots)
    assert {r["collector"]: r["reason"] for r in judged.collect()} == {"a": None, "b": "local_manifest", "c": "local_manifest", "d": "local_marker"}


def test_a_day_without_transfers_reports_none(spark):
    days = spark.createDataFrame([("a", "2024-01-01", "verified", "m", 0, 0, "t")], "collector STRING, archive_date STRING, status STRING, manifest_sha256 STRING, object_count BIGINT, row_count BIGINT, tree_sha256 STRING")
    fields = "collector STRING, archive_date STRING, pos BIGINT, relative_key STRING, kind STRING, table_name STRING, size_bytes BIGINT, sha256 STRING, seen_row_count BIGINT, seen_schema_sha256 STRING, seen_content_sha256 STRING"
    manifests = spark.createDataFrame([("a", "2024-01-01", "r2", "m")], "collector STRING, archive_date STRING, replica STRING, raw_sha256 STRING")
    moved = spark.createDataFrame([], "collector STRING, archive_date STRING, active_source STRING, sources_attempted ARRAY<STRING>, sources_completed ARRAY<STRING>, network_bytes BIGINT")
    report = rollup.verification_report(days, spark.createDataFrame([], fields), manifests, transfers=moved, verified_at=F.lit("now")).first()
    assert report["download_replica"] is None and report["download_sources_attempted"] == [] and report["downloaded_bytes_this_run"] == 0
    assert report["verified_at"] == "now" and report["objects"] == []
