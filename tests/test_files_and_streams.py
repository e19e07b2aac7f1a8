"""Sources, sinks and streams over real files."""

import hashlib
import json
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from daykeeper.contracts import Contracts
from daykeeper.functions.canonical import payload_text
from daykeeper.operators.reports import report_fields, report_index
from daykeeper.session import scratch_path
from daykeeper.sources.documents import missing_evidence, read_evidence, read_manifests, read_object_meta, read_reports
from daykeeper.sources.named import write_named
from daykeeper.sources.sinks import publish_verified_days, read_published, write_report
from daykeeper.sources.tables import arrow_schema_digest, list_objects, observe_objects, scan_day_tables
from daykeeper.streaming.progress import stream_progress, stream_speed, throttle
from daykeeper.streaming.sinks import append_to_table, upsert_to_table
from daykeeper.streaming.status import fresh_results
from tests.test_operators import PROGRESS, plain_speed, updates


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_manifests_carry_their_bytes_and_place(spark, tmp_path):
    raw = b'{"status": "verified", "objects": []}'
    put(tmp_path / "replica=r2/collector=a/date=2024-01-02/manifest.json", raw)
    row = read_manifests(spark, str(tmp_path)).first()
    assert (row["replica"], row["collector"], row["archive_date"]) == ("r2", "a", "2024-01-02")
    assert (row["raw_sha256"], row["raw_size"], bytes(row["raw"])) == (hashlib.sha256(raw).hexdigest(), len(raw), raw)


def test_sidecars_must_name_their_object(spark, tmp_path):
    suffix = Contracts("acme").sidecar_suffix
    base = tmp_path / "collector=a/date=2024-01-02/raw"
    put(base / f"x.parquet{suffix}", json.dumps({"relative_key": "date=2024-01-02/raw/x.parquet", "size_bytes": 5, "sha256": "s"}).encode())
    put(base / f"y.parquet{suffix}", json.dumps({"relative_key": "date=2024-01-02/raw/z.parquet", "size_bytes": 5, "sha256": "s"}).encode())
    put(base / f"z.parquet{suffix}", b"not json")
    got = {r["relative_key"][-9:]: (r["size_bytes"], r["reason"]) for r in read_object_meta(spark, str(tmp_path), suffix).collect()}
    assert got == {"x.parquet": (5, None), "y.parquet": (5, "meta_path"), "z.parquet": (None, "meta_invalid")}


def test_unreadable_reports_stay_as_rows(spark, tmp_path):
    put(tmp_path / "verify-2024-01-02.json", b'{"status":"verified","objects":[{"kind":"raw"}],"z":{"b":[1,null]},"a":null}')
    put(tmp_path / "deep/plan-2024-01-03-x.json", b"[]")
    put(tmp_path / "receipt-x.json", b"\xff")
    put(tmp_path / "big.json", b'{"a":"' + b"x" * 200 + b'"}')
    put(tmp_path / "skipped.txt", b"{}")
    reports = read_reports(spark, str(tmp_path), max_bytes=150)
    got = {r["name"]: (r["reason"], r["state"], r["archive_date"], r["object_count"]) for r in report_index(reports).collect()}
    assert got == {
        "verify-2024-01-02.json": (None, "✓ 已验证", "2024-01-02", 1), "plan-2024-01-03-x.json": ("not_object", "! 异常", "2024-01-03", 0),
        "receipt-x.json": ("bad_json", "! 异常", "--", 0), "big.json": ("too_large", "! 异常", "--", 0)}
    fields = {r["field"]: r["value"] for r in report_fields(reports).collect()}
    assert fields["z"] == '{"b":[1,null]}' and fields["a"] == "None"


def test_evidence_reasons(spark, tmp_path):
    put(tmp_path / "plan-1.json", b'{"archive_date":"d1","object_count":3,"unknown":1}')
    put(tmp_path / "plan-2.json", b"{")
    rows = read_evidence(spark, str(tmp_path), "plan")
    got = {r["file_name"]: (r["reason"], r["archive_date"], r["object_count"]) for r in rows.collect()}
    assert got == {"plan-1.json": (None, "d1", 3), "plan-2.json": ("bad_json", None, None)}
    digest = rows.where("file_name = 'plan-1.json'").first()["file_sha256"]
    assert digest == hashlib.sha256((tmp_path / "plan-1.json").read_bytes()).hexdigest()
    wanted = spark.createDataFrame([("d1",), ("d9",)], "archive_date STRING")
    assert {r["archive_date"]: r["reason"] for r in missing_evidence(wanted, rows, ["archive_date"]).collect()} == {"d1": None, "d9": "missing"}


def test_named_files_and_listing(spark, tmp_path):
    df = spark.createDataFrame([(f"a b+%20é/{i}.json", f"doc {i}".encode()) for i in range(20)], "name STRING, content BINARY")
    write_named(df, str(tmp_path))
    write_named(df, str(tmp_path))
    listed = {r["key"]: r["size_bytes"] for r in list_objects(spark, str(tmp_path)).collect()}
    assert listed == {f"a b+%20é/{i}.json": len(f"doc {i}") for i in range(20)}


def test_observed_files_match_the_contract(spark, tmp_path):
    table = pa.table({
        "id": [1, 2, 3], "v": pa.array([0.1, 1e16, None]), "t": pa.array([datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 5), None], pa.timestamp("us")),
        "m": pa.array([[("k", 1)], [], None], pa.map_(pa.string(), pa.int64()))})
    put(tmp_path / "x", b"")
    pq.write_table(table, tmp_path / "good.parquet", row_group_size=2)
    pq.write_table(pa.table({"v": [float("nan")]}), tmp_path / "nan.parquet")
    put(tmp_path / "bad.parquet", b"not parquet")
    names = ["good.parquet", "nan.parquet", "bad.parquet", "gone.parquet"]
    objects = spark.createDataFrame([("c", "d", n, "business", f"file://{tmp_path}/{n}") for n in names] + [("c", "d", "raw", "raw", f"file://{tmp_path}/good.parquet")],
                                    "collector STRING, archive_date STRING, relative_key STRING, kind STRING, uri STRING")
    got = {r["relative_key"]: r for r in observe_objects(objects, tasks=3).collect()}
    digest = hashlib.sha256()
    for row in table.to_pylist():
        data = payload_text(row).encode()
        digest.update(len(data).to_bytes(8, "big") + data)
    good, raw = got["good.parquet"], (tmp_path / "good.parquet").read_bytes()
    schema = hashlib.sha256(str(pq.ParquetFile(tmp_path / "good.parquet").schema_arrow).encode()).hexdigest()
    assert (good["size_bytes"], good["sha256"], good["row_count"], good["schema_sha256"], good["content_sha256"], good["reason"]) == (
        len(raw), hashlib.sha256(raw).hexdigest(), 3, schema, digest.hexdigest(), None)
    assert got["raw"]["content_sha256"] is None and got["raw"]["row_count"] == 3
    assert got["nan.parquet"]["reason"] == "non_finite" and got["gone.parquet"]["reason"] == "missing"
    assert got["bad.parquet"]["reason"].startswith("unreadable") and got["bad.parquet"]["size_bytes"] == 11
    footer = arrow_schema_digest(objects.where("relative_key = 'raw'")).first()
    assert (footer["row_count"], footer["schema_sha256"]) == (3, schema)


def test_day_tables_keep_file_order_and_prune_days(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 3).cast("string").alias("collector"), F.concat(F.lit("2024-01-0"), (F.col("id") % 2 + 1).cast("string")).alias("date"), "id")
    df.repartition("collector", "date").sortWithinPartitions("collector", "date", F.desc("id")).write.partitionBy("collector", "date").parquet(str(tmp_path / "t"))
    rows = scan_day_tables(spark, str(tmp_path / "t"), ["2024-01-02"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan or "PartitionFilters: [(cast(date" in plan
    per_file = {}
    for r in rows.collect():
        per_file.setdefault(r["file_path"], []).append((r["row_index"], r["id"]))
    assert sum(map(len, per_file.values())) == 150
    assert all([i for _, i in sorted(rows)] == sorted((i for _, i in rows), reverse=True) for rows in per_file.values())


def test_only_verified_days_become_visible_and_rewrites_replace(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-02", 2), ("b", "2024-01-01", 3)], "collector STRING, archive_date STRING, v INT")
    verdict = "collector STRING, archive_date STRING, status STRING"
    data, reports = str(tmp_path / "data"), str(tmp_path / "reports")
    publish_verified_days(rows, spark.createDataFrame([("a", "2024-01-01", "verified"), ("a", "2024-01-02", "failed"), ("b", "2024-01-01", "verified")], verdict), data, reports)
    assert sorted(r["v"] for r in read_published(spark, data, reports).collect()) == [1, 3]
    publish_verified_days(rows, spark.createDataFrame([("a", "2024-01-02", "verified"), ("b", "2024-01-01", "verified")], verdict), data, reports)
    assert sorted(r["v"] for r in read_published(spark, data, reports).collect()) == [1, 2, 3]
    # Rows without a report are not published yet.
    rows.withColumn("archive_date", F.lit("2024-01-09")).write.mode("append").partitionBy("collector", "archive_date").parquet(data)
    assert sorted(r["v"] for r in read_published(spark, data, reports).collect()) == [1, 2, 3]


def test_reports_are_canonical_json(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01", "é", None)], "collector STRING, archive_date STRING, z STRING, b INT")
    write_report(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()["value"] == '{"archive_date":"2024-01-01","b":null,"collector":"a","z":"é"}'


def stream_of(spark, rows, batches):
    """The rows as a stream of several files in time order, one file per micro-batch."""
    root = scratch_path(spark, "in")
    rows = sorted(rows, key=lambda row: (row[3], row[2]))
    size = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * size:(i + 1) * size], PROGRESS).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(PROGRESS).option("maxFilesPerTrigger", 1).parquet(root)


def test_streamed_speed_equals_the_batch_loop(spark):
    rows = updates(3, 400)
    stream = stream_of(spark, rows, 3).withColumnRenamed("bytes", "network_bytes")
    got = {r["seq"]: r["speed"] for r in append_to_table(stream_speed(stream), "speed").collect()}
    want = plain_speed(rows)
    assert got.keys() == want.keys()
    assert all((got[s] is None) == (want[s] is None) and (want[s] is None or abs(got[s] - want[s]) < 1e-6 * want[s] + 1e-6) for s in want)


def test_streamed_throttle_equals_the_batch_loop(spark):
    rows = updates(5, 400)
    got = {r["seq"] for r in append_to_table(throttle(stream_of(spark, rows, 3)), "throttle").collect()}
    last, want = {}, set()
    for t, name, seq, ts, moved, total, *_ in sorted(rows, key=lambda row: (row[3], row[2])):
        held = last.get((t, name))
        if held is None or min(max(moved, 0), total) >= total or ts - held >= timedelta(seconds=0.2):
            last[(t, name)] = ts
            want.add(seq)
    assert got == want


def test_streamed_high_water_is_the_newest_state(spark):
    rows = updates(6, 300)
    table = upsert_to_table(stream_progress(stream_of(spark, rows, 3)), "progress", ["transfer_id", "object_name"])
    want = {}
    for t, name, _, _, moved, total, completed, *_ in rows:
        want[(t, name)] = max(want.get((t, name), 0), total if completed else min(max(moved, 0), total))
    assert {(r["transfer_id"], r["object_name"]): r["object_bytes"] for r in table.collect()} == want


def test_errors_are_never_reused(spark):
    now = datetime(2024, 1, 1, 12)
    rows = [("a", now - timedelta(seconds=10), "verified"), ("b", now - timedelta(seconds=10), "error"), ("c", now - timedelta(seconds=300), "verified"),
            ("d", now - timedelta(seconds=299), "verified")]
    df = spark.createDataFrame(rows, "k STRING, checked_at TIMESTAMP_NTZ, state STRING")
    assert {r["k"] for r in fresh_results(df, F.lit(now).cast("timestamp_ntz"), ["k"]).collect()} == {"a", "d"}
