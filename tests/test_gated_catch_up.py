"""The catch-up cycle over batches: replicas that arrive apart, the gate, publishing with reports, state that ends."""

import hashlib
import json
from datetime import datetime, timedelta

import pytest

from daykeeper.contracts import Contracts
from daykeeper.session import scratch_path
from daykeeper.sources.sinks import read_published
from daykeeper.streaming.catchup import Cycle, gated_catch_up, gated_documents, read_decisions, read_reports_table

NAMES = Contracts("acme")
START = datetime(2024, 3, 1)
SCHEMA = "collector STRING, archive_date STRING, replica STRING, raw BINARY, declared_sha256 STRING, declared_size BIGINT, arrived TIMESTAMP"


def entry(day, rows):
    sha = hashlib.sha256(f"{day}".encode()).hexdigest()
    return {"relative_key": f"date={day}/raw/x.parquet", "kind": "raw", "table_name": "x", "size_bytes": 10, "sha256": sha, "row_count": rows, "schema_sha256": sha, "content_sha256": None}


def document(day, replica, hours, rows=1, collector="a", note=None):
    body = {
        "contract_version": NAMES.manifest, "status": "verified", "retention_delete_allowed": True, "archive_date": day, "object_count": 1, "row_count": rows, "objects": [entry(day, rows)],
        **({"note": note} if note else {}),
    }
    raw = json.dumps(body).encode()
    return (collector, day, replica, raw, hashlib.sha256(raw).hexdigest(), len(raw), START + timedelta(hours=hours))


def stream_of(spark, batches):
    root = scratch_path(spark, "arrivals")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(root)


def cycle_of(spark, tmp_path, require_both, days, local=()):
    seen = [("a", d, f"date={d}/raw/x.parquet", 10, hashlib.sha256(d.encode()).hexdigest(), 1, hashlib.sha256(d.encode()).hexdigest(), None, None) for d in days]
    observed = spark.createDataFrame(seen, "collector STRING, archive_date STRING, relative_key STRING, size_bytes BIGINT, sha256 STRING, row_count BIGINT, schema_sha256 STRING, content_sha256 STRING, reason STRING")
    markers = spark.createDataFrame(list(local), "collector STRING, archive_date STRING, status STRING, manifest_sha256 STRING")
    rows = spark.createDataFrame([("a", d, f"{r}:{d}", r) for d in days for r in ("google_drive", "r2")], "collector STRING, archive_date STRING, v STRING, replica STRING")
    chosen = lambda todo: rows.join(todo, ["collector", "archive_date", "replica"], "left_semi")
    return Cycle(lambda: observed, lambda: markers, chosen, str(tmp_path / "data"), str(tmp_path / "reports"), str(tmp_path / "decisions"), NAMES, require_both)


DAYS = [f"2024-01-0{k}" for k in range(1, 8)]
BATCHES = [
    # 1 and 2 wait for their second replica, 3 is whole, 4 never gets one, 5 differs, 6 is broken in one replica
    [document(DAYS[0], "google_drive", 0), document(DAYS[1], "r2", 0), document(DAYS[2], "google_drive", 0), document(DAYS[2], "r2", 0), document(DAYS[3], "r2", 0)],
    [document(DAYS[0], "r2", 1), document(DAYS[4], "r2", 1), document(DAYS[4], "google_drive", 1, note="other"), document(DAYS[5], "google_drive", 1)],
    [document(DAYS[1], "google_drive", 2), (*document(DAYS[5], "r2", 2)[:4], "0" * 64, 5, START + timedelta(hours=2))],
    # Time goes on: nothing more of the day that lacks a replica.
    [document(DAYS[6], "google_drive", 60), document(DAYS[6], "r2", 60)],
]


@pytest.mark.parametrize("require_both", [True, False])
def test_replicas_of_different_batches_meet(spark, tmp_path, require_both):
    cycle = cycle_of(spark, tmp_path, require_both, DAYS)
    gated_catch_up(stream_of(spark, BATCHES), cycle, str(tmp_path / "state"), wait_seconds=36_000, keep_seconds=3_600)
    got = {r["archive_date"]: (r["gate"], r["decision"], r["reason"], r["replica"]) for r in read_decisions(spark, cycle.decisions_path).collect()}
    fine = ("both", "verified", None, "google_drive")
    want = {d: fine for d in (DAYS[0], DAYS[1], DAYS[2], DAYS[6])}
    if require_both:
        want |= {DAYS[3]: ("waited", "refused", "replica_missing", None), DAYS[4]: ("both", "refused", "replicas_differ", None), DAYS[5]: ("both", "refused", "replica_missing", None)}
    else:
        want |= {DAYS[3]: ("waited", "verified", None, "r2"), DAYS[4]: fine, DAYS[5]: fine}
    assert got == want
    passed = {d for d, decided in want.items() if decided[1] == "verified"}
    published = read_published(spark, cycle.data_path, cycle.report_path).collect()
    assert sorted(r["v"] for r in published) == sorted(f"{want[d][3]}:{d}" for d in passed)
    assert {r["archive_date"] for r in read_reports_table(spark, cycle.report_path).collect()} == passed


def test_days_that_are_here_already_are_left_alone(spark, tmp_path):
    same, other = document(DAYS[0], "r2", 0), document(DAYS[1], "r2", 0)
    local = [("a", DAYS[0], "verified", same[4]), ("a", DAYS[1], "verified", "0" * 64)]
    cycle = cycle_of(spark, tmp_path, True, DAYS, local)
    batch = [same, document(DAYS[0], "google_drive", 0), other, document(DAYS[1], "google_drive", 0), document(DAYS[2], "r2", 0), document(DAYS[2], "google_drive", 0)]
    gated_catch_up(stream_of(spark, [batch]), cycle, str(tmp_path / "state"))
    got = {r["archive_date"]: r["decision"] for r in read_decisions(spark, cycle.decisions_path).collect()}
    assert got == {DAYS[0]: "already_verified", DAYS[1]: "conflict", DAYS[2]: "verified"}
    assert {r["archive_date"] for r in read_published(spark, cycle.data_path, cycle.report_path).collect()} == {DAYS[2]}


def run_and_count(spark, stream, path):
    """The rows that leave the gate by batch, and the state's rows after each batch."""
    seen = []

    def keep(batch, batch_id):
        seen.extend((batch_id, r["archive_date"], r["replica"], r["gate"], bytes(r["raw"])) for r in batch.collect())

    query = stream.writeStream.outputMode("append").option("checkpointLocation", path).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return seen, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_state_ends_and_late_replicas_are_defined(spark, tmp_path):
    one, two = document(DAYS[0], "r2", 0), document(DAYS[0], "google_drive", 30)
    newer = document(DAYS[1], "r2", 1, note="newer")
    batches = [
        [one, document(DAYS[1], "r2", 0), document(DAYS[2], "r2", 0)],
        [newer, document(DAYS[3], "r2", 20), document(DAYS[3], "google_drive", 20)],
        [document(DAYS[6], "r2", 21), document(DAYS[6], "google_drive", 21)],  # the wait of ten hours is over
        [two, document(DAYS[1], "google_drive", 30)],  # within keep: meets what waited
        [document(DAYS[4], "r2", 400), document(DAYS[4], "google_drive", 400)],  # all is forgotten
        [document(DAYS[5], "r2", 900), document(DAYS[5], "google_drive", 900)],
    ]
    seen, sizes = run_and_count(spark, gated_documents(stream_of(spark, batches), 36_000, 360_000), str(tmp_path / "state"))
    by_day = {}
    for _, day, replica, gate, raw in seen:
        by_day.setdefault(day, []).append((gate, replica, raw))
    assert [x[:2] for x in by_day[DAYS[0]]] == [("waited", "r2"), ("both", "google_drive"), ("both", "r2")]
    assert [x[:2] for x in by_day[DAYS[1]]] == [("waited", "r2"), ("both", "google_drive"), ("both", "r2")] and by_day[DAYS[1]][0][2] == newer[3]
    assert [x[:2] for x in by_day[DAYS[2]]] == [("waited", "r2")]
    assert all([x[0] for x in by_day[d]] == ["both", "both"] for d in DAYS[3:6])
    assert max(sizes) > 0 and sizes[-1] == 0
