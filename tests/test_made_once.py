"""What several steps ask for is made once: a micro-batch of the catch-up cycle, and the digests of a removal's phases."""

import pyarrow as pa

from daykeeper.plans import files, views
from daykeeper.streaming.catchup import judge_days, read_decisions
from tests.test_gated_catch_up import DAYS, SCHEMA, cycle_of, document


def test_a_micro_batch_is_evaluated_once(spark, tmp_path):
    rows = [document(d, r, 0) for d in DAYS[:3] for r in ("google_drive", "r2")]
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch.append_column("gate", pa.array(["both"] * batch.num_rows))

    documents = spark.createDataFrame(rows, SCHEMA).drop("arrived").repartition(2)
    batch = documents.mapInArrow(count, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in documents.schema)}, gate STRING")
    cycle = cycle_of(spark, tmp_path, True, DAYS)
    judge_days(cycle, batch, 0)
    assert counted.value == len(rows)
    assert {r["archive_date"]: r["decision"] for r in read_decisions(spark, cycle.decisions_path).collect()} == dict.fromkeys(DAYS[:3], "verified")


def calls_of(monkeypatch, module, name):
    made = []
    plain = getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: made.append(1) or plain(*a, **k))
    return made


def test_cycles_look_up_tables_that_are_made_once(spark, monkeypatch):
    made = calls_of(monkeypatch, views, "observed"), calls_of(monkeypatch, views, "markers")
    assert files.gated_cycle(spark, "/root/testdata/sf0.001", True).count()
    assert [len(m) for m in made] == [1, 1]


def test_documents_of_a_removal_come_from_given_digests(spark):
    rows = [("c0", f"2024-01-{d:02}", d, f"m{d}") for d in (1, 6, 10, 11, 13, 19)]
    digests = spark.createDataFrame(rows, "collector STRING, archive_date STRING, dom INT, manifest_sha256 STRING")
    days = lambda df: {int(r["archive_date"][-2:]): r for r in df.collect()}
    markers, receipts, retention = days(views.markers_of(digests)), days(views.receipts_of(digests)), days(views.retention_of(digests))
    assert (set(markers), set(receipts), set(retention)) == ({1, 6, 10, 11, 19}, {1, 6, 10}, {1, 6, 10, 11, 13})
    assert markers[1]["manifest_sha256"] == receipts[1]["manifest_sha256"] == retention[1]["verified_manifest_sha256"] == "m1"
    assert markers[6]["manifest_sha256"] != "m6" and markers[10]["contract_version"] == "broken/v0"
