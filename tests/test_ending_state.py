"""Streams whose state ends: results as without an end, and no state left after the last transfer."""

from datetime import datetime, timedelta

from daykeeper.session import scratch_path
from daykeeper.streaming.progress import Ending, ending_progress, stream_speed, throttle
from tests.test_operators import PROGRESS, plain_speed, updates


def run(spark, batches, build, mode):
    """All rows that a stream gives, and the rows of its state after each micro-batch."""
    root = scratch_path(spark, "in")
    schema = PROGRESS.replace("TIMESTAMP_NTZ", "TIMESTAMP")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root).withColumnRenamed("remaining_bytes", "rest")
    seen = []
    out = build(stream)
    query = out.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True)
    query = query.foreachBatch(lambda batch, k: seen.extend((k, *row) for row in batch.collect())).start()
    query.awaitTermination()
    return seen, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def later(hours):
    """An update of another transfer that lets event time go on."""
    return [(99, "tick", 10**6 + hours, datetime(2024, 1, 1) + timedelta(hours=hours), 1, 1, True, "downloading", 0)]


def test_progress_ends_with_its_transfer(spark):
    rows = sorted(updates(7, 300), key=lambda r: (r[3], r[2]))
    start = min(r[3] for r in rows)
    rows = [(*r[:3], datetime(2024, 1, 1) + (r[3] - start), *r[4:]) for r in rows]
    batches = [rows[:100], rows[100:200], rows[200:], later(50), later(100), later(150)]
    seen, sizes = run(spark, batches, lambda s: ending_progress(s, Ending(idle_seconds=3600, settle_seconds=600)), "update")
    newest = {(r[1], r[2]): r[3] for r in sorted(seen) if r[1] != 99}
    want = {}
    for t, name, _, _, moved, total, completed, *_ in rows:
        want[(t, name)] = max(want.get((t, name), 0), total if completed else min(max(moved, 0), total))
    assert newest == want
    # Left is the transfer of the last tick alone, whose own time is not over.
    assert max(sizes) > len(want) - 1 and sizes[-1] <= 1


def test_throttle_and_speed_end_and_are_equal_until_then(spark):
    rows = sorted(updates(8, 240), key=lambda r: (r[3], r[2]))
    start = min(r[3] for r in rows)
    rows = [(*r[:3], datetime(2024, 1, 1) + (r[3] - start), *r[4:]) for r in rows]
    batches = [rows[:120], rows[120:], later(50), later(100), later(150)]
    ending = Ending(idle_seconds=7200)
    seen, sizes = run(spark, batches, lambda s: throttle(s, ending=ending), "append")
    last, want = {}, set()
    for t, name, seq, ts, moved, total, *_ in rows:
        held = last.get((t, name))
        if held is None or min(max(moved, 0), total) >= total or ts - held >= timedelta(seconds=0.2):
            last[(t, name)] = ts
            want.add(seq)
    assert {r[3] for r in seen if r[1] != 99} == want and sizes[-1] <= 1
    seen, sizes = run(spark, batches, lambda s: stream_speed(s.withColumn("network_bytes", s["bytes"]), ending), "append")
    got, plain = {r[2]: r[3] for r in seen if r[1] != 99}, plain_speed(rows)
    assert got.keys() == plain.keys() and sizes[-1] <= 1
    assert all((got[k] is None) == (plain[k] is None) and (plain[k] is None or abs(got[k] - plain[k]) < 1e-6 * plain[k] + 1e-6) for k in plain)


def test_an_update_after_the_end_starts_anew(spark):
    at = datetime(2024, 1, 1)
    row = lambda seq, hours, moved: (1, "a", seq, at + timedelta(hours=hours), moved, 100, False, "downloading", 0)
    batches = [[row(1, 0, 80)], later(5), later(6), [row(2, 9, 10)], [row(3, 9.1, 5)]]
    seen, _ = run(spark, batches, lambda s: ending_progress(s, Ending(idle_seconds=3600)), "update")
    assert [r[3] for r in sorted(seen) if r[1] == 1] == [80, 10, 10]
