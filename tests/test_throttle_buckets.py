"""Objects that are throttled together in a bucket keep to their own last update, over micro-batches."""

import pytest
from pyspark.sql import functions as F

from daykeeper.session import scratch_path
from daykeeper.streaming import progress
from daykeeper.streaming.progress import throttle

SCHEMA = "transfer_id BIGINT, object_name STRING, seq BIGINT, ts TIMESTAMP, bytes BIGINT, object_total BIGINT"


@pytest.mark.parametrize("buckets", [1, 4096])
def test_every_object_has_its_own_clock(spark, monkeypatch, buckets):
    monkeypatch.setattr(progress, "OBJECT_BUCKETS", buckets)
    ids = [None, 1, 2, 2**60 + 1]
    rows = [
        (ids[k % 4], None if k % 11 == 0 else f"o{k % 3}", k, (k * 7919) % 4_000_000 + 2_000_000 * (k >= 200), (k * 37) % 900 - 5, 900 if k % 5 else 100)
        for k in range(400)
    ]
    root = scratch_path(spark, "in")
    for part in (rows[:200], rows[200:]):
        df = spark.createDataFrame(part, "transfer_id BIGINT, object_name STRING, seq BIGINT, micros BIGINT, bytes BIGINT, object_total BIGINT")
        df.select("transfer_id", "object_name", "seq", F.timestamp_micros("micros").alias("ts"), "bytes", "object_total").coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(root)
    seen = []
    query = throttle(stream, 0.5).writeStream.option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True)
    query = query.foreachBatch(lambda batch, k: seen.extend((k, *row) for row in batch.collect())).start()
    query.awaitTermination()
    assert {k for k, *_ in seen} == {0, 1} and len(seen) == len({r[1:] for r in seen})
    # A batch is in order in itself; the second goes on from the first.
    last, want = {}, set()
    for part in (rows[:200], rows[200:]):
        for t, o, seq, micros, moved, total in sorted(part, key=lambda r: (r[3], r[2])):
            if min(max(moved, 0), total) >= total or (t, o) not in last or micros - last[t, o] >= 500_000:
                last[t, o] = micros
                want.add((t, o, seq, moved))
    assert {r[1:] for r in seen} == want
