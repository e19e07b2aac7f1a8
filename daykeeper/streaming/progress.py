"""Live transfer progress."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from daykeeper.contracts import PUBLISH_SECONDS
from daykeeper.operators.telemetry import SPEED_STAGES, speed_step

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Objects without an end are folded together in so many buckets; each keeps a state entry of its own.
OBJECT_BUCKETS = 4096


def stream_progress(progress: DataFrame) -> DataFrame:
    """High water of each object; run it in update mode. Late and repeated updates do no harm.

    The state is one number per object; maxima combine before the shuffle.
    """
    clamped = F.greatest(F.least(F.col("bytes"), F.col("object_total")), F.lit(0).cast("bigint"))
    reached = F.when(F.col("completed"), F.col("object_total")).otherwise(clamped)
    return progress.groupBy("transfer_id", "object_name").agg(
        F.max(reached).alias("object_bytes"), F.max("object_total").alias("object_total")
    )


def transfer_totals(objects: DataFrame, totals: DataFrame) -> DataFrame:
    """Transfer figures from the latest object rows of ``stream_progress``, against the bytes that the manifest lists
    (``totals``: transfer_id, bytes_total). A transfer without updates yet has none done."""
    done = objects.groupBy("transfer_id").agg(F.sum("object_bytes").alias("_done"))
    joined = totals.select("transfer_id", "bytes_total").join(done, "transfer_id", "left")
    return joined.select("transfer_id", F.least(F.coalesce("_done", F.lit(0).cast("bigint")), "bytes_total").alias("bytes_completed"), "bytes_total")


def micros_of(ts: Column) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))


@dataclass(frozen=True)
class Ending:
    """When the state of a key goes: ``idle_seconds`` of event time after its last update, or ``settle_seconds`` after
    one that completes it. Updates more than ``late_seconds`` behind the newest are dropped as late; one that comes
    after its key's state went starts the key anew."""

    idle_seconds: float = 3600.0
    settle_seconds: float = 60.0
    late_seconds: float = 0.0

    def hold(self, state: GroupState, last_micros: int, complete: bool) -> None:
        after = self.settle_seconds if complete else self.idle_seconds
        state.setTimeoutTimestamp(max(last_micros // 1000 + int(after * 1000), state.getCurrentWatermarkMs() + 1))


def _stateful(
    stream: DataFrame, keys: list[str], columns: list[str], out: T.StructType, state: T.StructType, fold: Callable, ending: Ending | None = None, mode: str = "append"
) -> DataFrame:
    """``fold(key, frames, state)`` over the updates of each key; with an ``ending`` it is not called for a key whose
    time is over, and must say by ``ending.hold`` when that is."""
    if ending is None:
        slim = stream.select(*keys, micros_of(F.col("ts")).alias("micros"), *columns)
        return slim.groupBy(*keys).applyInPandasWithState(fold, out, state, mode, GroupStateTimeout.NoTimeout)

    def until_over(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        yield from fold(key, frames, held)

    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{ending.late_seconds} seconds")
    slim = timed.select(*keys, F.unix_micros("ts").alias("micros"), *columns, "ts")
    return slim.groupBy(*keys).applyInPandasWithState(until_over, out, state, mode, GroupStateTimeout.EventTimeTimeout)


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    # One key's rows of one micro-batch; the source's rate limit bounds them.
    return pd.concat(frames, ignore_index=True).sort_values(["micros", "seq"], kind="stable")


def ending_progress(stream: DataFrame, ending: Ending = Ending()) -> DataFrame:  # noqa: B008 - frozen
    """``stream_progress`` whose state ends: high water of each object after every micro-batch; run it in update mode.

    A key's frames are folded one by one, so a hot object is never one frame.
    """
    keys = ["transfer_id", "object_name"]
    schema = T.StructType([stream.schema[k] for k in keys] + [T.StructField("object_bytes", T.LongType()), T.StructField("object_total", T.LongType())])

    def rise(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, whole, last, complete = (*state.get,) if state.exists else (0, 0, 0, False)
        for frame in frames:
            reached = frame["bytes"].clip(lower=0).where(frame["bytes"] <= frame["object_total"], frame["object_total"])
            reached = reached.where(~frame["completed"], frame["object_total"])
            high, whole = max(high, int(reached.max())), max(whole, int(frame["object_total"].max()))
            last, complete = max(last, int(frame["micros"].max())), complete or bool(frame["completed"].any())
        state.update((high, whole, last, complete))
        ending.hold(state, last, complete)
        yield pd.DataFrame([(*key, high, whole)], columns=schema.names)

    held = T.StructType([T.StructField("high", T.LongType()), T.StructField("total", T.LongType()), T.StructField("last", T.LongType()), T.StructField("complete", T.BooleanType())])
    return _stateful(stream, keys, ["bytes", "object_total", "completed"], schema, held, rise, ending, "update")


def shown_updates(updates: Iterable[tuple], last: int | None, gap: int) -> tuple[list[int], int | None]:
    """Which of an object's updates (micros, bytes, object_total, in order) are shown, and when the last one was."""
    kept = []
    for k, (at, moved, total) in enumerate(updates):
        if min(max(moved, 0), total) >= total or last is None or at - last >= gap:
            last = int(at)
            kept.append(k)
    return kept, last


def _number(value: int | None) -> float:
    """As in a data frame: what is missing compares as false."""
    return math.nan if value is None else value


class Throttle(StatefulProcessor):
    """Keeps the updates that are shown, of all objects of a bucket. The state of an object is when it last showed one,
    an entry of its own: a micro-batch reads and writes only the objects that it names."""

    def __init__(self, columns: list[str], object_schema: str, gap: int):
        self.columns, self.object_schema, self.gap = columns, object_schema, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getMapState("shown", self.object_schema, "last BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        # A bucket's rows of one micro-batch; the source's rate limit and the number of buckets bound them.
        objects: dict[tuple, list[Row]] = {}
        for row in rows:
            objects.setdefault((row["transfer_id"], row["object_name"]), []).append(row)
        known = self.shown.exists()
        for name, updates in objects.items():
            updates.sort(key=lambda r: (r["micros"] is None, r["micros"] or 0, r["seq"] is None, r["seq"] or 0))
            before = self.shown.getValue(name) if known else None
            numbers = [(_number(r["micros"]), _number(r["bytes"]), _number(r["object_total"])) for r in updates]
            kept, last = shown_updates(numbers, before[0] if before else None, self.gap)
            if kept:
                self.shown.updateValue(name, (last,))
            for k in kept:
                yield Row(**{c: updates[k][c] for c in self.columns})

    def close(self) -> None:
        pass


def throttle(stream: DataFrame, seconds: float = PUBLISH_SECONDS, ending: Ending | None = None) -> DataFrame:
    """Drops an object's updates closer than ``seconds`` to its last kept one, unless complete. With an ``ending`` an
    object's state goes; without, it stays for the life of the stream, and as a data frame for each object takes
    milliseconds, objects are then folded by buckets."""
    keys = ["transfer_id", "object_name"]
    gap = round(seconds * 1e6)
    schema = T.StructType(
        [stream.schema["transfer_id"], stream.schema["object_name"], stream.schema["seq"], T.StructField("bytes", T.LongType())]
    )
    if ending is None:
        stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(OBJECT_BUCKETS)).alias("bucket")
        slim = stream.select(*keys, micros_of(F.col("ts")).alias("micros"), "seq", "bytes", "object_total", bucket)
        objects = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
        return slim.groupBy("bucket").transformWithState(Throttle(schema.names, objects, gap), schema, outputMode="append", timeMode="none")

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = _in_order(frames)
        kept, last = shown_updates(zip(rows["micros"], rows["bytes"], rows["object_total"]), last, gap)
        state.update((last,))
        ending.hold(state, int(rows["micros"].iloc[-1]), bool((rows["bytes"] >= rows["object_total"]).iloc[-1]))
        yield rows.iloc[kept][schema.names]

    state = T.StructType([T.StructField("last", T.LongType())])
    return _stateful(stream, keys, ["seq", "bytes", "object_total"], schema, state, keep, ending)


def stream_speed(stream: DataFrame, ending: Ending | None = None) -> DataFrame:
    """Smoothed speed after each update of a transfer, live. With an ``ending`` a silent transfer's state goes, and
    an update after that is its first again."""
    schema = T.StructType(
        [stream.schema["transfer_id"], stream.schema["seq"], T.StructField("speed", T.DoubleType())]
    )
    state_schema = T.StructType(
        [
            T.StructField("micros", T.LongType()),
            T.StructField("base", T.LongType()),
            T.StructField("speed", T.DoubleType()),
        ]
    )

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = tuple(state.get) if state.exists else (None, 0, None)
        rows = _in_order(frames)
        speeds = []
        for at, stage, moved in zip(rows["micros"], rows["stage"], rows["network_bytes"]):
            if stage in SPEED_STAGES:
                current = speed_step(current, int(at), int(moved), stage == "switching")
            speeds.append(current[2])
        state.update(current)
        if ending:
            ending.hold(state, int(rows["micros"].iloc[-1]), False)
        out = rows[["transfer_id", "seq"]].copy()
        out["speed"] = pd.array(speeds, dtype="Float64")
        yield out

    return _stateful(stream, ["transfer_id"], ["seq", "stage", "network_bytes"], schema, state_schema, follow, ending)
