"""Transfer attempts, progress and run logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daykeeper.contracts import DOWNLOAD_SHARE, SPEED_GAIN, SPEED_KEEP, SPEED_SAMPLE_SECONDS
from daykeeper.operators.reconcile import DAY
from daykeeper.operators.scans import chunked_running, time_chunk

ATTEMPT = [*DAY, "object_pos", "relative_key"]
DAY_SECONDS = 86_400


def object_source_fallback(attempts: DataFrame) -> DataFrame:
    """Per object the first source that worked, the sources tried and the bytes moved.

    ``attempts``: ATTEMPT, attempt, source, ok, network_bytes; at most one row per source, and the
    sources after the first success are not tried.
    """
    ok = F.col("ok")
    grouped = attempts.groupBy(*ATTEMPT).agg(
        F.min_by(F.when(ok, F.col("source")), F.when(ok, F.col("attempt"))).alias("source"),
        F.min(F.when(ok, F.col("attempt"))).alias("_done"),
        F.array_sort(F.collect_list(F.struct("attempt", "source", "ok", "network_bytes"))).alias("_tried"),
    )
    tried = F.filter("_tried", lambda a: F.col("_done").isNull() | (a["attempt"] <= F.col("_done")))
    moved = F.aggregate(tried, F.lit(0).cast("bigint"), lambda acc, a: acc + F.coalesce(a["network_bytes"], F.lit(0).cast("bigint")))
    return grouped.select(
        *ATTEMPT,
        "source",
        F.transform(tried, lambda a: a["source"]).alias("attempted"),
        (F.size(tried) - 1).cast("bigint").alias("fallbacks"),
        moved.alias("network_bytes"),
        F.when(F.col("_done").isNull(), F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
    )


def fallback_warnings(attempts: DataFrame) -> DataFrame:
    """One row per failed attempt that was followed by another source, in object order.

    Kept as rows: a day's warnings have no bound. The window spans one object's few attempts.
    """
    along = Window.partitionBy(*ATTEMPT).orderBy("attempt")
    done = F.min(F.when(F.col("ok"), F.col("attempt"))).over(Window.partitionBy(*ATTEMPT))
    marked = attempts.withColumns({"fallback": F.lead("source").over(along), "_done": done})
    real = F.col("_done").isNull() | (F.col("attempt") < F.col("_done"))
    return marked.where(~F.col("ok") & F.col("fallback").isNotNull() & real).select(
        *ATTEMPT, "attempt", "source", "fallback", "error"
    )


def transfer_rollup(attempts: DataFrame) -> DataFrame:
    """Per day: ordered distinct sources attempted and completed, the active source, bytes, warnings.

    The window spans one object's few attempts. Rows are then reduced to one per day and source
    before any list is built, so lists are as long as there are sources, however many objects a day
    has.
    """
    along = Window.partitionBy(*ATTEMPT)
    marked = attempts.select(
        *ATTEMPT, "attempt", "source", "network_bytes",
        F.min("attempt").over(along).alias("_first"),
        F.min(F.when(F.col("ok"), F.col("attempt"))).over(along).alias("_done_at"),
    )
    tried = marked.where(F.col("_done_at").isNull() | (F.col("attempt") <= F.col("_done_at")))
    once = F.col("attempt") == F.col("_first")
    by_source = tried.groupBy(*DAY, "source").agg(
        F.min(F.struct("object_pos", "attempt")).alias("_tried"),
        F.min(F.when(F.col("attempt") == F.col("_done_at"), F.col("object_pos"))).alias("_done"),
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(once).alias("_objects"),
        F.count_if(once & F.col("_done_at").isNull()).alias("_failed"),
        F.sum("network_bytes").alias("_bytes"),
    )

    def ordered(at: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.col(at).isNotNull(), F.struct(at, "source"))))
        names = F.transform(listed, lambda entry: entry["source"])
        return F.when(F.size(names) > 0, names)

    active = F.when(F.size("sources_completed") == 1, F.get("sources_completed", F.lit(0))).otherwise(F.lit("mixed"))
    return (
        by_source.groupBy(*DAY)
        .agg(
            F.sum("_objects").alias("objects"),
            F.sum("_failed").alias("failed_objects"),
            F.sum("_bytes").alias("network_bytes"),
            (F.sum("_rows") - F.sum("_objects")).alias("warnings"),
            ordered("_tried").alias("sources_attempted"),
            ordered("_done").alias("sources_completed"),
        )
        .withColumn("active_source", active)
    )


def planned_bytes(entries: DataFrame) -> DataFrame:
    """transfer_id, bytes_total of each transfer from the manifest entries it fetches (transfer_id, size_bytes)."""
    return entries.groupBy("transfer_id").agg(F.sum("size_bytes").cast("bigint").alias("bytes_total"))


def transfer_high_water(progress: DataFrame, totals: DataFrame, chunk_seconds: int = DAY_SECONDS) -> DataFrame:
    """Monotone progress: bytes per object, bytes of the transfer and overall position.

    ``progress``: transfer_id, object_name, seq, ts, bytes, object_total, completed. ``totals``:
    transfer_id, bytes_total of all that the manifest lists, whether an update has named it yet or not
    (``planned_bytes``); a transfer of nothing is at its end, one without a total has no position. Two
    chunked scans: the running maximum of clamped bytes per object, then the running sum of its
    increments over the transfer.
    """
    clamped = F.greatest(F.least(F.col("bytes"), F.col("object_total")), F.lit(0).cast("bigint"))
    reached = F.when(F.col("completed"), F.col("object_total")).otherwise(clamped)
    chunked = progress.withColumn("_chunk", time_chunk(F.col("ts"), chunk_seconds))
    highs = chunked_running(
        chunked, ["transfer_id", "object_name"], "_chunk", ["ts", "seq"], {"object_bytes": ("max", reached)}
    )
    step = F.col("object_bytes") - F.coalesce("object_bytes_before", F.lit(0).cast("bigint"))
    summed = chunked_running(
        highs.withColumn("_step", step), ["transfer_id"], "_chunk", ["ts", "seq"], {"sum_bytes": ("sum", F.col("_step"))}
    )
    capped = F.when(F.col("bytes_total").isNotNull(), F.least("sum_bytes", "bytes_total"))
    share = F.when(F.col("bytes_total") == 0, F.lit(1.0)).otherwise(capped / F.col("bytes_total"))
    return summed.join(totals.select("transfer_id", "bytes_total"), "transfer_id", "left").select(
        "transfer_id",
        "object_name",
        "seq",
        "object_bytes",
        capped.alias("bytes_completed"),
        "bytes_total",
        F.floor(share * DOWNLOAD_SHARE).cast("bigint").alias("overall"),
    )


def smooth(speed: float | None, instant: float) -> float:
    return instant if speed is None else speed * SPEED_KEEP + instant * SPEED_GAIN


#: Updates of other stages say nothing of the speed and are passed over.
SPEED_STAGES = ("downloading", "switching")
SAMPLE_MICROS = round(SPEED_SAMPLE_SECONDS * 1e6)


def speed_step(state: tuple, micros: int, moved: int, switching: bool) -> tuple:
    """Next (sample micros, sample bytes, speed) of a transfer after one update."""
    at, base, speed = state
    if switching:
        return None, base, None
    if at is None or moved < base:
        return micros, moved, speed
    # Whole microseconds, so that a gap of exactly the sample time counts as one.
    elapsed = micros - at
    if elapsed < SAMPLE_MICROS:
        return state
    if moved > base:
        speed = smooth(speed, (moved - base) / (elapsed / 1e6))
    return micros, moved, speed


def _micros() -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz"))


def _pieces(progress: DataFrame, chunk_seconds: int) -> DataFrame:
    """Cuts each transfer into pieces that start where the sample point is known.

    After a source switch, after a pause of at least the sample time, and at the start, an update
    fixes the sample point whatever came before. A piece is the stretch from such an update on, by
    the time slice of that update, so a hot transfer has as many pieces as time slices.
    """
    base = progress.where(F.col("stage").isin(*SPEED_STAGES)).select(
        "transfer_id", "seq", "ts", _micros().alias("micros"), (F.col("stage") == "switching").alias("switching"),
        "network_bytes", "remaining_bytes", time_chunk(F.col("ts"), chunk_seconds).alias("_chunk"),
    )
    along = (["transfer_id"], "_chunk", ["ts", "seq"])
    seen = chunked_running(base, *along, {"_at": ("last", F.struct("micros", "switching"))}).drop("_at")
    previous = F.col("_at_before")
    fixed = (
        F.col("switching")
        | previous.isNull()
        | F.coalesce(previous["switching"], F.lit(True))
        | (F.col("micros") - previous["micros"] >= SAMPLE_MICROS)
    )
    cut = chunked_running(seen, *along, {"piece": ("last", F.when(fixed, F.col("_chunk")))})
    return cut.select("transfer_id", "piece", "micros", "seq", "switching", "network_bytes", "remaining_bytes")


def _runs(frames: Iterator[pd.DataFrame], keys: list[str], columns: list[str]) -> Iterator[tuple]:
    """(key, is first of its run, row values) of rows sorted by key, batch after batch."""
    current = None
    for frame in frames:
        for key, values in zip(zip(*(frame[k] for k in keys)), zip(*(frame[c].to_list() for c in columns))):
            yield key, key != current, values
            current = key


_UPDATE = ["micros", "network_bytes", "switching"]
_SUMMARY = (
    "piece BIGINT, micros BIGINT, moved BIGINT, switching BOOLEAN, last_at BIGINT, last_base BIGINT, settled BOOLEAN, "
    "from_none DOUBLE, from_zero DOUBLE, decay DOUBLE"
)


def _summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per piece: what it does to any speed it may be entered with.

    The speed is affine in the entry speed: the fold runs from no speed and from zero, and ``decay``
    is the factor of the entry speed. A switch settles it.
    """
    names = ["transfer_id", *[field.split()[0] for field in _SUMMARY.split(", ")]]
    rows: list[tuple] = []
    held: list | None = None

    def close() -> tuple:
        key, first, none, zero, decay, settled = held
        return (*key, *first, none[0], none[1], settled, none[2], zero[2], decay)

    for key, starts, (micros, moved, switching) in _runs(frames, ["transfer_id", "piece"], _UPDATE):
        micros, moved, switching = int(micros), int(moved), bool(switching)
        if starts:
            if held is not None:
                rows.append(close())
            point = (None, 0) if switching else (micros, moved)
            held = [key, (micros, moved, switching), (*point, None), (*point, None if switching else 0.0), 1.0, switching]
        else:
            _, _, none, zero, decay, settled = held
            sampled = not switching and none[0] is not None and moved > none[1] and micros - none[0] >= SAMPLE_MICROS
            held[2] = speed_step(none, micros, moved, switching)
            held[3] = speed_step(zero, micros, moved, switching)
            held[4] = decay * SPEED_KEEP if sampled else decay
            held[5] = settled or switching
        if len(rows) >= 10_000:
            yield _nullable(rows, names)
            rows = []
    if held is not None:
        rows.append(close())
    if rows:
        yield _nullable(rows, names)


def _nullable(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    return frame.convert_dtypes(convert_floating=True, convert_integer=True)


def _enter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state each piece is entered with, from the summaries of a transfer's earlier pieces."""
    columns = ["piece", "micros", "moved", "switching", "last_at", "last_base", "settled", "from_none", "from_zero", "decay"]
    rows: list[tuple] = []
    state: tuple = (None, 0, None)

    def known(value):
        return None if pd.isna(value) else value

    for (transfer,), starts, values in _runs(frames, ["transfer_id"], columns):
        piece, micros, moved, switching, last_at, last_base, settled, none, zero, decay = map(known, values)
        state = (None, 0, None) if starts else state
        rows.append((transfer, piece, *state))
        speed = speed_step(state, int(micros), int(moved), bool(switching))[2]
        leaves = none if settled or speed is None else decay * speed + zero
        state = (None if last_at is None else int(last_at), int(last_base), leaves)
    if rows:
        yield _nullable(rows, ["transfer_id", "piece", "entry_at", "entry_base", "entry_speed"])


def _follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Speed after each update, piece by piece, holding one state."""
    current, state = None, (None, 0, None)
    columns = ["transfer_id", "piece", *_UPDATE, "entry_at", "entry_base", "entry_speed"]
    for frame in frames:
        speeds = []
        for transfer, piece, micros, moved, switching, at, base, speed in zip(*(frame[c].to_list() for c in columns)):
            if (transfer, piece) != current:
                current = (transfer, piece)
                state = (None if pd.isna(at) else int(at), int(base), None if pd.isna(speed) else float(speed))
            state = speed_step(state, int(micros), int(moved), bool(switching))
            speeds.append(state[2])
        out = frame[["transfer_id", "seq"]].copy()
        out["speed"] = pd.array(speeds, dtype="Float64")
        out["eta_seconds"] = frame["remaining_bytes"].clip(lower=0).astype("Float64") / out["speed"]
        yield out


def transfer_speed(progress: DataFrame, chunk_seconds: int = DAY_SECONDS) -> DataFrame:
    """Smoothed speed and remaining seconds after each update.

    ``progress``: transfer_id, seq, ts, stage, network_bytes, remaining_bytes. The smoothing is a chain
    over a transfer's updates, so a transfer is cut into pieces (``_pieces``) that are folded in three
    steps: each piece is summarised for any entry speed, the few summaries of a transfer are chained
    to entry states, and each piece is followed from its entry state. Pieces are shuffled and sorted
    with spill and stream by in Arrow batches; no task holds a transfer.
    """
    fields = {f.name: f.dataType.simpleString() for f in progress.schema.fields}
    key = f"transfer_id {fields['transfer_id']}"
    placed = _pieces(progress, chunk_seconds).repartition("transfer_id", "piece")
    order = ["transfer_id", "piece", "micros", "seq"]
    summaries = placed.sortWithinPartitions(*order).mapInPandas(_summarise, f"{key}, {_SUMMARY}")
    entries = (
        summaries.repartition("transfer_id")
        .sortWithinPartitions("transfer_id", "piece")
        .mapInPandas(_enter, f"{key}, piece BIGINT, entry_at BIGINT, entry_base BIGINT, entry_speed DOUBLE")
    )
    # Every piece has an entry; the left join keeps both uses of ``placed`` one shuffle.
    entered = placed.join(entries, ["transfer_id", "piece"], "left").repartition("transfer_id", "piece")
    return entered.sortWithinPartitions(*order).mapInPandas(
        _follow, f"{key}, seq {fields['seq']}, speed DOUBLE, eta_seconds DOUBLE"
    )


def latest_run(logs: DataFrame, since: Column, keys: list[str]) -> DataFrame:
    """The newest log not older than one second before ``since``, with its failed profiles.

    ``logs``: keys, file_name, modified (seconds), success, profiles array<struct<profile_id, success, error>>.
    """
    recent = logs.where(F.col("modified") >= since - 1)
    names = [name for name in logs.columns if name not in keys]
    picked = recent.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct("modified", "file_name")).alias("_log"))
    failures = F.filter("_log.profiles", lambda p: ~F.coalesce(p["success"], F.lit(False)))
    return picked.select(
        *keys,
        F.col("_log.file_name").alias("file_name"),
        F.col("_log.success").alias("success"),
        F.coalesce(F.size("_log.profiles"), F.lit(0)).cast("bigint").alias("profiles"),
        F.transform(failures, lambda p: F.coalesce(p["profile_id"], F.lit("unknown"))).alias("failed_profiles"),
    )
