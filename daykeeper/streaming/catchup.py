"""The catch-up cycle: fetch what is new, verify it, publish it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from daykeeper.contracts import DEFAULT_CONTRACTS, Contracts
from daykeeper.operators.manifests import manifest_objects, validate_manifests
from daykeeper.operators.reconcile import DAY, catch_up_days, select_source, two_replica_gate, verify_objects
from daykeeper.operators.rollup import verify_days
from daykeeper.session import durable
from daykeeper.sources.documents import manifest_columns
from daykeeper.sources.sinks import publish_verified_days, write_report
from daykeeper.streaming.sinks import run_available


def catch_up_stream(
    documents: DataFrame,
    observed: Callable[[], DataFrame],
    markers: Callable[[], DataFrame],
    report_path: str,
    checkpoint: str,
    contracts: Contracts = DEFAULT_CONTRACTS,
) -> None:
    """Verifies the days of newly arrived manifest documents and writes their reports.

    ``documents`` is a stream of collector, replica, archive_date, raw, declared_sha256 and
    declared_size. ``observed`` and ``markers`` give the tables as they are at each cycle. A day with
    a verified marker of the same digest is skipped, so a repeated cycle changes nothing; a replayed
    micro-batch rewrites the same day folders. ``contracts`` names the archive's namespace. Only the days
    of the batch are taken from ``observed`` and ``markers``.
    """

    def cycle(batch: DataFrame, batch_id: int) -> None:
        # The checked manifests are used three times: kept for the cycle, recomputed if lost.
        checked = validate_manifests(manifest_columns(batch), contracts).persist()
        try:
            judge(checked)
        finally:
            checked.unpersist()

    def judge(checked: DataFrame) -> None:
        days = checked.select(*DAY).distinct()
        chosen = select_source(checked)
        available = chosen.select(*DAY, "replica", F.col("raw_sha256").alias("manifest_sha256"))
        todo = catch_up_days(available, markers().join(days, DAY, "left_semi")).where(F.col("action") == "fetch").drop("action")
        fetched = checked.join(todo, [*DAY, "replica"])
        declared = fetched.select(
            *DAY, "manifest_sha256", F.col("object_count").cast("bigint"), F.col("row_count").cast("bigint")
        )
        verdicts = verify_days(declared, verify_objects(manifest_objects(fetched), observed().join(days, DAY, "left_semi")))
        write_report(verdicts.where(F.col("status") == "verified"), report_path)

    run_available(documents, cycle, "append", checkpoint)


#: Columns of a document that are kept until its day can be judged.
_HELD = ["replica", "raw", "declared_sha256", "declared_size"]
_JUDGED = "collector STRING, archive_date STRING, replica STRING, raw BINARY, declared_sha256 STRING, declared_size BIGINT, gate STRING"
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ReplicaGate(StatefulProcessor):
    """Holds a day's manifests until all replicas are there, or until one stayed away for ``wait``.

    State of a day: the newest document of each replica. When all are held they go on together
    (``both``) and the state goes. When the timer of the first arrival fires, what is held goes on as
    ``waited`` and stays for another ``keep``, so that a late replica still meets it; then it goes too.
    """

    def __init__(self, replicas: int, wait_ms: int, keep_ms: int):
        self.replicas, self.wait_ms, self.keep_ms = replicas, wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "replica STRING", "raw BINARY, declared_sha256 STRING, declared_size BIGINT, arrived BIGINT")
        self.told = handle.getValueState("told", "at BIGINT")

    def _rows(self, key, gate: str) -> list[Row]:
        held = sorted(((replica[0], document) for replica, document in self.held.iterator()), key=lambda item: item[0])
        return [Row(collector=key[0], archive_date=key[1], replica=replica, raw=bytes(d[0]), declared_sha256=d[1], declared_size=d[2], gate=gate) for replica, d in held]

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.clear()
        self.told.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        first = None
        for row in rows:
            name, old = (row["replica"],), None
            if self.held.containsKey(name):
                old = self.held.getValue(name)
            # A replica that is seen again replaces what was held, in the order of arrival.
            if old is None or row["arrived"] >= old[3]:
                self.held.updateValue(name, (row["raw"], row["declared_sha256"], row["declared_size"], row["arrived"]))
            first = row["arrived"] if first is None else min(first, row["arrived"])
        if sum(1 for _ in self.held.keys()) >= self.replicas:
            out = self._rows(key, "both")
            self._forget()
            yield from out
        elif first is not None and not self.told.exists() and not list(self.handle.listTimers()):
            self.handle.registerTimer(first + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        if self.told.exists():
            self._forget()
            return
        out = self._rows(key, "waited")
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.keep_ms > 0:
            self.told.update((now,))
            self.handle.registerTimer(now + self.keep_ms)
        else:
            self._forget()
        yield from out

    def close(self) -> None:
        pass


def gated_documents(documents: DataFrame, wait_seconds: int, keep_seconds: int, late_seconds: int = 0, replicas: int = 2) -> DataFrame:
    """A stream of manifest documents grouped to whole days: columns of the documents and ``gate``.

    ``documents`` has collector, archive_date, replica, raw, declared_sha256, declared_size and
    ``arrived`` (event time). Replicas of a day may arrive in different micro-batches; they leave
    together. A day without all of them leaves ``wait_seconds`` after its first arrival. ``late_seconds``
    is how far arrivals may be out of order. Documents without a replica name are left out.
    """
    spark = documents.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    arrived = F.unix_millis(F.col("arrived").cast("timestamp"))
    timed = documents.where(F.col("replica").isNotNull()).withWatermark("arrived", f"{late_seconds} seconds")
    slim = timed.select(*DAY, *_HELD, F.col("arrived").alias("_event"), arrived.alias("arrived"))
    gate = ReplicaGate(replicas, wait_seconds * 1000, keep_seconds * 1000)
    return slim.groupBy(*DAY).transformWithState(gate, _JUDGED, outputMode="append", timeMode="eventTime")


@dataclass
class Cycle:
    """What a catch-up cycle reads and where it writes.

    ``observed``, ``markers`` and ``rows`` give the tables as they are at each cycle: observed objects,
    local markers, and the data rows of the days (``rows`` gets the days with the chosen replica).
    """

    observed: Callable[[], DataFrame]
    markers: Callable[[], DataFrame]
    rows: Callable[[DataFrame], DataFrame]
    data_path: str
    report_path: str
    decisions_path: str
    contracts: Contracts
    require_both: bool = True


def judge_days(cycle: Cycle, documents: DataFrame, batch_id: int) -> None:
    """One micro-batch of ``gated_documents``: gate, source, verification, publishing; and what was decided.

    Data becomes visible with its report, after it. Decisions are a folder for each batch, which a
    replay replaces; a replay publishes the same days again from the same inputs.
    """
    # Kept before anything reads them: each further reading of the batch would run its keyed state again.
    documents = durable(documents)
    checked = validate_manifests(manifest_columns(documents), cycle.contracts).persist()
    try:
        days = checked.select(*DAY).distinct()
        gates = two_replica_gate(checked, cycle.require_both).select(*DAY, F.col("reason").alias("gate_reason"), "warnings")
        admitted = gates.where(F.col("gate_reason").isNull()).select(*DAY)
        chosen = select_source(checked.join(admitted, DAY, "left_semi"))
        available = chosen.select(*DAY, "replica", F.col("raw_sha256").alias("manifest_sha256"))
        actions = catch_up_days(available, cycle.markers().join(days, DAY, "left_semi"))
        todo = actions.where(F.col("action") == "fetch").select(*DAY, "replica")
        fetched = checked.join(todo, [*DAY, "replica"], "left_semi")
        declared = fetched.select(*DAY, F.col("raw_sha256").alias("manifest_sha256"), F.col("object_count").cast("bigint"), F.col("row_count").cast("bigint"))
        verdicts = verify_days(declared, verify_objects(manifest_objects(fetched), cycle.observed().join(days, DAY, "left_semi"))).persist()
        try:
            publish_verified_days(cycle.rows(todo), verdicts, cycle.data_path, cycle.report_path)
            how = documents.groupBy(*DAY).agg(F.max("gate").alias("gate"))
            decided = (
                how.join(gates, DAY).join(actions.select(*DAY, "replica", "action"), DAY, "left")
                .join(verdicts.select(*DAY, F.col("status").alias("verdict"), F.col("reason").alias("verdict_reason")), DAY, "left")
            )
            decision = F.when(F.col("gate_reason").isNotNull(), F.lit("refused")).when(F.col("action") != "fetch", F.col("action"))
            reason = F.coalesce("gate_reason", "verdict_reason")
            shown = decided.select(*DAY, "gate", "replica", "warnings", decision.otherwise(F.col("verdict")).alias("decision"), reason.alias("reason"))
            shown.write.mode("overwrite").parquet(f"{cycle.decisions_path}/batch={batch_id}")
        finally:
            verdicts.unpersist()
    finally:
        checked.unpersist()


def gated_catch_up(documents: DataFrame, cycle: Cycle, checkpoint: str, wait_seconds: int = 3600, keep_seconds: int = 86_400, late_seconds: int = 0) -> None:
    """The catch-up cycle over a stream of documents whose replicas need not arrive together.

    Runs what the source has now; the state between runs lies in ``checkpoint``. With
    ``cycle.require_both`` a day without two equal valid replicas is refused with its reason, else the
    preferred valid one is taken.
    """
    gated = gated_documents(documents, wait_seconds, keep_seconds, late_seconds)
    run_available(gated, lambda batch, batch_id: judge_days(cycle, batch, batch_id), "append", checkpoint)


def read_decisions(spark: SparkSession, decisions_path: str) -> DataFrame:
    """The newest decision of every day."""
    rows = spark.read.option("basePath", decisions_path).parquet(decisions_path)
    values = [c for c in rows.columns if c not in (*DAY, "batch")]
    newest = rows.groupBy(*DAY).agg(F.max_by(F.struct(*values), F.col("batch")).alias("_row"))
    return newest.select(*DAY, "_row.*")


def read_reports_table(spark: SparkSession, report_path: str) -> DataFrame:
    """The reports written so far."""
    return spark.read.schema("value STRING, collector STRING, archive_date STRING").text(report_path)
