"""Days published by pointer: each publication writes folders of its own, and a log entry makes them visible at once.

Below the root: ``data/version=V/collector=C/archive_date=D`` holds rows, ``pointers/P`` the days that a
publication points to its version, and ``log/N`` the publications in order. Nothing is ever overwritten,
so a publication that stops half-way changes nothing for readers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daykeeper.operators.reconcile import DAY
from daykeeper.session import durable
from daykeeper.sources.named import arrow_uri
from daykeeper.sources.sinks import report_text
from daykeeper.sources.tables import read_partitioned
from daykeeper.sources.tree import list_folders

_POINTERS = "collector STRING, archive_date STRING, version STRING, report STRING"


class VersionConflict(RuntimeError):
    """Another publication pointed some of the same days elsewhere after this one had read them."""


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _log(spark: SparkSession, root: str) -> list[tuple[int, str, bool]]:
    """Publications in order: number, pointers, whether they stand for all before."""
    files, place = _hadoop(spark, f"{root}/log")
    if not files.exists(place):
        return []
    out = []
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if name[:1] not in "._":
            number, pointers, kind = name.split("-")
            out.append((int(number), pointers, kind == "base"))
    return sorted(out)


def _commit(spark: SparkSession, root: str, number: int, pointers: str, kind: str = "days") -> bool:
    """Whether entry ``number`` is ours: its claim is a file that only one creator can make."""
    files, place = _hadoop(spark, f"{root}/log/.claims/{number:012d}")
    try:
        files.create(place, False).close()
    except Exception as error:  # noqa: BLE001 - the JVM's own exception class
        if "AlreadyExists" not in str(error) and "already exists" not in str(error):
            raise
        return False
    files, place = _hadoop(spark, f"{root}/log/{number:012d}-{pointers}-{kind}")
    files.create(place, False).close()
    return True


def current_versions(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """DAY, version, report, entry: where the newest publication of every day points."""
    log = [e for e in _log(spark, root) if upto is None or e[0] <= upto]
    bases = [k for k, e in enumerate(log) if e[2]]
    log = log[bases[-1] :] if bases else log
    if not log:
        return spark.createDataFrame([], f"{_POINTERS}, entry BIGINT")
    numbers = F.create_map(*[F.lit(x) for number, pointers, _ in log for x in (pointers, number)])
    rows = spark.read.schema(_POINTERS).parquet(*[f"{root}/pointers/{pointers}" for _, pointers, _ in log])
    held = rows.withColumn("entry", numbers[F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)].cast("bigint"))
    newest = held.groupBy(*DAY).agg(F.max_by(F.struct("version", "report", "entry"), F.col("entry")).alias("_p"))
    return newest.select(*DAY, "_p.*")


def last_entry(spark: SparkSession, root: str) -> int:
    log = _log(spark, root)
    return log[-1][0] if log else 0


def write_version(rows: DataFrame, verdicts: DataFrame, root: str) -> tuple[str, str]:
    """Rows and pointers of the verified days, not yet visible; returns the version and the pointers' name."""
    version, pointers = uuid.uuid4().hex, uuid.uuid4().hex
    passed = durable(verdicts.where(F.col("status") == "verified"))
    kept = rows.join(passed.select(*DAY), DAY, "left_semi")
    kept.hint("rebalance", *[F.col(c) for c in DAY]).write.partitionBy(*DAY).parquet(f"{root}/data/version={version}")
    pointed = report_text(passed).select(*DAY, F.lit(version).alias("version"), F.col("value").alias("report"))
    pointed.write.parquet(f"{root}/pointers/{pointers}")
    return version, pointers


def publish_versions(rows: DataFrame, verdicts: DataFrame, root: str, seen: int | None = None) -> int:
    """Publishes the rows of verified days beside what is there, and then lets readers see them at once.

    ``seen`` is the log entry on which the verdicts rest (by default the last one now). Where another
    publication has pointed one of the same days elsewhere since, ``VersionConflict`` is raised and
    nothing becomes visible; days of others do not matter. Returns the entry of this publication.
    """
    spark = rows.sparkSession
    seen = last_entry(spark, root) if seen is None else seen
    _, pointers = write_version(rows, verdicts, root)
    own = spark.read.schema(_POINTERS).parquet(f"{root}/pointers/{pointers}").select(*DAY)
    while True:
        last = last_entry(spark, root)
        if last > seen:
            newer = current_versions(spark, root).where(F.col("entry") > seen)
            if newer.join(own, DAY, "left_semi").limit(1).count():
                raise VersionConflict(f"days were published by an entry after {seen}")
        if _commit(spark, root, last + 1, pointers):
            return last + 1
        if last_entry(spark, root) == last:
            # A publication that stopped between its claim and its entry: its number stays empty.
            if _commit(spark, root, last + 2, pointers):
                return last + 2


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the current version of every published day; ``version`` is kept as a column."""
    keys = ["version", *DAY]
    pointed = current_versions(spark, root).select(*keys)
    return read_partitioned(spark, f"{root}/data", keys).join(pointed, keys, "left_semi")


def compact_log(spark: SparkSession, root: str) -> int:
    """One entry with the newest pointers of all days, so that readers need not go further back."""
    last = last_entry(spark, root)
    pointers = uuid.uuid4().hex
    current_versions(spark, root, last).select(*DAY, "version", "report").write.parquet(f"{root}/pointers/{pointers}")
    if not _commit(spark, root, last + 1, pointers, "base"):
        raise VersionConflict("the log went on meanwhile")
    return last + 1


def orphans(spark: SparkSession, root: str) -> DataFrame:
    """version and DAY of the folders to which no day points: left by stopped publications, or replaced."""
    found = list_folders(spark, f"{root}/data", ("version", *DAY))
    return found.join(current_versions(spark, root), ["version", *DAY], "left_anti")


def sweep(spark: SparkSession, root: str, running: list[str] | None = None) -> int:
    """Deletes the folders of ``orphans`` in tasks, but for versions of publications that are ``running``; readers that
    resolved their pointers before a republication must be done by then. Returns how many went."""
    gone = orphans(spark, root)
    gone = gone.where(~F.col("version").isin(running)) if running else gone
    paths = gone.select(F.concat(F.lit("version="), "version", F.lit("/collector="), "collector", F.lit("/archive_date="), "archive_date").alias("path"))
    base = arrow_uri(f"{root}/data").rstrip("/")

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        store, place = pafs.FileSystem.from_uri(base)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if store.get_file_info(f"{place}/{path}").type == pafs.FileType.Directory:
                    store.delete_dir(f"{place}/{path}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    listed = durable(paths)
    return listed.mapInArrow(delete, "n BIGINT").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
