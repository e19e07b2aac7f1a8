"""Writers: canonical JSON reports and verified day tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daykeeper.functions.canonical import canonical_json
from daykeeper.sources.tables import read_partitioned, spread_objects

#: Reports that one task writes.
REPORTS_TOGETHER = 64


def report_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """collector, archive_date and the canonical JSON report of each row."""
    names = columns or df.columns
    return df.select("collector", "archive_date", canonical_json(df, names).alias("value"))


def write_report(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One canonical JSON document per row below ``collector=/archive_date=``.

    The output commit replaces a day's folder as a whole; other days stay. Reports are spread over tasks by their
    number: a few hundred bytes each, thousands would meet in one task that opens a file for each.
    """
    (
        spread_objects(report_text(df, columns), ["collector", "archive_date"], REPORTS_TOGETHER)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("collector", "archive_date")
        .text(path)
    )


def publish_verified_days(rows: DataFrame, verdicts: DataFrame, data_path: str, report_path: str) -> None:
    """Writes the rows of verified days, then their reports; a failed day leaves nothing visible.

    Data first, reports second: a reader takes a day as published once its report exists. The
    rebalance hint gathers each day into few files and lets AQE split a day that holds most rows.
    """
    # Used for the data and for the reports: kept meanwhile, recomputed if an executor is lost.
    passed = verdicts.where(F.col("status") == "verified").persist()
    try:
        _publish(rows, passed, data_path, report_path)
    finally:
        passed.unpersist()


def _publish(rows: DataFrame, passed: DataFrame, data_path: str, report_path: str) -> None:
    days = passed.select("collector", "archive_date")
    kept = rows.join(days, ["collector", "archive_date"], "left_semi")
    (
        kept.hint("rebalance", F.col("collector"), F.col("archive_date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("collector", "archive_date")
        .parquet(data_path)
    )
    write_report(passed, report_path)


def read_published(spark, data_path: str, report_path: str) -> DataFrame:
    """Rows of days whose report exists."""
    keys = "collector STRING, archive_date STRING"
    reported = spark.read.schema(f"value STRING, {keys}").text(report_path).select("collector", "archive_date").distinct()
    rows = read_partitioned(spark, data_path, ["collector", "archive_date"])
    return rows.join(reported, ["collector", "archive_date"], "left_semi")
