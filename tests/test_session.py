"""The package reaches the executors, and partition columns stay text."""

import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from daykeeper.sources.sinks import publish_verified_days, read_published
from daykeeper.sources.tables import scan_day_tables

ROOT = Path(__file__).resolve().parent.parent

CODE = """
import sys
sys.path.insert(0, {root!r})
from daykeeper.session import build_session, ship_package
spark = build_session("ship", "local[1]", **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {folder!r}}})
ship_package(ship_package(spark))
from daykeeper.sources.tables import observe_objects
rows = spark.createDataFrame([("c", "2024-01-01", "k", "raw", {folder!r} + "/none")], "collector STRING, archive_date STRING, relative_key STRING, kind STRING, uri STRING")
print("REASON", observe_objects(rows, 1).first()["reason"])
"""


def test_python_operators_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=str(ROOT), folder=str(tmp_path))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "REASON missing" in done.stdout, done.stderr[-2000:]


def test_collector_007_stays_as_it_is(spark, tmp_path):
    rows = spark.createDataFrame([("007", "2024-01-01", 1), ("12", "2024-01-01", 2)], "collector STRING, archive_date STRING, v INT")
    rows.withColumnRenamed("archive_date", "date").write.partitionBy("collector", "date").parquet(str(tmp_path / "t"))
    assert {r["collector"] for r in scan_day_tables(spark, str(tmp_path / "t")).collect()} == {"007", "12"}
    verdicts = rows.select("collector", "archive_date", F.lit("verified").alias("status"))
    publish_verified_days(rows, verdicts, str(tmp_path / "d"), str(tmp_path / "r"))
    assert {(r["collector"], r["v"]) for r in read_published(spark, str(tmp_path / "d"), str(tmp_path / "r")).collect()} == {("007", 1), ("12", 2)}
