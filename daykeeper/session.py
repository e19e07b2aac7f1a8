"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import functools
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "daykeeper", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, AQE and skew handling; ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call sites of single column expressions are not needed and slow down plan building.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.python.unix.domain.socket.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.lru_cache(maxsize=8)
def _shipped(app_id: str) -> str:
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    target = Path(tempfile.mkdtemp(prefix="daykeeper-")) / f"daykeeper-{app_id}.zip"
    target.write_bytes(packed.getvalue())
    return str(target)


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, so that Python operators load there from wherever the job starts.

    The archive lies on the driver, whose file server hands it out; once per application. Nothing to do
    where the package itself was started from an archive.
    """
    context = spark.sparkContext
    name = f"daykeeper-{context.applicationId}.zip"
    if Path(__file__).is_file() and not any(str(f).endswith(name) for f in context._jsc.sc().listFiles().mkString("\n").split("\n")):
        context.addPyFile(_shipped(context.applicationId))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A cluster must name one that all executors see. Only a local-mode session, where driver and
    executors are one process, gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        folder = named
    elif spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    elif spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="daykeeper-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes the rows and cuts the lineage; survives executor loss."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
