"""Session settings and the lineage-cutting helper."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own.

    Python workers find the package through PYTHONPATH wherever the session is started; on a cluster it is
    shipped with :func:`ship_package` or installed.
    """
    root = str(Path(__file__).resolve().parents[1])
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("harmattan")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("HARMATTAN_LOCAL_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a running session, for clusters where it is not installed."""
    import shutil

    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/harmattan", "zip", Path(__file__).resolve().parents[1], "harmattan")
    spark.sparkContext.addPyFile(archive)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder; on any other master that would be a different
    folder on every machine, so it is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="harmattan-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and lets every later reader prune
    columns and push filters into the files.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
