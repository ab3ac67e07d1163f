"""Session helpers: local sessions for tests, and the folder for cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession


def local_session(cores: int | str = "*", name: str = "textloom", shuffle: int = 8, memory: str = "6g") -> SparkSession:
    """A session on this machine, with the settings that tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset the master must be local; a temporary folder is then set for this session.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = os.path.join(tempfile.gettempdir(), "textloom-checkpoints")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, deleted when the driver ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def delete() -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            files.delete(path, True)

    files.deleteOnExit(path)
    atexit.register(delete)
    return folder


def bounded(df: DataFrame, most: int, what: str) -> list[Row]:
    """The rows of a small dimension. More than `most` rows are an error: none is left out in silence."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows; join them instead")
    return rows


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)
