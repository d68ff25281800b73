"""Session building and the durable intermediate tables that the operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("loamql")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.openCostInBytes": "262144",  # small local files are still worth a task per core
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only where
    that is unset and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="loamql-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


_own: dict[str, str] = {}
_pinned: list[str] = []


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables that ``pin`` wrote in this process, but the first ``keep``; frames that read them
    can't be used after."""
    while len(_pinned) > keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(_pinned.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was pinned within it: ``with scratch(spark): query(...).df.write...``."""
    held = len(_pinned)
    try:
        yield
    finally:
        release(spark, held)


def _release_at_exit() -> None:
    """What is still pinned goes with the process, where its session is still there."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            release(spark)
        except Exception:  # noqa: BLE001, S110 - the session is going away
            pass


atexit.register(_release_at_exit)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted by ``release``."""
    path = f"{shared_dir(spark)}/{kind}-{os.getpid()}-{uuid.uuid4().hex}"
    _pinned.append(path)
    return path


def pinned_path(df: DataFrame, partitions_by: list[str] | None = None) -> str:
    """Write ``df`` once to the shared folder as compressed Parquet, and say where."""
    path = scratch_path(df.sparkSession, "pinned")
    writer = df.write.mode("error")
    if partitions_by:
        writer = writer.partitionBy(*partitions_by)
    writer.parquet(path)
    return path


def pin(df: DataFrame, partitions_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors and fixes whatever depends on how the rows
    were partitioned; a recomputed task writes the same rows again.
    """
    return df.sparkSession.read.schema(df.schema).parquet(pinned_path(df, partitions_by))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
