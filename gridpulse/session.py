"""Session settings and shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gridpulse", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library is written for; ``conf`` wins over them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split the partitions of hot keys even where a later step then shuffles once more.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        # Call sites per column cost a good part of building a large plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read, taken from ``spark.checkpoint.dir``.

    Only a session on this one machine that names no folder gets a fresh temporary one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    made = tempfile.mkdtemp(prefix="gridpulse-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_MADE: list[str] = []         # stage tables of this driver, until removed


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet inside the shared folder; ``clean_scratch`` removes what is written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a stage table that no frame reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _MADE:
        _MADE.remove(path)


def clean_scratch(spark: SparkSession) -> int:
    """Remove all stage tables this driver has made; returns their number. Call it when results are written."""
    made = list(_MADE)
    for path in made:
        drop_path(spark, path)
    return len(made)


_LONG = Lock()


@contextmanager
def long_tasks(spark: SparkSession) -> Iterator[int]:
    """How many tasks a job of long tasks may have: three quarters of the cores, one such job at a time.

    Jobs start their tasks in the order they came, so the short jobs of a fit beside it would wait for all of them.
    """
    with _LONG:
        yield max(1, spark.sparkContext.defaultParallelism * 3 // 4)


@contextmanager
def staged(df: DataFrame, name: str = "stage") -> Iterator[DataFrame]:
    """``df`` as a stage table that goes at the end of the block."""
    path = scratch_path(df.sparkSession, name)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        drop_path(df.sparkSession, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a place in shared storage, for reading inside tasks (file, hdfs, s3 and others)."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri).replace("s3a://", "s3://"))


def numbered_folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The n of all folders ``<prefix><n>`` directly under ``path``, ascending; none if ``path`` does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    names = [entry.getPath().getName() for entry in store.listStatus(place)]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later jobs survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
