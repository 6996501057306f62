"""Session set-up and lineage cuts."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def pin_session(spark: SparkSession) -> SparkSession:
    """Fix the settings that results depend on; sizing stays with the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


class _Stages(threading.local):
    """Folders of the runs that this thread is in, innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_STAGES = _Stages()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's setting, or in local mode one beside the warehouse."""
    local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and local:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    Later steps read that table, with only the columns they need, whatever executors are lost. Within
    `staging` the table goes when the run ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    if _STAGES.open:
        _STAGES.open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """As `materialise`, with aggregates over the rows that are taken while they are written, in no job of their own."""
    seen = Observation()
    rows = materialise(df.observe(seen, *[metric.alias(name) for name, metric in metrics.items()]))
    return rows, seen.get


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder from whatever store it is in."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """A run's staged tables: they are removed when it ends, well or not."""
    _STAGES.open.append([])
    try:
        yield
    finally:
        for path in _STAGES.open.pop():
            delete(spark, path)
