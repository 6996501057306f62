"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import math
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townbill.session import delete

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names, else one of this machine in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class _Scratch(threading.local):
    """Paths of the tables of the scopes that this thread is in, innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCRATCH = _Scratch()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored within go at the end, well or not; what leaves the scope must not read them."""
    _SCRATCH.open.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.open.pop():
            delete(spark, path)


def stored(df: DataFrame, name: str = "rows", leaves: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: they are computed once and survive lost executors.

    A table that `leaves` belongs to the scope around the present one.
    """
    path = new_path(df.sparkSession, name)
    scopes = _SCRATCH.open[:-1] if leaves else _SCRATCH.open
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; Spark removes its files once nothing refers to them."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def pieces_for(total: int | None, each: int) -> int:
    return max(1, math.ceil((total or 0) / each))


def n_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def n_words(text: str = "text") -> Column:
    """Number of words, without making an array of them."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


_CACHES: dict[str, Callable[[], None]] = {}


def keep_only(name: str | None = None) -> None:
    """At the start of a task: drops what an earlier step left in this reused worker, but for `name`."""
    for other, clear in _CACHES.items():
        if other != name:
            clear()
    give_back()


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's call that returns free memory to the system, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)


def give_back() -> None:
    """Returns to the system what this worker has freed: it may sit idle while others of its executor need the room."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def cached(name: str, clear: Callable[[], None]) -> None:
    _CACHES[name] = clear


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller pieces, as texts and results of a whole batch may be large."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that they need not have it installed."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if _SHIPPED.get("to") == sc.applicationId:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED["to"] = sc.applicationId


_SHIPPED: dict[str, str] = {}
