"""One source's stored rows as hash buckets of files that never change, and numbered manifests.

A manifest names the folder of every bucket that has rows. A commit writes only the buckets it touches,
to a folder of its own, and then creates the next manifest; until that file is there readers see the
rows of the one before, and afterwards all of the new ones. Creating it fails if another run has
committed meanwhile. Folders that none of the last manifests names are removed.

`root` is a folder whose name begins with an underscore, so that a plain scan of the catalogue skips it.
"""

from __future__ import annotations

import dataclasses
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from townbill import schemas
from townbill.session import delete

ROWS_EACH = 500_000
LEAST_BUCKETS = 16
KEPT = 2


@dataclasses.dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    folders: dict[int, str]
    rows: dict[int, int]

    @property
    def total(self) -> int:
        return sum(self.rows.values())


def root_of(path: str, source: str) -> str:
    return f"{path.rstrip('/')}/source={source}/_snapshots"


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of an id; the ids of a batch lead to it without a look at the stored rows."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_for(rows: int, each: int = ROWS_EACH) -> int:
    """A power of two, so that a bucket holds about `each` rows."""
    return max(LEAST_BUCKETS, 1 << max(0, (rows // each)).bit_length())


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def names_in(spark: SparkSession, path: str) -> list[str]:
    files, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def _numbered(spark: SparkSession, root: str) -> list[int]:
    """Versions that have a manifest, newest first."""
    found = (re.fullmatch(r"(\d+)\.json", name) for name in names_in(spark, f"{root}/manifests"))
    return sorted((int(m[1]) for m in found if m), reverse=True)


def _manifest(spark: SparkSession, root: str, version: int) -> Manifest | None:
    """None for a file whose writer was stopped before it was complete."""
    files, place = _place(spark, f"{root}/manifests/{version:09d}.json")
    stream = files.open(place)
    try:
        told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()
    return Manifest(version, told["buckets"], {int(b): f for b, f in told["folders"].items()}, {int(b): n for b, n in told["rows"].items()})


def live(spark: SparkSession, root: str) -> Manifest | None:
    """The newest complete manifest, or None before the first commit."""
    return next((m for m in (_manifest(spark, root, v) for v in _numbered(spark, root)) if m), None)


def read(spark: SparkSession, root: str, manifest: Manifest, only=None) -> DataFrame:
    """The rows of a manifest, or of some of its buckets, without the column `source`."""
    schema = StructType([f for f in StructType.fromDDL(schemas.LISTINGS).fields if f.name != "source"])
    folders = sorted({f"{root}/{f}" for b, f in manifest.folders.items() if only is None or b in only})
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def commit(rows: DataFrame, root: str, base: Manifest | None, touched=None, buckets: int | None = None) -> Manifest:
    """Makes `rows` the content of the touched buckets, of all if None, and the rest of `base` stay.

    `rows` may read the files of `base`, which stay as they are. If anything fails before the manifest is
    there, what was written is removed and the stored rows are those of `base`.
    """
    spark = rows.sparkSession
    buckets = buckets or (base.buckets if base else LEAST_BUCKETS)
    if touched is not None and (not base or base.buckets != buckets):
        raise ValueError("only a source with the same buckets can be changed in part")
    run = f"data/{uuid.uuid4().hex}"
    try:
        counted = rows.withColumn("bucket", bucket_of(F.col("id"), buckets))
        counted.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{run}")
        written = spark.read.schema("bucket INT").option("basePath", f"{root}/{run}").parquet(f"{root}/{run}")
        sizes = {r["bucket"]: r["count"] for r in written.groupBy("bucket").count().collect() if r["bucket"] is not None}
        stay = {b: f for b, f in base.folders.items() if b not in touched} if base and touched is not None else {}
        folders = {**stay, **{b: f"{run}/bucket={b}" for b in sizes}}
        counts = {**{b: base.rows[b] for b in stay}, **sizes}
        made = Manifest(next(iter(_numbered(spark, root)), 0) + 1, buckets, folders, counts)
        if live(spark, root) != base:
            raise RuntimeError("another run has committed to this source")
        files, place = _place(spark, f"{root}/manifests/{made.version:09d}.json")
        stream = files.create(place, False)
        stream.write(bytearray(json.dumps({"buckets": buckets, "folders": folders, "rows": counts}).encode()))
        stream.close()
    except BaseException:
        delete(spark, f"{root}/{run}")
        raise
    _clean(spark, root)
    return made


def _clean(spark: SparkSession, root: str) -> None:
    """Removes all but the last manifests, and the folders that only the removed ones name."""
    versions = _numbered(spark, root)
    kept = {f for v in versions[:KEPT] if (m := _manifest(spark, root, v)) for f in m.folders.values()}
    for version in versions[KEPT:]:
        old = _manifest(spark, root, version)
        for folder in set(old.folders.values()) - kept if old else ():
            delete(spark, f"{root}/{folder}")
        delete(spark, f"{root}/manifests/{version:09d}.json")
