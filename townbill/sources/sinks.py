"""Writing the catalogue, the run log and the quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from townbill import schemas
from townbill.functions.wallclock import utc_date
from townbill.operators import publish
from townbill.operators.quality import enforce
from townbill.session import delete, materialise, staging
from townbill.sources import snapshots
from townbill.sources.tables import as_listings, scan_catalogue


def write_catalogue(listings: DataFrame, path: str) -> None:
    """First load: the whole catalogue, one folder per source."""
    as_listings(listings).write.mode("overwrite").partitionBy("source").parquet(path)


def replace_source(rows: DataFrame, path: str, source: str) -> int:
    """Make the rows one source's next snapshot, all of it, and return the row count.

    Only the source's own folder is written, so that the runs of several sources do not meet.
    """
    spark, root = rows.sparkSession, snapshots.root_of(path, source)
    base = snapshots.live(spark, root)
    own = as_listings(rows).filter(F.col("source") == source).drop("source")
    made = snapshots.commit(own, root, base, buckets=snapshots.buckets_for(base.total if base else 0))
    _drop_first_load(spark, path, source)
    return made.total


def publish_source(
    spark: SparkSession, path: str, source: str, written: DataFrame, scraped: DataFrame | None = None,
    cleanup_words=(), purge: bool = False, new: dict | None = None,
) -> snapshots.Manifest:
    """Upsert, keyword clean-up and purge of one source; only the buckets that change are rewritten.

    Those are the buckets of the written ids and of the stored ids that a purge or the clean-up drops,
    which a scan of ids and titles finds. A source's first publish, and one that has outgrown its
    buckets, writes all of them.
    """
    root = snapshots.root_of(path, source)
    base = snapshots.live(spark, root)
    stored = scan_catalogue(spark, path, sources=[source]).drop("source")
    touched, buckets = None, snapshots.buckets_for(base.total if base else stored.count())
    if base and buckets <= 2 * base.buckets:
        buckets = base.buckets
        ids = written.select("id")
        if purge and scraped is not None:
            ids = ids.unionByName(publish.stale_rows(stored.select("id"), scraped))
        if cleanup_words:
            ids = ids.unionByName(publish.cleanup_hits(stored, cleanup_words).select("id"))
        touched = {r["bucket"] for r in ids.select(snapshots.bucket_of(F.col("id"), buckets).alias("bucket")).distinct().collect()}
        if not touched:
            return base
        stored = snapshots.read(spark, root, base, touched)
    rows = publish.next_snapshot(stored, written.drop("source"), scraped, cleanup_words, purge, new)
    rows = as_listings(rows.withColumn("source", F.lit(source))).drop("source")
    made = snapshots.commit(rows, root, base, touched, buckets)
    _drop_first_load(spark, path, source)
    return made


def _drop_first_load(spark: SparkSession, path: str, source: str) -> None:
    """Removes the files of a source's first load once a manifest has taken their place."""
    folder = f"{path.rstrip('/')}/source={source}"
    for name in snapshots.names_in(spark, folder):
        if not name.startswith("_snapshots"):
            delete(spark, f"{folder}/{name}")


def append_run(row: DataFrame, path: str) -> None:
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schemas.INGEST_RUNS).fields]
    row.select(*typed).withColumn("run_date", utc_date(F.col("ran_at"))).write.mode("append").partitionBy("run_date").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.INGEST_RUNS).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """Write the quality report, then fail the job if any check failed."""
    with staging(report.sparkSession):
        report = materialise(report)
        report.write.mode("overwrite").json(path)
        enforce(report)
