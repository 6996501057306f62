"""Table scans: the catalogue and the analytics export."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from townbill import fixed, schemas
from townbill.functions.wallclock import as_utc
from townbill.sources import snapshots


def scan_catalogue(spark: SparkSession, path: str, columns=None, sources=None) -> DataFrame:
    """Catalogue rows with only the columns asked for; a source selection prunes partitions.

    A source that was published since its first load is read as its newest manifest says.
    """
    published = {}
    for name in snapshots.names_in(spark, path):
        source = name.removeprefix("source=")
        if name.startswith("source=") and (not sources or source in sources):
            manifest = snapshots.live(spark, snapshots.root_of(path, source))
            if manifest:
                published[source] = manifest
    rows = spark.read.schema(schemas.LISTINGS).parquet(path)
    if sources:
        rows = rows.filter(F.col("source").isin(*sources))
    if published:
        rows = rows.filter(~F.col("source").isin(*published))
    for source, manifest in published.items():
        own = snapshots.read(spark, snapshots.root_of(path, source), manifest)
        rows = rows.unionByName(own.withColumn("source", F.lit(source)))
    return rows.select(*columns) if columns else rows


def as_listings(df: DataFrame, *extras: str) -> DataFrame:
    """The catalogue columns in order, with typed nulls for those the frame lacks, then the extras."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in StructType.fromDDL(schemas.LISTINGS).fields
        ],
        *extras,
    )


def as_batch(df: DataFrame) -> DataFrame:
    """Parsed listings as a batch: catalogue columns, batch order and the price lock."""
    if "seq" not in df.columns:
        df = df.withColumn("seq", F.monotonically_increasing_id())
    if "price_locked" not in df.columns:
        df = df.withColumn("price_locked", F.lit(False))
    extra = [c for c in ("age_resolved",) if c in df.columns]
    return as_listings(df, "seq", "price_locked", *extra)


def recent_export(export: DataFrame, today, days: int = fixed.ANALYTICS_DAYS) -> DataFrame:
    """Export rows of the last days; with event_date as partition column this prunes folders."""
    first = as_utc(today).date() - dt.timedelta(days=days)
    return export.filter(F.col("event_date") >= F.lit(first))


def flatten_export(export: DataFrame) -> DataFrame:
    """Nested export rows to flat analytics rows, one per event, before validity checks."""

    def param(key: str, kind: str):
        hit = F.filter(F.col("event_params"), lambda p: p["key"] == key)
        return F.get(hit, F.lit(0))["value"][kind]

    return export.select(
        F.col("user_pseudo_id").alias("visitor_id"),
        F.concat(F.col("user_pseudo_id"), F.lit("."), param("ga_session_id", "int_value").cast("string")).alias(
            "session_id"
        ),
        "event_name",
        F.round(F.col("event_timestamp") / 1000).cast("bigint").alias("timestamp"),
        F.coalesce(F.col("traffic_source.medium"), F.lit("(none)")).alias("channel"),
        param("event_id", "string_value").alias("event_id"),
        param("method", "string_value").alias("method"),
        param("fields", "string_value").alias("filter_fields"),
        param("city", "string_value").alias("city"),
    )


def valid_rows(rows: DataFrame) -> DataFrame:
    """Drop rows without visitor, session or event name; a missing time becomes 0."""
    named = F.lit(True)
    for c in ("visitor_id", "session_id", "event_name"):
        named = named & F.nullif(F.col(c), F.lit("")).isNotNull()
    return rows.filter(named).withColumn("timestamp", F.coalesce(F.col("timestamp"), F.lit(0).cast("bigint")))


def scan_analytics(spark: SparkSession, path: str, today, days: int = fixed.ANALYTICS_DAYS) -> DataFrame:
    """The analytics export of the last days as flat, valid rows."""
    export = spark.read.schema(schemas.ANALYTICS_EXPORT).parquet(path)
    return valid_rows(flatten_export(recent_export(export, today, days)))
