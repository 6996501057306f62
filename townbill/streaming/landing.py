"""The same operators on a stream of landed files.

An addition to the nightly batch: landed files are picked up as they arrive, and each
micro-batch goes through the same guarded run as a nightly batch would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from townbill import fixed
from townbill.functions.wallclock import utc_date
from townbill.plans.ingest import RULES, run_source


def landed_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def publish_stream(
    landings: DataFrame,
    source: str,
    to_listings,
    catalogue_path: str,
    runs_path: str,
    checkpoint_path: str,
    now,
    answers_for=None,
    rules: dict = RULES,
) -> StreamingQuery:
    """Guard and publish every micro-batch of landed pages, then stop when none are left.

    A micro-batch is only part of a source, so neither its missing ids nor its size say anything.
    Upserting by id makes a replayed micro-batch harmless. A micro-batch that is aborted or fails
    stops the stream before its offset is committed, so that it is tried again.
    """

    def publish(batch: DataFrame, _: int) -> None:
        rows = to_listings(batch)
        result = run_source(
            batch.sparkSession, source, rows, catalogue_path, runs_path, now, answers_for, rules=rules, partial=True
        )
        if result.aborted:
            raise RuntimeError(f"{source}: micro-batch not published: {'; '.join(result.errors)}")

    return (
        landings.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def weekly_active_stream(
    rows: DataFrame, lateness: str = "1 day", conversions=fixed.CONVERSION_EVENTS
) -> DataFrame:
    """Converting visitors per Monday-anchored week, as (week, visitor) pairs seen once.

    The pairs are de-duplicated within the watermark; counting them per week is left to the
    reader of the output, since a distinct count cannot be updated in append mode.
    """
    ts = F.timestamp_millis(F.col("timestamp"))
    week = F.window("ts", "7 days", startTime="4 days")
    return (
        rows.filter(F.col("event_name").isin(*conversions))
        .withColumn("ts", ts)
        .withWatermark("ts", lateness)
        .groupBy(week.alias("span"), "visitor_id")
        .agg(F.count("*").alias("conversions"))
        .select(utc_date(F.col("span.start")).alias("week"), "visitor_id", "conversions")
    )
