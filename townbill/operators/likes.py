"""Like counters from a log of likes and unlikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def like_counts(log: DataFrame, pieces: int | None = None) -> DataFrame:
    """Final count per item of a log (event_id, ts, seq, delta), floored at 0 after every step.

    The first write of an item always sets 1. With S the running sum (its first step taken as
    +1), flooring at each step ends at S_end − min(0, lowest S). Sum and lowest prefix compose
    over consecutive pieces of a log. The log is cut into `pieces` ranges of (item, time) that hold
    about as many rows each, so that an item with much of the log, even within an hour, is spread
    over several; the ordered window runs inside an item's share of a piece, a second one over the
    shares, at most one per piece.
    """
    pieces = pieces or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.struct("ts", "seq")
    log = log.select("event_id", "ts", "seq", "delta").repartitionByRange(pieces, "event_id", "ts", "seq")
    log = log.withColumn("chunk", F.spark_partition_id())
    inside = Window.partitionBy("event_id", "chunk").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    chunks = (
        log.withColumn("running", F.sum("delta").over(inside))
        .groupBy("event_id", "chunk")
        .agg(
            F.sum("delta").alias("total"),
            F.min("running").alias("lowest"),
            F.min_by("delta", order).alias("first_delta"),
        )
    )
    before = Window.partitionBy("event_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("total").over(before), F.lit(0))
    totals = (
        chunks.withColumn("lowest_so_far", F.col("lowest") + offset)
        .groupBy("event_id")
        .agg(
            F.sum("total").alias("total"),
            F.min("lowest_so_far").alias("lowest"),
            F.min_by("first_delta", "chunk").alias("first_delta"),
        )
    )
    lift = 1 - F.col("first_delta")
    return totals.select(
        "event_id",
        (F.col("total") + lift - F.least(F.lit(0), F.col("lowest") + lift)).cast("bigint").alias("count"),
    )
