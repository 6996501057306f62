"""A layout of rows with a start and an end that is read by the time asked for, not by its history.

Rows are filed by length, in classes of up to 1, 8, 64, ... days, and within a class by their start's bin,
which is as wide as the class's longest row. Whatever overlaps a time therefore starts in the bins of that
time or in the one before them, so that a reader opens a few folders a class, however many there are.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from townbill.functions.wallclock import as_utc, instant

#: powers of two of the classes' lengths in days; the last one is longer than all of time
STEPS = (0, 3, 6, 9, 12, 15, 18, 21, 24)
SPAN, BIN = "interval_span", "interval_bin"
DAY = 86_400


def with_bins(rows: DataFrame, start: str = "start_datetime", end: str = "end_datetime") -> DataFrame:
    """`rows` with `interval_span` and `interval_bin`, which replace columns of these names.

    A row without an end, or whose end is before its start, is filed as a moment; one without a start has
    a null bin and is found by no reader.
    """
    seconds = F.unix_seconds(F.col(end)) - F.unix_seconds(F.col(start))
    days = F.coalesce(F.greatest(F.floor(seconds / DAY), F.lit(0)), F.lit(0)) + 1
    span = F.coalesce(*[F.when(days <= 2**c, F.lit(c)) for c in STEPS[:-1]], F.lit(STEPS[-1]))
    width = F.expr(f"shiftleft(1L, {SPAN})")
    return rows.withColumn(SPAN, span).withColumn(BIN, F.floor(F.floor(F.unix_seconds(F.col(start)) / DAY) / width))


def may_overlap(since: dt.datetime, until: dt.datetime) -> Column:
    """Bins that can hold a row that starts at `until` or before and ends at `since` or after; constants only."""
    day = lambda t: int(as_utc(t).timestamp() // DAY)
    first, last = day(since), day(until)
    tests = [(F.col(SPAN) == c) & F.col(BIN).between((first - 2**c) // 2**c, last // 2**c) for c in STEPS]
    return reduce(lambda a, b: a | b, tests)


def write_intervals(rows: DataFrame, path: str, start: str = "start_datetime", end: str = "end_datetime") -> None:
    """Writes the layout to the new folder `path`; a bin with very many rows is split over tasks."""
    with_bins(rows, start, end).hint("rebalance", SPAN, BIN).write.partitionBy(SPAN, BIN).parquet(path)


def overlapping(
    spark: SparkSession, path: str, schema: StructType, since: dt.datetime, until: dt.datetime, start: str = "start_datetime", end: str = "end_datetime"
) -> DataFrame:
    """The rows of the layout that start before `until` and end at `since` or after; `schema` is that of the written rows.

    With both at a day's cutoff these are the rows ongoing then. Rows without a start or an end are not
    among them, as in a comparison with null.
    """
    held = StructType([f for f in schema.fields if f.name not in (SPAN, BIN)])
    filed = StructType([*held.fields, StructField(SPAN, IntegerType()), StructField(BIN, LongType())])
    hits = spark.read.schema(filed).parquet(path).filter(may_overlap(since, until))
    return hits.filter((F.col(start) < instant(until)) & (F.col(end) >= instant(since))).select(*held.names)
