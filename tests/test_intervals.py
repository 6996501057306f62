"""The interval layout: same rows as a plain filter, and files read that do not follow the history."""

import datetime as dt
import random

from pyspark.sql import functions as F

from townbill.sources import intervals

DDL = "id int, start_datetime timestamp, end_datetime timestamp"
T0 = dt.datetime(2026, 8, 1, 5, tzinfo=dt.timezone.utc)


def files_read(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_same_rows_as_a_filter(spark, tmp_path):
    pick = random.Random(5)
    rows = [(0, None, T0), (1, T0, None), (2, None, None), (3, T0 + dt.timedelta(days=3), T0), (4, T0 - dt.timedelta(days=9000), T0 + dt.timedelta(days=9000))]
    for i in range(5, 600):
        start = T0 + dt.timedelta(minutes=pick.randint(-200_000, 200_000))
        rows.append((i, start, start + dt.timedelta(minutes=pick.choice([0, 1439, 1440, 1441, 8 * 1440, pick.randint(0, 300_000)]))))
    rows += [(600, T0, T0), (601, T0 - dt.timedelta(days=1), T0), (602, T0 - dt.timedelta(days=8), T0), (603, T0 - dt.timedelta(seconds=1), T0 - dt.timedelta(seconds=1))]
    rows += [rows[10], rows[10]]
    df = spark.createDataFrame(rows, DDL).withColumn("interval_bin", F.lit("theirs"))
    path = str(tmp_path / "filed")
    intervals.write_intervals(df, path)
    assert spark.read.parquet(path).count() == len(rows)
    for since, until in ((T0, T0), (T0, T0 + dt.timedelta(days=30)), (T0 - dt.timedelta(days=5), T0 - dt.timedelta(days=4, hours=3)), (T0 - dt.timedelta(days=20_000),) * 2):
        want = sorted(i for i, a, b in rows if a and b and a < until and b >= since)
        assert sorted(r.id for r in intervals.overlapping(spark, path, df.schema, since, until).collect()) == want


def test_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], DDL)
    intervals.write_intervals(df, str(tmp_path / "none"))
    assert intervals.overlapping(spark, str(tmp_path / "none"), df.schema, T0, T0).count() == 0


def test_files_read_do_not_follow_the_history(spark, tmp_path):
    read = []
    for days in (60, 600):
        k = F.col("id")
        start = F.lit(T0) - F.make_interval(days=k.cast("int"))
        df = spark.range(days).select(k.cast("int").alias("id"), start.alias("start_datetime"), (start + F.make_interval(days=(k % 12).cast("int"))).alias("end_datetime"))
        path = str(tmp_path / str(days))
        intervals.write_intervals(df, path)
        rows, n = files_read(intervals.overlapping(spark, path, df.schema, T0, T0))
        assert sorted(r.id for r in rows) == [i for i in range(1, days) if i % 12 >= i]
        read.append(n)
    assert read[0] == read[1] <= 12
