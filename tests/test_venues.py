"""Venue positions from a table of fragments against the ordered chain and a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import plan_of
from townbill import fixed
from townbill.functions import labels
from townbill.operators import venues

DDL = "fragment string, priority long, lat double, lng double"


def plain(name, entries, default):
    hits = [(p, f, (lat, lng)) for f, p, lat, lng in entries if f is not None and name is not None and f in name.lower()]
    return min(hits)[2] if hits else default


def positions(df, into="point"):
    return {r["id"]: tuple(r[into]) for r in df.collect()}


def test_same_answer_as_the_chain(spark):
    table = spark.createDataFrame([(v, i, lat, lng) for i, (v, lat, lng) in enumerate(fixed.VENUE_COORDS)], DDL)
    names = [None, "", "Nowhere", *(f"{a} at {b.upper()}" for a, _, _ in fixed.VENUE_COORDS for b, _, _ in fixed.VENUE_COORDS)]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, location_name string")
    chain = rows.select("id", labels.venue_coordinates(F.col("location_name")).alias("point"))
    assert positions(venues.locate(rows, table)) == positions(chain)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("gram", [1, 3, 5])
def test_against_a_plain_search(spark, seed, gram):
    pick = random.Random(seed)
    word = lambda lo, hi: "".join(pick.choice("abé 😀") for _ in range(pick.randint(lo, hi)))
    entries = [(word(1, 7), pick.randint(0, 9), float(pick.randint(0, 99)), 1.0) for _ in range(80)] + [(None, 0, 0.0, 0.0)]
    names = [word(0, 30) for _ in range(200)] + [None, "", "ABÉ", "ab" * 5000] + ["the hot one ab"] * 50
    rows = spark.createDataFrame(list(enumerate(names)), "id int, location_name string")
    got = positions(venues.locate(rows, spark.createDataFrame(entries, DDL), default=(-1.0, -2.0), gram=gram))
    assert got == {i: plain(n, entries, (-1.0, -2.0)) for i, n in enumerate(names)}


def test_empty_tables_empty_fragment_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "Hall", "x", 5, 6), (1, "Hall", "x", 5, 6), (2, None, "y", 7, 8)], "id int, venue string, point string, digest int, gram int")
    none = spark.createDataFrame([], DDL)
    assert positions(venues.locate(rows, none, "venue", default=(3.0, 4.0))) == {1: (3.0, 4.0), 2: (3.0, 4.0)}
    all_of = spark.createDataFrame([("", 5, 1.0, 2.0), ("", 4, 9.0, 9.0), ("hall", 4, 8.0, 8.0)], DDL)
    got = venues.locate(rows, all_of, "venue", default=(3.0, 4.0))
    assert got.columns == ["id", "venue", "digest", "gram", "point"] and got.count() == 3
    assert positions(got) == {1: (9.0, 9.0), 2: (3.0, 4.0)}
    assert venues.locate(rows.limit(0), all_of, "venue").count() == 0


def test_many_fragments_without_a_nested_loop(spark):
    table = spark.range(100_000).select(F.concat(F.lit("venue "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("fragment"), F.col("id").alias("priority"), F.col("id").cast("double").alias("lat"), F.lit(0.0).alias("lng"))
    rows = spark.range(20_000).select("id", F.concat(F.lit("The VENUE "), F.lpad((F.col("id") * 5).cast("string"), 6, "0"), F.lit(", rear")).alias("location_name"))
    got = venues.locate(rows, table)
    plan = plan_of(got)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan
    assert got.where("point.lat <> id * 5").count() == 0 and got.count() == 20_000
