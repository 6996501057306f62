"""Catalogue queries: search, indexable rows, venues, branches, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from townbill import fixed
from townbill.functions.ages import passes_age_filter
from townbill.functions.text import contains_any
from townbill.functions.wallclock import day_start, instant, today_cutoff


def kid_gate() -> Column:
    """Only an explicit 'not relevant' hides a row."""
    return F.col("kid_relevant").isNull() | (F.col("kid_relevant") == F.lit(True))


def adult_gate(adult_age: int = fixed.ADULT_AGE) -> Column:
    return F.col("age_min").isNull() | (F.col("age_min") < adult_age)


def selected(sources=None, branches=None, is_free: bool = False) -> Column:
    """Source, branch and free-only selection; an empty selection does not filter."""
    tests = []
    if sources:
        tests.append(F.col("source").isin(*sources))
    if branches:
        tests.append(F.col("location_name").isin(*branches))
    if is_free:
        tests.append(F.col("is_free") == F.lit(True))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def date_window(date_from=None, date_to=None, offset_hours: int = fixed.DAY_OFFSET_HOURS) -> Column:
    """Starts on the local days from..to, both included, under the fixed day offset."""
    tests = []
    if date_from:
        tests.append(F.col("start_datetime") >= instant(day_start(date_from, offset_hours)))
    if date_to:
        tests.append(F.col("start_datetime") < instant(day_start(date_to, offset_hours, plus_days=1)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def upcoming(now) -> Column:
    return F.col("start_datetime") >= instant(today_cutoff(now))


def ongoing(now) -> Column:
    """Started before today and not over yet."""
    cutoff = instant(today_cutoff(now))
    return (F.col("start_datetime") < cutoff) & (F.col("end_datetime") >= cutoff)


def adult_programme(source: str = "frisco-library", words=fixed.ADULT_PROGRAM_KEYWORDS) -> Column:
    """Rows of the one source that files adult programmes under children."""
    return (F.col("source") == source) & contains_any(F.col("title"), words)


def by_start(df: DataFrame) -> DataFrame:
    return df.orderBy("start_datetime", "id")


def age_filter(df: DataFrame, ranges, inferred_sources=fixed.INFERRED_SOURCES) -> DataFrame:
    return df.filter(
        passes_age_filter(
            ranges, F.col("source"), F.col("kid_relevant"), F.col("age_confidence"), F.col("age_buckets"),
            F.col("age_min"), F.col("age_max"), inferred_sources,
        )
    )


def search_listings(
    listings: DataFrame,
    now,
    sources=None,
    branches=None,
    is_free: bool = False,
    ages=None,
    date_from=None,
    date_to=None,
    upcoming_limit: int | None = None,
    ongoing_limit: int | None = None,
) -> DataFrame:
    """The list view: ongoing and upcoming rows, soonest first.

    All matching rows are returned unless a limit is stated; limits apply after all filters.
    Ongoing rows ignore the date window. Without limits one scan reads both parts.
    """
    shown = listings.filter(selected(sources, branches, is_free) & kid_gate() & adult_gate())
    if ages:
        shown = age_filter(shown, ages)
        if not sources or "frisco-library" in sources:
            shown = shown.filter(~F.coalesce(adult_programme(), F.lit(False)))
    later, running = date_window(date_from, date_to) & upcoming(now), ongoing(now)
    if upcoming_limit is None and ongoing_limit is None:
        return by_start(shown.filter(later | running))
    parts = [(running, ongoing_limit), (later, upcoming_limit)]
    rows = [shown.filter(p) if n is None else by_start(shown.filter(p)).limit(n) for p, n in parts]
    return by_start(rows[0].unionByName(rows[1]))


def page(rows: DataFrame, number: int, size: int = fixed.PAGE_SIZE, cumulative: bool = False) -> DataFrame:
    """Page `number` (from 1) of an ordered result, or everything up to it."""
    if cumulative:
        return rows.limit(number * size)
    return rows.offset((number - 1) * size).limit(size)


def indexable(now, gated_source: str = "play-frisco") -> Column:
    """May the row appear in public indexes?"""
    cutoff = instant(today_cutoff(now))
    hidden = (F.col("source") == gated_source) & (F.col("kid_relevant") == F.lit(False))
    past = F.coalesce("end_datetime", "start_datetime") < cutoff
    off = lambda c: ~F.coalesce(c, F.lit(False))
    return off(hidden) & adult_gate() & off(adult_programme()) & off(past)


def indexable_listings(
    listings: DataFrame,
    now,
    city: str | None = None,
    city_sources: dict = fixed.CITY_SOURCES,
    limit: int | None = None,
) -> DataFrame:
    """Upcoming indexable rows, soonest first, optionally of one city or no more than a stated limit."""
    rows = listings.filter(upcoming(now) & indexable(now))
    if city:
        rows = rows.filter(F.col("source").isin(*city_sources[city]))
    rows = by_start(rows)
    return rows if limit is None else rows.limit(limit)


def for_city(listings: DataFrame, city: str, city_sources: dict = fixed.CITY_SOURCES) -> DataFrame:
    return listings.filter(F.col("source").isin(*city_sources[city]))


def by_id(listings: DataFrame, item_id: str, source: str | None = None) -> DataFrame:
    """The row of an id; a known source prunes the other partitions."""
    rows = listings.filter(F.col("source") == source) if source else listings
    return rows.filter(F.col("id") == item_id)


def with_source_dim(listings: DataFrame, dim: dict = fixed.SOURCE_DIM) -> DataFrame:
    """Organisation, home page, short label and city of each row's source."""
    table = listings.sparkSession.createDataFrame(
        [(s, *v) for s, v in dim.items()], "source STRING, org_name STRING, org_url STRING, short_label STRING, city STRING"
    )
    return listings.join(F.broadcast(table), "source", "left")


def distinct_branches(listings: DataFrame, source: str = "plano-library", excluded=fixed.EXCLUDED_BRANCHES) -> DataFrame:
    return (
        listings.filter((F.col("source") == source) & (F.coalesce(F.col("location_name"), F.lit("")) != ""))
        .filter(~F.col("location_name").isin(*excluded))
        .select("location_name")
        .distinct()
        .orderBy("location_name")
    )


def distinct_venues(listings: DataFrame) -> DataFrame:
    """One row per venue name and source with a position, virtual ones left out; least id wins."""
    placed = listings.filter(
        F.col("location_lat").isNotNull() & F.col("location_lng").isNotNull() & F.col("location_name").isNotNull()
        & ~F.contains(F.lower("location_name"), F.lit("virtual"))
    )
    first = F.min_by(F.struct("location_address", "location_lat", "location_lng"), "id").alias("v")
    return placed.groupBy("location_name", "source").agg(first).select(
        "location_name", "v.location_address", "v.location_lat", "v.location_lng", "source"
    )
