"""Metrics of the ingest pipeline and of what the catalogue shows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from townbill import fixed
from townbill.functions.ages import age_badge
from townbill.functions.wallclock import as_utc, instant, utc_date


def source_totals(listings: DataFrame, sources=fixed.COUNTED_SOURCES) -> DataFrame:
    """Rows per listed source, 0 for a source without any."""
    spine = listings.sparkSession.createDataFrame([(s,) for s in sources], "source STRING")
    counts = listings.groupBy("source").agg(F.count("*").alias("n"))
    return spine.join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("total"))


def tri_state_totals(listings: DataFrame, flag: str = "is_free") -> DataFrame:
    """Free, paid and unknown rows over all sources."""
    c = F.col(flag)
    return listings.agg(
        F.count_if(c).alias("free"), F.count_if(~c).alias("paid"), F.count_if(c.isNull()).alias("unknown")
    )


def age_visibility(listings: DataFrame, source: str = "play-frisco") -> DataFrame:
    """How the inferred ages of a source show: family, specific, nothing or hidden."""
    badge = age_badge(
        F.col("source"), F.col("kid_relevant"), F.col("age_confidence"), F.col("age_buckets"),
        F.col("age_min"), F.col("age_max"), inferred_sources=(source,),
    )
    state = (
        F.when(F.col("kid_relevant") == F.lit(False), "hidden")
        .when(badge["kind"] == "inferred-family", "family")
        .when(badge["kind"] == "inferred-specific", "specific")
        .otherwise("nothing")
    )
    rows = listings.filter(F.col("source") == source).select(state.alias("state"))
    return rows.agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("family", "specific", "nothing", "hidden")],
        F.count("*").alias("total"),
    )


def price_visibility(listings: DataFrame, source: str = "play-frisco") -> DataFrame:
    """Free and paid rows of a source, by confirmed or inferred price, and the unknown rest."""
    free, paid = F.col("price_class") == "free", F.col("price_class") == "paid"
    confirmed = F.col("price_confidence").eqNullSafe("confirmed")
    known = F.coalesce(free | paid, F.lit(False))
    return listings.filter(F.col("source") == source).agg(
        F.count_if(free & confirmed).alias("free_confirmed"),
        F.count_if(free & ~confirmed).alias("free_inferred"),
        F.count_if(paid & confirmed).alias("paid_confirmed"),
        F.count_if(paid & ~confirmed).alias("paid_inferred"),
        F.count_if(~known).alias("unknown"),
        F.count("*").alias("total"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """The most recent run; of several at one time, the least id."""
    return runs.orderBy(F.col("ran_at").desc(), "id").limit(1)


def last_runs(runs: DataFrame, n: int = 7) -> DataFrame:
    return runs.orderBy(F.col("ran_at").desc(), "id").limit(n)


def status_rank(status: Column, ranks: dict = fixed.STATUS_RANK) -> Column:
    return F.coalesce(*[F.when(status == s, r) for s, r in ranks.items()], F.lit(0))


def status_history(runs: DataFrame, today, days: int = 14, ranks: dict = fixed.STATUS_RANK) -> DataFrame:
    """Worst status per day over the last days, 'none' for a day without a run."""
    last = as_utc(today).date()
    first = last - dt.timedelta(days=days - 1)
    spine = runs.sparkSession.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    ran_at = F.col("ran_at")
    names = F.array(*[F.lit(s) for s, _ in sorted(ranks.items(), key=lambda e: e[1])])
    worst = (
        runs.filter((ran_at >= instant(first)) & (ran_at < instant(last + dt.timedelta(days=1))))
        .select(utc_date(ran_at).alias("day"), status_rank(F.col("status"), ranks).alias("rank"))
        .groupBy("day")
        .agg(F.max("rank").alias("rank"))
    )
    return spine.join(worst, "day", "left").select(
        "day", F.element_at(names, F.coalesce("rank", F.lit(0)) + 1).alias("status")
    )


def cost_summary(runs: DataFrame) -> DataFrame:
    """Cost of the latest run, cumulative cost and calls; nulls count as 0."""
    cost = F.coalesce("llm_cost_usd", F.lit(0).cast("decimal(10,4)"))
    order = F.struct(-F.unix_micros("ran_at"), "id")
    zero = F.lit(0)
    return runs.agg(
        F.coalesce(F.min_by(cost, order), zero).alias("last_run_usd"),
        F.coalesce(F.sum(cost), zero).alias("cumulative_usd"),
        F.coalesce(F.sum(F.coalesce("llm_calls", zero)), zero).alias("total_calls"),
    )
