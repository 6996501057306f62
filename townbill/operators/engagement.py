"""Engagement metrics over flat analytics rows.

Rows carry visitor_id, session_id, event_name, timestamp (epoch ms) and optional dimensions.
Each metric aggregates before it shuffles; distinct counts are two keyed aggregations, so a
visitor, session or item that owns a large share of the rows stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from townbill import fixed
from townbill.functions.maths import safe_ratio
from townbill.functions.wallclock import week_of

def _name() -> Column:
    return F.col("event_name")


def row_week() -> Column:
    return week_of(F.timestamp_millis(F.col("timestamp")))


def step_level(levels: dict = fixed.STEP_LEVEL) -> Column:
    """Funnel step of the row's event; null for events outside the funnel."""
    by_level: dict[int, list[str]] = {}
    for name, level in levels.items():
        by_level.setdefault(level, []).append(name)
    return F.coalesce(*[F.when(_name().isin(*names), level) for level, names in by_level.items()])


def sessionise(
    rows: DataFrame,
    levels: dict = fixed.STEP_LEVEL,
    sub_metrics: dict = fixed.SUB_METRICS,
    share_event: str = fixed.SHARE_EVENT,
    keys=("session_id",),
) -> DataFrame:
    """One row per session: the furthest step reached, and which events it held."""
    return rows.groupBy(*keys).agg(
        F.coalesce(F.max(step_level(levels)), F.lit(0)).alias("max_step"),
        F.bool_or(_name() == share_event).alias("shared"),
        *[F.bool_or(_name() == event).alias(f"had_{m}") for m, (event, _) in sub_metrics.items()],
    )


def _funnel_aggregates(sub_metrics: dict) -> list[Column]:
    reached = lambda step: F.count_if(F.col("max_step") >= step)
    return [
        F.count("*").alias("sessions"),
        reached(1).alias("engaged"),
        reached(2).alias("intent"),
        reached(3).alias("converted"),
        *[
            F.count_if(F.col(f"had_{m}") & (F.col("max_step") >= step)).alias(m)
            for m, (_, step) in sub_metrics.items()
        ],
    ]


def _with_rates(counts: DataFrame, sub_metrics: dict) -> DataFrame:
    base = {0: "sessions", 1: "engaged", 2: "intent", 3: "converted"}
    return counts.select(
        "*",
        safe_ratio(F.col("engaged"), F.col("sessions")).alias("engaged_rate"),
        safe_ratio(F.col("intent"), F.col("engaged")).alias("intent_rate"),
        safe_ratio(F.col("converted"), F.col("intent")).alias("conversion_rate"),
        *[safe_ratio(F.col(m), F.col(base[step])).alias(f"{m}_share") for m, (_, step) in sub_metrics.items()],
    )


def funnel_of(sessions: DataFrame, sub_metrics: dict = fixed.SUB_METRICS) -> DataFrame:
    return _with_rates(sessions.agg(*_funnel_aggregates(sub_metrics)), sub_metrics)


def funnel(
    rows: DataFrame, channel: str | None = None, levels: dict = fixed.STEP_LEVEL, sub_metrics: dict = fixed.SUB_METRICS
) -> DataFrame:
    """Cumulative step counts, step rates and sub-metrics as one row, optionally for one channel."""
    scoped = rows.filter(F.col("channel") == channel) if channel else rows
    return funnel_of(sessionise(scoped, levels, sub_metrics), sub_metrics)


def funnel_by_channel(
    rows: DataFrame, levels: dict = fixed.STEP_LEVEL, sub_metrics: dict = fixed.SUB_METRICS
) -> DataFrame:
    """The funnel of every channel at once; each channel sees only its own rows of a session."""
    sessions = sessionise(rows, levels, sub_metrics, keys=("channel", "session_id"))
    return _with_rates(sessions.groupBy("channel").agg(*_funnel_aggregates(sub_metrics)), sub_metrics)


def funnel_with_total(
    rows: DataFrame, levels: dict = fixed.STEP_LEVEL, sub_metrics: dict = fixed.SUB_METRICS
) -> DataFrame:
    """The funnel of every channel and of all rows, told apart by `is_total`, from one scan.

    A session that spans channels counts in each of them by its own rows there, and once in the total by
    all its rows. So the sessions per channel, which are few beside the rows, are grouped again by
    session with and without the channel, which merges their flags.
    """
    parts = sessionise(rows, levels, sub_metrics, keys=("channel", "session_id"))
    flags = ["shared", *[f"had_{m}" for m in sub_metrics]]
    merged = parts.groupingSets([["channel", "session_id"], ["session_id"]], "channel", "session_id").agg(
        (F.grouping("channel") == 1).alias("is_total"),
        F.max("max_step").alias("max_step"),
        *[F.bool_or(f).alias(f) for f in flags],
    )
    return _with_rates(merged.groupBy("channel", "is_total").agg(*_funnel_aggregates(sub_metrics)), sub_metrics)


def visitor_weeks(rows: DataFrame, conversions=fixed.CONVERSION_EVENTS) -> DataFrame:
    """One row per visitor and active week, with whether the visitor converted in it."""
    return rows.groupBy("visitor_id", row_week().alias("week")).agg(
        F.bool_or(_name().isin(*conversions)).alias("converted")
    )


def weekly_active(rows: DataFrame, conversions=fixed.CONVERSION_EVENTS) -> DataFrame:
    """Distinct converting visitors per week, for the weeks that have any."""
    pairs = rows.filter(_name().isin(*conversions)).select(row_week().alias("week"), "visitor_id").distinct()
    return pairs.groupBy("week").agg(F.count("*").alias("active"))


def daily_sketches(rows: DataFrame, conversions=fixed.CONVERSION_EVENTS, log_size: int = 14, keys=()) -> DataFrame:
    """(day, sketch), further split by `keys`: a sketch of the converting visitors of each day.

    A sketch is at most 2 ** log_size bytes or so however many visitors it has seen, so a table of them
    can be kept, appended to day by day and merged to any span of days without another look at the rows.
    """
    day = F.to_date(F.timestamp_millis(F.col("timestamp")))
    seen = rows.filter(_name().isin(*conversions)).groupBy(day.alias("day"), *keys)
    return seen.agg(F.hll_sketch_agg(F.col("visitor_id").cast("string"), log_size).alias("sketch"))


def weekly_active_estimate(sketches: DataFrame, keys=()) -> DataFrame:
    """(week, active) from daily sketches; the standard error is about 1.04 / sqrt(2 ** log_size)."""
    weeks = sketches.groupBy(week_of(F.col("day").cast("timestamp")).alias("week"), *keys)
    return weeks.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("active"))


def weekly_delta(weekly: DataFrame, weeks: int = 8) -> DataFrame:
    """The last weeks of a weekly series, each with the change from the week before it.

    The series has one row per week, so ordering it as a whole is cheap.
    """
    ordered = Window.orderBy("week")
    previous = F.lag("active").over(ordered)
    return (
        weekly.select("week", "active", previous.alias("previous"), (F.col("active") - previous).alias("delta"))
        .orderBy(F.col("week").desc())
        .limit(weeks)
    )


def return_rate(rows: DataFrame, conversions=fixed.CONVERSION_EVENTS) -> DataFrame:
    """Per week: converters, those of them seen again in the following week, and the rate."""
    upcoming = F.lead("week").over(Window.partitionBy("visitor_id").orderBy("week"))
    back = F.coalesce(upcoming == F.date_add("week", 7), F.lit(False))
    return (
        visitor_weeks(rows, conversions)
        .withColumn("came_back", back)
        .filter("converted")
        .groupBy("week")
        .agg(F.count("*").alias("converters"), F.count_if("came_back").alias("returned"))
        .withColumn("return_rate", safe_ratio(F.col("returned"), F.col("converters")))
    )


WEEKS_IN_BLOCK = 32


def week_bits(rows: DataFrame, conversions=fixed.CONVERSION_EVENTS) -> DataFrame:
    """(visitor_id, block, active, converted): the weeks of a visitor as bits, 32 weeks to a block.

    The upper half of `active` holds the next block's weeks, so that what follows a week is in its row.
    """
    number = (F.datediff("week", F.lit("1970-01-05").cast("date")) / 7).cast("int")
    weeks = visitor_weeks(rows, conversions).withColumn("number", number)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), at)
    at, block = F.pmod("number", F.lit(WEEKS_IN_BLOCK)).cast("int"), F.floor(F.col("number") / WEEKS_IN_BLOCK)
    own = F.struct(block.alias("block"), bit(at).alias("active"), F.when(F.col("converted"), bit(at)).otherwise(0).cast("bigint").alias("converted"))
    ahead = F.struct((block - 1).alias("block"), bit(at + WEEKS_IN_BLOCK).alias("active"), F.lit(0).cast("bigint").alias("converted"))
    sides = weeks.select("visitor_id", F.inline(F.array(own, ahead)))
    return sides.groupBy("visitor_id", "block").agg(F.bit_or("active").alias("active"), F.bit_or("converted").alias("converted"))


def retention(rows: DataFrame, weeks: int = 8, conversions=fixed.CONVERSION_EVENTS) -> DataFrame:
    """(week, after, converters, returned, return_rate): of a week's converters, how many were active
    `after` weeks later, for each number of weeks from 1 to `weeks`, at most 31.

    Every rate comes from one aggregate over the visitors' bits, however many weeks there are.
    """
    if not 0 < weeks < WEEKS_IN_BLOCK:
        raise ValueError(f"weeks must be from 1 to {WEEKS_IN_BLOCK - 1}")
    shifted = lambda c, n: F.call_function("shiftrightunsigned", c, n)
    on = lambda c: c.bitwiseAND(F.lit(1).cast("bigint")) == 1
    places = F.sequence(F.lit(0), F.lit(WEEKS_IN_BLOCK - 1))
    converted = F.filter(places, lambda at: on(shifted(F.col("converted"), at)))
    each = week_bits(rows, conversions).filter("converted <> 0").select("block", "active", F.explode(converted).alias("at"))
    day = ((F.col("block") * WEEKS_IN_BLOCK + F.col("at")) * 7).cast("int")
    ahead = each.select(F.date_add(F.lit("1970-01-05").cast("date"), day).alias("week"), shifted(F.col("active"), F.col("at")).alias("ahead"))
    counts = ahead.groupBy("week").agg(
        F.count("*").alias("converters"),
        F.array(*[F.count_if(on(F.shiftright("ahead", k))) for k in range(1, weeks + 1)]).alias("returned"),
    )
    rows_ = counts.select("week", "converters", F.posexplode("returned").alias("at", "returned"))
    rate = safe_ratio(F.col("returned"), F.col("converters")).alias("return_rate")
    return rows_.select("week", (F.col("at") + 1).alias("after"), "converters", "returned", rate)


def return_rate_for(rows: DataFrame, week: str, conversions=fixed.CONVERSION_EVENTS) -> DataFrame:
    """Return rate of one week as a single row, 0 when nobody converted in it."""
    start = F.lit(week).cast("date")
    two_weeks = rows.filter((row_week() >= start) & (row_week() < F.date_add(start, 14)))
    per_visitor = two_weeks.groupBy("visitor_id").agg(
        F.bool_or((row_week() == start) & _name().isin(*conversions)).alias("converted"),
        F.bool_or(row_week() == F.date_add(start, 7)).alias("came_back"),
    )
    return per_visitor.agg(
        safe_ratio(F.count_if(F.col("converted") & F.col("came_back")), F.count_if("converted")).alias("return_rate")
    )


def weekly_shares(rows: DataFrame, share_event: str = fixed.SHARE_EVENT) -> DataFrame:
    return rows.filter(_name() == share_event).groupBy(row_week().alias("week")).agg(F.count("*").alias("shares"))


def converted_share_of(sessions: DataFrame) -> DataFrame:
    """Of the sessions that converted, how many also shared."""
    converted = F.col("max_step") >= 3
    return sessions.agg(
        F.count_if(converted).alias("converted"), F.count_if(converted & F.col("shared")).alias("shared")
    ).withColumn("shared_rate", safe_ratio(F.col("shared"), F.col("converted")))


def conversion_actions(
    rows: DataFrame,
    calendar_event: str = "calendar_add",
    attending_event: str = "attending_tap",
    methods: dict | None = None,
) -> DataFrame:
    """Raw counts of the conversion buttons; calendar actions are told apart by method."""
    methods = methods or {"google_calendar": "google", "apple_calendar": "ics"}
    return rows.agg(
        *[
            F.count_if((_name() == calendar_event) & (F.col("method") == value)).alias(column)
            for column, value in methods.items()
        ],
        F.count_if(_name() == attending_event).alias("attending"),
    )


def filter_usage(rows: DataFrame, filter_event: str = fixed.FILTER_EVENT) -> DataFrame:
    """Uses per filter field, per city and in total, as (kind, key, uses)."""
    used = rows.filter(_name() == filter_event)
    fields = F.filter(F.transform(F.split("filter_fields", ","), lambda f: F.trim(f)), lambda f: f != "")
    tokens = F.transform(fields, lambda f: F.struct(F.lit("field").alias("kind"), f.alias("key")))
    city = F.when(
        F.coalesce(F.col("city"), F.lit("")) != "",
        F.array(F.struct(F.lit("city").alias("kind"), F.col("city").alias("key"))),
    )
    total = F.array(F.struct(F.lit("total").alias("kind"), F.lit("all").alias("key")))
    none = F.array().cast("array<struct<kind:string,key:string>>")
    marks = F.concat(F.coalesce(tokens, none), F.coalesce(city, none), total)
    return used.select(F.inline(marks)).groupBy("kind", "key").agg(F.count("*").alias("uses"))


def item_tallies(rows: DataFrame, tallies: dict = fixed.ITEM_TALLIES) -> DataFrame:
    """Counts per item of the events that target one."""
    targeted = rows.filter((F.coalesce(F.col("event_id"), F.lit("")) != "") & _name().isin(*tallies.values()))
    return targeted.groupBy("event_id").agg(
        *[F.count_if(_name() == event).alias(column) for column, event in tallies.items()]
    )


def top_items(tallies: DataFrame, n: int = 10, by: str = "attending") -> DataFrame:
    """The n items with the highest count; equal counts go by item id."""
    return tallies.orderBy(F.col(by).desc(), "event_id").limit(n)


def with_titles(top: DataFrame, listings: DataFrame) -> DataFrame:
    """Titles and sources for a short list of items; items without a listing keep nulls.

    The list's limit bounds its size, which lets the planner broadcast it to the listings scan.
    """
    wanted = top.select(F.col("event_id").alias("id"))
    found = listings.select("id", "title", "source").join(wanted, "id", "left_semi")
    return top.join(found.withColumnRenamed("id", "event_id"), "event_id", "left")
