"""The data-quality gate over published listings."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, functions as F

from townbill import fixed
from townbill.functions.ages import passes_age_filter
from townbill.functions.maths import percent_text, safe_ratio
from townbill.functions.text import let, matches_any
from townbill.functions.wallclock import implausible_start, instant


@dataclasses.dataclass(frozen=True)
class AgeThresholds:
    min_rows: int = fixed.MIN_ROWS["frisco-library"]
    max_dominant_share: float = fixed.MAX_DOMINANT_SHARE
    max_toddler_share: float = fixed.MAX_TODDLER_SHARE


# source -> name used in its checks
SHORT_NAMES = {
    "frisco-library": "frisco", "plano-library": "plano",
    "play-frisco": "play-frisco", "kaleidoscope-park": "kaleidoscope-park",
}


def adult_title_leak(
    title: Column, age_min: Column, patterns=fixed.ADULT_TITLE_PATTERNS, adult_age: int = fixed.ADULT_AGE
) -> Column:
    """A title aimed at adults on a row that children would see."""
    aimed = let(F.lower(title), lambda t: matches_any(t, patterns))
    return F.coalesce(aimed, F.lit(False)) & (F.coalesce(age_min, F.lit(0)) < adult_age)


def bucket_text(lo: Column, hi: Column) -> Column:
    show = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.concat(show(lo), F.lit("-"), show(hi))


def dominant_bucket(df: DataFrame, lo: str = "age_min", hi: str = "age_max", keys=()) -> DataFrame:
    """The most frequent (lowest, highest) age pair and its share; ties go to the lesser text."""
    per_bucket = df.groupBy(*keys, bucket_text(F.col(lo), F.col(hi)).alias("bucket")).agg(F.count("*").alias("n"))
    best = F.min_by("bucket", F.struct(-F.col("n"), "bucket"))
    measures = [
        F.coalesce(best, F.lit("n/a")).alias("bucket"),
        safe_ratio(F.max("n"), F.sum("n")).alias("share"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    ]
    return per_bucket.groupBy(*keys).agg(*measures)


def filter_share(df: DataFrame, passes: Column, keys=()) -> DataFrame:
    """Share of rows that a filter lets through, 0 for no rows."""
    return df.groupBy(*keys).agg(safe_ratio(F.count_if(passes), F.count("*")).alias("share"))


def early_start_share(df: DataFrame, max_share: float = fixed.MAX_EARLY_SHARE, zone: str = fixed.LOCAL_ZONE) -> DataFrame:
    """Per source, the share of starts in the small hours and whether it is tolerable."""
    early = implausible_start(F.col("start_datetime"), unknown_is_bad=False, zone=zone)
    return (
        df.groupBy("source")
        .agg(F.count_if(early).alias("early"), F.count("*").alias("total"))
        .withColumn("share", safe_ratio(F.col("early"), F.col("total")))
        .withColumn("pass", F.col("share") <= max_share)
    )


def row_count_checks(df: DataFrame, minimums: dict = fixed.MIN_ROWS) -> DataFrame:
    """Rows per expected source against its minimum; a source without rows still gets a line."""
    wanted = df.sparkSession.createDataFrame(list(minimums.items()), "source STRING, min_rows INT")
    counts = df.groupBy("source").agg(F.count("*").alias("n"))
    found = F.coalesce(F.col("n"), F.lit(0))
    return wanted.join(counts, "source", "left").select(
        "source", found.alias("total"), "min_rows", (found >= F.col("min_rows")).alias("pass")
    )


def freshness(df: DataFrame, now, max_hours: int = fixed.FRESHNESS_HOURS, column: str = "ingested_at") -> DataFrame:
    """One row: newest ingest, its age in hours, and whether it is recent enough."""
    hours = (F.unix_seconds(instant(now)) - F.unix_seconds("newest")) / 3600
    return df.agg(F.max(column).alias("newest")).select(
        "newest", hours.alias("hours"), F.coalesce(hours <= max_hours, F.lit(False)).alias("pass")
    )


def _source_measures(upcoming: DataFrame) -> DataFrame:
    """All measures of the report per source: one pass over the rows, keyed by age pair."""
    early = implausible_start(F.col("start_datetime"), unknown_is_bad=False)
    leak = adult_title_leak(F.col("title"), F.col("age_min"))
    toddler = passes_age_filter(
        [fixed.TODDLER_RANGE], F.col("source"), F.col("kid_relevant"), F.col("age_confidence"),
        F.col("age_buckets"), F.col("age_min"), F.col("age_max"),
    )
    per_bucket = upcoming.groupBy("source", bucket_text(F.col("age_min"), F.col("age_max")).alias("bucket")).agg(
        F.count("*").alias("n"),
        F.count_if(leak).alias("leaks"),
        F.min(F.when(leak, F.col("title"))).alias("leak_title"),
        F.count_if(toddler).alias("toddlers"),
        F.count_if(early).alias("early"),
        F.min(F.when(early, F.col("title"))).alias("early_title"),
    )
    return per_bucket.groupBy("source").agg(
        F.sum("n").alias("n"),
        F.max("n").alias("top"),
        F.min_by("bucket", F.struct(-F.col("n"), "bucket")).alias("bucket"),
        F.sum("leaks").alias("leaks"),
        F.min("leak_title").alias("leak_title"),
        F.sum("toddlers").alias("toddlers"),
        F.sum("early").alias("early"),
        F.min("early_title").alias("early_title"),
    )


def _check(name: Column, passed: Column, detail: Column) -> Column:
    return F.struct(name.alias("name"), passed.alias("pass"), detail.alias("detail"))


def quality_report(
    listings: DataFrame,
    now,
    ages: AgeThresholds = AgeThresholds(),
    minimums: dict = fixed.MIN_ROWS,
    names: dict = SHORT_NAMES,
    max_early_share: float = fixed.MAX_EARLY_SHARE,
    age_checked: str = "frisco-library",
) -> DataFrame:
    """Every check of the gate as (name, pass, detail), over all upcoming rows of each source."""
    spark = listings.sparkSession
    upcoming = listings.filter(F.col("start_datetime") >= instant(now))
    spine = spark.createDataFrame(
        [(s, names[s], minimums[s]) for s in names], "source STRING, label STRING, min_rows INT"
    )
    m = spine.join(_source_measures(upcoming), "source", "left").fillna(0, ["n", "top", "leaks", "toddlers", "early"])
    n, label, least = F.col("n"), F.col("label"), F.col("min_rows")
    text = lambda c: c.cast("string")
    dominant, toddlers, early = (safe_ratio(F.col(c), n) for c in ("top", "toddlers", "early"))
    titled = lambda c: F.concat(F.lit(', e.g. "'), F.col(c), F.lit('"'))
    enough = _check(
        F.concat(label, F.when(least > 0, ": non-empty").otherwise(": present")),
        n >= least,
        F.concat(text(n), F.lit(" upcoming"), F.when(least > 0, F.concat(F.lit(" (min "), text(least), F.lit(")"))).otherwise("")),
    )
    start = _check(
        F.concat(label, F.lit(": start times plausible")),
        early <= max_early_share,
        F.when(n == 0, "no events")
        .when(F.col("early") == 0, "none in the small hours")
        .otherwise(F.concat(text(F.col("early")), F.lit("/"), text(n), F.lit(" start in the small hours"), titled("early_title"))),
    )
    variety = _check(
        F.concat(label, F.lit(": age variety")),
        dominant <= ages.max_dominant_share,
        F.concat(
            F.lit("top bucket "), F.coalesce(F.col("bucket"), F.lit("n/a")), F.lit(" = "), percent_text(dominant),
            F.lit("% (max "), percent_text(F.lit(ages.max_dominant_share)), F.lit("%)"),
        ),
    )
    leaks = _check(
        F.concat(label, F.lit(": no adult-title leaks")),
        F.col("leaks") == 0,
        F.when(F.col("leaks") == 0, "none").otherwise(F.concat(text(F.col("leaks")), F.lit(" leaked"), titled("leak_title"))),
    )
    narrows = _check(
        F.concat(label, F.lit(": toddler filter narrows")),
        toddlers <= ages.max_toddler_share,
        F.concat(
            F.lit("toddlers match "), percent_text(toddlers), F.lit("% (max "),
            percent_text(F.lit(ages.max_toddler_share)), F.lit("%)"),
        ),
    )
    checks = F.when(F.col("source") == age_checked, F.array(enough, variety, leaks, narrows, start)).otherwise(
        F.array(enough, start)
    )
    hours = F.col("hours")
    fresh = freshness(listings, now).select(
        F.lit("freshness").alias("name"),
        "pass",
        F.coalesce(F.format_string("last ingest %.1fh ago", hours), F.lit("none recorded")).alias("detail"),
    )
    fresh = fresh.withColumn("detail", F.when(F.col("detail").contains("null"), "none recorded").otherwise(F.col("detail")))
    return m.select(F.inline(checks)).unionByName(fresh)


class QualityGateFailed(RuntimeError):
    """At least one check of a quality report failed."""


def enforce(report: DataFrame) -> None:
    """Raise when any check failed; the report has a handful of rows by construction."""
    failed = [r["name"] for r in report.filter(~F.col("pass")).select("name").collect()]
    if failed:
        raise QualityGateFailed(f"{len(failed)} check(s) failed: {', '.join(sorted(failed))}")
