"""Catalogue, quality, pipeline and feed queries over orders as listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from townbill import fixed
from townbill.bindings.registry import query, table
from townbill.bindings.views import CUTOFF, LISTINGS, NOW, order_listings, sql_stamp, stamp
from townbill.functions import ages, labels, prices
from townbill.functions.wallclock import implausible_start, today_cutoff
from townbill.operators import catalog, pipeline_metrics, quality
from townbill.sources import feeds, intervals

SHOWN = "COALESCE(kid_relevant, true) AND (age_min IS NULL OR age_min < 18)"
FIELDS = f"id, source, title, {sql_stamp('start_datetime')} AS start_text"


def fields(df):
    return df.select("id", "source", "title", stamp("start_datetime").alias("start_text"))


def found(where: str = "true", window: str = "true", after: str = "true") -> str:
    """The list view: all rows of both parts that pass the filters."""
    return f"""WITH {LISTINGS},
    later AS (SELECT * FROM order_listings WHERE {SHOWN} AND {where} AND {window} AND start_datetime >= {CUTOFF}),
    running AS (SELECT * FROM order_listings WHERE {SHOWN} AND {where} AND start_datetime < {CUTOFF}
                AND end_datetime >= {CUTOFF}),
    both_parts AS (SELECT * FROM later UNION ALL SELECT * FROM running)
    SELECT {FIELDS} FROM both_parts WHERE {after}"""


ADULT_WORDS = "'book club|write club|figure club|reader''s choice|entrepreneur''s workshop|esl book'"
# ranges 0-5 and 13-17
AGE_HIT = """CASE WHEN source = 'play-frisco'
  THEN COALESCE(kid_relevant AND age_confidence IN ('high', 'medium') AND list_has_any(age_buckets, ['toddler', 'teen', 'family']), false)
  ELSE COALESCE((age_min <= 5 AND age_max >= 0) OR (age_min <= 17 AND age_max >= 13), false) END"""
AGES = [(0, 5), (13, 17)]


@query(found())
def search_listings(spark, sf):
    return fields(catalog.search_listings(order_listings(spark, sf), NOW))


@query(found("source IN ('frisco-library', 'plano-library') AND is_free", "true", "true"))
def search_free_libraries(spark, sf):
    return fields(
        catalog.search_listings(order_listings(spark, sf), NOW, ["frisco-library", "plano-library"], is_free=True)
    )


@query(found("location_name IN ('Branch 1 - 12 Main St', 'Branch 4 - 12 Main St')",
             "start_datetime >= TIMESTAMP '1998-07-01 05:00:00' AND start_datetime < TIMESTAMP '1998-10-01 05:00:00'"))
def search_branches_dates(spark, sf):
    return fields(
        catalog.search_listings(
            order_listings(spark, sf), NOW, branches=["Branch 1 - 12 Main St", "Branch 4 - 12 Main St"],
            date_from="1998-07-01", date_to="1998-09-30",
        )
    )


@query(found(after=f"{AGE_HIT} AND NOT (source = 'frisco-library' AND regexp_matches(lower(title), {ADULT_WORDS}))"))
def search_by_age(spark, sf):
    return fields(catalog.search_listings(order_listings(spark, sf), NOW, ages=AGES))


@query(f"WITH {LISTINGS} SELECT {FIELDS} FROM order_listings WHERE {AGE_HIT}")
def age_any_of(spark, sf):
    return fields(catalog.age_filter(order_listings(spark, sf), AGES))


@query("SELECT p_partkey, p_size <= 12 AND p_size >= 6 OR p_size <= 40 AND p_size >= 30 AS in_range FROM part")
def range_overlap(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", (ages.ranges_overlap(size, size, 6, 12) | ages.ranges_overlap(size, size, 30, 40)).alias("in_range")
    )


@query(f"WITH {LISTINGS} SELECT {FIELDS} FROM order_listings WHERE start_datetime < {CUTOFF} AND end_datetime >= {CUTOFF}")
def ongoing_listings(spark, sf):
    return fields(order_listings(spark, sf).filter(catalog.ongoing(NOW)))


@query(f"WITH {LISTINGS} SELECT {FIELDS} FROM order_listings WHERE start_datetime < {CUTOFF} AND end_datetime >= {CUTOFF}")
def ongoing_by_bins(spark, sf):
    """The same rows by the bins of the interval layout that can hold them."""
    cutoff = today_cutoff(NOW)
    filed = intervals.with_bins(order_listings(spark, sf)).filter(intervals.may_overlap(cutoff, cutoff))
    return fields(filed.filter(catalog.ongoing(NOW)))


@query(f"WITH {LISTINGS} SELECT {FIELDS} FROM order_listings WHERE start_datetime >= {CUTOFF} AND {SHOWN}")
def upcoming_shown(spark, sf):
    rows = order_listings(spark, sf)
    return fields(rows.filter(catalog.upcoming(NOW) & catalog.kid_gate() & catalog.adult_gate()))


@query(f"WITH {LISTINGS} SELECT {FIELDS} FROM order_listings WHERE start_datetime >= {CUTOFF} ORDER BY start_datetime, id LIMIT 20 OFFSET 20")
def second_page(spark, sf):
    rows = catalog.by_start(order_listings(spark, sf).filter(catalog.upcoming(NOW)))
    return fields(catalog.page(rows, 2))


@query(f"WITH {LISTINGS} SELECT {FIELDS} FROM order_listings WHERE start_datetime >= {CUTOFF} ORDER BY start_datetime, id LIMIT 60")
def three_pages(spark, sf):
    rows = catalog.by_start(order_listings(spark, sf).filter(catalog.upcoming(NOW)))
    return fields(catalog.page(rows, 3, cumulative=True))


INDEXABLE = f"""NOT COALESCE(source = 'play-frisco' AND NOT kid_relevant, false) AND (age_min IS NULL OR age_min < 18)
  AND NOT (source = 'frisco-library' AND regexp_matches(lower(title), {ADULT_WORDS}))
  AND COALESCE(end_datetime, start_datetime) >= {CUTOFF}"""


@query(f"WITH {LISTINGS} SELECT {FIELDS} FROM order_listings WHERE {INDEXABLE}")
def indexable(spark, sf):
    return fields(order_listings(spark, sf).filter(catalog.indexable(NOW)))


@query(
    f"""WITH {LISTINGS}, firsts AS (SELECT * FROM order_listings WHERE start_datetime >= {CUTOFF}
      AND source IN ('frisco-library', 'play-frisco'))
    SELECT {FIELDS} FROM firsts WHERE {INDEXABLE}"""
)
def indexable_city(spark, sf):
    return fields(catalog.indexable_listings(order_listings(spark, sf), NOW, "frisco"))


@query(f"WITH {LISTINGS} SELECT {FIELDS} FROM order_listings WHERE source = 'plano-library'")
def city_listings(spark, sf):
    return fields(catalog.for_city(order_listings(spark, sf), "plano"))


@query(f"WITH {LISTINGS} SELECT {FIELDS} FROM order_listings WHERE id = 'play-frisco-1002'")
def listing_by_id(spark, sf):
    return fields(catalog.by_id(order_listings(spark, sf), "play-frisco-1002"))


@query(
    f"""WITH {LISTINGS} SELECT DISTINCT location_name FROM order_listings
    WHERE source = 'plano-library' AND location_name IS NOT NULL AND location_name NOT IN ('Plano Public Library')"""
)
def distinct_branches(spark, sf):
    return catalog.distinct_branches(order_listings(spark, sf))


@query(
    f"""WITH {LISTINGS} SELECT location_name, location_address, location_lat, location_lng, source FROM (
      SELECT *, row_number() OVER (PARTITION BY location_name, source ORDER BY id) AS rn FROM order_listings
      WHERE location_lat IS NOT NULL AND location_lng IS NOT NULL AND location_name IS NOT NULL
        AND NOT contains(lower(location_name), 'virtual')) WHERE rn = 1"""
)
def distinct_venues(spark, sf):
    return catalog.distinct_venues(order_listings(spark, sf))


@query(
    f"""WITH {LISTINGS} SELECT id, CASE source WHEN 'frisco-library' THEN 'Frisco Public Library' WHEN 'plano-library' THEN 'Plano Public Library'
      WHEN 'play-frisco' THEN 'Play Frisco (Frisco Parks & Recreation)' ELSE 'Kaleidoscope Park' END AS org_name,
      CASE WHEN source = 'plano-library' THEN 'plano' ELSE 'frisco' END AS city FROM order_listings"""
)
def source_organisation(spark, sf):
    return catalog.with_source_dim(order_listings(spark, sf)).select("id", "org_name", "city")


# ---- quality ----------------------------------------------------------------------------

SHARE = "CAST({0} AS DOUBLE) / {1}"


@query(
    """WITH b AS (SELECT p_brand AS source, COALESCE(CAST(lo AS VARCHAR), 'null') || '-' || COALESCE(CAST(hi AS VARCHAR), 'null') AS bucket, COUNT(*) AS n
      FROM (SELECT p_brand, p_size % 4 * 5 AS lo, CASE WHEN p_size % 3 > 0 THEN p_size % 4 * 5 + 4 END AS hi FROM part) GROUP BY ALL)
    SELECT source, arg_min(bucket, (-n, bucket)) AS bucket, CAST(MAX(n) AS DOUBLE) / SUM(n) AS share, CAST(SUM(n) AS BIGINT) AS total
    FROM b GROUP BY source"""
)
def dominant_bucket(spark, sf):
    lo = F.col("p_size") % 4 * 5
    parts = table(spark, sf, "part").select(
        F.col("p_brand").alias("source"), lo.alias("age_min"), F.when(F.col("p_size") % 3 > 0, lo + 4).alias("age_max")
    )
    return quality.dominant_bucket(parts, keys=("source",))


@query(
    f"""WITH {LISTINGS} SELECT source, CAST(COUNT(*) FILTER ({AGE_HIT}) AS DOUBLE) / COUNT(*) AS share
    FROM order_listings GROUP BY source"""
)
def age_filter_share(spark, sf):
    c = F.col
    passes = ages.passes_age_filter(
        AGES, c("source"), c("kid_relevant"), c("age_confidence"), c("age_buckets"), c("age_min"), c("age_max")
    )
    return quality.filter_share(order_listings(spark, sf), passes, ["source"])


EARLY = "hour(lt) < 7 AND NOT (hour(lt) = 0 AND minute(lt) = 0)"
WITH_LOCAL = "(SELECT *, (start_datetime AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS lt FROM order_listings)"


@query(
    f"""WITH {LISTINGS} SELECT source, COUNT(*) FILTER ({EARLY}) AS early, COUNT(*) AS total,
    CAST(COUNT(*) FILTER ({EARLY}) AS DOUBLE) / COUNT(*) AS share,
    CAST(COUNT(*) FILTER ({EARLY}) AS DOUBLE) / COUNT(*) <= 0.05 AS pass FROM {WITH_LOCAL} GROUP BY source"""
)
def early_start_share(spark, sf):
    return quality.early_start_share(order_listings(spark, sf))


LEAK = r"regexp_matches(lower(title), '\bfor adults\b|\badult[''’]?s?\b|\bseniors?\b|\b18\+\b') AND COALESCE(age_min, 0) < 18"


@query(f"WITH {LISTINGS} SELECT {FIELDS} FROM order_listings WHERE {LEAK}")
def adult_title_leaks(spark, sf):
    return fields(order_listings(spark, sf).filter(quality.adult_title_leak(F.col("title"), F.col("age_min"))))


@query(
    """SELECT w.source, COALESCE(n, 0) AS total, min_rows, COALESCE(n, 0) >= min_rows AS pass
    FROM (VALUES ('src0', 300), ('src1', 5), ('src99', 1), ('src98', 0)) AS w(source, min_rows)
    LEFT JOIN (SELECT source, COUNT(*) AS n FROM documents GROUP BY source) c ON c.source = w.source"""
)
def row_count_checks(spark, sf):
    return quality.row_count_checks(table(spark, sf, "documents"), {"src0": 300, "src1": 5, "src99": 1, "src98": 0})


@query(
    """SELECT strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS newest,
    CAST(CAST(floor(epoch(TIMESTAMP '2024-02-01 00:00:00')) AS BIGINT) - CAST(floor(epoch(MAX(ts))) AS BIGINT) AS DOUBLE) / 3600 AS hours,
    (CAST(floor(epoch(TIMESTAMP '2024-02-01 00:00:00')) AS BIGINT) - CAST(floor(epoch(MAX(ts))) AS BIGINT)) / 3600.0 <= 48 AS pass FROM events"""
)
def freshness(spark, sf):
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ingested_at"))
    return quality.freshness(events, "2024-02-01").withColumn("newest", stamp("newest"))


@query(
    f"""WITH {LISTINGS}, up AS (SELECT * FROM order_listings WHERE start_datetime >= TIMESTAMP '1998-06-15 12:00:00'),
    loc AS (SELECT *, (start_datetime AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS lt FROM up),
    m AS (SELECT source, COUNT(*) AS n, COUNT(*) FILTER ({EARLY}) AS early FROM loc GROUP BY source),
    fr AS (SELECT * FROM up WHERE source = 'frisco-library'),
    b AS (SELECT MAX(n) AS top FROM (SELECT COUNT(*) AS n FROM fr GROUP BY age_min, age_max))
    SELECT label || CASE WHEN least_rows > 0 THEN ': non-empty' ELSE ': present' END AS name, COALESCE(n, 0) >= least_rows AS pass
    FROM (VALUES ('frisco-library', 'frisco', 30), ('plano-library', 'plano', 30), ('play-frisco', 'play-frisco', 0),
                 ('kaleidoscope-park', 'kaleidoscope-park', 5)) AS w(source, label, least_rows) LEFT JOIN m USING (source)
    UNION ALL
    SELECT label || ': start times plausible', COALESCE(CAST(early AS DOUBLE) / n, 0) <= 0.05
    FROM (VALUES ('frisco-library', 'frisco'), ('plano-library', 'plano'), ('play-frisco', 'play-frisco'),
                 ('kaleidoscope-park', 'kaleidoscope-park')) AS w(source, label) LEFT JOIN m USING (source)
    UNION ALL SELECT 'frisco: age variety', CAST(top AS DOUBLE) / (SELECT COUNT(*) FROM fr) <= 0.85 FROM b
    UNION ALL SELECT 'frisco: no adult-title leaks', COUNT(*) FILTER ({LEAK}) = 0 FROM fr
    UNION ALL SELECT 'frisco: toddler filter narrows', CAST(COUNT(*) FILTER (age_min <= 5 AND age_max >= 0) AS DOUBLE) / COUNT(*) <= 0.9 FROM fr
    UNION ALL SELECT 'freshness', MAX(ingested_at) >= TIMESTAMP '1998-06-15 12:00:00' - INTERVAL 48 HOUR FROM order_listings"""
)
def quality_report(spark, sf):
    return quality.quality_report(order_listings(spark, sf), NOW).select("name", "pass")


# ---- badges, rules and texts ------------------------------------------------------------

BADGE = """
badged AS (SELECT *,
  CASE WHEN source = 'play-frisco' THEN
      CASE WHEN NOT COALESCE(kid_relevant AND age_confidence IN ('high', 'medium'), false) THEN NULL
           WHEN list_contains(age_buckets, 'family') THEN 'inferred-family' WHEN len(age_buckets) > 0 THEN 'inferred-specific' END
    WHEN list_contains(age_buckets, 'family') THEN 'confirmed-family'
    WHEN groups > 1 THEN 'structured-multi' WHEN groups = 1 THEN 'structured-specific' END AS age_kind,
  CASE WHEN source = 'play-frisco' THEN
      CASE WHEN price_class IN ('free', 'paid') THEN price_class || CASE WHEN price_confidence = 'confirmed' THEN '-confirmed' ELSE '-inferred' END END
    WHEN is_free THEN 'free-confirmed' WHEN NOT is_free THEN 'paid-confirmed' END AS price_kind
 FROM (SELECT *, COALESCE(CAST(age_min <= 5 AND age_max >= 0 AS INT), 0) + COALESCE(CAST(age_min <= 12 AND age_max >= 6 AS INT), 0)
              + COALESCE(CAST(age_min <= 17 AND age_max >= 13 AS INT), 0) AS groups FROM order_listings))
"""


def age_badge():
    c = F.col
    return ages.age_badge(c("source"), c("kid_relevant"), c("age_confidence"), c("age_buckets"), c("age_min"), c("age_max"))


def price_badge():
    c = F.col
    return prices.price_badge(c("source"), c("price_class"), c("price_confidence"), c("is_free"))


@query(
    f"""WITH {LISTINGS}, {BADGE} SELECT id, age_kind AS kind,
      CASE age_kind WHEN 'confirmed-family' THEN 'Family' WHEN 'inferred-family' THEN '~ Family ✦' WHEN 'inferred-specific' THEN '✦' END AS card,
      CASE WHEN age_kind LIKE '%family' THEN CASE WHEN age_kind LIKE 'inferred%' THEN '~ Family ✦' ELSE 'Family' END
           WHEN age_kind = 'inferred-specific' THEN CASE age_buckets[1] WHEN 'toddler' THEN '~ Ages 0–5 ✦' ELSE '~ Ages 6–17 ✦' END
           WHEN age_kind = 'structured-specific' THEN CASE age_min WHEN 0 THEN 'Ages 0–5' WHEN 6 THEN 'Ages 6–12'
                ELSE CASE WHEN source = 'frisco-library' THEN 'Teens' ELSE 'Ages 13–17' END END END AS detail
    FROM badged"""
)
def age_badges(spark, sf):
    badge = F.col("badge")
    return order_listings(spark, sf).withColumn("badge", age_badge()).select(
        "id", F.col("badge.kind").alias("kind"), ages.card_age_text(badge).alias("card"), ages.detail_age_text(badge).alias("detail")
    )


@query(
    f"""WITH {LISTINGS}, {BADGE}, l AS (SELECT *, CASE WHEN price_kind LIKE 'free%' THEN 'Free' WHEN price_kind LIKE 'paid%' THEN 'Paid' END AS label FROM badged)
    SELECT id, price_kind AS kind, CASE WHEN price_kind LIKE '%inferred' THEN label || ' ✦' ELSE label END AS card,
      CASE WHEN price_kind = 'free-confirmed' THEN 'Free admission' WHEN price_kind LIKE '%inferred' THEN label || ' ✦' ELSE label END AS detail FROM l"""
)
def price_badges(spark, sf):
    badge = F.col("badge")
    return order_listings(spark, sf).withColumn("badge", price_badge()).select(
        "id", F.col("badge.kind").alias("kind"), prices.card_price_text(badge).alias("card"),
        prices.detail_price_text(badge).alias("detail"),
    )


@query(
    f"""WITH {LISTINGS}, {BADGE}, s AS (SELECT id,
      CASE age_kind WHEN 'inferred-family' THEN 'Family suitability' WHEN 'inferred-specific' THEN 'Age suitability' END AS a,
      CASE price_kind WHEN 'free-inferred' THEN '''Free'' admission status' WHEN 'paid-inferred' THEN '''Paid'' admission status' END AS p FROM badged)
    SELECT id, CASE WHEN a IS NOT NULL OR p IS NOT NULL THEN concat_ws(' and ', a, p) || ' estimated from event description' END AS disclosure FROM s"""
)
def disclosures(spark, sf):
    rows = order_listings(spark, sf).withColumn("a", age_badge()).withColumn("p", price_badge())
    return rows.select("id", labels.inference_disclosure(F.col("a"), F.col("p")).alias("disclosure"))


@query(
    f"""WITH {LISTINGS} SELECT id, 'Can kids be dropped off? ' || CASE source
      WHEN 'frisco-library' THEN CASE WHEN age_min >= 13 THEN 'Yes — teens 13+ may attend alone' WHEN age_max <= 9 THEN 'No — adult must stay with child'
        WHEN age_min IS NOT NULL AND age_max IS NOT NULL THEN 'Only if child is 10 or older (Frisco Library policy)' ELSE 'Check with Frisco Library' END
      WHEN 'plano-library' THEN 'Plan to stay' ELSE 'Check with venue' END AS label,
      CASE WHEN source IN ('play-frisco', 'kaleidoscope-park') THEN 'Check with venue before dropping off.'
        WHEN source = 'plano-library' THEN 'No formal Plano Library policy — staff generally prefer a parent stay with younger kids, or remain in the library.' END AS note
    FROM order_listings"""
)
def supervision_rules(spark, sf):
    rule = labels.supervision(F.col("source"), F.col("age_min"), F.col("age_max"))
    return order_listings(spark, sf).select("id", rule.alias("r")).select("id", "r.label", "r.note")


@query(
    f"""WITH {LISTINGS} SELECT id, CASE WHEN age_min IS NOT NULL AND age_max IS NOT NULL THEN age_min || '-' || age_max
      WHEN len(age_buckets) > 0 THEN CASE age_buckets[1] WHEN 'toddler' THEN '0-5' WHEN 'kids' THEN '6-17' ELSE '0-17' END END AS ages FROM order_listings"""
)
def typical_ages(spark, sf):
    return order_listings(spark, sf).select(
        "id", ages.typical_age_range(F.col("age_min"), F.col("age_max"), F.col("age_buckets")).alias("ages")
    )


# ---- pipeline metrics -------------------------------------------------------------------


@query(
    f"""WITH {LISTINGS} SELECT w.source, COALESCE(n, 0) AS total FROM (VALUES ('frisco-library'), ('plano-library'), ('play-frisco'), ('nowhere')) AS w(source)
    LEFT JOIN (SELECT source, COUNT(*) AS n FROM order_listings GROUP BY source) c ON c.source = w.source"""
)
def source_totals(spark, sf):
    return pipeline_metrics.source_totals(order_listings(spark, sf), (*fixed.COUNTED_SOURCES, "nowhere"))


@query(
    f"""WITH {LISTINGS} SELECT COUNT(*) FILTER (is_free) AS free, COUNT(*) FILTER (NOT is_free) AS paid,
    COUNT(*) FILTER (is_free IS NULL) AS unknown FROM order_listings"""
)
def tri_state_totals(spark, sf):
    return pipeline_metrics.tri_state_totals(order_listings(spark, sf))


@query(
    f"""WITH {LISTINGS}, {BADGE}, s AS (SELECT CASE WHEN kid_relevant = false THEN 'hidden' ELSE age_kind END AS state FROM badged WHERE source = 'play-frisco')
    SELECT COUNT(*) FILTER (state = 'inferred-family') AS family, COUNT(*) FILTER (state = 'inferred-specific') AS specific,
      COUNT(*) FILTER (state IS NULL) AS nothing, COUNT(*) FILTER (state = 'hidden') AS hidden, COUNT(*) AS total FROM s"""
)
def age_visibility(spark, sf):
    return pipeline_metrics.age_visibility(order_listings(spark, sf))


@query(
    f"""WITH {LISTINGS} SELECT COUNT(*) FILTER (price_class = 'free' AND price_confidence = 'confirmed') AS free_confirmed,
      COUNT(*) FILTER (price_class = 'free' AND price_confidence = 'inferred') AS free_inferred,
      COUNT(*) FILTER (price_class = 'paid' AND price_confidence = 'confirmed') AS paid_confirmed,
      COUNT(*) FILTER (price_class = 'paid' AND price_confidence = 'inferred') AS paid_inferred,
      COUNT(*) FILTER (price_class = 'unknown') AS unknown, COUNT(*) AS total FROM order_listings WHERE source = 'play-frisco'"""
)
def price_visibility(spark, sf):
    return pipeline_metrics.price_visibility(order_listings(spark, sf))


STATUS = "CASE WHEN o_orderpriority LIKE '1%' THEN 'err' WHEN o_orderpriority LIKE '2%' THEN 'warn' WHEN o_orderpriority LIKE '3%' THEN 'odd' ELSE 'ok' END"


def order_statuses(spark, sf):
    p = F.col("o_orderpriority")
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("ran_at"),
        F.when(p.like("1%"), "err").when(p.like("2%"), "warn").when(p.like("3%"), "odd").otherwise("ok").alias("status"),
        F.when(k % 5 > 0, k % 400).alias("llm_calls"),
        F.when(k % 5 > 0, (k % 400) * F.lit(0.006)).cast("decimal(10,4)").alias("llm_cost_usd"),
    )


@query(
    f"""WITH days AS (SELECT CAST(UNNEST(generate_series(TIMESTAMP '1998-06-02', TIMESTAMP '1998-06-15', INTERVAL 1 DAY)) AS DATE) AS day),
    worst AS (SELECT CAST(o_orderdate AS DATE) AS day, MAX(CASE {STATUS} WHEN 'err' THEN 3 WHEN 'warn' THEN 2 WHEN 'ok' THEN 1 ELSE 0 END) AS rank
              FROM orders GROUP BY 1)
    SELECT day, ['none', 'ok', 'warn', 'err'][COALESCE(rank, 0) + 1] AS status FROM days LEFT JOIN worst USING (day)"""
)
def status_history(spark, sf):
    return pipeline_metrics.status_history(order_statuses(spark, sf), "1998-06-15")


COST = "CAST(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 400 END * 0.006 AS DECIMAL(10,4))"


@query(
    f"""WITH runs AS (SELECT o_orderkey AS id, o_orderdate AS ran_at, COALESCE({COST}, 0) AS cost,
      CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 400 ELSE 0 END AS calls FROM orders)
    SELECT CAST((SELECT cost FROM runs ORDER BY ran_at DESC, id LIMIT 1) AS DOUBLE) AS last_run_usd,
      CAST(SUM(cost) AS DOUBLE) AS cumulative_usd, CAST(SUM(calls) AS BIGINT) AS total_calls FROM runs"""
)
def cost_summary(spark, sf):
    cost = pipeline_metrics.cost_summary(order_statuses(spark, sf))
    return cost.select(
        F.col("last_run_usd").cast("double").alias("last_run_usd"),
        F.col("cumulative_usd").cast("double").alias("cumulative_usd"), "total_calls",
    )


@query(f"SELECT o_orderkey AS id, {STATUS} AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def latest_run(spark, sf):
    return pipeline_metrics.latest_run(order_statuses(spark, sf)).select("id", "status")


@query(f"SELECT o_orderkey AS id, {STATUS} AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 7")
def last_runs(spark, sf):
    return pipeline_metrics.last_runs(order_statuses(spark, sf)).select("id", "status")


# ---- feeds ------------------------------------------------------------------------------


@query(
    f"""WITH {LISTINGS} SELECT * FROM (VALUES ('https://listings.example.org', CAST(NULL AS VARCHAR), 'daily', CAST(1.0 AS DOUBLE)),
      ('https://listings.example.org/frisco', NULL, 'daily', 0.9), ('https://listings.example.org/plano', NULL, 'daily', 0.9))
      AS s(url, last_modified, change_frequency, priority)
    UNION ALL SELECT 'https://listings.example.org/events/' || id, {sql_stamp('ingested_at')}, 'weekly', 0.7
    FROM order_listings WHERE {INDEXABLE}"""
)
def sitemap_rows(spark, sf):
    rows = order_listings(spark, sf).filter(catalog.indexable(NOW))
    return feeds.sitemap(rows).withColumn("last_modified", stamp("last_modified"))


CITY_ROWS = f"""placed AS (SELECT *, CASE WHEN source = 'plano-library' THEN 'plano' WHEN source <> 'kaleidoscope-park' THEN 'frisco' END AS city
  FROM order_listings WHERE {INDEXABLE} AND start_datetime >= {CUTOFF}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY start_datetime, id) AS position FROM placed WHERE city IS NOT NULL)"""


@query(f"WITH {LISTINGS}, {CITY_ROWS} SELECT city, position, id FROM numbered WHERE position <= 50")
def item_positions(spark, sf):
    rows = order_listings(spark, sf).filter(catalog.indexable(NOW) & catalog.upcoming(NOW))
    placed = rows.withColumn(
        "city", F.when(F.col("source") == "plano-library", "plano").when(F.col("source") != "kaleidoscope-park", "frisco")
    ).filter(F.col("city").isNotNull())
    return feeds.item_positions(placed, ["city"]).select("city", F.col("position").cast("bigint").alias("position"), "id")


@query(
    f"""WITH {LISTINGS}, {CITY_ROWS} SELECT city, '{{"@context":"https://schema.org","@type":"ItemList","name":"Free kids events in '
      || CASE city WHEN 'plano' THEN 'Plano' ELSE 'Frisco' END || ', TX","url":"https://listings.example.org/' || city || '","numberOfItems":'
      || COUNT(*) || ',"itemListElement":[' || string_agg(CASE WHEN position <= 50 THEN '{{"@type":"ListItem","position":' || position
      || ',"url":"https://listings.example.org/events/' || id || '","name":"' || title || '"}}' END, ',' ORDER BY position) || ']}}' AS json
    FROM numbered GROUP BY city"""
)
def item_lists(spark, sf):
    return feeds.item_lists(order_listings(spark, sf), NOW)


ISO_SQL = "strftime({0}, '%Y-%m-%dT%H:%M:%S.000Z')"


@query(
    f"""WITH {LISTINGS} SELECT id, '{{"@context":"https://schema.org","@type":"Event","name":"' || title || '","startDate":"' || {ISO_SQL.format('start_datetime')}
      || '","eventAttendanceMode":"https://schema.org/OfflineEventAttendanceMode","eventStatus":"https://schema.org/EventScheduled","url":"https://listings.example.org/events/' || id
      || '","organizer":{{"@type":"Organization","name":"' || CASE source WHEN 'frisco-library' THEN 'Frisco Public Library' WHEN 'plano-library' THEN 'Plano Public Library'
           WHEN 'play-frisco' THEN 'Play Frisco (Frisco Parks & Recreation)' ELSE 'Kaleidoscope Park' END
      || '","url":"' || CASE source WHEN 'frisco-library' THEN 'https://www.friscolibrary.com/' WHEN 'plano-library' THEN 'https://library.plano.gov/'
           WHEN 'play-frisco' THEN 'https://www.friscotexas.gov/291/Parks-Recreation' ELSE 'https://kaleidoscopepark.org/events/' END || '"}}'
      || COALESCE(',"endDate":"' || {ISO_SQL.format('end_datetime')} || '"', '') || ',"description":"' || description || '"'
      || COALESCE(',"image":["' || thumbnail_url || '"]', '')
      || COALESCE(',"location":{{"@type":"Place","name":"' || location_name || '","address":"' || COALESCE(location_address, location_name) || '"'
           || COALESCE(',"geo":{{"@type":"GeoCoordinates","latitude":' || location_lat || ',"longitude":' || location_lng || '}}', '') || '}}', '')
      || CASE WHEN is_free THEN ',"isAccessibleForFree":true,"offers":{{"@type":"Offer","price":"0","priceCurrency":"USD","availability":"https://schema.org/InStock","url":"https://listings.example.org/events/' || id || '"}}'
              WHEN NOT is_free THEN ',"isAccessibleForFree":false' ELSE '' END
      || COALESCE(',"typicalAgeRange":"' || CASE WHEN age_min IS NOT NULL AND age_max IS NOT NULL THEN age_min || '-' || age_max
           WHEN len(age_buckets) > 0 THEN CASE age_buckets[1] WHEN 'toddler' THEN '0-5' WHEN 'kids' THEN '6-17' ELSE '0-17' END END || '"', '')
      || '}}' AS json FROM order_listings"""
)
def structured_feed(spark, sf):
    return feeds.structured_feed(order_listings(spark, sf))


ICS_TIME = "strftime({0}, '%Y%m%dT%H%M%SZ')"


@query(
    f"""WITH {LISTINGS} SELECT id, CASE title WHEN 'Story Time' THEN 'Story-Time' WHEN 'Evening Book  Club' THEN 'Evening-Book-Club'
        WHEN 'City Council session' THEN 'City-Council-session' WHEN 'Painting for Adults' THEN 'Painting-for-Adults'
        WHEN 'Teen robot lab' THEN 'Teen-robot-lab' WHEN 'story time' THEN 'story-time' ELSE 'Senior-swim-18-all' END || '.ics' AS filename,
      concat_ws(chr(13) || chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//Town listings//EN', 'CALSCALE:GREGORIAN', 'METHOD:PUBLISH', 'BEGIN:VEVENT',
        'UID:' || id || '@listings.example.org', 'DTSTAMP:' || {ICS_TIME.format('ingested_at')}, 'DTSTART:' || {ICS_TIME.format('start_datetime')},
        'DTEND:' || COALESCE({ICS_TIME.format('end_datetime')}, {ICS_TIME.format('start_datetime')}),
        'SUMMARY:' || replace(replace(title, ';', chr(92) || ';'), ',', chr(92) || ','),
        'DESCRIPTION:' || description || chr(92) || 'n' || chr(92) || 'nMore info: ' || event_url,
        'LOCATION:' || replace(NULLIF(concat_ws(', ', location_name, location_address), ''), ',', chr(92) || ','),
        'URL:' || event_url, 'END:VEVENT', 'END:VCALENDAR') AS ics FROM order_listings"""
)
def calendar_feed(spark, sf):
    return feeds.calendar_feed(order_listings(spark, sf), F.col("ingested_at"))
