"""The given tables in the shapes the operators expect, as DataFrames and as the same SQL.

Every row of the table takes part; missing dimensions are derived from its own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from townbill.bindings.registry import table

# ---- events as analytics rows -----------------------------------------------------------

LEVELS = {"view": 1, "click": 2, "signup": 3, "purchase": 3}
CONVERSIONS = ("signup", "purchase")
SUB_METRICS = {"viewed": ("view", 1), "clicked": ("click", 2), "signed_up": ("signup", 3), "purchased": ("purchase", 3)}
SHARE = "error"

FILTER_FIELDS = ("ages,sources", " date_from , ages,", "branches", "ages,ages", "")


def pick(index: Column, values) -> Column:
    """The index-th of a list of literals, from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def analytics_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.withColumn("k", k).select(
        F.col("user_id").cast("string").alias("visitor_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("."), day).alias("session_id"),
        F.col("event_type").alias("event_name"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.concat(F.lit("c"), (F.col("k") % 4).cast("string")).alias("channel"),
        F.col("k").cast("string").alias("event_id"),
        pick(F.col("k") % 3, ["google", "ics", "other"]).alias("method"),
        pick(F.col("k") % 5, FILTER_FIELDS).alias("filter_fields"),
        F.when(F.col("k") % 3 == 0, "frisco").when(F.col("k") % 3 == 1, "plano").alias("city"),
    )


ANALYTICS = """
keyed AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
analytics AS (
  SELECT CAST(user_id AS VARCHAR) AS visitor_id,
         CAST(user_id AS VARCHAR) || '.' || strftime(ts, '%Y-%m-%d') AS session_id,
         event_type AS event_name,
         epoch_ms(ts) AS "timestamp",
         CAST(date_trunc('week', ts) AS DATE) AS week,
         'c' || (k % 4) AS channel,
         CAST(k AS VARCHAR) AS event_id,
         CASE k % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'ics' ELSE 'other' END AS method,
         CASE k % 5 WHEN 0 THEN 'ages,sources' WHEN 1 THEN ' date_from , ages,' WHEN 2 THEN 'branches'
                    WHEN 3 THEN 'ages,ages' ELSE '' END AS filter_fields,
         CASE k % 3 WHEN 0 THEN 'frisco' WHEN 1 THEN 'plano' END AS city
  FROM keyed)
"""

SESSIONS = """
sessions AS (
  SELECT session_id,
         COALESCE(MAX(CASE event_name WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3
                      WHEN 'purchase' THEN 3 END), 0) AS max_step,
         BOOL_OR(event_name = 'view') AS had_viewed, BOOL_OR(event_name = 'click') AS had_clicked,
         BOOL_OR(event_name = 'signup') AS had_signed_up, BOOL_OR(event_name = 'purchase') AS had_purchased,
         BOOL_OR(event_name = 'error') AS shared
  FROM analytics GROUP BY session_id)
"""

# ---- orders as listings -----------------------------------------------------------------

SOURCES = ("frisco-library", "plano-library", "play-frisco", "kaleidoscope-park")
TITLES = (
    "Story Time", "Evening Book  Club", "City Council session", "Painting for Adults", "Teen robot lab",
    "story time", "Senior swim; 18+, all",
)
NOW = "1998-06-15T12:00:00Z"


def order_listings(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    n = k % 4
    step = F.floor(k / 4)
    classified = n >= 2
    day = F.col("o_orderdate").cast("timestamp")
    minutes = (k % 24) * 60 + (k % 2) * 30
    start = day + F.make_dt_interval(mins=minutes.cast("int"))
    lone = lambda *v: F.array(*[F.lit(x) for x in v])
    return o.select(
        F.concat(pick(n, SOURCES), F.lit("-"), k.cast("string")).alias("id"),
        pick(n, SOURCES).alias("source"),
        pick(k % 7, TITLES).alias("title"),
        F.concat(F.col("o_orderpriority"), F.lit(" for customer "), F.col("o_custkey").cast("string")).alias("description"),
        start.alias("start_datetime"),
        F.when(k % 3 == 0, start + F.make_dt_interval(days=(k % 20).cast("int"))).alias("end_datetime"),
        F.when(k % 9 == 8, "A virtual room").when(k % 9 == 7, "Plano Public Library").when(k % 11 == 0, None)
        .otherwise(F.concat(F.lit("Branch "), (k % 9).cast("string"), F.lit(" - 12 Main St"))).alias("location_name"),
        F.when(k % 2 == 0, F.concat((k % 5).cast("string"), F.lit(" Main St, Town"))).alias("location_address"),
        F.when(k % 13 != 0, 33 + (k % 9) / 100).alias("location_lat"),
        (-96 - (k % 9) / 100).alias("location_lng"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("is_free"),
        pick(k % 5, [0, 6, 13, 18, None]).alias("age_min"),
        pick(k % 5, [5, 12, 17, 99, None]).alias("age_max"),
        F.when(classified & (step % 3 != 2), step % 3 == 0).alias("kid_relevant"),
        F.when(classified, F.when(step % 4 == 0, lone("toddler")).when(step % 4 == 1, lone("kids", "teen"))
               .when(step % 4 == 2, lone("family")).otherwise(F.array().cast("array<string>")))
        .when(k % 20 == 1, lone("family")).alias("age_buckets"),
        F.when(classified, pick(step % 5, ["high", "medium", "low", "high", None])).alias("age_confidence"),
        F.when(classified, pick(step % 3, ["free", "paid", "unknown"])).alias("price_class"),
        F.when(classified, pick(step % 2, ["confirmed", "inferred"])).alias("price_confidence"),
        F.concat(F.lit("https://town.example.org/e/"), k.cast("string")).alias("event_url"),
        F.when(k % 6 == 0, F.concat(F.lit("https://img.example.org/"), k.cast("string"), F.lit(".png"))).alias("thumbnail_url"),
        (day + F.make_dt_interval(days=F.lit(1))).alias("ingested_at"),
        day.alias("created_at"),
        k.alias("seq"),
    )


LISTINGS = """
order_listings AS (
  SELECT src || '-' || k AS id, src AS source,
         CASE k % 7 WHEN 0 THEN 'Story Time' WHEN 1 THEN 'Evening Book  Club' WHEN 2 THEN 'City Council session'
              WHEN 3 THEN 'Painting for Adults' WHEN 4 THEN 'Teen robot lab' WHEN 5 THEN 'story time'
              ELSE 'Senior swim; 18+, all' END AS title,
         o_orderpriority || ' for customer ' || o_custkey AS description,
         st AS start_datetime,
         CASE WHEN k % 3 = 0 THEN st + to_days(CAST(k % 20 AS INT)) END AS end_datetime,
         CASE WHEN k % 9 = 8 THEN 'A virtual room' WHEN k % 9 = 7 THEN 'Plano Public Library' WHEN k % 11 = 0 THEN NULL
              ELSE 'Branch ' || (k % 9) || ' - 12 Main St' END AS location_name,
         CASE WHEN k % 2 = 0 THEN (k % 5) || ' Main St, Town' END AS location_address,
         CASE WHEN k % 13 <> 0 THEN 33 + CAST(k % 9 AS DOUBLE) / 100 END AS location_lat,
         -96 - CAST(k % 9 AS DOUBLE) / 100 AS location_lng,
         CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_free,
         CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 13 WHEN 3 THEN 18 END AS age_min,
         CASE k % 5 WHEN 0 THEN 5 WHEN 1 THEN 12 WHEN 2 THEN 17 WHEN 3 THEN 99 END AS age_max,
         CASE WHEN n >= 2 AND step % 3 <> 2 THEN step % 3 = 0 END AS kid_relevant,
         CASE WHEN n >= 2 THEN CASE step % 4 WHEN 0 THEN ['toddler'] WHEN 1 THEN ['kids', 'teen'] WHEN 2 THEN ['family']
                                ELSE CAST([] AS VARCHAR[]) END
              WHEN k % 20 = 1 THEN ['family'] END AS age_buckets,
         CASE WHEN n >= 2 THEN CASE step % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'high' END END
           AS age_confidence,
         CASE WHEN n >= 2 THEN CASE step % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' ELSE 'unknown' END END AS price_class,
         CASE WHEN n >= 2 THEN CASE step % 2 WHEN 0 THEN 'confirmed' ELSE 'inferred' END END AS price_confidence,
         'https://town.example.org/e/' || k AS event_url,
         CASE WHEN k % 6 = 0 THEN 'https://img.example.org/' || k || '.png' END AS thumbnail_url,
         o_orderdate + INTERVAL 1 DAY AS ingested_at, o_orderdate AS created_at, k AS seq
  FROM (SELECT *, o_orderkey AS k, o_orderkey % 4 AS n, o_orderkey // 4 AS step,
               CASE o_orderkey % 4 WHEN 0 THEN 'frisco-library' WHEN 1 THEN 'plano-library'
                    WHEN 2 THEN 'play-frisco' ELSE 'kaleidoscope-park' END AS src,
               o_orderdate + to_minutes((o_orderkey % 24) * 60 + (o_orderkey % 2) * 30) AS st
        FROM orders))
"""
# today's local midnight at NOW
CUTOFF = "TIMESTAMP '1998-06-15 05:00:00'"

# ---- documents as listings --------------------------------------------------------------


def document_listings(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    return d.select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("d"), k.cast("string")).alias("id"),
        pick(k % 4, SOURCES).alias("source"),
        F.split("text", r"\.")[0].alias("title"),
        F.col("text").alias("description"),
        (k % 3 == 0).alias("registration_required"),
        "lang",
    )


DOCUMENTS = """
document_listings AS (
  SELECT doc_id AS seq, 'd' || doc_id AS id,
         CASE doc_id % 4 WHEN 0 THEN 'frisco-library' WHEN 1 THEN 'plano-library'
              WHEN 2 THEN 'play-frisco' ELSE 'kaleidoscope-park' END AS source,
         split_part(text, '.', 1) AS title, text AS description, doc_id % 3 = 0 AS registration_required, lang
  FROM documents)
"""


def stamp(c) -> Column:
    """Timestamps leave a query as text, so that both engines print them alike."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
