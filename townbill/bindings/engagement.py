"""Engagement queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from townbill.bindings.registry import query, table
from townbill.bindings.views import ANALYTICS, CONVERSIONS, LEVELS, SESSIONS, SHARE, SUB_METRICS, analytics_rows
from townbill.operators import engagement as eg
from townbill.operators.likes import like_counts
from townbill.sources.tables import flatten_export, valid_rows

COUNTS = """
  COUNT(*) AS sessions,
  COUNT(*) FILTER (max_step >= 1) AS engaged,
  COUNT(*) FILTER (max_step >= 2) AS intent,
  COUNT(*) FILTER (max_step >= 3) AS converted,
  COUNT(*) FILTER (had_viewed AND max_step >= 1) AS viewed,
  COUNT(*) FILTER (had_clicked AND max_step >= 2) AS clicked,
  COUNT(*) FILTER (had_signed_up AND max_step >= 3) AS signed_up,
  COUNT(*) FILTER (had_purchased AND max_step >= 3) AS purchased
"""


def ratio(a: str, b: str, name: str) -> str:
    return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF({b}, 0), 0) AS {name}"


RATES = ",\n".join(
    [
        ratio("engaged", "sessions", "engaged_rate"),
        ratio("intent", "engaged", "intent_rate"),
        ratio("converted", "intent", "conversion_rate"),
        ratio("viewed", "engaged", "viewed_share"),
        ratio("clicked", "intent", "clicked_share"),
        ratio("signed_up", "converted", "signed_up_share"),
        ratio("purchased", "converted", "purchased_share"),
    ]
)


@query(f"WITH {ANALYTICS}, {SESSIONS}, counts AS (SELECT {COUNTS} FROM sessions) SELECT *, {RATES} FROM counts")
def session_funnel(spark, sf):
    return eg.funnel(analytics_rows(spark, sf), levels=LEVELS, sub_metrics=SUB_METRICS)


CHANNEL_SESSIONS = SESSIONS.replace("SELECT session_id,", "SELECT channel, session_id,").replace(
    "GROUP BY session_id", "GROUP BY channel, session_id"
)


@query(
    f"WITH {ANALYTICS}, {CHANNEL_SESSIONS}, counts AS (SELECT channel, {COUNTS} FROM sessions GROUP BY channel) "
    f"SELECT *, {RATES} FROM counts"
)
def funnel_by_channel(spark, sf):
    return eg.funnel_by_channel(analytics_rows(spark, sf), LEVELS, SUB_METRICS)


@query(
    f"WITH {ANALYTICS}, {CHANNEL_SESSIONS}, whole AS ({SESSIONS.split("AS (", 1)[1].strip()[:-1]}), "
    f"counts AS (SELECT channel, FALSE AS is_total, {COUNTS} FROM sessions GROUP BY channel "
    f"UNION ALL SELECT NULL, TRUE, {COUNTS} FROM whole) SELECT *, {RATES} FROM counts"
)
def funnel_with_total(spark, sf):
    return eg.funnel_with_total(analytics_rows(spark, sf), LEVELS, SUB_METRICS)


@query(
    f"WITH {ANALYTICS}, {CHANNEL_SESSIONS}, counts AS (SELECT {COUNTS} FROM sessions WHERE channel = 'c1') "
    f"SELECT *, {RATES} FROM counts"
)
def funnel_one_channel(spark, sf):
    return eg.funnel(analytics_rows(spark, sf), "c1", LEVELS, SUB_METRICS)


@query(f"WITH {ANALYTICS}, {SESSIONS} SELECT session_id, max_step, shared FROM sessions")
def session_steps(spark, sf):
    return eg.sessionise(analytics_rows(spark, sf), LEVELS, SUB_METRICS, SHARE).select("session_id", "max_step", "shared")


WEEKLY = """
weekly AS (SELECT week, COUNT(DISTINCT visitor_id) AS active FROM analytics
           WHERE event_name IN ('signup', 'purchase') GROUP BY week)
"""


@query(f"WITH {ANALYTICS}, {WEEKLY} SELECT week, active FROM weekly")
def weekly_active(spark, sf):
    return eg.weekly_active(analytics_rows(spark, sf), CONVERSIONS)


@query(f"WITH {ANALYTICS}, {WEEKLY} SELECT week, active, TRUE AS near FROM weekly")
def weekly_active_sketches(spark, sf):
    """The exact count beside whether the estimate from daily sketches is within five standard errors."""
    rows = analytics_rows(spark, sf)
    told = eg.weekly_active_estimate(eg.daily_sketches(rows, CONVERSIONS)).withColumnRenamed("active", "estimate")
    both = eg.weekly_active(rows, CONVERSIONS).join(told, "week", "left")
    near = F.abs(F.col("estimate") - F.col("active")) <= F.ceil(F.col("active") * (5 * 1.04 / 2**7))
    return both.select("week", "active", F.coalesce(near, F.lit(False)).alias("near"))


@query(
    f"WITH {ANALYTICS}, {WEEKLY} SELECT week, active, LAG(active) OVER (ORDER BY week) AS previous, "
    "active - LAG(active) OVER (ORDER BY week) AS delta FROM weekly ORDER BY week DESC LIMIT 8"
)
def weekly_active_delta(spark, sf):
    return eg.weekly_delta(eg.weekly_active(analytics_rows(spark, sf), CONVERSIONS))


RETURNS = f"""
WITH {ANALYTICS},
conv AS (SELECT DISTINCT week, visitor_id FROM analytics WHERE event_name IN ('signup', 'purchase')),
act AS (SELECT DISTINCT week, visitor_id FROM analytics),
joined AS (SELECT c.week, a.visitor_id AS back FROM conv c
           LEFT JOIN act a ON a.visitor_id = c.visitor_id AND a.week = c.week + 7)
"""


@query(
    RETURNS + "SELECT week, COUNT(*) AS converters, COUNT(back) AS returned, "
    "CAST(COUNT(back) AS DOUBLE) / COUNT(*) AS return_rate FROM joined GROUP BY week"
)
def return_visit_rate(spark, sf):
    return eg.return_rate(analytics_rows(spark, sf), CONVERSIONS)


@query(
    f"""WITH {ANALYTICS},
conv AS (SELECT DISTINCT week, visitor_id FROM analytics WHERE event_name IN ('signup', 'purchase')),
act AS (SELECT DISTINCT week, visitor_id FROM analytics),
joined AS (SELECT c.week, k.after, a.visitor_id AS back FROM conv c CROSS JOIN (SELECT unnest(range(1, 9)) AS after) k
           LEFT JOIN act a ON a.visitor_id = c.visitor_id AND a.week = c.week + 7 * CAST(k.after AS INT))
SELECT week, CAST(after AS INT) AS after, COUNT(*) AS converters, COUNT(back) AS returned,
       CAST(COUNT(back) AS DOUBLE) / COUNT(*) AS return_rate FROM joined GROUP BY week, after"""
)
def retention_triangle(spark, sf):
    return eg.retention(analytics_rows(spark, sf), 8, CONVERSIONS)


@query(RETURNS + "SELECT CAST(COUNT(back) AS DOUBLE) / COUNT(*) AS return_rate FROM joined WHERE week = DATE '2024-01-08'")
def return_visit_rate_week(spark, sf):
    return eg.return_rate_for(analytics_rows(spark, sf), "2024-01-08", CONVERSIONS)


@query(f"WITH {ANALYTICS} SELECT week, COUNT(*) AS shares FROM analytics WHERE event_name = 'error' GROUP BY week")
def referral_weekly(spark, sf):
    return eg.weekly_shares(analytics_rows(spark, sf), SHARE)


@query(
    f"WITH {ANALYTICS}, {SESSIONS}, c AS (SELECT COUNT(*) FILTER (max_step >= 3) AS converted, "
    "COUNT(*) FILTER (max_step >= 3 AND shared) AS shared FROM sessions) "
    f"SELECT *, {ratio('shared', 'converted', 'shared_rate')} FROM c"
)
def referral_converted_share(spark, sf):
    return eg.converted_share_of(eg.sessionise(analytics_rows(spark, sf), LEVELS, SUB_METRICS, SHARE))


TALLIES = {"attending": "purchase", "calendar_adds": "signup", "directions": "click", "shares": "error"}
TALLY_SQL = f"""
WITH {ANALYTICS},
tallies AS (
  SELECT event_id, COUNT(*) FILTER (event_name = 'purchase') AS attending,
         COUNT(*) FILTER (event_name = 'signup') AS calendar_adds,
         COUNT(*) FILTER (event_name = 'click') AS directions, COUNT(*) FILTER (event_name = 'error') AS shares
  FROM analytics WHERE event_name <> 'view' AND event_id <> '' GROUP BY event_id),
best AS (SELECT * FROM tallies ORDER BY attending DESC, event_id LIMIT 10)
"""


@query(TALLY_SQL + "SELECT * FROM tallies")
def item_tallies(spark, sf):
    return eg.item_tallies(analytics_rows(spark, sf), TALLIES)


@query(TALLY_SQL + "SELECT * FROM best")
def top_items(spark, sf):
    return eg.top_items(eg.item_tallies(analytics_rows(spark, sf), TALLIES))


@query(
    TALLY_SQL + "SELECT best.*, p_name AS title, p_brand AS source FROM best "
    "LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = event_id"
)
def top_item_titles(spark, sf):
    listings = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("source")
    )
    return eg.with_titles(eg.top_items(eg.item_tallies(analytics_rows(spark, sf), TALLIES)), listings)


@query(
    f"WITH {ANALYTICS} SELECT COUNT(*) FILTER (event_name = 'signup' AND method = 'google') AS google_calendar, "
    "COUNT(*) FILTER (event_name = 'signup' AND method = 'ics') AS apple_calendar, "
    "COUNT(*) FILTER (event_name = 'purchase') AS attending FROM analytics"
)
def conversion_actions(spark, sf):
    return eg.conversion_actions(analytics_rows(spark, sf), "signup", "purchase")


@query(
    f"""WITH {ANALYTICS}, used AS (SELECT * FROM analytics WHERE event_name = 'view'),
    tokens AS (SELECT TRIM(UNNEST(string_split(filter_fields, ','))) AS key FROM used)
    SELECT 'field' AS kind, key, COUNT(*) AS uses FROM tokens WHERE key <> '' GROUP BY key
    UNION ALL SELECT 'city', city, COUNT(*) FROM used WHERE city IS NOT NULL GROUP BY city
    UNION ALL SELECT 'total', 'all', COUNT(*) FROM used"""
)
def filter_usage(spark, sf):
    return eg.filter_usage(analytics_rows(spark, sf), "view")


@query(
    f"WITH {ANALYTICS} SELECT visitor_id, week, BOOL_OR(event_name IN ('signup', 'purchase')) AS converted "
    "FROM analytics GROUP BY visitor_id, week"
)
def visitor_weeks(spark, sf):
    return eg.visitor_weeks(analytics_rows(spark, sf), CONVERSIONS)


def export_rows(spark, sf):
    """The events table as a nested analytics export; one in ten users has no session id."""
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    text = lambda key, value: F.struct(
        F.lit(key).alias("key"),
        F.struct(value.cast("string").alias("string_value"), F.lit(None).cast("bigint").alias("int_value")).alias("value"),
    )
    number = lambda key, value: F.struct(
        F.lit(key).alias("key"),
        F.struct(F.lit(None).cast("string").alias("string_value"), value.cast("bigint").alias("int_value")).alias("value"),
    )
    session = F.when(F.col("user_id") % 10 != 0, F.array(number("ga_session_id", F.dayofmonth("ts"))))
    return e.select(
        F.to_date("ts").alias("event_date"),
        F.col("user_id").cast("string").alias("user_pseudo_id"),
        F.col("event_type").alias("event_name"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("event_timestamp"),
        F.struct(F.when(k % 4 > 0, F.concat(F.lit("c"), (k % 4).cast("string"))).alias("medium")).alias("traffic_source"),
        F.concat(
            F.array(text("event_id", k), text("city", F.when(k % 2 == 0, "plano"))),
            F.coalesce(session, F.array().cast(
                "array<struct<key:string,value:struct<string_value:string,int_value:bigint>>>"
            )),
        ).alias("event_params"),
    )


FLAT = """
WITH flat AS (
  SELECT CAST(user_id AS VARCHAR) AS visitor_id,
         CASE WHEN user_id % 10 <> 0 THEN user_id || '.' || day(ts) END AS session_id,
         event_type AS event_name,
         CAST(round(epoch_us(ts) / 1000.0) AS BIGINT) AS "timestamp",
         CASE WHEN k % 4 > 0 THEN 'c' || (k % 4) ELSE '(none)' END AS channel,
         CAST(k AS VARCHAR) AS event_id,
         CAST(NULL AS VARCHAR) AS method,
         CAST(NULL AS VARCHAR) AS filter_fields,
         CASE WHEN k % 2 = 0 THEN 'plano' END AS city
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
  WHERE CAST(ts AS DATE) >= DATE '2024-01-15')
"""


@query(FLAT + "SELECT * FROM flat")
def flatten_params(spark, sf):
    from townbill.sources.tables import recent_export

    return flatten_export(recent_export(export_rows(spark, sf), "2024-04-14"))


@query(FLAT + "SELECT * FROM flat WHERE session_id IS NOT NULL")
def valid_analytics_rows(spark, sf):
    from townbill.sources.tables import recent_export

    return valid_rows(flatten_export(recent_export(export_rows(spark, sf), "2024-04-14")))


@query(
    """WITH log AS (
      SELECT regexp_extract(props, '([0-9]+)', 1) AS event_id,
             list(CASE WHEN event_type IN ('error', 'view') THEN -1 ELSE 1 END ORDER BY ts, event_id) AS deltas
      FROM events GROUP BY 1)
    SELECT event_id, CAST(list_reduce(list_prepend(1, deltas[2:]), lambda a, d: greatest(0, a + d)) AS BIGINT) AS count
    FROM log"""
)
def like_counter(spark, sf):
    log = table(spark, sf, "events").select(
        F.regexp_extract("props", r"(\d+)", 1).alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("error", "view"), -1).otherwise(1).alias("delta"),
    )
    return like_counts(log)
