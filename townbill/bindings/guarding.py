"""Guard, publish and merge queries over orders, lineitem and part."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from townbill.bindings.registry import query, table
from townbill.bindings.views import LISTINGS, analytics_rows, order_listings, sql_stamp, stamp
from townbill.functions.wallclock import implausible_start, local_second_of_day
from townbill.operators import guard, publish, series
from townbill.session import checkpoint_dir
from townbill.sources import sinks, tables
from townbill.sources.landings import fallback_verdict


def stored_orders(spark, sf):
    """Orders as stored rows, every start at 15:00 UTC."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=F.lit(15))).alias("start_datetime"),
    )


def incoming_orders(spark, sf):
    """The same orders scraped again: most 300 minutes early, some late, some under a new id."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    minutes = F.when(k % 10 < 7, -300).when(k % 10 == 7, 90).when(k % 10 == 8, 10).otherwise(0)
    return o.select(
        F.when(k % 50 >= 48, -k).otherwise(k).cast("string").alias("id"),
        F.concat(F.lit("order "), k.cast("string")).alias("title"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=F.lit(18), mins=minutes)).alias("start_datetime"),
        k.alias("seq"),
    )


GUARD = """
stored AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate + INTERVAL 15 HOUR AS st FROM orders),
incoming AS (
  SELECT CAST(CASE WHEN k % 50 >= 48 THEN -k ELSE k END AS VARCHAR) AS id, k AS seq, 'order ' || k AS title,
         o_orderdate + INTERVAL 18 HOUR + to_minutes(CASE WHEN k % 10 < 7 THEN -300 WHEN k % 10 = 7 THEN 90
                                  WHEN k % 10 = 8 THEN 10 ELSE 0 END) AS st
  FROM (SELECT *, o_orderkey AS k FROM orders)),
screened AS (
  SELECT *, hour(lt) < 7 AND NOT (hour(lt) = 0 AND minute(lt) = 0) AS bad
  FROM (SELECT *, (st AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS lt FROM incoming)),
offsets AS (
  SELECT CAST(round((epoch_ms(i.st) - epoch_ms(s.st)) / 60000.0) AS BIGINT) AS o, COUNT(*) AS n
  FROM screened i JOIN stored s ON s.id = i.id WHERE NOT i.bad GROUP BY 1),
moved AS (SELECT * FROM offsets WHERE abs(o) >= 30),
shift AS (
  SELECT CAST(COALESCE((SELECT SUM(n) FROM offsets), 0) AS BIGINT) AS overlap,
         CAST(COALESCE((SELECT SUM(n) FROM moved), 0) AS BIGINT) AS moved,
         (SELECT o FROM moved ORDER BY n DESC, abs(o), o LIMIT 1) AS dominant_offset_min,
         COALESCE((SELECT MAX(n) FROM moved), 0) AS agreeing),
judged AS (
  SELECT *, COALESCE(CAST(agreeing AS DOUBLE) / NULLIF(overlap, 0), 0) AS agreement,
         overlap >= 20 AND COALESCE(CAST(agreeing AS DOUBLE) / NULLIF(overlap, 0), 0) >= 0.8 AS systemic FROM shift),
counted AS (
  SELECT (SELECT COUNT(*) FROM screened) AS incoming, (SELECT COUNT(*) FROM screened WHERE bad) AS dropped,
         (SELECT COUNT(*) FROM screened WHERE NOT bad) AS kept, (SELECT COUNT(*) FROM stored) AS stored)
"""


@query(f"WITH {GUARD} SELECT overlap, moved, dominant_offset_min, agreement, systemic FROM judged")
def uniform_shift(spark, sf):
    kept = guard.with_screen(incoming_orders(spark, sf)).filter(~F.col("implausible"))
    return guard.uniform_shift(kept, stored_orders(spark, sf))


VERDICT = """
SELECT c.*, j.overlap, j.moved, j.dominant_offset_min, j.agreement, j.systemic,
       COALESCE(CAST(dropped AS DOUBLE) / NULLIF(incoming, 0), 0) AS implausible_share,
       CAST(dropped AS DOUBLE) / incoming > 0.1 OR {shifted} OR (stored >= 20 AND kept < stored * 0.5) AS abort,
       list_filter([
         CASE WHEN dropped > 0 THEN 'dropped ' || dropped || ' rows with unpublishable start times, e.g. '
              || (SELECT title FROM screened WHERE bad ORDER BY seq LIMIT 1) END,
         CASE WHEN CAST(dropped AS DOUBLE) / incoming > 0.1
              THEN 'ABORT: ' || printf('%.0f', 100.0 * dropped / incoming) || '% of rows had implausible times (max 10%)' END,
         CASE WHEN systemic THEN CASE WHEN {shifted} THEN 'ABORT: ' ELSE '' END || 'uniform ' || dominant_offset_min || 'min shift across '
              || printf('%.0f', 100 * agreement) || '% of ' || overlap || CASE WHEN {shifted} THEN ' stored rows' ELSE ' rows, allowed' END END,
         CASE WHEN stored >= 20 AND kept < stored * 0.5 THEN 'ABORT: batch has ' || kept || ' rows against ' || stored || ' stored' END],
         lambda x: x IS NOT NULL) AS reasons
FROM counted c, judged j
"""


@query(f"WITH {GUARD} " + VERDICT.format(shifted="systemic"))
def guard_verdict(spark, sf):
    return guard.guard_verdict(incoming_orders(spark, sf), stored_orders(spark, sf))


@query(f"WITH {GUARD} " + VERDICT.format(shifted="false"))
def guard_verdict_shift_allowed(spark, sf):
    return guard.guard_verdict(incoming_orders(spark, sf), stored_orders(spark, sf), allow_time_shift=True)


# the stored rows themselves, one in twenty moved and one in thirty dropped to 3 a.m. local
EDITED = f"""
stored AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate + INTERVAL 15 HOUR AS st FROM orders),
edited AS (SELECT id, k, CASE WHEN k % 30 = 7 THEN st - INTERVAL 6 HOUR WHEN k % 20 = 3 THEN st + INTERVAL 2 HOUR ELSE st END AS st
           FROM (SELECT *, CAST(id AS BIGINT) AS k FROM stored))
"""


def edited_orders(spark, sf):
    k = F.col("id").cast("bigint")
    hours = F.when(k % 30 == 7, -6).when(k % 20 == 3, 2).otherwise(0)
    return stored_orders(spark, sf).withColumn(
        "start_datetime", F.col("start_datetime") + F.make_dt_interval(hours=hours)
    )


@query(f"WITH {EDITED} SELECT id, {sql_stamp('st')} AS start_text FROM edited WHERE k % 30 <> 7")
def guard_write_set(spark, sf):
    batch, stored = edited_orders(spark, sf), stored_orders(spark, sf)
    write = guard.write_set(batch, guard.guard_verdict(batch, stored))
    return write.select("id", stamp("start_datetime").alias("start_text"))


@query(f"WITH {EDITED} SELECT id FROM edited WHERE k % 30 = 7")
def guard_dropped_set(spark, sf):
    return guard.dropped_set(edited_orders(spark, sf)).select("id")


LOCAL = "(ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago'"


@query(
    f"""SELECT event_id, hour(lt) * 3600 + minute(lt) * 60 + CAST(floor(second(lt)) AS BIGINT) AS local_second,
    hour(lt) < 7 AND NOT (hour(lt) = 0 AND minute(lt) = 0) AS implausible
    FROM (SELECT event_id, {LOCAL} AS lt FROM events)"""
)
def implausible_starts(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", local_second_of_day(ts).alias("local_second"), implausible_start(ts, True).alias("implausible")
    )


@query(
    f"""SELECT count(*) AS incoming, count(*) FILTER (bad) AS dropped,
    CAST(count(*) FILTER (bad) AS DOUBLE) / count(*) AS share, CAST(count(*) FILTER (bad) AS DOUBLE) / count(*) > 0.1 AS broken
    FROM (SELECT hour(lt) < 7 AND NOT (hour(lt) = 0 AND minute(lt) = 0) AS bad FROM (SELECT {LOCAL} AS lt FROM events))"""
)
def implausible_share(spark, sf):
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("start_datetime"))
    counts = guard.with_screen(events).agg(
        F.count("*").alias("incoming"), F.count_if("implausible").alias("dropped")
    )
    share = F.col("dropped") / F.col("incoming")
    return counts.withColumn("share", share).withColumn("broken", share > guard.Thresholds().max_implausible_share)


# ---- publish ----------------------------------------------------------------------------


def snapshot_rows(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created_at"))


def batch_rows(spark, sf):
    """A later batch: even orders again at a new price, plus as many new ids; it lacks a stored column."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.when(k % 2 == 0, k).otherwise(-k).alias("id"), F.col("o_orderstatus").alias("title"),
        (F.col("o_totalprice") + 1).alias("price"),
    )


PUBLISH = """
stored AS (SELECT o_orderkey AS id, o_orderpriority AS title, o_totalprice AS price, o_orderdate AS created_at FROM orders),
batch AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END AS id, o_orderstatus AS title,
                 o_totalprice + 1 AS price FROM orders),
merged AS (SELECT * FROM stored WHERE id NOT IN (SELECT id FROM batch) UNION ALL
           SELECT b.*, CASE WHEN s.id IS NULL THEN DATE '1999-01-01' ELSE s.created_at END FROM batch b LEFT JOIN stored s ON s.id = b.id)
"""
FIRST_SEEN_DAY = "1999-01-01"


@query(f"WITH {PUBLISH} SELECT * FROM merged")
def upsert_snapshot(spark, sf):
    return publish.upsert(snapshot_rows(spark, sf), batch_rows(spark, sf), new={"created_at": F.lit(FIRST_SEEN_DAY).cast("date")})


@query(f"WITH {PUBLISH} SELECT * FROM stored WHERE id IN (SELECT id FROM batch)")
def purge_stale(spark, sf):
    return publish.purge_stale(snapshot_rows(spark, sf), batch_rows(spark, sf))


@query(f"WITH {PUBLISH} SELECT * FROM stored WHERE id NOT IN (SELECT id FROM batch)")
def stale_rows(spark, sf):
    return publish.stale_rows(snapshot_rows(spark, sf), batch_rows(spark, sf))


@query(f"WITH {PUBLISH} SELECT * FROM stored WHERE NOT regexp_matches(lower(title), 'urgent|medium')")
def keyword_cleanup(spark, sf):
    return publish.keyword_cleanup(snapshot_rows(spark, sf), ["urgent", "medium"])


@query(
    f"WITH {PUBLISH} SELECT * FROM merged WHERE NOT regexp_matches(lower(title), 'urgent|medium') "
    "AND id IN (SELECT id FROM batch UNION ALL SELECT id FROM stored WHERE id % 3 = 0)"
)
def next_snapshot(spark, sf):
    batch = batch_rows(spark, sf)
    # of the stored rows not written, a third was scraped
    seen = F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(10**15) + F.col("id")).alias("id")
    scraped = batch.select("id").unionByName(snapshot_rows(spark, sf).select(seen))
    return publish.next_snapshot(snapshot_rows(spark, sf), batch, scraped, ["urgent", "medium"], purge=True, new={"created_at": F.lit(FIRST_SEEN_DAY).cast("date")})


@query(
    f"WITH {PUBLISH} SELECT CAST(id AS VARCHAR) AS id, title, CAST(created_at AS DATE) AS created_at FROM merged "
    "WHERE NOT regexp_matches(lower(title), 'urgent|medium')"
)
def bucketed_publish(spark, sf):
    """The next snapshot by way of files: a first load, a publish of it, and one of the batch that changes some buckets."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    first, later = (rows.withColumn("id", F.col("id").cast("string")) for rows in (snapshot_rows(spark, sf), batch_rows(spark, sf)))
    sinks.write_catalogue(first.withColumn("source", F.lit("orders")), path)
    sinks.publish_source(spark, path, "orders", first.select("id", "title").where("id = '1'"))
    new = {"created_at": F.lit(FIRST_SEEN_DAY).cast("timestamp")}
    sinks.publish_source(spark, path, "orders", later.select("id", "title"), cleanup_words=["urgent", "medium"], new=new)
    rows = tables.scan_catalogue(spark, path, sources=["orders"])
    return rows.select("id", "title", F.col("created_at").cast("date").alias("created_at"))


@query("SELECT o_orderkey AS id, o_orderpriority AS title, 'orders' AS source FROM orders "
       "UNION ALL SELECT p_partkey, p_name, 'part' FROM part")
def union_sources(spark, sf):
    orders = snapshot_rows(spark, sf).select("id", "title", F.lit("orders").alias("source"))
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("part").alias("source")
    )
    return publish.union_sources([orders, parts])


RUNS = """
runs AS (
  SELECT o_orderkey AS id, o_orderdate AS ran_at, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_custkey END AS total_upserted,
         CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 400 END AS llm_calls, o_orderkey % 3 AS n_errors FROM orders),
logged AS (
  SELECT id, ran_at, total_upserted, COALESCE(llm_calls, 0) AS llm_calls,
         CASE WHEN total_upserted = 0 THEN 'err' WHEN n_errors > 0 THEN 'warn' ELSE 'ok' END AS status,
         CAST(round(COALESCE(llm_calls, 0) * 0.006, 4) AS DOUBLE) AS llm_cost_usd FROM runs)
"""


def order_runs(spark, sf):
    """Orders as finished runs."""
    k = F.col("o_orderkey")
    runs = table(spark, sf, "orders").select(
        k.alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("ran_at"),
        F.when(k % 7 == 0, 0).otherwise(F.col("o_custkey")).alias("total_upserted"),
        F.when(k % 5 > 0, k % 400).alias("llm_calls"),
        F.array_repeat(F.lit("x"), (k % 3).cast("int")).alias("errors"),
    )
    return publish.run_log_row(runs)


@query(f"WITH {RUNS} SELECT id, status, llm_calls, llm_cost_usd FROM logged")
def run_log_status(spark, sf):
    return order_runs(spark, sf).select("id", "status", "llm_calls", F.col("llm_cost_usd").cast("double").alias("llm_cost_usd"))


@query(
    """SELECT o_orderpriority AS source, COUNT(*) AS fetched,
    CAST(SUM(CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE o_orderkey END) AS BIGINT) AS upserted,
    SUM(CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE o_orderkey END) = 0 AS nothing_written,
    BOOL_OR(o_orderpriority LIKE '2%') AS capped,
    SUM(CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE o_orderkey END) = 0 OR BOOL_OR(o_orderpriority LIKE '2%') AS failed
    FROM orders GROUP BY o_orderpriority"""
)
def run_summary(spark, sf):
    p = F.col("o_orderpriority")
    return publish.run_summary(
        table(spark, sf, "orders").select(
            p.alias("source"), F.lit(1).cast("bigint").alias("fetched"),
            F.when(p.like("1%"), 0).otherwise(F.col("o_orderkey")).cast("bigint").alias("upserted"), p.like("2%").alias("capped"),
        )
    )


# ---- merge, first occurrence, series ----------------------------------------------------


@query(
    """WITH lines AS (
      SELECT l_orderkey, seq,
             CASE WHEN b = 0 THEN NULL WHEN b < 8 THEN 18 ELSE b + 4 END AS lo,
             CASE WHEN t = 0 THEN NULL ELSE 20 + t END AS hi
      FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS seq,
                   CAST(l_quantity AS INT) % 30 AS b, CAST(floor(l_extendedprice) AS BIGINT) % 60 AS t FROM lineitem)),
    lists AS (SELECT l_orderkey, list({'lo': lo, 'hi': hi} ORDER BY seq) AS rows FROM lines GROUP BY l_orderkey),
    folded AS (
      SELECT l_orderkey, list_reduce(rows, lambda a, e:
        CASE WHEN a.lo IS DISTINCT FROM 18 AND e.lo IS NOT NULL AND e.hi IS NOT NULL
             THEN {'lo': least(a.lo, e.lo), 'hi': greatest(a.hi, e.hi)} ELSE a END) AS r FROM lists)
    SELECT l_orderkey AS id, CAST(r.lo AS INT) AS age_min, CAST(r.hi AS INT) AS age_max FROM folded"""
)
def merge_ranges(spark, sf):
    b = F.col("l_quantity").cast("int") % 30
    t = F.col("l_extendedprice").cast("bigint") % 60
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.when(b == 0, None).when(b < 8, 18).otherwise(b + 4).cast("int").alias("age_min"),
        F.when(t == 0, None).otherwise(20 + t).cast("int").alias("age_max"),
        (F.col("l_linenumber") * F.lit(1000000000).cast("bigint") + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("seq"),
    )
    return series.merge_by_id(lines).drop("seq")


@query(
    """SELECT user_id, event_id, event_type FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1"""
)
def first_occurrence(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return series.first_by(e, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    """WITH keyed AS (SELECT p_partkey AS id, p_brand AS source, p_name AS title,
        trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS norm, p_partkey % 10 = 0 AS flag FROM part)
    SELECT id, flag OR n >= 2 AS is_recurring,
           CASE WHEN n >= 2 AND NOT flag THEN 'Recurring' WHEN flag THEN 'Weekly' END AS recurrence_label
    FROM (SELECT *, COUNT(*) OVER (PARTITION BY source, norm) AS n FROM keyed)"""
)
def recurring_flag(spark, sf):
    k = F.col("p_partkey")
    parts = table(spark, sf, "part").select(
        k.alias("id"), F.col("p_brand").alias("source"), F.col("p_name").alias("title"),
        (k % 10 == 0).alias("is_recurring"), F.when(k % 10 == 0, "Weekly").alias("recurrence_label"),
    )
    return series.mark_recurring(parts).drop("source", "title")


@query(
    "SELECT COUNT(*) AS total, COUNT(*) FILTER (p_size > 20) AS fallback, "
    "CAST(COUNT(*) FILTER (p_size > 20) AS DOUBLE) / COUNT(*) AS share, "
    "COUNT(*) >= 20 AND CAST(COUNT(*) FILTER (p_size > 20) AS DOUBLE) / COUNT(*) > 0.5 AS warn FROM part"
)
def fallback_rate(spark, sf):
    return fallback_verdict(
        table(spark, sf, "part").agg(F.count("*").alias("total"), F.count_if(F.col("p_size") > 20).alias("fallback"))
    )
