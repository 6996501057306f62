import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import dicts, one, table
from townbill import schemas
from townbill.operators import engagement as eg
from townbill.operators.likes import like_counts
from townbill.plans.dashboard import functional_metrics
from townbill.sources.tables import flatten_export, recent_export, valid_rows

WEEK1 = int(dt.datetime(2026, 1, 5, 12, tzinfo=dt.timezone.utc).timestamp() * 1000)
WEEK2 = WEEK1 + 7 * 86_400_000

# (visitor, session, week, channel, [(event, item, extras)])
SESSIONS = [
    ("v1", "s1", WEEK1, "organic", [("session_start",), ("event_card_click", "e1"), ("detail_view", "e1"), ("calendar_add", "e1", {"method": "google"})]),
    ("v2", "s2", WEEK1, "direct", [("session_start",), ("filter_applied", None, {"city": "frisco", "filter_fields": "ages"})]),
    ("v3", "s3", WEEK1, "organic", [("session_start",), ("event_card_click", "e1"), ("detail_view", "e1"), ("directions_tap", "e1")]),
    ("v4", "s4", WEEK1, "organic", [("session_start",), ("event_card_click", "e1"), ("attending_tap", "e1"), ("share_tap", "e1")]),
    ("v5", "s5", WEEK1, "referral", [("session_start",)]),
    ("v1", "s6", WEEK2, "organic", [("session_start",)]),
    ("v6", "s7", WEEK2, "direct", [("session_start",), ("event_card_click", "e2"), ("detail_view", "e2"), ("calendar_add", "e2", {"method": "ics"})]),
]


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for visitor, session, ts, channel, events in SESSIONS:
        for name, *rest in events:
            item = rest[0] if rest else None
            extra = rest[1] if len(rest) > 1 else {}
            out.append(dict(visitor_id=visitor, session_id=session, event_name=name, timestamp=ts, channel=channel, event_id=item, **extra))
    return table(spark, schemas.ANALYTICS, out)


def test_week_starts_on_monday(spark):
    days = ["2026-01-05", "2026-01-08", "2026-01-11", "2026-01-12"]
    ms = [int(dt.datetime.fromisoformat(d + "T23:59:00+00:00").timestamp() * 1000) for d in days]
    got = [r[0] for r in table(spark, "timestamp BIGINT", [{"timestamp": m} for m in ms]).select(eg.row_week()).collect()]
    assert [str(d) for d in got] == ["2026-01-05", "2026-01-05", "2026-01-05", "2026-01-12"]


def test_funnel(rows):
    r = one(eg.funnel(rows))
    assert (r["sessions"], r["engaged"], r["intent"], r["converted"]) == (7, 5, 4, 3)
    assert (r["engaged_rate"], r["intent_rate"], r["conversion_rate"]) == (5 / 7, 4 / 5, 3 / 4)
    counts = [r[c] for c in ("card_click", "filter_applied", "detail_view", "directions", "calendar_add", "attending")]
    assert counts == [4, 1, 3, 1, 2, 1]
    shares = [r[c + "_share"] for c in ("card_click", "filter_applied", "detail_view", "directions", "calendar_add", "attending")]
    assert shares == [4 / 5, 1 / 5, 3 / 4, 1 / 4, 2 / 3, 1 / 3]


def test_funnel_of_nothing(rows):
    assert set(one(eg.funnel(rows.limit(0))).values()) == {0, 0.0}


def test_funnel_for_a_channel(rows):
    r = one(eg.funnel(rows, "organic"))
    assert (r["sessions"], r["engaged"], r["intent"], r["converted"]) == (4, 3, 3, 2)
    by = {x["channel"]: x["sessions"] for x in dicts(eg.funnel_by_channel(rows))}
    assert by == {"organic": 4, "direct": 2, "referral": 1}


def test_sub_metric_needs_its_step(spark):
    # a session that only shares stays at step 0 and counts nowhere
    r = one(eg.funnel(table(spark, schemas.ANALYTICS, [dict(visitor_id="v", session_id="s", event_name="share_tap", timestamp=0)])))
    assert (r["sessions"], r["engaged"], r["card_click"]) == (1, 0, 0)


def test_weekly_active_and_delta(rows):
    weekly = eg.weekly_active(rows)
    assert [(str(r["week"]), r["active"]) for r in sorted(dicts(weekly), key=lambda r: r["week"])] == [("2026-01-05", 2), ("2026-01-12", 1)]
    top = eg.weekly_delta(weekly, 1)
    assert (one(top)["previous"], one(top)["delta"]) == (2, -1)


def test_return_rate(rows):
    assert one(eg.return_rate_for(rows, "2026-01-05"))["return_rate"] == 0.5
    assert one(eg.return_rate_for(rows, "2025-01-06"))["return_rate"] == 0.0
    assert {str(r["week"]): r["return_rate"] for r in dicts(eg.return_rate(rows))} == {"2026-01-05": 0.5, "2026-01-12": 0.0}


def test_referral(rows):
    assert [r["shares"] for r in dicts(eg.weekly_shares(rows))] == [1]
    assert one(eg.converted_share_of(eg.sessionise(rows)))["shared_rate"] == pytest.approx(1 / 3)


def test_actions_filters_and_items(rows):
    assert one(eg.conversion_actions(rows)) == {"google_calendar": 1, "apple_calendar": 1, "attending": 1}
    used = {(r["kind"], r["key"]): r["uses"] for r in dicts(eg.filter_usage(rows))}
    assert used == {("field", "ages"): 1, ("city", "frisco"): 1, ("total", "all"): 1}
    top = [tuple(r.values()) for r in dicts(eg.top_items(eg.item_tallies(rows)))]
    assert top == [("e1", 1, 1, 1, 1), ("e2", 0, 1, 0, 0)]


def test_filter_tokens_are_trimmed_and_counted_twice(spark):
    rows = table(spark, schemas.ANALYTICS, [dict(event_name="filter_applied", filter_fields=" ages ,, ages,sources"), dict(event_name="filter_applied")])
    used = {(r["kind"], r["key"]): r["uses"] for r in dicts(eg.filter_usage(rows))}
    assert used == {("field", "ages"): 2, ("field", "sources"): 1, ("total", "all"): 2}


def test_titles_of_top_items(spark, rows):
    titles = table(spark, "id STRING, title STRING, source STRING", [dict(id="e1", title="One", source="s")])
    got = {r["event_id"]: r["title"] for r in dicts(eg.with_titles(eg.top_items(eg.item_tallies(rows)), titles))}
    assert got == {"e1": "One", "e2": None}


def test_dashboard_shares_sessions(rows):
    tab = functional_metrics(rows)
    assert one(tab["funnel"])["converted"] == 3
    assert one(tab["referral"])["converted"] == 3
    tab["sessions"].unpersist()


def test_export_rows(spark):
    def row(day, user, session=7, medium=None, event="detail_view", params=()):
        entries = [dict(key=k, value=dict(string_value=v, int_value=None)) for k, v in params]
        if session:
            entries.append(dict(key="ga_session_id", value=dict(string_value=None, int_value=session)))
        return dict(event_date=dt.date.fromisoformat(day), user_pseudo_id=user, event_name=event, event_timestamp=1_767_614_400_123_567,
                    traffic_source=dict(medium=medium), event_params=entries)

    export = table(spark, schemas.ANALYTICS_EXPORT, [
        row("2026-01-05", "u", params=[("event_id", "e1"), ("fields", "ages")], medium="organic"),
        row("2026-01-05", "u2", session=None), row("2026-01-05", None), row("2026-01-05", "u3", event=""), row("2025-01-05", "u4"),
    ])
    r = one(valid_rows(flatten_export(recent_export(export, "2026-04-05"))))
    assert (r["session_id"], r["timestamp"], r["channel"], r["event_id"], r["filter_fields"], r["method"]) == ("u.7", 1_767_614_400_124, "organic", "e1", "ages", None)
    assert flatten_export(export).filter("visitor_id = 'u2'").first()["channel"] == "(none)"


def test_missing_time_is_zero(spark):
    rows = table(spark, schemas.ANALYTICS, [dict(visitor_id="v", session_id="s", event_name="e")])
    assert one(valid_rows(rows))["timestamp"] == 0


@pytest.mark.parametrize("chunk", [1, 100, 10**6])
def test_likes_against_steps(spark, chunk):
    import random

    rng = random.Random(chunk)
    log, want = [], {}
    for seq in range(600):
        item = rng.choice(["hot", "hot", "b", "c", "d"])
        delta = rng.choice([1, -1, -1])
        want[item] = max(0, want[item] + delta) if item in want else 1
        log.append(dict(event_id=item, ts=dt.datetime.fromtimestamp(1000 + seq // 3, dt.timezone.utc), seq=seq, delta=delta))
    got = {r["event_id"]: r["count"] for r in dicts(like_counts(table(spark, schemas.LIKE_LOG, log), chunk))}
    assert got == want


def test_likes_of_one_hour_are_spread(spark):
    from townbill.operators.likes import like_counts

    log = spark.range(4000).selectExpr("'hot' AS event_id", "timestamp'2026-08-01 10:00:00' + make_dt_interval(0, 0, 0, id / 10) AS ts", "id AS seq", "CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END AS delta")
    count = 0
    for i in range(4000):
        count = 1 if i == 0 else max(0, count + (-1 if i % 3 == 0 else 1))
    assert [r["count"] for r in like_counts(log).collect()] == [count]
    ranged = log.repartitionByRange(8, "event_id", "ts", "seq").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(ranged) >= 6 and max(r["count"] for r in ranged) < 1500


def test_total_counts_a_session_once(spark, rows):
    got = {(r["channel"], r["is_total"]): r for r in dicts(eg.funnel_with_total(rows))}
    assert {k: v for k, v in got[None, True].items() if k not in ("channel", "is_total")} == one(eg.funnel(rows))
    by = {r["channel"]: r for r in dicts(eg.funnel_by_channel(rows))}
    assert {c: {k: v for k, v in r.items() if k != "is_total"} for (c, total), r in got.items() if not total} == by
    # one session on two channels and none: it converts once in all, and in the one channel that saw it convert
    spread = [dict(session_id="s", channel="a", event_name="event_card_click"), dict(session_id="s", channel="b", event_name="attending_tap"), dict(session_id="s", event_name="detail_view")]
    got = {(r["channel"], r["is_total"]): (r["sessions"], r["converted"], r["card_click"]) for r in dicts(eg.funnel_with_total(table(spark, schemas.ANALYTICS, spread)))}
    assert got == {(None, True): (1, 1, 1), ("a", False): (1, 0, 1), ("b", False): (1, 1, 0), (None, False): (1, 0, 0)}


def test_total_scans_once(rows):
    plan = eg.funnel_with_total(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") + plan.count("LogicalRDD") + plan.count("Scan") <= 1


def test_sketches_merge_to_weeks(spark):
    ids = spark.range(60_000)
    events = ids.select(
        (F.col("id") % 9_000).cast("string").alias("visitor_id"), F.lit("attending_tap").alias("event_name"),
        (F.lit(WEEK1) + (F.col("id") % 14) * 86_400_000).alias("timestamp"),
    )
    days = eg.daily_sketches(events)
    assert days.count() == 14
    told = {r["week"]: r["active"] for r in dicts(eg.weekly_active_estimate(days))}
    exact = {r["week"]: r["active"] for r in dicts(eg.weekly_active(events))}
    assert told.keys() == exact.keys() and all(abs(told[w] - n) <= 5 * 1.04 / 2**7 * n for w, n in exact.items())
    # sketches of parts, merged, say what one of all says
    parts = eg.daily_sketches(events.where("timestamp % 2 = 0")).unionByName(eg.daily_sketches(events.where("timestamp % 2 <> 0")))
    assert {r["week"]: r["active"] for r in dicts(eg.weekly_active_estimate(parts))} == told
    assert eg.weekly_active_estimate(eg.daily_sketches(events.limit(0))).count() == 0


def test_retention(spark, rows):
    first = [(r["week"], r["converters"], r["returned"], r["return_rate"]) for r in dicts(eg.retention(rows)) if r["after"] == 1]
    assert sorted(first) == sorted((r["week"], r["converters"], r["returned"], r["return_rate"]) for r in dicts(eg.return_rate(rows)))
    # weeks over many blocks, before 1970 too, against sets
    r = random.Random(2)
    seen = sorted({(f"v{r.randrange(8)}", r.randrange(-40, 90), r.random() < 0.4) for _ in range(500)})
    monday = dt.datetime(1970, 1, 5, 12, tzinfo=dt.timezone.utc)
    data = [dict(visitor_id=v, event_name="attending_tap" if c else "detail_view", timestamp=int((monday + dt.timedelta(weeks=w)).timestamp() * 1000)) for v, w, c in seen]
    active, converted = {(v, w) for v, w, _ in seen}, {(v, w) for v, w, c in seen if c}
    want = {}
    for v, w in converted:
        for k in range(1, 32):
            have = want.setdefault((w, k), [0, 0])
            have[0] += 1
            have[1] += (v, w + k) in active
    got = {((x["week"] - monday.date()).days // 7, x["after"]): [x["converters"], x["returned"]] for x in dicts(eg.retention(table(spark, schemas.ANALYTICS, data), 31))}
    assert got == want
    with pytest.raises(ValueError):
        eg.retention(rows, 32)
    assert eg.retention(rows.limit(0)).count() == 0
