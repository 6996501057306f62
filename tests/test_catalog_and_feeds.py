import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import column, dicts, listings, one, plan_of, table, utc
from townbill import schemas
from townbill.functions import wallclock
from townbill.operators import catalog, pipeline_metrics
from townbill.plans.dashboard import technical_metrics
from townbill.sources import feeds, sinks, tables

NOW = "2026-07-25T12:00:00Z"


def ids(df):
    return [r["id"] for r in df.select("id").collect()]


def at(day, hour=15):
    return utc(f"2026-{day}T{hour:02d}:00:00Z")


def test_search(spark):
    rows = listings(spark, [
        dict(id="today-early", start_datetime=at("07-25", 5)), dict(id="yesterday", start_datetime=at("07-25", 4)), dict(id="running", start_datetime=at("07-20"), end_datetime=at("07-26")),
        dict(id="over", start_datetime=at("07-20"), end_datetime=at("07-25", 4)), dict(id="hidden", start_datetime=at("07-26"), kid_relevant=False),
        dict(id="shown", start_datetime=at("07-26"), kid_relevant=True, source="play-frisco"), dict(id="adult", start_datetime=at("07-26"), age_min=18, age_max=99),
        dict(id="club", start_datetime=at("07-27"), title="Evening Book Club", age_min=0, age_max=5), dict(id="plano", start_datetime=at("07-28"), source="plano-library", location_name="Parr Library", is_free=None),
        dict(id="kid", start_datetime=at("07-29"), age_min=0, age_max=5, is_free=False),
    ])
    assert ids(catalog.search_listings(rows, NOW)) == ["running", "today-early", "shown", "club", "plano", "kid"]
    assert ids(catalog.search_listings(rows, NOW, ["plano-library"])) == ["plano"]
    assert ids(catalog.search_listings(rows, NOW, branches=["Parr Library"])) == ["plano"]
    assert ids(catalog.search_listings(rows, NOW, is_free=True)) == ["running", "today-early", "shown", "club"]
    # ongoing rows ignore the date window
    assert ids(catalog.search_listings(rows, NOW, date_from="2026-07-26", date_to="2026-07-27")) == ["running", "shown", "club"]
    # the adult-programme words count only under an age filter, and only where that source may show
    assert ids(catalog.search_listings(rows, NOW, ages=[(0, 5)])) == ["kid"]
    assert ids(catalog.search_listings(rows, NOW, ["frisco-library", "play-frisco"], ages=[(0, 5)])) == ["kid"]
    # stated limits come after all filters
    assert ids(catalog.search_listings(rows, NOW, ages=[(0, 5)], upcoming_limit=4)) == ["kid"]


def test_pages(spark):
    rows = catalog.by_start(listings(spark, [dict(id=f"e{i:02d}") for i in range(45)]))
    assert ids(catalog.page(rows, 3)) == [f"e{i:02d}" for i in range(40, 45)]
    assert len(ids(catalog.page(rows, 2, cumulative=True))) == 40


def test_indexable(spark):
    now = "2026-07-25T06:00:00Z"
    rows = listings(spark, [
        dict(id="a"), dict(id="b", source="play-frisco", kid_relevant=False), dict(id="c", source="play-frisco"), dict(id="d", age_min=18), dict(id="e", title="ESL Book talk"),
        dict(id="f", start_datetime=at("07-24")), dict(id="g", start_datetime=at("07-24"), end_datetime=at("07-26")), dict(id="h", source="kaleidoscope-park", kid_relevant=False),
        dict(id="i", title="ESL Book talk", source="plano-library"),
    ])
    assert ids(rows.filter(catalog.indexable(now))) == ["a", "c", "g", "h", "i"]
    assert ids(catalog.indexable_listings(rows, now, "frisco")) == ["a", "c"]
    assert ids(catalog.indexable_listings(rows, now)) == ["a", "c", "h", "i"]


def test_branches_and_venues(spark):
    spot = dict(location_lat=33.0, location_lng=-96.0)
    rows = listings(spark, [
        dict(id="1", source="plano-library", location_name="Parr", location_address="B", **spot), dict(id="0", source="plano-library", location_name="Parr", location_address="A", **spot),
        dict(id="2", source="plano-library", location_name="Plano Public Library", **spot), dict(id="3", location_name="Parr", **spot), dict(id="4", source="plano-library", location_name="VIRTUAL room", **spot),
        dict(id="5", location_name="Nowhere"), dict(id="6", source="plano-library", location_name=None, **spot),
    ])
    assert column(catalog.distinct_branches(rows), "location_name", "location_name") == ["Parr", "VIRTUAL room"]
    got = {(r["location_name"], r["source"]): r["location_address"] for r in dicts(catalog.distinct_venues(rows))}
    assert got == {("Parr", "plano-library"): "A", ("Parr", "frisco-library"): None, ("Plano Public Library", "plano-library"): None}


def test_scan_prunes(spark, tmp_path):
    path = str(tmp_path / "catalogue")
    sinks.write_catalogue(listings(spark, [dict(id="a"), dict(id="b", source="plano-library")]), path)
    df = catalog.search_listings(tables.scan_catalogue(spark, path), NOW, ["plano-library"]).select("id", "start_datetime")
    assert ids(df) == ["b"]
    plan = plan_of(df)
    assert "PartitionFilters: [source" in plan or "isnotnull(source" in plan.split("PartitionFilters")[1]
    assert "GreaterThanOrEqual(start_datetime" in plan and "Or(IsNull(kid_relevant),EqualTo(kid_relevant,true))" in plan
    assert "description" not in plan.split("ReadSchema")[1]


# ---- metrics ----------------------------------------------------------------------------


def visible(spark):
    play = dict(source="play-frisco", kid_relevant=True)
    return listings(spark, [
        dict(id="1", is_free=True), dict(id="2", source="plano-library", is_free=True), dict(id="3", **play, age_buckets=["family"], age_confidence="high", is_free=True, price_class="free", price_confidence="inferred"),
        dict(id="4", **play, age_buckets=["kids"], age_confidence="medium", is_free=False, price_class="paid", price_confidence="confirmed"),
        dict(id="5", **play, age_buckets=["kids"], age_confidence="low", is_free=None, price_class="unknown"), dict(id="6", source="play-frisco", kid_relevant=False, is_free=None),
    ])


def runs(spark):
    return table(spark, schemas.INGEST_RUNS, [
        dict(id="r1", ran_at=utc("2026-07-20T10:00:00Z"), status="ok", llm_calls=5, llm_cost_usd=Decimal("0.03"), errors=[]),
        dict(id="r2", ran_at=utc("2026-07-21T10:00:00Z"), status="warn", llm_calls=2, llm_cost_usd=Decimal("0.012"), errors=["x"]),
        dict(id="r0", ran_at=utc("2026-07-21T09:00:00Z"), status="ok", errors=[]),
    ])


def test_technical_tab(spark):
    tab = technical_metrics(visible(spark), runs(spark), "2026-07-21")
    assert {r["source"]: r["total"] for r in dicts(tab["source_totals"])} == {"frisco-library": 1, "plano-library": 1, "play-frisco": 4}
    assert one(tab["price_totals"]) == {"free": 3, "paid": 1, "unknown": 2}
    assert one(tab["age_visibility"]) == {"family": 1, "specific": 1, "nothing": 1, "hidden": 1, "total": 4}
    assert one(tab["price_visibility"]) == {"free_confirmed": 0, "free_inferred": 1, "paid_confirmed": 1, "paid_inferred": 0, "unknown": 2, "total": 4}
    assert one(tab["latest_run"])["id"] == "r2"
    history = [r["status"] for r in dicts(tab["history"].orderBy("day"))]
    assert history == ["none"] * 12 + ["ok", "warn"]
    cost = one(tab["cost"])
    assert (float(cost["last_run_usd"]), float(cost["cumulative_usd"]), cost["total_calls"]) == (0.012, 0.042, 7)
    assert ids(tab["last_runs"]) == ["r2", "r0", "r1"]


def test_metrics_of_nothing(spark):
    none = runs(spark).limit(0)
    assert pipeline_metrics.latest_run(none).count() == 0
    assert [float(v) for v in one(pipeline_metrics.cost_summary(none)).values()] == [0, 0, 0]
    assert one(pipeline_metrics.age_visibility(visible(spark).limit(0)))["total"] == 0


# ---- feeds ------------------------------------------------------------------------------


def documents(spark, **kw):
    return json.loads(one(feeds.structured_feed(listings(spark, [dict(id="a", **kw)])))["json"])


def test_structured_feed(spark):
    full = documents(spark, description="<p>Come  in</p>", end_datetime=at("08-14", 16), thumbnail_url="https://i", location_address="1 St", location_lat=33.1, location_lng=-96.8, age_min=0, age_max=5)
    assert full["startDate"] == "2026-08-14T15:00:00.000Z" and full["endDate"] == "2026-08-14T16:00:00.000Z"
    assert full["description"] == "Come in" and full["image"] == ["https://i"] and full["typicalAgeRange"] == "0-5"
    assert full["location"] == {"@type": "Place", "name": "Frisco Public Library", "address": "1 St", "geo": {"@type": "GeoCoordinates", "latitude": 33.1, "longitude": -96.8}}
    assert full["isAccessibleForFree"] is True and full["offers"]["price"] == "0" and full["organizer"]["name"] == "Frisco Public Library"
    bare = documents(spark, is_free=None, location_name=None, description="<br>", source="play-frisco", age_buckets=["kids", "teen"])
    assert not {"isAccessibleForFree", "offers", "location", "description", "image", "endDate"} & set(bare) and bare["typicalAgeRange"] == "6-17"
    paid = documents(spark, is_free=False)
    assert paid["isAccessibleForFree"] is False and "offers" not in paid and paid["location"]["address"] == "Frisco Public Library"


def test_calendar_feed(spark):
    rows = listings(spark, [dict(id="a", title="Songs; rhymes, \\more", description="One\nTwo", end_datetime=at("08-14", 16), location_address="1 St, Town"),
                            dict(id="b", description=None, event_url="", location_name=None)])
    got = {r["id"]: r for r in dicts(feeds.calendar_feed(rows, F.lit("2026-07-24 15:00:00").cast("timestamp")))}
    lines = got["a"]["ics"].split("\r\n")
    assert lines[0] == "BEGIN:VCALENDAR" and lines[-1] == "END:VCALENDAR" and "DTSTAMP:20260724T150000Z" in lines
    assert "SUMMARY:Songs\\; rhymes\\, \\\\more" in lines and "LOCATION:Frisco Public Library\\, 1 St\\, Town" in lines
    assert "DESCRIPTION:One\\nTwo\\n\\nMore info: https://town.example.org/x" in lines and "DTEND:20260814T160000Z" in lines
    assert got["a"]["filename"] == "Songs-rhymes-more.ics"
    bare = got["b"]["ics"].split("\r\n")
    assert not [l for l in bare if l.split(":")[0] in ("DESCRIPTION", "LOCATION", "URL")] and "DTEND:20260814T150000Z" in bare


def test_sitemap_and_lists(spark, tmp_path):
    rows = listings(spark, [dict(id=f"e{i:02d}", title=f"T{i}") for i in range(60)] + [dict(id="p", source="plano-library", title='Say "hi"'), dict(id="k", source="kaleidoscope-park")])
    site = feeds.sitemap(rows)
    assert site.count() == 65 and {r["priority"] for r in dicts(site)} == {1.0, 0.9, 0.7}
    lists = {r["city"]: json.loads(r["json"]) for r in dicts(feeds.item_lists(rows, NOW))}
    assert set(lists) == {"frisco", "plano"} and lists["frisco"]["numberOfItems"] == 60
    items = lists["frisco"]["itemListElement"]
    assert len(items) == 50 and [i["position"] for i in items] == list(range(1, 51)) and items[0]["name"] == "T0"
    assert lists["plano"]["itemListElement"][0]["name"] == 'Say "hi"'
    feeds.write_sitemap(site, str(tmp_path / "xml"))
    assert spark.read.format("xml").option("rowTag", "url").schema("url STRING, priority DOUBLE").load(str(tmp_path / "xml")).count() == 65
    feeds.write_sitemap(site, str(tmp_path / "csv"), "csv")
    feeds.write_text_feed(feeds.structured_feed(rows), str(tmp_path / "json"), "json")
    assert spark.read.text(str(tmp_path / "json")).count() == 62
    feeds.write_text_feed(feeds.calendar_feed(rows, F.col("ingested_at")), str(tmp_path / "ics"), "ics")
    assert spark.read.parquet(str(tmp_path / "ics")).count() == 62


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/Chicago"])
def test_results_do_not_depend_on_the_session_zone(spark, zone):
    rows = listings(spark, [dict(id="a", end_datetime=at("08-14", 16)), dict(id="b", source="plano-library", start_datetime=at("11-01", 2))])
    stamp = wallclock.instant("2026-07-24T15:00:00Z")

    def results():
        return [
            dicts(df.orderBy(df.columns[0]))
            for df in (
                feeds.structured_feed(rows), feeds.calendar_feed(rows, stamp), feeds.item_lists(rows, NOW),
                catalog.search_listings(rows, NOW, date_to="2026-12-01").select("id"), pipeline_metrics.status_history(runs(spark), "2026-07-21"),
                rows.select("id", wallclock.short_when(F.col("start_datetime")), wallclock.long_when(F.col("start_datetime"), F.col("end_datetime"))),
                rows.groupBy(wallclock.week_of(F.col("start_datetime")).alias("week")).count(),
            )
        ]

    want = results()
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert results() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
