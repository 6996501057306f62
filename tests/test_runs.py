"""Whole runs against a catalogue on disk."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from helpers import dicts, listings, table, utc
from townbill import schemas, session
from townbill.plans import ingest
from townbill.sources import landings, sinks, tables
from townbill.streaming import landing as stream

NOW = "2026-08-01T12:00:00Z"
GOOD = '{"kid_relevant": true, "age_buckets": ["kids"], "confidence": "high", "price": "free", "reasoning": "r"}'


@pytest.fixture()
def paths(tmp_path):
    return str(tmp_path / "catalogue"), str(tmp_path / "runs")


def rows(spark, n, source="frisco-library", hour=15, first=0, **kw):
    return listings(spark, [dict(id=f"{source}-{i}", source=source, title=f"Title {i}", start_datetime=utc(f"2026-08-14T{hour:02d}:00:00Z"), **kw) for i in range(first, first + n)])


def stored(spark, paths):
    return {r["id"]: r for r in dicts(tables.scan_catalogue(spark, paths[0]))}


def all_good(due):
    return due.select("id", F.lit(GOOD).alias("answer"))


def test_library_run_accumulates(spark, paths):
    sinks.write_catalogue(rows(spark, 30).unionByName(rows(spark, 3, "plano-library")), paths[0])
    batch = rows(spark, 25, first=10).unionByName(rows(spark, 1, first=99, age_min=5, age_max=6)).unionByName(
        listings(spark, [dict(id="frisco-library-club", title="Book Club", start_datetime=utc("2026-08-14T15:00:00Z"))]))
    result = ingest.run_source(spark, "frisco-library", batch, *paths, NOW)
    assert (result.fetched, result.upserted, result.aborted, result.errors) == (27, 27, False, [])
    have = stored(spark, paths)
    assert len(have) == 36 + 3 and "frisco-library-club" not in have
    log = dicts(sinks.read_runs(spark, paths[1]))
    assert [(r["status"], r["frisco_fetched"], r["plano_fetched"], r["total_upserted"]) for r in log] == [("ok", 27, 0, 27)]


def test_shifted_batch_changes_nothing(spark, paths):
    sinks.write_catalogue(rows(spark, 40), paths[0])
    before = stored(spark, paths)
    result = ingest.run_source(spark, "frisco-library", rows(spark, 40, hour=20), *paths, NOW)
    assert result.aborted and result.upserted == 0 and "uniform 300min" in result.errors[0]
    assert stored(spark, paths) == before
    assert dicts(sinks.read_runs(spark, paths[1]))[0]["status"] == "err"
    allowed = ingest.run_source(spark, "frisco-library", rows(spark, 40, hour=20), *paths, NOW, allow_time_shift=True)
    assert allowed.upserted == 40 and {r["start_datetime"].hour for r in stored(spark, paths).values()} == {20}


def test_classified_run_purges_and_caps(spark, paths):
    sinks.write_catalogue(
        rows(spark, 10, "play-frisco", kid_relevant=True, age_confidence="high").unionByName(rows(spark, 2, "play-frisco", first=50)), paths[0])
    batch = rows(spark, 14, "play-frisco", kid_relevant=None)
    result = ingest.run_source(spark, "play-frisco", batch.withColumn("price_locked", F.lit(False)).withColumn("seq", F.monotonically_increasing_id()),
                               *paths, NOW, all_good, cap=3)
    assert (result.fetched, result.upserted, result.llm_calls, result.capped) == (14, 13, 3, True)
    have = stored(spark, paths)
    assert len(have) == 13 and "play-frisco-50" not in have  # stale rows go, the skipped row waits
    again = ingest.run_source(spark, "play-frisco", batch.withColumn("price_locked", F.lit(False)), *paths, NOW, all_good, cap=0)
    assert (again.llm_calls, again.upserted) == (0, 13)


def test_classifier_is_required(spark, paths):
    sinks.write_catalogue(rows(spark, 1), paths[0])
    with pytest.raises(ValueError):
        ingest.run_source(spark, "play-frisco", rows(spark, 1, "play-frisco"), *paths, NOW)


def test_empty_batch_is_no_abort(spark, paths):
    sinks.write_catalogue(rows(spark, 3).unionByName(listings(spark, [dict(id="club", title="Book club")])), paths[0])
    result = ingest.run_source(spark, "frisco-library", rows(spark, 0), *paths, NOW)
    assert (result.aborted, result.upserted) == (False, 0)
    assert set(stored(spark, paths)) == {f"frisco-library-{i}" for i in range(3)}
    assert dicts(sinks.read_runs(spark, paths[1]))[0]["status"] == "err"


def test_first_load(spark, paths):
    sinks.write_catalogue(rows(spark, 0), paths[0])
    result = ingest.run_source(spark, "plano-library", rows(spark, 4, "plano-library"), *paths, NOW)
    assert result.upserted == 4 and len(stored(spark, paths)) == 4
    log = dicts(sinks.read_runs(spark, paths[1]))[0]
    assert log["plano_fetched"] == 4 and log["duration_ms"] > 0


def test_last_rows_of_a_source_can_go(spark, paths):
    sinks.write_catalogue(rows(spark, 2).unionByName(rows(spark, 2, "plano-library")), paths[0])
    sinks.replace_source(tables.scan_catalogue(spark, paths[0], sources=["plano-library"]).limit(0), paths[0], "plano-library")
    assert set(stored(spark, paths)) == {"frisco-library-0", "frisco-library-1"}


def test_combined_summary(spark):
    results = [ingest.RunResult("a", 5, 5, 0, []), ingest.RunResult("b", 5, 0, 0, []), ingest.RunResult("c", 5, 3, 3, [], capped=True)]
    assert {r["source"]: r["failed"] for r in dicts(ingest.summarise(results, spark))} == {"a": False, "b": True, "c": True}


def payload(page, entries, total=1):
    return dict(source="kaleidoscope-park", url=f"p{page}", page_no=page, fetched_at=utc(NOW), body=json.dumps({"total_pages": total, "events": entries}))


def entry(i, **kw):
    return {"id": i, "title": f"Trail &#8211; {i}", "start_date": "2026-08-14 09:00:00", "cost": "", "image": False, "venue": [], "url": "", **kw}


def test_streamed_landings_go_through_the_guard(spark, tmp_path, paths):
    sinks.write_catalogue(rows(spark, 2, "plano-library"), paths[0])
    landed = str(tmp_path / "landed")
    pages = [payload(1, [entry(i) for i in range(4)])]
    table(spark, schemas.RAW_PAGES, pages).write.parquet(landed)

    def run():
        source = stream.landed_files(spark, landed, schemas.RAW_PAGES)
        q = stream.publish_stream(source, "kaleidoscope-park", landings.park_listings, *paths, str(tmp_path / "offsets"), NOW, all_good)
        assert q.awaitTermination(120) and q.exception() is None

    run()
    assert {k for k in stored(spark, paths) if k.startswith("k")} == {f"kaleidoscope-park-{i}" for i in range(4)}
    table(spark, schemas.RAW_PAGES, [payload(1, [entry(3, title="Renamed"), entry(7)])]).write.mode("append").parquet(landed)
    run()
    have = stored(spark, paths)
    assert have["kaleidoscope-park-3"]["title"] == "Renamed" and len(have) == 2 + 5
    assert have["kaleidoscope-park-7"]["kid_relevant"] is True and have["kaleidoscope-park-7"]["location_name"] == "Kaleidoscope Park"


def test_streamed_weekly_active(spark, tmp_path):
    path = str(tmp_path / "rows")
    week = int(utc("2026-01-05T00:00:00Z").timestamp() * 1000)
    data = [("v1", "calendar_add", 0), ("v1", "attending_tap", 5), ("v2", "attending_tap", 6 * 86400), ("v3", "detail_view", 1), ("v1", "calendar_add", 7 * 86400), ("v9", "calendar_add", 40 * 86400)]
    table(spark, schemas.ANALYTICS, [dict(visitor_id=v, event_name=e, timestamp=week + s * 1000) for v, e, s in data]).write.parquet(path)
    out = stream.weekly_active_stream(stream.landed_files(spark, path, schemas.ANALYTICS))
    q = out.writeStream.format("memory").queryName("weekly_pairs").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(str(r["week"]), r["visitor_id"]) for r in spark.table("weekly_pairs").collect()}
    assert {("2026-01-05", "v1"), ("2026-01-05", "v2"), ("2026-01-12", "v1")} <= got and not [g for g in got if g[1] == "v3"]


# ---- extraction edges -------------------------------------------------------------------


def test_park_edges(spark):
    pages = [
        payload(1, [entry(1, description="<p>a</p>b"), entry(2, title=""), entry(3, start_date=None), entry(4, cost="$5", venue={"venue": "Lawn &amp; hill", "geo_lat": "33.5", "geo_lng": 0})], total=2),
        payload(2, [entry(5, image={"url": "https://x/a b.png"}, end_date="2026-08-14 10:30:00", cost=5)], total=2), payload(3, [entry(6)], total=2),
        dict(source="kaleidoscope-park", url="bad", page_no=1, fetched_at=utc(NOW), body="<html>blocked</html>"),
    ]
    got = {r["id"].rsplit("-", 1)[1]: r for r in dicts(landings.park_listings(table(spark, schemas.RAW_PAGES, pages)))}
    assert set(got) == {"1", "4", "5", "6"}
    assert got["1"]["title"] == "Trail – 1" and got["1"]["description"] == "a b" and got["1"]["price_locked"] is False
    assert (got["4"]["price_class"], got["4"]["price_reasoning"], got["4"]["location_name"]) == ("paid", 'Cost field: "$5"', "Lawn & hill")
    assert (got["4"]["location_lat"], got["4"]["location_lng"]) == (33.5, -96.8230)
    assert got["5"]["thumbnail_url"] == "https://x/a%20b.png" and got["5"]["end_datetime"].minute == 30 and got["5"]["price_locked"] is False


def test_feed_edges(spark):
    def feed(items, branch="Davis Library", page=1):
        return dict(branch=branch, page_no=page, fetched_at=utc(NOW), body=f'<rss xmlns:dc="http://d"><channel><title>t</title>{items}</channel></rss>')

    item = lambda link, title="A &amp; B", date="<pubDate>Fri, 14 Aug 2026 09:30:00 +0000</pubDate>": f"<item><title>{title}</title>{link}{date}</item>"
    feeds = [
        feed(item("<link>https://p/event/1-x</link>", title="late branch"), branch="Parr Library"),
        feed(item("<link>https://p/event/1-x</link>")), feed(item("<link>https://p/event/</link>", title="No id here at all"), page=2),
        feed(item("<guid>https://p/g/77</guid>", date="<dc:date>2026-08-14</dc:date>") + item("<link>https://p/8</link>", date="") + item("<link>https://p/9</link>", date="<pubDate>soon</pubDate>"), page=3), feed("", page=4),
    ]
    rows = table(spark, "branch STRING, page_no INT, fetched_at TIMESTAMP, body STRING", feeds)
    details = table(spark, "url STRING, body STRING", [dict(url="https://p/g/77", body='AGE GROUP <a href="/events?a=Teens">')])
    got = {r["id"]: r for r in dicts(landings.branch_listings(rows, details))}
    assert set(got) == {"plano-library-1x", "plano-library-Tm8gaWQgaGVyZSBhdCBhbGw=", "plano-library-77"}
    assert (got["plano-library-1x"]["title"], got["plano-library-1x"]["location_name"], got["plano-library-1x"]["start_datetime"].hour) == ("A & B", "Davis Library", 14)
    assert (got["plano-library-77"]["age_min"], got["plano-library-77"]["age_label"]) == (13, "Teens")


def test_horizon_runs_past_short_months():
    assert landings.horizon_end("2026-08-31T10:00:00Z") == utc("2027-03-03T10:00:00Z")
    assert landings.horizon_end("2026-12-01T00:00:00Z") == utc("2027-06-01T00:00:00Z")


# ---- what a run keeps, and what it does when something fails -----------------------------


def test_stored_columns_survive_a_republish(spark, paths):
    born = utc("2026-01-01T00:00:00Z")
    sinks.write_catalogue(rows(spark, 60, created_at=born), paths[0])
    batch = rows(spark, 62).drop("created_at")
    assert ingest.run_source(spark, "frisco-library", batch, *paths, NOW).upserted == 62
    have = stored(spark, paths)
    assert len(have) == 62 and sum(r["created_at"] == born.replace(tzinfo=None) or r["created_at"] == born for r in have.values()) == 60
    assert all(r["created_at"] is not None for r in have.values())


def test_partial_batch_over_many_stored_rows(spark, paths):
    sinks.write_catalogue(rows(spark, 60, "kaleidoscope-park", kid_relevant=True, age_confidence="high"), paths[0])
    few = rows(spark, 3, "kaleidoscope-park").drop("created_at").withColumn("title", F.lit("Renamed"))
    whole = ingest.run_source(spark, "kaleidoscope-park", few, *paths, NOW, all_good)
    assert whole.aborted and "ABORT" in whole.errors[-1]
    part = ingest.run_source(spark, "kaleidoscope-park", few, *paths, NOW, all_good, partial=True)
    assert not part.aborted and part.upserted == 3
    have = stored(spark, paths)
    assert len(have) == 60 and sum(r["title"] == "Renamed" for r in have.values()) == 3


def test_aborted_micro_batch_stops_the_stream(spark, tmp_path, paths):
    sinks.write_catalogue(rows(spark, 2, "plano-library"), paths[0])
    landed = str(tmp_path / "landed")
    bad = [payload(1, [entry(i, start_date="2026-08-14 03:00:00") for i in range(4)])]
    table(spark, schemas.RAW_PAGES, bad).write.parquet(landed)
    source = stream.landed_files(spark, landed, schemas.RAW_PAGES)
    q = stream.publish_stream(source, "kaleidoscope-park", landings.park_listings, *paths, str(tmp_path / "offsets"), NOW, all_good)
    with pytest.raises(Exception, match="not published"):
        q.awaitTermination(120)


def test_skipped_rows_come_back_as_pending(spark, tmp_path, paths):
    sinks.write_catalogue(rows(spark, 1, "plano-library"), paths[0])
    pending = str(tmp_path / "pending")
    result = ingest.run_source(spark, "play-frisco", rows(spark, 9, "play-frisco"), *paths, NOW, all_good, cap=4, pending_path=pending)
    assert (result.capped, result.upserted, spark.read.parquet(pending).count()) == (True, 4, 5)
    uncapped = ingest.run_source(spark, "play-frisco", rows(spark, 9, "play-frisco"), *paths, NOW, all_good)
    assert (uncapped.capped, uncapped.upserted, uncapped.llm_calls) == (False, 9, 5)


def test_all_sources_run_on_when_one_fails(spark, paths):
    sinks.write_catalogue(rows(spark, 3), paths[0])

    def broken():
        raise OSError("page not landed")

    resolved = rows(spark, 30).withColumn("age_resolved", F.lit(False))
    batches = {"frisco-library": resolved, "plano-library": broken, "kaleidoscope-park": lambda: rows(spark, 4, "kaleidoscope-park").withColumn("id", F.expr("raise_error('torn')"))}
    got = {r.source: r for r in ingest.run_all(spark, {**batches, "play-frisco": rows(spark, 2, "play-frisco")}, *paths, NOW, all_good)}
    assert [got[s].upserted for s in ("frisco-library", "plano-library", "kaleidoscope-park", "play-frisco")] == [30, 0, 0, 2]
    assert got["frisco-library"].errors == ["30 of 30 listings fell back to all ages"]
    assert "page not landed" in got["plano-library"].errors[0] and got["kaleidoscope-park"].aborted
    log = [r["status"] for r in dicts(sinks.read_runs(spark, paths[1]))]
    assert sorted(log) == ["err", "err", "ok", "warn"]
    failed = {r["source"]: r["failed"] for r in dicts(ingest.summarise(list(got.values()), spark))}
    assert failed == {"frisco-library": False, "plano-library": True, "kaleidoscope-park": True, "play-frisco": False}


def test_two_sources_publish_at_the_same_time(spark, paths):
    from concurrent.futures import ThreadPoolExecutor

    names = ["frisco-library", "plano-library", "play-frisco"]
    sinks.write_catalogue(rows(spark, 5, names[0]).unionByName(rows(spark, 5, names[1])).unionByName(rows(spark, 5, names[2])), paths[0])
    with ThreadPoolExecutor(3) as pool:
        jobs = [pool.submit(sinks.replace_source, rows(spark, n, s), paths[0], s) for s, n in zip(names, (7, 0, 9))]
        assert [j.result() for j in jobs] == [7, 0, 9]
    have = [r["source"] for r in stored(spark, paths).values()]
    assert [have.count(s) for s in names] == [7, 0, 9]


def test_staged_tables_go_with_the_run(spark, paths):
    import os

    from townbill.session import checkpoint_dir

    sinks.write_catalogue(rows(spark, 5), paths[0])
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    ingest.run_source(spark, "frisco-library", rows(spark, 6), *paths, NOW)
    ingest.run_source(spark, "frisco-library", rows(spark, 6).withColumn("id", F.expr("raise_error('torn')")), *paths, NOW)
    assert set(os.listdir(folder)) == before


def test_details_and_pages_landed_twice(spark):
    late = lambda r, **kw: {**r, "fetched_at": utc("2026-08-02T12:00:00Z"), **kw}
    one = payload(1, [entry(1), entry(2)])
    pages = table(spark, schemas.RAW_PAGES, [one, late(one, body=json.dumps({"events": [entry(1, title="Later"), entry(2)]}))])
    got = dicts(ingest.prepare(tables.as_batch(landings.park_listings(pages))))
    assert sorted(r["title"] for r in got) == ["Later", "Trail – 2"]
    item = "<item><title>A</title><link>https://p/e/1</link><pubDate>Fri, 14 Aug 2026 09:30:00 +0000</pubDate></item>"
    feed = dict(branch="Davis Library", page_no=1, fetched_at=utc(NOW), body=f"<rss><channel>{item}</channel></rss>")
    feeds = table(spark, "branch STRING, page_no INT, fetched_at TIMESTAMP, body STRING", [feed, late(feed)])
    page = lambda who, at: dict(url="https://p/e/1", fetched_at=utc(at), body=f'AGE GROUP <a href="/events?a={who}">')
    details = table(spark, "url STRING, fetched_at TIMESTAMP, body STRING", [page("Kids", NOW), page("Teens", "2026-08-03T12:00:00Z")])
    listed = dicts(landings.branch_listings(feeds, details))
    assert [r["age_label"] for r in listed] == ["Teens"]


def test_texts_past_the_old_windows(spark):
    long = "".join(f"<p>Paragraph number {i} of a long text.</p>" for i in range(300))
    gap = " " * 1500
    body = (
        f'<title>Painting</title><b itemprop="startDate">2026-08-14T18:30:00</b><i class="specificDetailHeader">Time:</i>{gap}<i class="specificDetailItem">6:30 PM - 9:15 PM</div>'
        f'<i class="specificDetailHeader">Location:</i>{gap}<i class="specificDetailItem">Hall</div><div itemprop="description" class="fr-view">{long}</div><p>Not part of the text</p>'
    )
    pages = table(spark, "eid STRING, fetched_at TIMESTAMP, body STRING", [dict(eid="5", fetched_at=utc(NOW), body=body)])
    (got,) = dicts(landings.calendar_listings(pages, NOW))
    assert got["description"].count("Paragraph") == 300 and "Not part" not in got["description"]
    assert got["location_name"] == "Hall" and got["end_datetime"].minute == 15


def jobs_of(spark, action):
    name = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(name, name)
    try:
        got = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("n", [0, 1000])
def test_metrics_come_from_the_write(spark, n):
    rows = spark.range(n).repartition(4).groupBy((F.col("id") % 10).alias("k")).count()
    metrics = dict(total=F.count(F.lit(1)), top=F.max("count"), some=F.coalesce(F.bool_or(F.col("k") == 3), F.lit(False)))
    with session.staging(spark):
        plain, least = jobs_of(spark, lambda: session.materialise(rows))
        (kept, got), jobs = jobs_of(spark, lambda: session.measured(rows, **metrics))
        assert jobs == least
        assert got == kept.agg(*[m.alias(c) for c, m in metrics.items()]).first().asDict()
        assert kept.columns == plain.columns and sorted(kept.collect()) == sorted(plain.collect())
