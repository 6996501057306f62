import pytest

from helpers import dicts, listings, one, utc
from townbill.operators import quality
from townbill.sources import sinks

NOW = "2026-08-01T12:00:00Z"


def aged(spark, groups, **kw):
    rows, n = [], 0
    for count, lo, hi in groups:
        for _ in range(count):
            rows.append(dict(id=f"e{n}", title=f"Title {n}", age_min=lo, age_max=hi, ingested_at=utc("2026-08-01T00:00:00Z"), **kw))
            n += 1
    return rows


def passes(report):
    return {r["name"]: r["pass"] for r in dicts(report)}


def others():
    at = dict(start_datetime=utc("2026-08-20T15:00:00Z"), ingested_at=utc("2026-08-01T00:00:00Z"))
    return [dict(id=f"p{i}", source="plano-library", **at) for i in range(30)] + [dict(id=f"k{i}", source="kaleidoscope-park", **at) for i in range(5)]


def test_healthy_report(spark):
    rows = aged(spark, [(20, 0, 5), (15, 6, 12), (10, 13, 17), (8, 18, 99)]) + others()
    report = quality.quality_report(listings(spark, rows), NOW)
    assert len(passes(report)) == 12 and all(passes(report).values())
    quality.enforce(report)


def test_collapsed_ages_fail(spark):
    rows = aged(spark, [(50, 0, 17)]) + others()
    rows[0]["title"] = "D&D for Adults"
    report = quality.quality_report(listings(spark, rows), NOW)
    failed = {n for n, ok in passes(report).items() if not ok}
    assert failed == {"frisco: age variety", "frisco: no adult-title leaks", "frisco: toddler filter narrows"}
    details = {r["name"]: r["detail"] for r in dicts(report)}
    assert details["frisco: age variety"] == "top bucket 0-17 = 100% (max 85%)"
    assert "D&D for Adults" in details["frisco: no adult-title leaks"]
    with pytest.raises(quality.QualityGateFailed):
        quality.enforce(report)


def test_empty_catalogue(spark):
    got = passes(quality.quality_report(listings(spark, []), NOW))
    assert not got["frisco: non-empty"] and got["play-frisco: present"] and not got["freshness"]
    assert got["plano: start times plausible"] and got["frisco: age variety"]


def test_report_counts_every_upcoming_row(spark):
    rows = aged(spark, [(1500, 0, 5), (10, 6, 12)])
    details = {r["name"]: r["detail"] for r in dicts(quality.quality_report(listings(spark, rows), NOW))}
    assert details["frisco: non-empty"] == "1510 upcoming (min 30)"


def test_stale_ingest(spark):
    rows = listings(spark, [dict(ingested_at=utc("2026-07-30T11:00:00Z"))])
    assert one(quality.freshness(rows, NOW))["pass"] is False
    assert one(quality.freshness(rows, "2026-08-01T11:00:00Z"))["pass"] is True


def test_adult_titles(spark):
    titles = {
        "D&D for Adults": True, "Adult’s craft": True, "Seniors tea": True, "18+a night": True, "18+ night": False,
        "Adulting 101": False, "Éadult": True, "Young readers": False, None: False,
    }
    rows = listings(spark, [dict(id=str(i), title=t, age_min=0) for i, t in enumerate(titles)])
    from pyspark.sql import functions as F

    got = {r["id"]: r["leak"] for r in dicts(rows.select("id", quality.adult_title_leak(F.col("title"), F.col("age_min")).alias("leak")))}
    assert [got[str(i)] for i in range(len(titles))] == list(titles.values())


def test_dominant_bucket(spark):
    rows = listings(spark, aged(spark, [(2, 0, 5), (2, None, None)]))
    assert one(quality.dominant_bucket(rows)) == {"bucket": "0-5", "share": 0.5, "total": 4}
    assert one(quality.dominant_bucket(rows.limit(0))) == {"bucket": "n/a", "share": 0.0, "total": 0}


def test_report_sink_fails_the_job(spark, tmp_path):
    report = quality.quality_report(listings(spark, []), NOW)
    with pytest.raises(quality.QualityGateFailed):
        sinks.write_report(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == report.count()
