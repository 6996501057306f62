"""Publishing by buckets: only what changes is written, and a failed run changes nothing."""

import json
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from helpers import dicts, listing, table, utc
from townbill import schemas
from townbill.operators import publish
from townbill.sources import sinks, snapshots, tables

SOURCE = "play-frisco"


def rows(spark, ids, **kw):
    return table(spark, schemas.LISTINGS, [listing(id=f"e{i}", source=SOURCE, **{"title": f"Title {i}", **kw}) for i in ids])


def files(path):
    return {str(p) for p in pathlib.Path(path).rglob("*.parquet") if p.is_file()}


def stored(spark, path):
    return {r["id"]: r for r in dicts(tables.scan_catalogue(spark, path, sources=[SOURCE]))}


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "catalogue")
    sinks.write_catalogue(rows(spark, range(400)), path)
    sinks.publish_source(spark, path, SOURCE, rows(spark, [0], title="First"))
    return path


def test_first_publish_takes_over_the_first_load(spark, path):
    have = stored(spark, path)
    assert len(have) == 400 and have["e0"]["title"] == "First" and have["e7"]["title"] == "Title 7"
    assert {r["source"] for r in have.values()} == {SOURCE}
    assert not [f for f in files(path) if "_snapshots" not in f]
    assert set(tables.scan_catalogue(spark, path, ["id"]).columns) == {"id"}


def test_only_touched_buckets_are_written(spark, path):
    before, root = files(path), snapshots.root_of(path, SOURCE)
    base = snapshots.live(spark, root)
    made = sinks.publish_source(spark, path, SOURCE, rows(spark, [3, 1000], title="Changed"), new={"created_at": F.lit("2026-01-01").cast("timestamp")})
    moved = {b for b in made.folders if made.folders[b] != base.folders.get(b)}
    want = {r["b"] for r in spark.createDataFrame([("e3",), ("e1000",)], "id string").select(snapshots.bucket_of(F.col("id"), base.buckets).alias("b")).collect()}
    assert moved == want and before <= files(path)
    have = stored(spark, path)
    assert len(have) == 401 == made.total and have["e3"]["title"] == have["e1000"]["title"] == "Changed"
    assert have["e1000"]["created_at"].year == 2026 and have["e4"]["title"] == "Title 4"


def test_purge_and_cleanup_touch_what_they_drop(spark, path):
    sinks.publish_source(spark, path, SOURCE, rows(spark, [5], title="Board meeting"))
    scraped = rows(spark, range(1, 398))
    base = snapshots.live(spark, snapshots.root_of(path, SOURCE))
    made = sinks.publish_source(spark, path, SOURCE, rows(spark, [9], title="New"), scraped, ["board meeting"], purge=True)
    have = stored(spark, path)
    assert set(have) == {f"e{i}" for i in range(1, 398) if i != 5} and have["e9"]["title"] == "New"
    assert any(made.folders[b] == base.folders[b] for b in made.folders)
    assert sinks.publish_source(spark, path, SOURCE, rows(spark, []), scraped, ["board meeting"], purge=True) == made


def test_same_rows_as_a_whole_rewrite(spark, path):
    old = tables.scan_catalogue(spark, path, sources=[SOURCE])
    write, scraped, words = rows(spark, [*range(50, 60), 700, 701], title="Again"), rows(spark, range(30, 390)), ["title 77", "title 111"]
    want = dicts(publish.next_snapshot(old, write, scraped, words, True, {"created_at": F.lit(None)}))
    sinks.publish_source(spark, path, SOURCE, write, scraped, words, True, {"created_at": F.lit(None)})
    key = lambda r: r["id"]
    got = dicts(tables.scan_catalogue(spark, path, sources=[SOURCE]))
    assert sorted(got, key=key) == sorted(({k: r[k] for k in got[0]} for r in want), key=key)


def test_failed_run_leaves_the_snapshot(spark, path):
    before, have = files(path), stored(spark, path)
    bad = rows(spark, [1, 2]).withColumn("title", F.raise_error(F.lit("no answer")).cast("string"))
    with pytest.raises(Exception, match="no answer"):
        sinks.publish_source(spark, path, SOURCE, bad)
    assert files(path) == before and stored(spark, path) == have


def test_readers_skip_half_a_manifest(spark, path):
    root = snapshots.root_of(path, SOURCE)
    made = snapshots.live(spark, root)
    pathlib.Path(root, "manifests", f"{made.version + 1:09d}.json").write_text('{"buckets": 16, "fol')
    assert snapshots.live(spark, root) == made and len(stored(spark, path)) == 400
    later = sinks.publish_source(spark, path, SOURCE, rows(spark, [2], title="After"))
    assert later.version == made.version + 2 and stored(spark, path)["e2"]["title"] == "After"


def test_a_second_writer_fails(spark, path):
    root = snapshots.root_of(path, SOURCE)
    base = snapshots.live(spark, root)
    sinks.publish_source(spark, path, SOURCE, rows(spark, [1], title="Theirs"))
    touched = {r["b"] for r in rows(spark, [1]).select(snapshots.bucket_of(F.col("id"), base.buckets).alias("b")).collect()}
    with pytest.raises(RuntimeError, match="another run"):
        snapshots.commit(rows(spark, [1], title="Mine").drop("source"), root, base, touched)
    assert stored(spark, path)["e1"]["title"] == "Theirs"


def test_old_folders_go(spark, path):
    root = snapshots.root_of(path, SOURCE)
    for k in range(4):
        sinks.publish_source(spark, path, SOURCE, rows(spark, range(400), title=f"Run {k}"))
    assert len(os.listdir(f"{root}/manifests")) - sum(n.startswith(".") for n in os.listdir(f"{root}/manifests")) == snapshots.KEPT
    named = {f for p in pathlib.Path(root, "manifests").glob("*.json") for f in json.loads(p.read_text())["folders"].values()}
    assert {str(pathlib.Path(f).parent.relative_to(root)) for f in files(root)} == named
    assert {r["title"] for r in stored(spark, path).values()} == {"Run 3"}


def test_buckets_grow(spark, path, monkeypatch):
    monkeypatch.setattr(snapshots, "buckets_for", lambda rows, each=0: 64)
    made = sinks.publish_source(spark, path, SOURCE, rows(spark, [1], title="Wide"))
    assert made.buckets == 64 and made.total == 400 and stored(spark, path)["e1"]["title"] == "Wide"
    assert snapshots.live(spark, snapshots.root_of(path, SOURCE)).total == 400 and utc("2026-01-01T00:00:00Z")
