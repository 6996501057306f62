import pytest

from helpers import dicts, listings, one, utc
from townbill.operators import guard, quality

DAY = "2026-08-14T{:02d}:{:02d}:00Z"


def batch(spark, n=40, hour=15, minute=0, first=0, start=None, **kw):
    at = utc(start or DAY.format(hour, minute))
    return listings(spark, [dict(id=f"e{i}", start_datetime=at, **kw) for i in range(first, first + n)])


def verdict(incoming, stored, **kw):
    return one(guard.guard_verdict(incoming, stored.select("id", "start_datetime"), **kw))


def test_healthy_batch(spark):
    v = verdict(batch(spark), batch(spark))
    assert (v["abort"], v["kept"], v["reasons"], v["moved"], v["dominant_offset_min"]) == (False, 40, [], 0, None)


@pytest.mark.parametrize("hour, minute, offset, abort", [(10, 0, -300, True), (20, 0, 300, True), (16, 0, 60, True), (15, 10, None, False)])
def test_uniform_shift(spark, hour, minute, offset, abort):
    v = one(guard.uniform_shift(batch(spark, hour=hour, minute=minute), batch(spark)))
    assert (v["dominant_offset_min"], v["systemic"], v["overlap"]) == (offset, abort, 40)
    assert v["agreement"] == (1.0 if abort else 0.0)


def test_early_shift_aborts_and_writes_nothing(spark):
    incoming, stored = batch(spark, hour=10), batch(spark)
    v = guard.guard_verdict(incoming, stored)
    assert one(v)["abort"] and guard.write_set(incoming, v).count() == 0
    assert guard.dropped_set(incoming).count() == 40


def test_few_moved_rows_are_edits(spark):
    mixed = batch(spark, 35).unionByName(batch(spark, 5, 18, first=35))
    v = one(guard.uniform_shift(mixed, batch(spark)))
    assert (v["moved"], v["systemic"]) == (5, False)


def test_small_overlap_is_no_verdict(spark):
    v = one(guard.uniform_shift(batch(spark, 3, 20), batch(spark)))
    assert (v["overlap"], v["systemic"]) == (3, False)


def test_single_bad_row_is_dropped(spark):
    incoming = batch(spark).unionByName(batch(spark, 1, 10, first=100, title="Too early"))
    v = guard.guard_verdict(incoming, batch(spark))
    assert not one(v)["abort"] and one(v)["dropped"] == 1 and "Too early" in one(v)["reasons"][0]
    assert guard.write_set(incoming, v).count() == 40


def test_mostly_bad_batch_aborts(spark):
    assert verdict(batch(spark, 30, 10).unionByName(batch(spark, 10, first=30)), batch(spark))["abort"]


@pytest.mark.parametrize("n", [5, 0])
def test_partial_scrape_aborts(spark, n):
    v = verdict(batch(spark).limit(n), batch(spark))
    assert v["abort"] and v["kept"] == n and "batch has" in v["reasons"][-1]


def test_allowed_shift(spark):
    incoming, stored = batch(spark, hour=15), batch(spark, hour=10)
    assert verdict(incoming, stored)["abort"]
    v = guard.guard_verdict(incoming, stored, allow_time_shift=True)
    assert not one(v)["abort"] and guard.write_set(incoming, v).count() == 40 and "allowed" in one(v)["reasons"][0]


def test_first_load(spark):
    v = verdict(batch(spark), batch(spark).limit(0))
    assert (v["abort"], v["kept"], v["stored"]) == (False, 40, 0)


def test_half_of_stored_is_enough(spark):
    assert not verdict(batch(spark, 20), batch(spark))["abort"]
    assert verdict(batch(spark, 19), batch(spark))["abort"]


def test_offset_rounds_half_up(spark):
    new = batch(spark, start="2026-08-14T14:29:30Z")  # 30.5 minutes early
    assert one(guard.uniform_shift(new, batch(spark)))["dominant_offset_min"] == -30


def test_small_hours(spark):
    starts = {
        "2026-08-14T10:00:00Z": True, "2026-08-14T12:00:00Z": False, "2026-08-14T05:00:00Z": False,
        "2026-12-14T06:00:00Z": False, "2026-08-14T05:30:00Z": True, "2026-08-14T05:00:59Z": False, None: True,
    }
    rows = listings(spark, [dict(id=str(i), start_datetime=s and utc(s)) for i, s in enumerate(starts)])
    got = {r["id"]: r["implausible"] for r in dicts(guard.with_screen(rows))}
    assert [got[str(i)] for i in range(len(starts))] == list(starts.values())
    # the published-data check lets an unknown start pass
    assert one(quality.early_start_share(rows))["early"] == 2
