import random

import pytest
from pyspark.sql import functions as F

from helpers import column, dicts, listings, one, table
from townbill.operators import classify, publish, series
from townbill.plans.ingest import classify_batch


def brute_merge(rows):
    out = {}
    for r in rows:
        if r["id"] not in out:
            out[r["id"]] = dict(r)
            continue
        have = out[r["id"]]
        if have["age_min"] != 18 and r["age_min"] is not None and r["age_max"] is not None:
            have["age_min"] = min(r["age_min"] if have["age_min"] is None else have["age_min"], r["age_min"])
            have["age_max"] = max(r["age_max"] if have["age_max"] is None else have["age_max"], r["age_max"])
    return {k: (v["title"], v["age_min"], v["age_max"]) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_merge_against_steps(spark, seed):
    rng = random.Random(seed)
    ages = [None, 5, 17, 18, 18, 18, 20, 25, 30]
    rows = [
        dict(id=rng.choice(["hot"] * 3 + [f"i{n}" for n in range(120)]), title=f"t{seq}", age_min=rng.choice(ages[seed:]), age_max=rng.choice([None, 30, 40, 99]), seq=seq)
        for seq in range(700)
    ]
    df = table(spark, "id STRING, title STRING, age_min INT, age_max INT, seq BIGINT", rows).repartition(5)
    got = {r["id"]: (r["title"], r["age_min"], r["age_max"]) for r in dicts(series.merge_by_id(df))}
    assert got == brute_merge(rows)


def test_recurring(spark):
    rows = listings(spark, [
        dict(id="a", title="Story Time"), dict(id="b", title=" story  TIME"), dict(id="c", title="Story time"), dict(id="d", title="Other"),
        dict(id="e", title="Story time", source="plano-library"), dict(id="f", title="Once", is_recurring=True, recurrence_label="Weekly"),
        dict(id="g", title="Twin", recurrence_label="Daily"), dict(id="h", title="Twin", recurrence_label=""),
    ])
    got = {r["id"]: (r["is_recurring"], r["recurrence_label"]) for r in dicts(series.mark_recurring(rows))}
    yes = (True, "Recurring")
    assert got == {"a": yes, "b": yes, "c": yes, "d": (False, None), "e": (False, None), "f": (True, "Weekly"), "g": (True, "Daily"), "h": yes}


def test_first_by(spark):
    rows = table(spark, "k STRING, p INT, q INT, v STRING", [dict(k="a", p=2, q=1, v="late"), dict(k="a", p=1, q=2, v="mid"), dict(k="a", p=1, q=1), dict(k="b", p=9, q=9, v="only")])
    assert {r["k"]: r["v"] for r in dicts(series.first_by(rows, ["k"], ["p", "q"]))} == {"a": None, "b": "only"}


# ---- classification ---------------------------------------------------------------------

GOOD = '{"kid_relevant": true, "age_buckets": ["kids"], "confidence": "high", "price": "free", "price_confidence": "inferred", "reasoning": "r"}'


def batch(spark, rows):
    return listings(spark, rows, ", seq BIGINT, price_locked BOOLEAN")


def answers(**by_id):
    def ask(due):
        given = table(due.sparkSession, "id STRING, answer STRING", [dict(id=k, answer=v) for k, v in by_id.items()])
        return due.select("id").join(given, "id")

    return ask


def run(spark, rows, prior=(), cap=300, retry_failed=False, **by_id):
    base = dict(source="play-frisco", is_free=True, price_text="Free", price_class="free", price_confidence="inferred")
    rows = [{**base, "seq": n, "price_locked": False, **r} for n, r in enumerate(rows)]
    got = classify_batch(batch(spark, rows), listings(spark, [dict(source="play-frisco", **p) for p in prior]), answers(**by_id), cap, retry_failed)
    return {r["id"]: r for r in dicts(got)}


def test_known_rows_keep_their_classification_and_price(spark):
    stored = dict(id="a", kid_relevant=True, age_buckets=["teen"], age_confidence="medium", price_class="unknown", is_free=None, price_text=None)
    r = run(spark, [dict(id="a", price_class="paid", price_confidence="confirmed", is_free=False, price_locked=True)], [stored], a=GOOD)["a"]
    # even a price the source has just stated is replaced by the stored one
    assert (r["age_buckets"], r["price_class"], r["is_free"], r["price_text"], r["carried"]) == (["teen"], "unknown", None, None, True)


def test_answer_applies_to_new_rows(spark):
    got = run(spark, [dict(id="a"), dict(id="b", description="a class"), dict(id="c", registration_required=True), dict(id="d", price_locked=True, price_class="paid", price_confidence="confirmed", is_free=False)],
              [dict(id="a")], a=GOOD, b=GOOD, c=GOOD, d=GOOD)
    assert [(got[k]["kid_relevant"], got[k]["age_confidence"], got[k]["price_class"], got[k]["is_free"]) for k in "abcd"] == [
        (True, "high", "free", True), (True, "high", "unknown", None), (True, "high", "unknown", None), (True, "high", "paid", False)]


def test_failed_answer_hides(spark):
    got = run(spark, [dict(id="a"), dict(id="b")], a="no json")
    for k in "ab":
        assert (got[k]["kid_relevant"], got[k]["age_reasoning"], got[k]["price_class"]) == (False, classify.UNAVAILABLE, "free")


def test_failed_answer_is_known_next_time(spark):
    stored = [dict(id="a", kid_relevant=False, age_reasoning=classify.UNAVAILABLE)]
    assert run(spark, [dict(id="a")], stored, a=GOOD)["a"]["kid_relevant"] is False
    assert run(spark, [dict(id="a")], stored, retry_failed=True, a=GOOD)["a"]["kid_relevant"] is True


@pytest.mark.parametrize("cap, skipped", [(0, {"b", "c", "d"}), (1, {"c", "d"}), (3, set()), (9, set())])
def test_spend_cap(spark, cap, skipped):
    got = run(spark, [dict(id=k) for k in "abcd"], [dict(id="a", kid_relevant=True)], cap=cap, b=GOOD, c=GOOD, d=GOOD)
    assert {k for k, r in got.items() if r["budget_skipped"]} == skipped
    # a skipped row is neither shown nor hidden
    assert all(got[k]["kid_relevant"] is None for k in skipped)


def test_adult_override(spark):
    rows = [dict(id="a", description="Adults only night"), dict(id="b", title="21 + crowd"), dict(id="c", title="Must be 21"), dict(id="d", title="18+"), dict(id="e", title="121+ puzzles"), dict(id="f")]
    got = run(spark, rows, [dict(id="a", kid_relevant=True), dict(id="f", kid_relevant=True, age_confidence="low")], **{k: GOOD for k in "bcde"})
    assert {k: r["kid_relevant"] for k, r in got.items()} == {"a": False, "b": False, "c": False, "d": False, "e": True, "f": False}


def test_cap_setting():
    caps = {None: None, "": None, " ": None, "abc": None, "-1": None, "nan": None, "inf": None, "0": 0, "12": 12, "12.9": 12}
    assert {k: classify.call_cap(k) for k in caps} == caps


def test_calibration(spark):
    rows = table(spark, "expected STRING, got STRING", [dict(expected="free", got="free"), dict(expected="free", got="paid"), dict(expected="free", got="free")])
    assert {(r["expected"], r["got"]): (r["cases"], r["passed"]) for r in dicts(classify.calibration_matrix(rows))} == {("free", "free"): (2, 2), ("free", "paid"): (1, 0)}


# ---- snapshots --------------------------------------------------------------------------


def small(spark, rows):
    return table(spark, "id STRING, title STRING", [dict(id=i, title=t) for i, t in rows])


def test_next_snapshot(spark):
    stored = small(spark, [("a", "old"), ("b", "kept: scraped, not written"), ("c", "stale"), ("d", "City Council"), ("n", None)])
    write, scraped = small(spark, [("a", "new"), ("e", "board of x"), ("f", "added")]), small(spark, [(i, "") for i in "abdefn"])
    words = ("city council", "board of")
    full = {r["id"]: r["title"] for r in dicts(publish.next_snapshot(stored, write, scraped, words, purge=True))}
    assert full == {"a": "new", "b": "kept: scraped, not written", "f": "added", "n": None}
    plain = publish.next_snapshot(stored, write)
    assert set(column(plain, "id")) == set("abcdefn") and plain.count() == 7


def test_run_log(spark):
    rows = table(spark, "id INT, total_upserted INT, llm_calls INT, errors ARRAY<STRING>", [
        dict(id=1, total_upserted=0, llm_calls=5, errors=["x"]), dict(id=2, total_upserted=3, errors=["x"]), dict(id=3, total_upserted=3, llm_calls=2, errors=[])])
    got = dicts(publish.run_log_row(rows).orderBy("id"))
    assert [(r["status"], str(r["llm_cost_usd"]), r["llm_calls"]) for r in got] == [("err", "0.0300", 5), ("warn", "0.0000", 0), ("ok", "0.0120", 2)]
