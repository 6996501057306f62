"""Whitening, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from townbill.llm import whitening


def brute(rows, width, count):
    x = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and len(v) == width and all(c is not None and math.isfinite(c) and abs(64 * c) < 2**53 for c in v):
            x[k] = np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000
    fit = np.array(sorted({tuple(r.tolist()) for r in x.values()}))
    n, total = len(fit), fit.sum(0)
    centred = (n * fit - total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = [k for k in np.argsort(-values, kind="stable")[:count] if values[k] > 1e-13 * values.sum()]
    white = {k: ((n * r - total) / n) @ vectors[:, order] / np.sqrt(values[order]) for k, r in x.items()}
    return n, total, {k: int(((n * r - total) ** 2).sum()) for k, r in x.items()}, white, values[order] / values.sum()


def given(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("x", "row", "n", "hash", "index", "values", "at", "task", "gap", "deviation", "vector"):
        df = df.withColumn(name, F.lit("kept"))
    return df.repartition(5)


def vectors(n, width, seed=0):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(width, width)) * np.linspace(2, 0.05, width)
    return [(i, v.tolist()) for i, v in enumerate(r.normal(size=(n, width)) @ mix)]


@pytest.mark.parametrize(("n", "width", "count", "block", "panel"), [(150, 6, 16, 1 << 17, 1 << 16), (400, 20, 16, 200, 1 << 16), (300, 5, 3, 50, 7)])
def test_against_numpy(spark, monkeypatch, n, width, count, block, panel):
    monkeypatch.setattr(whitening, "BLOCK_VALUES", block)
    rows = vectors(n, width)
    rows += [(1000 + i, rows[3][1]) for i in range(90)] + [(None, rows[5][1]), (5, rows[5][1])]
    rows += [(2000, None), (2001, [None] * width), (2002, [math.nan] * width), (2003, [math.inf] + [0.0] * (width - 1)), (2004, []), (2005, [1.0] * (width + 1)), (2006, [1e300] * width)]
    fit_n, total, deviation, white, explained = brute(rows, width, count)
    got, model = whitening.whiten(given(spark, rows), keep=("vec_id", "x"), count=count, panel_blocks=panel)
    out = got.collect()
    assert model.n == fit_n and model.sums == total.tolist() and model.identity_error < 1e-9
    assert np.allclose(model.explained, explained, rtol=1e-9) and abs(sum(model.explained)) <= 1 + 1e-9
    assert len(out) == len(white) and {r.row.x for r in out} == {"kept"}
    by_id = sorted(((rows[k][0], deviation[k]) for k in white), key=str)
    assert sorted(((r.row.vec_id, r.deviation) for r in out), key=str) == by_id
    unique = {r.row.vec_id: np.array(r.whitened) for r in out}
    keys = [k for k in white if rows[k][0] is not None and k < n]
    a, b = np.array([unique[rows[k][0]] for k in keys]), np.array([white[k] for k in keys])
    sign = np.sign((a * b).sum(0))
    assert np.abs(a * sign - b).max() < 1e-7


def test_no_direction(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out, model = whitening.whiten(given(spark, rows))
        assert out.count() == 0 and model.explained == []
    # the third entry follows from the others
    rows = [(i, [a, b, a + b]) for i, (a, b) in enumerate((k % 7 / 64, k * k % 11 / 64) for k in range(60))]
    out, model = whitening.whiten(given(spark, rows))
    assert len(model.explained) == 2 and {len(r.whitened) for r in out.collect()} == {2}


def test_numbers_past_a_long(spark):
    rows = [(i, [float((-1) ** i * 2**46 - i), float(i)]) for i in range(40)]
    out, model = whitening.whiten(given(spark, rows))
    assert model.identity_error < 1e-4 and all(r.deviation is None for r in out.collect())


def test_index_has_no_gaps(spark):
    rows = whitening.numbered(spark.range(1000).repartition(13).select("id"))
    assert sorted(r["index"] for r in rows.collect()) == list(range(1000))
