"""Vector links, set joins and components, against brute force."""

import math
import random

import numpy as np
import pytest
from townbill.llm import jaccard_join, vector_dedup
from townbill.llm.components import components, smallest_labels


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(200, 320)] + [(1, i) for i in range(2, 150)] + [(r.randint(400, 700), r.randint(400, 700)) for _ in range(150)]
    r.shuffle(links)
    u = Union()
    for a, b in links:
        u.join(a, b)
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {x.node: x.component for x in components(df).collect()}
    assert got == {n: u.find(n) for ab in links for n in ab if ab[0] != ab[1] or n in got}
    assert components(df.where("a < 0")).count() == 0


def test_smallest_labels():
    assert smallest_labels(np.array([3, 2, 5]), np.array([2, 1, 6]), 8).tolist() == [0, 1, 1, 1, 4, 5, 5, 7]


def brute_vectors(rows, threshold):
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    u, links = Union(), [0] * len(rows)
    for i, (_, v, a) in enumerate(rows):
        u.find(i)
        for j in range(i):
            w, b = rows[j][1:]
            if a is None or a != b or not good(v) or not good(w) or len(v) != len(w):
                continue
            x, y = np.array(v, float), np.array(w, float)
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                u.join(i, j)
    groups = {}
    for i, (d, _, _) in enumerate(rows):
        groups.setdefault(u.find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted((str(d), n, str(least[u.find(i)])) for i, (d, n) in enumerate(zip((r[0] for r in rows), links, strict=True)))


@pytest.mark.parametrize("width", [1, 2, 3, 16, 40])
def test_vectors(spark, width):
    from townbill.llm import common

    common.ship(spark)
    r = np.random.default_rng(width)
    centres = r.normal(size=(12, width))
    rows = []
    for i in range(260):
        v = centres[r.integers(12)] + r.normal(scale=r.choice([0.05, 0.25, 0.8]), size=width)
        rows.append((i, [float(x) for x in v * 10.0 ** r.integers(-3, 4)], int(r.integers(3)) if r.random() < 0.95 else None))
    rows += [(300 + k, rows[0][1], rows[0][2]) for k in range(30)]
    rows += [(400, None, 1), (401, [0.0] * width, 1), (402, [float("nan")] + [1.0] * (width - 1), 1), (403, [float("inf")] * width, 1), (404, [None] + [1.0] * (width - 1), 1), (405, [1.0] * (width + 1), 1), (None, rows[1][1], rows[1][2]), (0, rows[2][1], rows[2][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cls", vector_dedup.F.lit("x"))
    got = vector_dedup.vector_dedup(df, tile=16).collect()
    assert sorted((str(x.vec_id), x.n_links, str(x.component_id)) for x in got) == brute_vectors(rows, 0.93)
    assert all(x.kept == (x.vec_id is None or x.vec_id == x.component_id) for x in got)
    assert vector_dedup.vector_dedup(df.where("vec_id < 0")).count() == 0


def test_close_pairs_drops_none():
    r = np.random.default_rng(5)
    a, b = (vector_dedup.unit(r.normal(size=(70, 30)) @ np.diag(np.linspace(3, 0.1, 30))) for _ in range(2))
    i, j = vector_dedup.close_pairs(a, b, 0.6, strip=4)
    assert set(zip(*np.nonzero(a @ b.T >= 0.6), strict=True)) <= set(zip(i, j, strict=True))


def shingles(text, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_sets(rows, n, percent):
    sets, u = [shingles(t, n) for _, t in rows], Union()
    for i, a in enumerate(sets):
        u.find(i)
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                u.join(i, j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(u.find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted((str(d), len(sets[i]), str(least[u.find(i)])) for i, (d, _) in enumerate(rows))


def near_copies(seed, n=150):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("Th", "er", "io", "é", "qu") for b in ("a", "en", "ou", "s,", "x.")]
    bases = [r.choices(words, k=r.choice([1, 2, 4, 12, 60, 150])) for _ in range(9)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 1)] = [r.choice(words)]
            w = w or ["a"]
        rows.append((i, r.choice([" ", "\n", " \t"]).join(w)))
    return rows + [(900, None), (901, ""), (902, "  "), (None, rows[3][1]), (5, rows[4][1]), (7, rows[7][1]), (903, "Word " * 20000), (904, "word " * 19999)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (1, 60), (5, 80)])
def test_sets(make, n, percent):
    rows = near_copies(percent)
    got = jaccard_join.jaccard_components(make(rows), n, percent).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute_sets(rows, n, percent)


def test_one_of_each_group_stays(make):
    rows = near_copies(90)
    docs = make(rows)
    left = jaccard_join.keep_one(docs)
    assert left.columns == docs.columns
    ids = [x.doc_id for x in left.collect()]
    want = {c for _, n, c in brute_sets(rows, 3, 90) if n}
    assert sorted(str(i) for i in ids) == sorted([*want, "900", "901", "902"])
    assert jaccard_join.keep_one(docs.where("doc_id > 5000")).count() == 0


def test_rows_that_stay_are_not_moved(make, monkeypatch):
    kept, plans = {}, {}
    real = jaccard_join.common.stored

    def spy(df, name="rows", leaves=False):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        kept[name] = out = real(df, name, leaves)
        return out

    monkeypatch.setattr(jaccard_join.common, "stored", spy)
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, " ".join(f"a{i}x{j}" for j in range(30))) for i in range(40)]
    rows += [(100, words), (101, words + " z"), (101, words + " z"), (102, None), (102, None), (None, words), (103, "seldom seen"), (103, "seldom seen")]
    left = sorted(str((r.doc_id, r.text)) for r in jaccard_join.keep_one(make(rows)).collect())
    assert left == sorted(str(r) for r in [*rows[:40], (100, words), (102, None), (102, None), (103, "seldom seen")])
    # 101 and the one without an id go, 103 stands twice; all other rows are not met again
    assert sorted((str(r.r_id), r.stays) for r in kept["told"].collect()) == [("101", False), ("103", True), ("None", False)]
    # prefixes are made once a class, without meeting the classes' rows
    assert plans["prefixes"].count("Join ") == 1


def test_counters_of_any_size(make):
    rows = [(i, "the same words") for i in range(300)] + [(1000, "other words here")]
    seen = jaccard_join.frequencies(make(rows).repartition(3), 3)
    prints = [next(jaccard_join.sets_of([t], 3))[0] for t in ("the same words", "other words here")]
    assert [seen[int(p % np.uint64(jaccard_join.COUNTERS))] for p in prints] == [300, 1] and seen.sum() == 301


def test_cheaper_prefix_asks_for_more_matches():
    assert jaccard_join.choose_matches(np.array([1, 1, 1, 900]), 3, 30) == 1
    assert jaccard_join.choose_matches(np.full(10, 50), 3, 30) > 1
