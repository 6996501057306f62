"""Language, quality and mixing."""

import random
import re
from collections import Counter

import pytest
from townbill.llm import language_id, mixing, quality_rules
from townbill.llm.queries import held_out

WORDS = {"en": "the of and thing with hand er", "de": "der und nicht für schön straße ein", "fr": "le été où garçon eau les être"}


def prose(seed, n=240):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(4, 60))), lang if r.random() < 0.8 else None, r.choice(["a", "b", "c"])))
    return rows


def test_language(make):
    rows = prose(1)
    truth = {i: next(k for k, v in WORDS.items() if t.split()[0] in v.split()) for i, t, *_ in rows}
    edge = [(900, None, None, "a"), (901, "", "en", "a"), (902, "12 34 !?", None, "a"), (903, "the hand and " * 40_000, None, "a"), (None, "der und", "de", None)]
    docs = make(rows + edge).withColumn("held_out", held_out())
    model = language_id.fit(docs.where(~docs.held_out))
    got = {r.doc_id: r for r in language_id.identify(docs, model, keep=("held_out",)).collect()}
    assert len(got) == len(rows) + len(edge)
    assert sum(got[i].lang_pred == t for i, t in truth.items()) >= 0.98 * len(truth)
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[903].lang_pred == "en" and not got[903].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    strange = language_id.identify(make([(1, "жзи клм нопр " * 30), (2, "the hand of and")]), model).collect()
    assert [r.rejected for r in sorted(strange, key=lambda r: r.doc_id)] == [True, False]
    none = docs.where("doc_id < 0")
    assert language_id.fit(none) is None
    assert language_id.identify(none, model).count() == 0
    assert language_id.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def test_language_of_copies(spark, make):
    few = ["kissa istuu ikkunalla", "koira juoksee metsässä", "lumi sataa hiljaa maahan"]
    copies = make([(k, t, "fi", "a") for k, t in enumerate(few)]).crossJoin(spark.range(10_000)).drop("id")
    for docs in (copies, copies.unionByName(make(prose(3)))):
        model = language_id.fit(docs)
        assert "fi" in model.languages
        assert sum(model.languages[k] == "fi" for k in model.owner) == 3  # a centroid for each text
        assert [r.lang_pred for r in language_id.identify(make([(1, t) for t in few]), model).collect()] == ["fi"] * 3


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, cover, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            cover.update(range(i, i + 8))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), n < 20 or 100 * len(cover) > 30 * n


def test_quality_rules(make):
    r = random.Random(2)
    good, bad = "the of and thing with hand er on in at to by".split(), "zz| yy& xx% ww$".split()
    rows = [(i, "\n".join(" ".join(r.choices(bad if i % 5 == 0 else good, k=r.randint(1, 30))) for _ in range(r.randint(1, 6)))) for i in range(120)]
    p = " ".join(r.choices([f"w{k}" for k in range(500)], k=40))
    rows += [(200, None), (200, ""), (201, "  \n "), (202, p + " x " + p), (203, (p + "\n") * 3), (204, "a b c d e f g h " * 3000), (None, "é 日本 \x0b|x"), (205, "a a a a a a a a"), (206, "a " * 9)]
    docs = make(rows)
    trusted = docs.where("doc_id % 5 != 0 and doc_id < 120").select("doc_id")
    weights = quality_rules.weights(docs, trusted)
    out = quality_rules.judge(docs, weights)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    got = out.collect()
    assert sorted((str(x.doc_id), x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got) == sorted((str(d), *brute_base(t)) for d, t in rows)
    for x in got:
        assert x.kept == (not x.base_failed and x.score >= quality_rules.THRESHOLD)
        if x.doc_id is not None and x.doc_id < 120 and not x.base_failed:
            assert x.kept == (x.doc_id % 5 != 0)
    none = docs.where("doc_id < 0")
    assert quality_rules.judge(none, quality_rules.weights(none, trusted)).count() == 0


def brute_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        open_ -= set(full)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("share", [0.3, 1.5, 2.0, 3.0])
def test_mixing(make, share):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 30), "en", r.choices(["a", "b", "ä", "B", None, "n"], [50, 5, 9, 20, 3, 1])[0]) for i in range(900)]
    rows += [(1000, None, "en", None), (1001, "x", None, "only"), (1002, "", "en", "empty"), (1, rows[1][1], "en", rows[1][3]), (None, "a b", "en", "a")]
    docs = make(rows)
    sizes = mixing.sizes_of(docs)
    plan = mixing.plan(sizes, [5, 2, 1], share)
    got = mixing.mix(sizes, plan).collect()
    words = Counter()
    for _, t, _, s in rows:
        words[s] += len((t or "").split())
    want = brute_targets(words, [5, 2, 1], share, 2.0)
    taken = Counter()
    assert len(got) == len(rows)
    for x in got:
        assert x.source_size == words[x.source] and x.target == pytest.approx(want[x.source]) and 0 <= x.copies <= 2
        taken[x.source] += x.copies * x.size
    # the boundary document is taken or left, whichever is nearer
    for s, t in taken.items():
        assert abs(want[s] - t) <= 15 + 1e-6
    assert sorted(map(str, mixing.mix(mixing.sizes_of(docs), mixing.plan(sizes, [5, 2, 1], share)).collect())) == sorted(map(str, got))
    out = mixing.take(docs, plan)
    assert out.columns == docs.columns and out.count() == sum(x.copies for x in got)
    # with many sources rows are dealt by source and salt; the result is the same
    dealt = mixing.plan(sizes, [5, 2, 1], share, few=1)
    assert sorted(map(str, mixing.mix(sizes, dealt, few=1).collect())) == sorted(map(str, got))
    none = docs.where("doc_id < 0")
    assert mixing.mix(mixing.sizes_of(none), mixing.plan(mixing.sizes_of(none), [5, 2, 1])).count() == 0


def test_mixing_moves_no_text(spark, make):
    """At any size, as the sources are counted; the planner's own limit for broadcasts plays no part."""
    docs = make([(i, "some words " * (i % 5), "en", "abc"[i % 3]) for i in range(60)])
    plan = mixing.plan(mixing.sizes_of(docs), [5, 2, 1])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = (mixing.take(docs, plan, few=n)._jdf.queryExecution().executedPlan().toString() for n in (3, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "hashpartitioning" not in few and "hashpartitioning(key" in many and "salt" in many
