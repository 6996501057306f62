"""Spelling variants, against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from townbill.llm import spelling


def counted(docs):
    """Words by the rule of the query: some runs lose a letter."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(lower)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def brute(count, ratio=10):
    words = sorted(count)
    near = {w: [] for w in words}
    for w in words:
        deleted = {w[:i] + w[i + 1 :] for i in range(len(w))}
        for other in words:
            if len(other) == len(w) and sum(a != b for a, b in zip(w, other, strict=True)) == 1:
                near[w].append(other)
            elif other in deleted:
                near[w].append(other)
                near[other].append(w)
    form = {w: min(own, key=lambda x: (-count[x], x), default=None) for w, own in near.items()}
    form = {w: f if f and count[f] >= ratio * count[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), count[form[w]] if form[w] else None) for w, n in count.items())


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def corpus(seed):
    r = random.Random(seed)
    base = ["grammar", "bananaés", "aaaaaaa", "aaaaaaaa", "straßenbahn", "Àéîoüxyz", "tschuldigung", "x" * 70, "x" * 71, "short"]
    docs = []
    for d in range(60):
        words = []
        for _ in range(r.randint(0, 60)):
            w = base[min(int(r.expovariate(0.6)), len(base) - 1)]
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abxyé") + w[i:], w[:i] + r.choice("abxyß") + w[i + 1 :]])
            words.append(w.upper() if r.random() < 0.2 else w)
        docs.append((d, r.choice([" ", ", ", "1", "\n"]).join(words)))
    return [*docs, (100, None), (101, ""), (None, docs[0][1]), (3, docs[3][1]), (102, "grammar " * 3000 + "y" * 5000 + " " + "y" * 5000)]


def words_of(df):
    import townbill.llm.queries as queries

    runs = spelling.runs(df, 1)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    assert queries.QUERIES["op13_spelling_variants"]
    at = F.pmod(h, F.length("run")).cast("int")
    return runs.select(F.when(h % 31 == 0, spelling.without(F.col("run"), at)).otherwise(F.col("run")).alias("word"))


@pytest.mark.parametrize(("seed", "shard_words", "round_bytes"), [(1, 1 << 18, 32 << 20), (2, 5, 200), (3, 40, 1 << 20)])
def test_variants(spark, make, seed, shard_words, round_bytes):
    docs = corpus(seed)
    got = spelling.variants(words_of(make(docs)), shard_words=shard_words, round_bytes=round_bytes)
    want = brute(counted(docs))
    assert found(got) == want
    assert any(form for _, form, *_ in want) and any(n > 1 for *_, n, _ in want)


def test_chains_and_ties(spark):
    words = {"abcdefg": 5000, "abcdefx": 400, "abcdexx": 30, "abcdxxx": 2, "abcdefz": 5000, "zzzzzzz": 20, "azzzzzz": 2, "zzzzzza": 20}
    df = spark.createDataFrame([(w,) for w, n in words.items() for _ in range(n)] + [(None,)] * 3, "word string")
    got = found(spelling.variants(df))
    assert got == brute(words)
    assert {w: r for w, _, r, *_ in got}["abcdxxx"] == "abcdefg"


def test_no_words(spark, make):
    assert spelling.variants(words_of(make([]))).count() == 0
    assert spelling.variants(words_of(make([(1, None), (2, "one two")]))).count() == 0


def test_filters_let_all_words_through():
    words = [f"word{i:05d}" for i in range(3000)]
    layout = spelling.Layout.of({9: 3000}, 700)
    letters = spelling.Letters(words)
    c = letters.classes()
    blocks = layout.block(letters.hash, c)
    shard = layout.first_shard[c] + layout.part(letters.hash, c)
    assert set(shard.tolist()) == {0, 1, 2, 3, 4} and all(f <= b < f + n for s, f, n in layout.shards() for b in blocks[shard == s])
    # hashes of edits are those of the words they make
    i, h = letters.shorter(7)
    made = spelling.Letters([words[w][:a] + words[w][a + 1 :] for w, a in zip(letters.word[i], letters.at[i], strict=True)])
    assert np.array_equal(made.hash, h)
    i, h = letters.replaced(ord("0"))
    made = spelling.Letters([words[w][:a] + "0" + words[w][a + 1 :] for w, a in zip(letters.word[i], letters.at[i], strict=True)])
    assert np.array_equal(made.hash, h)


def test_rounds_are_bounded():
    layout = spelling.Layout.of({9: 10_000_000, 12: 3, 64: 100})
    rounds = layout.rounds(4 << 20)
    assert [s for r in rounds for s, _, _ in r] == [s for s, _, _ in layout.shards()]
    assert all(sum(n * 64 for *_, n in r) <= 4 << 20 for r in rounds)
