"""Benchmark decontamination, against brute force."""

import random
import re

import pytest
from townbill.llm import decontaminate

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return LETTERS.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    tests = [("" if k is None else str(k), words_of(t)) for k, t in items]
    out = []
    for d, t in docs:
        w, hit, names, most = words_of(t), set(), set(), 0
        for name, own in tests:
            k = min(window, len(own))
            for q in range(len(own) - k + 1 if own else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == own[q : q + k]:
                        hit.update(range(p, p + k))
                        names.add(name)
                        n = k
                        while p + n < len(w) and q + n < len(own) and w[p + n] == own[q + n]:
                            n += 1
                        most = max(most, n)
        spans = [(p, next(z for z in range(p, len(w) + 1) if z not in hit)) for p in sorted(hit) if p - 1 not in hit]
        out.append((d, len(w), most, tuple(spans), tuple(sorted(names))))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.row.doc_id, r.n_words, r.longest, tuple((s.start, s.end) for s in r.spans), tuple(r["items"])) for r in df.collect()), key=str)


def case(seed):
    r = random.Random(seed)
    vocabulary = ["ab", "Été", "x1", "THE", "of", "zz", "naïve", "日本", "q", "Ⅻ"]
    say = lambda n: r.choice([" ", ", ", "\n", "-"]).join(r.choices(vocabulary, k=n))
    items = [(i, say(r.choice([1, 3, 9, 10, 11, 25, 60]))) for i in range(14) if i != 3]
    items += [(99, None), (100, " .,; "), (5, say(30)), (None, say(12)), (101, items[4][1])]
    docs = []
    for d in range(40):
        parts = [say(r.randint(0, 30)) for _ in range(3)]
        if r.random() < 0.6:
            own = (r.choice(items)[1] or "").split()
            parts.insert(1, " ".join(own[r.randint(0, len(own) // 3) :]).lower())
        docs.append((d, " . ".join(parts)))
    docs += [(100, None), (101, ""), (102, "?!"), (7, docs[7][1]), (None, docs[8][1]), (103, " ".join(docs[9][1] for _ in range(40)))]
    return docs, items


@pytest.mark.parametrize(("seed", "shard", "chunk"), [(1, 1 << 20, 1 << 20), (2, 700, 1 << 20), (3, 2000, 40)])
def test_windows(spark, make, seed, shard, chunk):
    docs, items = case(seed)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("row", decontaminate.F.lit("x"))
    got = decontaminate.contaminated(make(docs), bench, window=10, shard_bytes=shard, chunk_words=chunk)
    want = brute(docs, items, 10)
    if chunk < 100:  # matches are followed within pieces only
        assert [x[:2] + x[3:] for x in found(got)] == [x[:2] + x[3:] for x in want]
    else:
        assert found(got) == want


def test_clean_keeps_all_columns(spark, make):
    docs, items = case(4)
    given, bench = make(docs), spark.createDataFrame(items, "item_id long, text string")
    left = decontaminate.clean(given, bench, window=10)
    want = [d for d, _, _, spans, _ in brute(docs, items, 10) if not spans]
    assert left.columns == given.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark, make):
    docs, items = case(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contaminated(make(docs[:0]), bench).count() == 0
    assert found(decontaminate.contaminated(make(docs), bench.limit(0))) == brute(docs, [], 10)


def test_texts_in_stretches(monkeypatch):
    texts = ["the Cat", "", "sat\x00on", "ÀÉ 12", " x "]
    data = decontaminate.np.frombuffer("".join(texts).encode(), decontaminate.np.uint8)
    ends = decontaminate.np.cumsum([len(t.encode()) for t in texts])
    whole, n = decontaminate.word_hashes(data, ends)
    monkeypatch.setattr(decontaminate, "STRETCH_BYTES", 3)
    assert n.tolist() == [2, 0, 2, 2, 1] and decontaminate.word_hashes(data, ends)[0].tolist() == whole.tolist()


def test_one_place_in_many_items(spark, make):
    passage = " ".join(f"w{i}" for i in range(30))
    items = [(i, passage if i % 3 == 0 else f"{passage} end{i}") for i in range(60)]
    docs = [(d, f"start{d} {passage} tail") for d in range(80)]
    got = found(decontaminate.contaminated(make(docs), spark.createDataFrame(items, "item_id long, text string"), shard_bytes=1000))
    assert {x[1:] for x in got} == {(32, 30, ((1, 31),), tuple(sorted(str(i) for i in range(60))))}
