"""Removal of repeated bytes and words, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from townbill.llm import blocks, substring_dedup, suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_bytes(docs, length):
    count = Counter(b[i : i + length] for _, t in docs for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        starts, ends = blocks.runs(gone)
        out.append((d, len(b), bytes(np.frombuffer(b, np.uint8)[~gone]), tuple(zip(starts.tolist(), ends.tolist(), strict=True))))
    return sorted(out, key=str)


def brute_words(docs, window):
    words = [(d, WORD.findall((t or "").encode())) for d, t in docs]
    late = float("inf")
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, late), late if d is None else d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (late if d is None else d):
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["ab", "été", "x", "line", "the", "of", "zz", "quux", "naïve", "b"]
    shared = [" ".join(r.choices(words, k=r.randint(20, 90))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(r.choice(shared) if r.random() < 0.5 else " ".join(r.choices(words, k=r.randint(1, 40))))
            if r.random() < 0.3:
                p = parts[-1]
                parts[-1] = p[r.randint(0, len(p) // 2) : r.randint(len(p) // 2, len(p))]
        docs.append((i, r.choice([" ", "\n", "\t ", "\x0b"]).join(parts)))
    return docs


EDGE = [(900, None), (901, ""), (902, " \n\t"), (903, "a" * 700), (904, "a" * 700), (904, "a" * 700), (None, "line the of " * 60), (905, "line the of " * 60), (906, "é" * 300), (907, "Ouwhea rend and of threlyes. " * 2500)]


@pytest.mark.parametrize("length", [2, 9, 40, 130])
def test_bytes(make, length):
    docs = corpus(length) + EDGE
    got = suffix_dedup.suffix_dedup(make(docs), length, block_bytes=9_000, samples_each=500, part_bytes=3_000).collect()
    got = sorted(((r.doc_id, r.n_bytes, bytes(r.kept), tuple((s.start, s.end) for s in r.spans)) for r in got), key=str)
    assert got == brute_bytes(docs, length)


@pytest.mark.parametrize("window", [2, 5, 11, 50])
def test_words(make, window):
    docs = corpus(window + 100) + EDGE
    got = substring_dedup.substring_dedup(make(docs), window, block_bytes=9_000, probes_each=400, windows_each=300).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_words(docs, window)


def test_empty_tables(make):
    none = make([(1, "a")]).where("doc_id > 1")
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0


def test_text_of_cut_characters(make):
    docs = make([(1, "é" * 300), (2, "éa" + "é" * 220)])
    rows = suffix_dedup.suffix_dedup(docs, as_text=True, carry=("source", "lang")).collect()
    assert all(isinstance(r.kept, str) and r.row.source == "s" for r in rows)


@pytest.mark.parametrize("length", [1, 2, 25, 26, 100, 400, 1000])
def test_cover(length):
    d, v = suffix_dedup.cover(length)
    assert {(a - b) % v for a in d.tolist() for b in d.tolist()} == set(range(v))
    assert v <= max(1, length // 2)


@pytest.mark.parametrize("length", [2, 7, 30, 60, 150])
def test_bucket_sort_splits_long_ties(length):
    r = np.random.default_rng(length)
    base = r.integers(97, 99, 400).astype(np.uint8)
    pieces = []
    for _ in range(40):
        p = base.copy()
        p[r.integers(0, 400, r.integers(0, 3))] = 122
        pieces.append(p[r.integers(0, 60) :])
    text = np.concatenate(pieces)
    starts = np.cumsum([0] + [len(p) for p in pieces[:-1]])
    windows = np.concatenate([np.arange(s, s + len(p) - length + 1) for s, p in zip(starts, pieces, strict=True)])
    count = Counter(text[w : w + length].tobytes() for w in windows)
    want = [count[text[w : w + length].tobytes()] > 1 for w in windows]
    assert suffix_dedup.repeated_windows(text, windows, length).tolist() == want
