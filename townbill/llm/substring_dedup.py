"""Removal of word sequences that an earlier document has, by fixed-block anchors.

Every document's words are cut into non-overlapping blocks of half a window. Any window of an equal
sequence holds at least one whole block of the document it comes from, wherever the window starts. So

1. the blocks of all documents are indexed, and every rolling window of a block's length in every
   document is probed against the index; only a 32-bit name per distinct probe travels, and one bit back;
2. hits are extended: all full windows over a hit, which are few, get 64-bit fingerprints, and the
   smallest document that has each is found. Consecutive windows that an earlier document has make up
   the maximal exact repeats, whose words go.

The texts are shuffled once; a sequence that a third of the documents share is one entry per block of
texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from townbill.llm import blocks, common
from townbill.llm.blocks import U64, Block, Fingerprints

WINDOW = 50
PROBES_EACH = 1_000_000
WINDOWS_EACH = 1_000_000
NEVER = np.iinfo(np.int64).max
RESULT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"


@dataclass
class Words:
    """The words of a block's texts: where they are, what they are, and which text they belong to."""

    block: Block
    begins: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # text of each word
    first: np.ndarray  # first word of each text
    count: np.ndarray  # words of each text
    prints: Fingerprints

    @staticmethod
    def of(table: pa.Table) -> Words:
        block = Block.of(table)
        space = np.zeros(256, bool)
        space[[ord(c) for c in common.SPACES]] = True
        is_word = ~space[block.data]
        before = np.concatenate([[False], is_word[:-1]]) if len(is_word) else is_word
        after = np.concatenate([is_word[1:], [False]]) if len(is_word) else is_word
        own = block.starts[block.starts < block.ends]
        start_of_text = np.zeros(len(is_word) + 1, bool)
        start_of_text[own] = True
        start_of_text[-1] = True
        begins = np.flatnonzero(is_word & (~before | start_of_text[:-1]))
        ends = np.flatnonzero(is_word & (~after | start_of_text[1:])) + 1
        doc = np.searchsorted(block.ends, begins, "right")
        count = np.bincount(doc, minlength=len(block.starts)).astype(np.int64)
        values = Fingerprints.of_bytes(block.data).at(begins, ends - begins) if len(begins) else np.zeros(0, U64)
        return Words(block, begins, ends, doc, np.cumsum(count) - count, count, Fingerprints(values))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of n words that lie in one text, and their fingerprints."""
        at = np.arange(max(0, len(self.begins) - n + 1), dtype=np.int64)
        at = at[self.doc[at] == self.doc[at + n - 1]]
        return at, self.prints.at(at, n)


def _block_words(window: int) -> int:
    return (window + 1) // 2


def _probes(words: Words, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling windows of a block's length: first words, keys, and which are index blocks of their text."""
    n = _block_words(window)
    at, prints = words.windows(n)
    long_enough = words.count[words.doc[at]] >= window
    at, prints = at[long_enough], prints[long_enough]
    return at, blocks.split_names(prints, buckets), (at - words.first[words.doc[at]]) % n == 0


def _ask(window: int, buckets: int):
    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, keys, anchor = _probes(Words.of(table), window, buckets)
        rows = []
        for indexed, own in ((False, np.unique(keys)), (True, np.unique(keys[anchor]))):
            names = (own & U64(0xFFFFFFFF)).astype("<u4")
            rows += [(b, key[0].as_py(), indexed, names[a:z].tobytes()) for b, a, z in blocks.by_bucket(own)]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("bucket", "block", "indexed", "names"), cols, kinds, strict=True)})

    return ask


def _answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each block's probes: indexed anywhere, and found in a second block of texts."""
    indexed = np.array(table.column("indexed").to_pylist(), bool)
    parts = [np.frombuffer(x, "<u4") for x in table.column("names").to_pylist()]
    index = np.unique(np.concatenate([p for p, i in zip(parts, indexed, strict=True) if i] or [np.zeros(0, "<u4")]))
    owners = table.column("block").to_pylist()
    asked = [(o, p) for o, p, i in zip(owners, parts, indexed, strict=True) if not i]
    hits = []
    for _, names in asked:
        at = np.minimum(np.searchsorted(index, names), max(len(index) - 1, 0))
        hits.append(index[at] == names if len(index) else np.zeros(len(names), bool))
    seen = np.zeros(len(index) + 1, np.int32)  # blocks of texts that probe each indexed name
    for (_, names), hit in zip(asked, hits, strict=True):
        seen[np.searchsorted(index, names[hit])] += 1
    rows = []
    for (owner, names), hit in zip(asked, hits, strict=True):
        shared = hit.copy()
        shared[hit] = seen[np.searchsorted(index, names[hit])] > 1
        if hit.any():
            rows.append((owner, key[0].as_py(), blocks.bits(hit), blocks.bits(shared)))
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "bucket", "hit", "shared"), cols, kinds, strict=True)})


def _candidates(words: Words, answers: pa.Table, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and fingerprints of the full windows over a probe that hit."""
    at, own, _ = _probes(words, window, buckets)
    keys, back, count = np.unique(own, return_inverse=True, return_counts=True)
    found = np.zeros(len(keys), bool)
    for bucket, hit, shared in zip(*(answers.column(c).to_pylist() for c in ("bucket", "hit", "shared")), strict=True):
        low, high = np.searchsorted(keys, np.array([bucket << 32, (bucket + 1) << 32], U64))
        found[low:high] |= blocks.unbits(hit, high - low) & (blocks.unbits(shared, high - low) | (count[low:high] > 1))
    over = np.zeros(len(words.begins) + 1, np.int64)
    over[at[found[back]] + 1] = 1
    over = np.cumsum(over)  # hits before each word
    full, prints = words.windows(window)
    some = over[full + window - _block_words(window) + 1] > over[full]
    return full[some], prints[some]


def _doc_ids(words: Words) -> np.ndarray:
    """Document ids of the texts; those without one are earlier than none."""
    return np.array([NEVER if d is None else d for d in words.block.ids.to_pylist()], np.int64)


def _extend(window: int, buckets: int, window_buckets: int):
    def extend(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words.of(docs)
        full, prints = _candidates(words, answers, window, buckets)
        order = np.lexsort((_doc_ids(words)[words.doc[full]], prints, prints % U64(window_buckets)))
        prints, who = prints[order], _doc_ids(words)[words.doc[full]][order]
        new = np.concatenate([[True], prints[1:] != prints[:-1]])[: len(prints)]
        prints, who = prints[new], who[new]
        bucket = (prints % U64(window_buckets)).astype(np.int64)
        names, place = np.unique(who, return_inverse=True)
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        rows = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            if z > a:
                own, local = np.unique(place[a:z], return_inverse=True)
                kind = "<u2" if len(own) <= 65_536 else "<u4"
                rows.append((int(bucket[a]), key[0].as_py(), prints[a:z].astype("<u8").tobytes(), names[own].astype("<i8").tobytes(), local.astype(kind).tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("bucket", "block", "prints", "docs", "place"), cols, kinds, strict=True)})

    return extend


def _earliest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """To each block of texts, the windows that an earlier document elsewhere has, with that document."""
    prints = [np.frombuffer(x, "<u8") for x in table.column("prints").to_pylist()]
    who = []
    for names, place, p in zip(table.column("docs").to_pylist(), table.column("place").to_pylist(), prints, strict=True):
        who.append(np.frombuffer(names, "<i8")[np.frombuffer(place, "<u2" if len(place) == 2 * len(p) else "<u4")])
    every, back = np.unique(np.concatenate(prints), return_inverse=True)
    least = np.full(len(every), NEVER, np.int64)
    np.minimum.at(least, back, np.concatenate(who))
    rows, at = [], 0
    for owner, p, w in zip(table.column("block").to_pylist(), prints, who, strict=True):
        first = least[back[at : at + len(p)]]
        at += len(p)
        earlier = first < w
        if earlier.any():
            rows.append((owner, p[earlier].tobytes(), first[earlier].astype("<i8").tobytes()))
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    kinds = (pa.int64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "prints", "docs"), cols, kinds, strict=True)})


def _remove(window: int):
    def remove(key: tuple[pa.Scalar, ...], docs: pa.Table, found: pa.Table) -> pa.Table:
        words = Words.of(docs)
        ids = _doc_ids(words)
        full, prints = words.windows(window)
        known = np.frombuffer(b"".join(found.column("prints").to_pylist()), "<u8")
        first = np.frombuffer(b"".join(found.column("docs").to_pylist()), "<i8")
        order = np.argsort(known)
        known, first = known[order], first[order]
        mine = ids[words.doc[full]]
        least = np.full(len(full), NEVER, np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, prints), len(known) - 1)
            least = np.where(known[at] == prints, first[at], NEVER)
        # documents of this block; what it sent was its smallest document for each window
        order = np.lexsort((mine, prints))
        head = np.concatenate([[True], prints[order][1:] != prints[order][:-1]])[: len(order)]
        here = np.empty(len(full), np.int64)
        here[order] = mine[order][head][np.cumsum(head) - 1] if len(order) else here[order]
        marks = np.zeros(len(words.begins), bool)
        marks[full[np.minimum(least, here) < mine]] = True
        gone = blocks.spread(marks, window)
        data = words.block.data.tobytes()
        kept, removed, spans = [], [], []
        for i, (a, n) in enumerate(zip(words.first.tolist(), words.count.tolist(), strict=True)):
            own = gone[a : a + n]
            k = int(own.sum())
            removed.append(k)
            text = data[words.block.starts[i] : words.block.ends[i]].split()
            kept.append(b" ".join(text if not k else [text[j] for j in np.flatnonzero(~own).tolist()]).decode())
            begins, ends = blocks.runs(own) if k else ((), ())
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(begins, ends, strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": words.block.ids, "n_words": pa.array(words.count), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, kind)})

    return remove


def substring_dedup(docs: DataFrame, window: int = WINDOW, block_bytes: int = blocks.BLOCK_BYTES, probes_each: int = PROBES_EACH, windows_each: int = WINDOWS_EACH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): the words left of each text, and the word spans removed.

    A word goes if a window of `window` words over it also starts in a document with a smaller id. Null
    texts have no words. Rows with equal ids are one document in this: they take nothing from each other.
    A document without an id comes after all others. An empty table gives an empty table; other columns
    are not read. Windows are compared by 64-bit fingerprints of their words.
    """
    texts, size = blocks.in_blocks(docs, block_bytes=block_bytes)
    words = size // 6 + 1
    buckets = common.pieces_for(words, probes_each)
    window_buckets = common.pieces_for(words // 2, windows_each)
    asked = texts.groupBy("block").applyInArrow(_ask(window, buckets), "bucket long, block long, indexed boolean, names binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "block long, bucket long, hit binary, shared binary")
    extended = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_extend(window, buckets, window_buckets), "bucket long, block long, prints binary, docs binary, place binary")
    found = extended.groupBy("bucket").applyInArrow(_earliest, "block long, prints binary, docs binary")
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_remove(window), RESULT)
