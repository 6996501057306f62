"""Benchmark decontamination with suffix arrays of the training texts.

Words are 64-bit hashes of their bytes. Training texts are read in shards of bounded size; a shard's
suffix array holds its suffixes by word, as far as the first two words of each also start a test suffix,
which any match needs. Every test suffix is searched in it: each word narrows its range of the array by
one binary search, all test suffixes at a time. A range that is left after a whole window holds the
places where the window occurs; followed further, it gives the longest verbatim match.

Test texts go to all tasks in chunks of at most CHUNK_WORDS words; a benchmark of more words takes one
pass over the documents a chunk. Documents are not shuffled, and keep their order and all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from townbill.llm import common
from townbill.llm.blocks import ODD, U64, Fingerprints, mixed, runs

WINDOW = 10
SHARD_BYTES = 2 << 20
PIECE_WORDS = 1 << 16
CHUNK_WORDS = 1 << 20
STRETCH_BYTES = 4 << 20
#: spaces and the like are 0, A-Z count as a-z
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of texts that lie end to end, never 0, and the number of words of each text."""
    inside = _IN_WORD[data]
    if not len(data) or not inside.any():
        return np.zeros(0, U64), np.zeros(len(ends), np.int64)
    before = np.concatenate([[False], inside[:-1]])
    cuts = ends[ends < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    after[cuts[cuts > 0] - 1] = False
    stops = np.flatnonzero(inside & ~after) + 1
    h = np.zeros(len(starts), U64)
    at = 0
    while at < len(starts):
        # a stretch of words at a time, as a fingerprint takes many times the bytes of its text
        stop = max(at + 1, int(np.searchsorted(stops, starts[at] + STRETCH_BYTES, "right")))
        base = int(starts[at])
        h[at:stop] = Fingerprints.of_bytes(_LOWER[data[base : int(stops[stop - 1])]]).at(starts[at:stop] - base, stops[at:stop] - starts[at:stop])
        at = stop
    upto = np.searchsorted(starts, ends)
    return np.where(h == 0, U64(1), h), np.diff(upto, prepend=0)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end and where each ends; nulls are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at[1:] - at[0]


def _pieces(window: int, piece_words: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only("powers")
        for batch in common.slices(batches, 100):
            h, n = word_hashes(*_bytes_of(batch.column("text")))
            out: list[tuple[str, int, bytes]] = []
            for item, end, k in zip(batch.column("item_id").to_pylist(), np.cumsum(n).tolist(), n.tolist(), strict=True):
                own, width = h[end - k : end], min(window, k)
                # neighbours share all words of a window but one, so each window lies in one of them
                for at in range(0, max(k - width, 0) + 1 if k else 0, piece_words):
                    out.append((item, width, own[at : at + piece_words + width - 1].tobytes()))
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([x[0] for x in out], pa.string()), "width": pa.array([x[1] for x in out], pa.int32()), "words": pa.array([x[2] for x in out], pa.binary())})

    return pieces


class Tests:
    """Test texts end to end, a 0 after each, with what their suffixes start with."""

    def __init__(self, rows: list):
        self.names = sorted({r["item_id"] for r in rows})
        number = {name: k for k, name in enumerate(self.names)}
        own = [np.frombuffer(r["words"], U64) for r in rows]
        self.words = np.concatenate([x for w in own for x in (w, np.zeros(1, U64))]) if own else np.zeros(0, U64)
        sizes = np.array([len(w) for w in own], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        count = sizes - np.array([r["width"] for r in rows], np.int64) + 1
        self.item = np.repeat(np.array([number[r["item_id"]] for r in rows], np.int64), count)
        self.width = np.repeat(np.array([r["width"] for r in rows], np.int64), count)
        self.suffix = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        slots = 1 << max(16, min(24, int(8 * len(self.suffix)).bit_length()))
        self.mask = U64(slots - 1)
        self.ones, self.twos = np.zeros(slots, bool), np.zeros(slots, bool)
        first = self.words[self.suffix]
        self.ones[(first & self.mask)[self.width == 1]] = True
        two = self.suffix[self.width > 1]
        self.twos[_two(self.words[two], self.words[two + 1]) & self.mask] = True

    def starts(self, words: np.ndarray) -> np.ndarray:
        """Places whose first words may start a test suffix; the others surely do not."""
        out = np.zeros(len(words), bool)
        out[:-1] = self.twos[_two(words[:-1], words[1:]) & self.mask]
        return np.flatnonzero((out | self.ones[words & self.mask]) & (words != 0))


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * U64(ODD) + b)


class SuffixArray:
    """The suffixes at the given places in the order of their words, as deep as anyone asks."""

    def __init__(self, words: np.ndarray, places: np.ndarray, depth: int):
        self.words = np.concatenate([words, np.zeros(depth, U64)])
        self.depth = depth
        self.places = places
        self.sorted_to = 0
        self._sort(np.zeros(len(places), np.int64), np.arange(len(places)))

    def _sort(self, group: np.ndarray, slots: np.ndarray) -> None:
        """Orders the suffixes in `slots`, whose words so far are equal within a group, by the next words."""
        own = self.places[slots]
        last = len(self.words) - 1
        keys = [self.words[np.minimum(own + at, last)] for at in range(self.sorted_to, self.sorted_to + self.depth)]
        self.places[slots] = own[np.lexsort([*keys[::-1], group])]

    def deeper(self, low: np.ndarray, high: np.ndarray) -> None:
        """Sorts `depth` words further within the given ranges, which are equal or apart."""
        self.sorted_to += self.depth
        begin, end = np.divmod(np.unique(low * (len(self.places) + 1) + high), len(self.places) + 1)
        group = np.repeat(np.arange(len(begin)), end - begin)
        slots = np.repeat(begin - (np.cumsum(end - begin) - (end - begin)), end - begin) + np.arange(len(group))
        self._sort(group, slots)

    def bound(self, at: int, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
        """Binary search, for all ranges at a time, of the word that is wanted at a distance."""
        low, high = low.copy(), high.copy()
        last = len(self.words) - 1
        while True:
            wide = np.flatnonzero(low < high)
            if not len(wide):
                return low
            middle = (low[wide] + high[wide]) >> 1
            here = self.words[np.minimum(self.places[middle] + at, last)]
            ahead = here <= wanted[wide] if right else here < wanted[wide]
            low[wide] = np.where(ahead, middle + 1, low[wide])
            high[wide] = np.where(ahead, high[wide], middle)

    def inside(self, pairs: np.ndarray) -> np.ndarray:
        """The places in ranges, which are given as one number each."""
        begin, end = np.divmod(pairs, len(self.places) + 1)
        return self.places[np.repeat(begin - (np.cumsum(end - begin) - (end - begin)), end - begin) + np.arange(int((end - begin).sum()))]


def search(words: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words hit, the longest match that starts at each, and (places, items) of each range that a window has."""
    change, longest = np.zeros(len(words) + 1, np.int32), np.zeros(len(words), np.int64)
    array = SuffixArray(words, tests.starts(words), WINDOW)
    alive = np.arange(len(tests.suffix))
    low, high = np.zeros(len(alive), np.int64), np.full(len(alive), len(array.places), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while len(alive):
        if at == array.sorted_to + array.depth:
            array.deeper(low, high)
        wanted = tests.words[tests.suffix[alive] + at]
        low, high = array.bound(at, low, high, wanted, False), array.bound(at, low, high, wanted, True)
        left = (low < high) & (wanted != 0)
        alive, low, high = alive[left], low[left], high[left]
        at += 1
        ranges = low * (len(array.places) + 1) + high
        longest[array.inside(np.unique(ranges[tests.width[alive] <= at]))] = at
        whole = tests.width[alive] == at
        if whole.any():
            order = np.argsort(ranges[whole], kind="stable")
            own, items = ranges[whole][order], tests.item[alive[whole]][order]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            for a, z in zip(heads.tolist(), [*heads[1:].tolist(), len(own)], strict=True):
                found.append((array.inside(own[a : a + 1]), items[a:z]))
            # ranges of one depth are apart, so no place comes twice
            places = array.inside(own[heads])
            change[places] += 1
            np.subtract.at(change, places + at, 1)
    return np.cumsum(change[:-1]) > 0, longest, found


def _judge(sent, shard_bytes: int, with_text: bool):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only("powers")
        tests: Tests = sent.value
        names = np.array(tests.names, object)
        for batch in batches:
            for shard in _shards(batch, shard_bytes):
                h, n = word_hashes(*_bytes_of(shard.column("text")))
                # a 0 after each text keeps matches inside it
                begin = np.cumsum(n + 1) - n - 1
                words = np.zeros(int((n + 1).sum()), U64)
                words[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
                hit, longest, found = search(words, tests)
                items: dict[int, set[int]] = {}
                for places, own in found:
                    for d in np.unique(np.searchsorted(begin, places, "right") - 1).tolist():
                        items.setdefault(d, set()).update(own.tolist())
                begins, ends = runs(hit)
                doc = np.searchsorted(begin, begins, "right") - 1
                spans: list[list] = [[] for _ in range(len(n))]
                for d, a, z in zip(doc.tolist(), begins.tolist(), ends.tolist(), strict=True):
                    spans[d].append({"start": a - int(begin[d]), "end": z - int(begin[d])})
                most = np.maximum.reduceat(longest, begin) if len(n) else longest
                columns = {"row": shard.column("row")} | ({"text": shard.column("text")} if with_text else {})
                columns |= {"n_words": pa.array(n), "longest": pa.array(most)}
                columns["spans"] = pa.array(spans, SPANS)
                columns["items"] = pa.array([names[sorted(items[d])].tolist() if d in items else [] for d in range(len(n))], pa.list_(pa.string()))
                yield pa.RecordBatch.from_pydict(columns)

    return judge


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _shards(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about so many bytes of text, one row at least."""
    _, ends = _bytes_of(batch.column("text"))
    at, base = 0, 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, stop - at)
        at, base = stop, int(ends[stop - 1])


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(row, n_words, longest, spans, items) of every document; `row` holds the columns in `keep`.

    Words are runs of digits, a-z in either case and characters past ASCII. A test text's windows are its
    runs of `window` words, or all its words if it has fewer. `spans` are the runs of document words that
    any occurrence of a window covers, `items` the ids (item_id as text, null as empty) of the test texts
    with an occurring window, each once and in order, `longest` the most words in a row, from a window
    on, that the document has in common with a test text, 0 if no window occurs; test texts are cut at
    PIECE_WORDS words and followed that far. Null and empty texts have no words, so a test text without
    any hits nothing; repeated rows are judged alike; an empty benchmark hits nothing.
    """
    tests = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item_id"), benchmark["text"].cast("string").alias("text"))
    pieces = common.stored(tests.mapInArrow(_pieces(window, min(PIECE_WORDS, chunk_words)), "item_id string, width int, words binary"), "tests")
    words = (pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // 8
    chunks = common.pieces_for(words, chunk_words)
    chunk = F.pmod(F.xxhash64("item_id", "words"), F.lit(chunks))
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].cast("string").alias("text"))
    for k in range(chunks):
        sent = docs.sparkSession.sparkContext.broadcast(Tests(pieces.where(chunk == k).collect()))
        more = k + 1 < chunks
        told = rows.mapInArrow(_judge(sent, shard_bytes, more), _schema(rows, more))
        if k:
            # what this chunk of the benchmark says, and what those before said, which is in `row`
            spans = merged(F.concat(F.col("row.spans"), F.col("spans")))
            both = [F.col("row.row"), F.col("row.n_words"), F.greatest("row.longest", "longest").alias("longest"), spans.alias("spans"), F.array_sort(F.array_union("row.items", "items")).alias("items")]
            told = told.select(*both, *(["text"] if more else []))
        if more:
            rows = common.stored(told, "judged").select(F.struct("row", "n_words", "longest", "spans", "items").alias("row"), "text")
    return told


def _schema(rows: DataFrame, with_text: bool) -> T.StructType:
    told = T.StructType([rows.schema["row"]])
    if with_text:
        told.add("text", "string")
    told.add("n_words", "long").add("longest", "long")
    told.add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
    return told.add("items", T.ArrayType(T.StringType()))


def merged(spans):
    """Spans in order, those that meet as one."""
    none = F.array().cast("array<struct<start:long,end:long>>")

    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last["end"] >= s["start"], F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, add)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no window of the benchmark occurs in, with all their columns."""
    told = contaminated(docs, benchmark, keep=tuple(docs.columns), **options)
    return told.where(F.size("spans") == 0).select("row.*")
