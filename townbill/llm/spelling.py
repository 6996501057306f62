"""Spelling variants by edits that Bloom filters let through.

The vocabulary is in shards by length, large lengths split further by hash. Each shard is a blocked Bloom
filter: a word sets one bit in each of the eight numbers of one block of 64 bytes. The filters are sent
to all tasks, in rounds of at most ROUND_BYTES, so that their size has a bound and their rate of false
positives does not change as the vocabulary grows.

A task makes all edits of its words as hashes, without their texts: a word's hash is the exclusive or of
one number per place and letter, so an edit's follows from a few of them. Of two near words of one length
the one with the larger letter makes the edit, of two lengths the longer one, so a pair comes up once.
Only edits that a filter lets through become texts and are shuffled, to the exact join with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townbill.llm import common
from townbill.llm.blocks import ODD, U64, mixed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
CLASSES = 64
SHARD_WORDS = 1 << 14
BITS_EACH = 16
ROUND_BYTES = 32 << 20
BATCH_LETTERS = 200_000


def runs(docs: DataFrame, least: int = LEAST_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run): every maximal run of at least `least` letters of every text, lower-cased in A-Z only.

    Null texts have none; ids go along as they are.
    """
    text = F.translate(docs[text_col], UPPER, LOWER)
    return docs.select(docs[id_col].alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(f"{LETTER}{{{least},}}"), F.lit(0))).alias("run"))


def without(word: Column, at: Column) -> Column:
    """The word without its letter at a place, counted from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough, as a stored table; nulls are no words."""
    counts = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return common.stored(counts.where(F.col("n") >= least_count), "vocabulary")


@dataclass
class Layout:
    """Which shard, and which block in all filters end to end, holds a word's bits."""

    parts: np.ndarray
    blocks: np.ndarray
    first_shard: np.ndarray
    first_block: np.ndarray

    @staticmethod
    def of(sizes: dict[int, int], shard_words: int = SHARD_WORDS) -> Layout:
        count = np.array([sizes.get(c, 0) for c in range(CLASSES + 1)], np.int64)
        parts = -(-count // shard_words)
        blocks = np.where(count > 0, -(-count * BITS_EACH // (np.maximum(parts, 1) * 512)) + 1, 0)
        return Layout(parts.astype(U64), blocks.astype(U64), np.cumsum(parts) - parts, (np.cumsum(parts * blocks) - parts * blocks).astype(np.int64))

    def shards(self) -> list[tuple[int, int, int]]:
        """(shard, first block, blocks) in order."""
        out = []
        for c in np.flatnonzero(self.parts):
            for k in range(int(self.parts[c])):
                out.append((int(self.first_shard[c]) + k, int(self.first_block[c]) + k * int(self.blocks[c]), int(self.blocks[c])))
        return out

    def rounds(self, most: int) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = []
        room = 0
        for shard in self.shards():
            size = shard[2] * 64
            if size > room:
                out.append([])
                room = max(most, size)
            out[-1].append(shard)
            room -= size
        return out

    def part(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((h >> U64(32)) * self.parts[c] >> U64(32)).astype(np.int64)

    def block(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Among all blocks; a length that no word has, has none (-1)."""
        inside = ((h & U64(0xFFFFFFFF)) * self.blocks[c] >> U64(32)).astype(np.int64)
        return np.where(self.parts[c] > 0, self.first_block[c] + self.part(h, c) * self.blocks[c].astype(np.int64) + inside, -1)


def _number(at: np.ndarray, letter: np.ndarray | int) -> np.ndarray:
    """The number of a letter at a place."""
    return mixed(at.astype(U64) * U64(ODD) + np.asarray(letter).astype(U64) * U64(0xC2B2AE3D27D4EB4F) + U64(1))


def _bit(h: np.ndarray, k: int) -> np.ndarray:
    """The bit that a hash sets in the k-th number of its block."""
    return U64(1) << ((h * U64(0xFF51AFD7ED558CCD)) >> U64(6 * k + 10) & U64(63))


class Letters:
    """Some words end to end as code points, with what their hashes and those of their edits need."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.word = np.repeat(np.arange(len(words)), self.lengths)
        self.at = np.arange(len(self.codes)) - self.starts[self.word]
        self.own = _number(self.at, self.codes)
        self.upto = np.concatenate([np.zeros(1, U64), np.bitwise_xor.accumulate(self.own)])
        self.hash = self.upto[self.starts + self.lengths] ^ self.upto[self.starts]

    def classes(self, less: int = 0) -> np.ndarray:
        return np.minimum(self.lengths - less, CLASSES)

    def shorter(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places whose letter is deleted, each different result once, and the results' hashes."""
        moved = np.concatenate([np.zeros(1, U64), np.bitwise_xor.accumulate(np.where(self.at > 0, _number(self.at - 1, self.codes), U64(0)))])
        first = np.ones(len(self.codes), bool)
        first[1:] = (self.codes[1:] != self.codes[:-1]) | (self.at[1:] == 0)
        i = np.flatnonzero(first & (self.lengths[self.word] > least))
        begin = self.starts[self.word[i]]
        end = begin + self.lengths[self.word[i]]
        return i, self.upto[i] ^ self.upto[begin] ^ moved[end] ^ moved[i + 1]

    def replaced(self, letter: int) -> tuple[np.ndarray, np.ndarray]:
        """Places with a larger letter, and the hashes with `letter` there."""
        i = np.flatnonzero(self.codes > letter)
        table = _number(np.arange(int(self.lengths.max(initial=0))), letter)
        return i, self.hash[self.word[i]] ^ self.own[i] ^ table[self.at[i]]


def _in_letters(batches: Iterator[pa.RecordBatch], most: int = BATCH_LETTERS) -> Iterator[tuple[list[str], list[int]]]:
    for batch in batches:
        words, counts, size = [], [], 0
        for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            words.append(w)
            counts.append(n)
            size += len(w)
            if size >= most:
                yield words, counts
                words, counts, size = [], [], 0
        if words:
            yield words, counts


def _hashes(layout: Layout):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only()
        for words, _ in _in_letters(batches):
            letters = Letters(words)
            c = letters.classes()
            shard = layout.first_shard[c] + layout.part(letters.hash, c)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard), "block": pa.array(layout.block(letters.hash, c)), "hash": pa.array(letters.hash.view(np.int64))})

    return hashes


def _filter(first_blocks: dict[int, tuple[int, int]]):
    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        common.keep_only()
        shard = key[0].as_py()
        first, n = first_blocks[shard]
        bits = np.zeros(n * 8, U64)
        block = table.column("block").to_numpy() - first
        h = table.column("hash").to_numpy().view(U64)
        for k in range(8):
            np.bitwise_or.at(bits, block * 8 + k, _bit(h, k))
        return pa.table({"shard": pa.array([shard], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    return build


def _probe(layout: Layout, first: int, sent, alphabet: list[int], least: int):
    def let_through(bits: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Which hashes have all their bits in this round's filters."""
        block = layout.block(h, c) - first
        left = np.flatnonzero((block >= 0) & (block * 8 < len(bits)) & (layout.parts[c] > 0))
        for k in range(8):
            bit = _bit(h[left], k)
            left = left[bits[block[left] * 8 + k] & bit == bit]
        return left

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only()
        bits = np.frombuffer(sent.value, U64)
        for words, counts in _in_letters(batches):
            letters = Letters(words)
            edits, by = [], []
            i, h = letters.shorter(least)
            c = letters.classes(1)[letters.word[i]]
            for k in i[let_through(bits, h, c)].tolist():
                own, at = int(letters.word[k]), int(letters.at[k])
                edits.append(words[own][:at] + words[own][at + 1 :])
                by.append(own)
            classes = letters.classes()
            for letter in alphabet:
                i, h = letters.replaced(letter)
                for k in i[let_through(bits, h, classes[letters.word[i]])].tolist():
                    own, at = int(letters.word[k]), int(letters.at[k])
                    edits.append(words[own][:at] + chr(letter) + words[own][at + 1 :])
                    by.append(own)
            yield pa.RecordBatch.from_pydict({"edit": pa.array(edits, pa.string()), "word": pa.array([words[k] for k in by], pa.string()), "n": pa.array([counts[k] for k in by], pa.int64())})

    return probe


def near_pairs(words: DataFrame, least_length: int = LEAST_LENGTH, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(a, n_a, b, n_b): the pairs of words of a stored vocabulary (word, n) that one edit tells apart, each once."""
    spark = words.sparkSession
    class_of = F.least(F.length("word"), F.lit(CLASSES))
    layout = Layout.of({r["c"]: r["count"] for r in words.groupBy(class_of.alias("c")).count().collect()}, shard_words)
    # no more letters than there are code points
    alphabet = sorted(ord(r["letter"]) for r in words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").distinct().collect())
    places = {s: (first, n) for s, first, n in layout.shards()}
    filters = common.stored(words.mapInArrow(_hashes(layout), "shard long, block long, hash long").groupBy("shard").applyInArrow(_filter(places), "shard long, bits binary"), "filters")
    tried = [words.where(F.lit(False)).select(F.col("word").alias("edit"), "word", "n")]
    for shards in layout.rounds(round_bytes):
        low, high = shards[0][0], shards[-1][0]
        rows = filters.where(F.col("shard").between(low, high)).orderBy("shard").collect()
        sent = spark.sparkContext.broadcast(b"".join(r["bits"] for r in rows))
        tried.append(common.stored(words.mapInArrow(_probe(layout, shards[0][1], sent, alphabet, least_length), "edit string, word string, n long"), "edits"))
        sent.destroy()
    edits = tried[0]
    for one in tried[1:]:
        edits = edits.unionByName(one)
    known = words.select(F.col("word").alias("edit"), F.col("n").alias("n_b"))
    return edits.join(known, "edit").select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("edit").alias("b"), "n_b")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to.

    Every round doubles how far a link has been followed. A form is RATIO times as frequent as its word,
    so no chain is longer than a count has digits and a few rounds do.
    """
    reached = common.stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = common.stored(reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reached


def variants(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the column `word` that is long and frequent enough.

    Near words differ by one inserted, deleted or replaced code point. A word's form is its near word of
    largest n, of equal ones the first in code-point order, if that n is at least `ratio` times its own.
    Its root is where forms lead to, itself without one. Null words count nowhere; words of any length
    are compared whole; an empty table gives an empty table.
    """
    known = vocabulary(words, least_length, least_count)
    pairs = near_pairs(known, least_length, shard_words, round_bytes)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    sides = pairs.select(F.inline(both))
    best = sides.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    is_form = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    near = common.stored(best.select("word", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "near")
    led = near.join(roots(near.where("form IS NOT NULL")), "word", "left")
    return known.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
