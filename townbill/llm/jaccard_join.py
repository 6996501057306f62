"""Jaccard self-join of word n-gram sets with adaptive multi-match prefixes.

The n-grams of a set are ordered by an estimate of how often all documents have them, rarest first. Two
sets that overlap by t share at least k n-grams among the first |x| - t + k of each. Every document
picks its own k: a longer prefix costs more index entries, but a partner has to share k of them, and by
Markov's bound no more than (entries of the prefix) / k documents do. A pair is verified if it shares as
many as the smaller of the two k.

Frequencies come from one fixed-size table of counters over all documents. Equal sets are one class.
Components do not need all pairs of a group: first each document is verified against the one document
of its prefix lists that it shares most with; after that only documents of different components are
paired, all of those that may be similar. So the links inside a component are not all found, and the
operator gives neither links nor their number per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townbill.llm import common
from townbill.llm.blocks import U64, Fingerprints, mixed
from townbill.llm.components import components

COUNTERS = 1 << 21
CHUNK = 1 << 15
MOST_MATCHES = 3
VERIFY_COST = 4.0
FILTER_BITS = 1 << 24
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _text_prints(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct fingerprints of its word n-grams, or of all its words if fewer."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    is_word = ~space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[0] = cut[-1] = True
    cut[ends] = True
    begin = is_word.copy()
    begin[1:] &= ~is_word[:-1] | cut[1:-1]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:] | cut[1:-1]
    begins, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
    words = Fingerprints.of_bytes(data).at(begins, stops - begins) if len(begins) else np.zeros(0, U64)
    prints = Fingerprints(words)
    doc = np.searchsorted(ends, begins, "right")
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    out = []
    for a, c in zip(first.tolist(), count.tolist(), strict=True):
        if c == 0:
            out.append(np.zeros(0, U64))
        elif c < n:  # told from n-grams by its length
            out.append(mixed(prints.at(np.array([a]), c) + U64(c)))
        else:
            out.append(np.unique(prints.at(np.arange(a, a + c - n + 1), n)))
    return out


def sets_of(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Sets of whole texts, lower-casing A-Z, a bounded number of bytes at a time."""
    own: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode().translate(UPPER)
        if own and size + len(raw) > 1 << 20:
            yield from _text_prints(own, n)
            own, size = [], 0
        own.append(raw)
        size += len(raw)
    if own:
        yield from _text_prints(own, n)


def overlap_for(a: Column, b: Column, percent: int) -> Column:
    """Smallest overlap with 100 * overlap >= percent * union, for sets of a and b."""
    total = 100 + percent
    return F.floor((percent * (a + b) + total - 1) / total).cast("long")


def _needed(size: int, percent: int) -> int:
    """Smallest overlap with any set that a set of `size` can be linked with."""
    return -(-percent * size // 100)


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """Counters of how many documents have each n-gram, by hash; a fixed-size table over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only("powers")
        seen = np.zeros(COUNTERS, np.int32)
        for batch in common.slices(batches):
            for own in sets_of(batch.column(0).to_pylist(), n):
                np.add.at(seen, (own % U64(COUNTERS)).astype(np.int64), 1)
        parts = seen.reshape(-1, CHUNK)
        some = np.flatnonzero(parts.any(axis=1))
        # most counters of a task are small: each part goes in the narrowest type that holds it
        made = [parts[i].astype(np.min_scalar_type(parts[i].max())).tobytes() for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(made, pa.binary())], names=["part", "seen"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in table.column("seen").to_pylist():
            total += np.frombuffer(x, f"u{len(x) // CHUNK}")
        return pa.table({"part": [key[0].as_py()], "seen": pa.array([np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "part long, seen binary").groupBy("part").applyInArrow(add, "part long, seen binary")
    out = np.zeros(COUNTERS, np.int32)
    for row in parts.collect():
        out[row["part"] * CHUNK : (row["part"] + 1) * CHUNK] = np.frombuffer(row["seen"], np.int32)
    return out


def choose_matches(cost: np.ndarray, base: int, size: int) -> int:
    """How many prefix n-grams a partner must share: the cheapest by scanned entries and verifications.

    `cost`: estimated documents per n-gram in order; `base`: length of the prefix for one match.
    """
    best, least = 1, np.inf
    for k in range(1, MOST_MATCHES + 1):
        length = base + k - 1
        if length > size:
            break
        entries = float(cost[:length].sum())
        total = entries + VERIFY_COST * entries / k
        if total < least:
            best, least = k, total
    return best


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, cls, matches, prefix) of each row: the class of its set, how many
    matches it asks for and its prefix in order."""
    seen = docs.sparkSession.sparkContext.broadcast(frequencies(docs, n))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only("powers")
        often = seen.value
        for batch in common.slices(batches):
            sizes, classes, matches, prefixes = [], [], [], []
            for own in sets_of(batch.column("text").to_pylist(), n):
                size = len(own)
                sizes.append(size)
                classes.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True))
                f = often[(own % U64(COUNTERS)).astype(np.int64)]
                base = size - _needed(size, percent) + 1
                order = np.lexsort((own, f))[: base + MOST_MATCHES] if size else np.zeros(0, int)
                k = choose_matches(f[order], base, size) if size else 1
                matches.append(k)
                prefixes.append(own[order[: base + k - 1]].view(np.int64))
            at = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]), pa.int32())
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
            made = [pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(matches, pa.int32()), pa.ListArray.from_arrays(at, flat)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made], names=["doc_id", "text_hash", "n_shingles", "cls", "matches", "prefix"])

    return docs.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, cls long, matches int, prefix array<long>")


def _may_link(a: str, b: str, percent: int) -> Column:
    """For a shared prefix n-gram: sizes fit, and it may be among the first `matches` shared ones of a
    pair that overlaps enough."""
    col = lambda side, name: F.col(f"{side}.{name}")
    sizes = (100 * F.least(col(a, "size"), col(b, "size")) >= percent * F.greatest(col(a, "size"), col(b, "size")))
    rest = F.least(col(a, "size") - col(a, "pos"), col(b, "size") - col(b, "pos")) + F.least(col(a, "matches"), col(b, "matches")) - 1
    return sizes & (F.least(rest, col(a, "reach"), col(b, "reach")) >= overlap_for(col(a, "size"), col(b, "size"), percent))


def _perhaps(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `docs`, and in `perhaps` whether their text may be wanted: true for all that are and some others; nothing is shuffled.

    One bit per slot of hashes, 64 to a row: the broadcast side has FILTER_BITS / 64 rows at most.
    """
    slot = lambda h: F.pmod(h, F.lit(FILTER_BITS))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), slot(h).bitwiseAND(F.lit(63)).cast("int"))
    group = lambda h: F.shiftright(slot(h), 6)
    bits = wanted.groupBy(group(F.col("r_hash")).alias("bit_group")).agg(F.bit_or(bit(F.col("r_hash"))).alias("bits"))
    found = docs.withColumn("bit_group", group(F.col("text_hash"))).join(F.broadcast(bits), "bit_group", "left")
    return found.withColumn("perhaps", F.coalesce(F.col("bits").bitwiseAND(bit(F.col("text_hash"))) != 0, F.lit(False))).drop("bit_group", "bits")


def verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of classes that are links, judged on their whole sets."""
    wanted = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select("b")).distinct().join(reps, "cls").select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), "cls")
    wanted = common.stored(wanted, "wanted")
    # the same join at every size, so that shuffles grow with the input
    texts = _perhaps(docs, wanted).where("perhaps").join(wanted.hint("merge"), (F.col("text_hash") == F.col("r_hash")) & F.col("doc_id").eqNullSafe(F.col("r_id")))
    # the texts of the pairs only, once each
    texts = common.stored(texts.groupBy("cls").agg(F.any_value("text").alias("text")), "texts")
    with_a = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only("powers")
        for batch in common.slices(batches):
            good = []
            for x, y in zip(sets_of(batch.column(2).to_pylist(), n), sets_of(batch.column(3).to_pylist(), n), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return common.stored(both.mapInArrow(judge, "a long, b long").distinct(), "links")


def _components_of(signed: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(cls, component_id, head): the component of each class, and the text that stands for it."""
    some = signed.where("n_shingles > 0")
    reps = common.stored(
        some.groupBy("cls").agg(F.min("doc_id").alias("first"), F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("rep")).select("cls", "first", "rep.doc_id", "rep.text_hash"),
        "classes",
    )
    # the rows of a class have the same set, and so the same prefix
    one = some.groupBy("cls").agg(F.any_value("n_shingles").alias("size"), F.any_value("matches").alias("matches"), F.any_value("prefix").alias("prefix"))
    entries = one.select("cls", "size", "matches", F.posexplode("prefix").alias("pos", "gram"))
    # grams of one list only are met by nobody; those before a shared gram are surely not in the partner, as
    # the order would put them into its prefix too. `reach` is the overlap that is left at a gram
    lists = entries.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    alive = F.row_number().over(Window.partitionBy("cls").orderBy("pos"))
    live = entries.join(lists.select("gram"), "gram").withColumn("reach", F.col("size") - F.col("pos") + alive - 1)
    live = common.stored(live.where(100 * F.col("reach") >= percent * F.col("size")), "prefixes")
    # the head of a list is the document with the fewest grams before: the least edited of a group of copies
    heads = live.groupBy("gram").agg(F.min(F.struct("pos", F.xxhash64("cls").alias("h"), "cls", "size", "matches", "reach")).alias("head"))
    own = F.struct("cls", "size", "pos", "matches", "reach").alias("e")
    star = live.select("gram", own).join(heads, "gram").where(F.col("e.cls") != F.col("head.cls")).where(_may_link("e", "head", percent))
    shared = star.groupBy(F.col("e.cls").alias("a"), F.col("head.cls").alias("b")).agg(F.count("*").alias("n"))
    best = shared.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    links = verify(common.stored(best, "pairs"), reps, rows, n, percent)
    groups = components(links)

    known = common.stored(live.join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "prefixes")
    x, y = known.alias("x"), known.alias("y")
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.component") != F.col("y.component")) & _may_link("x", "y", percent))
    pairs = met.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(F.count("*").alias("n"), F.max(F.least("x.matches", "y.matches")).alias("k")).where("n >= k").select("a", "b")
    more = verify(common.stored(pairs, "pairs"), reps, rows, n, percent)
    groups = components(links.unionAll(more))

    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    named = common.stored(reps.select("cls", "first", first.alias("rep")).join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "first", "rep", F.coalesce("component", "cls").alias("component")), "components")
    named = common.stored(named.join(named.groupBy("component").agg(F.min("first").alias("component_id"), F.min("rep").alias("head")), "component").select("cls", "component_id", "head"), "heads", leaves=True)
    return named


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, stays), one row per row of `docs`.

    `stays` marks one text of each component: that of its smallest id, then of its smallest hash.

    Null texts and those without words have an empty set and link with nothing; their component is their
    own id. Rows with equal ids are documents of their own. A component of rows without an id has none.
    An empty table gives an empty table; other columns are not read. N-grams are compared by 64-bit
    fingerprints of their words.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("text_hash"))
    signed = common.stored(signatures(rows, n, percent), "signatures")
    with common.scratch(docs.sparkSession):
        named = _components_of(signed, rows, n, percent)
    some = signed.where("n_shingles > 0")
    stays = F.col("text_hash").eqNullSafe(F.col("head.text_hash")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id"))
    linked = some.join(named, "cls").select("doc_id", "text_hash", "n_shingles", "component_id", stays.alias("stays"))
    alone = signed.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return linked.unionAll(alone)


def keep_one(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of `docs` with one document left of each component, and all that have no words.

    Where the same row stands more than once, it stays once.
    """
    own = docs.columns
    with common.scratch(docs.sparkSession):
        told = jaccard_components(docs, n, percent).groupBy(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"))
        told = told.agg(F.max("n_shingles").alias("n_shingles"), F.count("*").alias("times"), F.bool_or("stays").alias("stays"))
        # what goes, or stands more than once; all other rows stay, and need not be moved to find that out
        told = common.stored(told.where(~F.col("stays") | ((F.col("times") > 1) & (F.col("n_shingles") > 0))).select("r_id", "r_hash", "stays"), "told", leaves=True)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), F.struct(*[docs[c] for c in own]).alias("row"))
    rows = _perhaps(rows, told)
    met = rows.where("perhaps").join(told.hint("merge"), (F.col("text_hash") == F.col("r_hash")) & F.col("doc_id").eqNullSafe(F.col("r_id")), "left")
    once = met.where("stays").groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))
    return rows.where(~F.col("perhaps")).select("row").unionAll(met.where(F.col("stays").isNull()).select("row")).unionAll(once.select("row")).select("row.*")
