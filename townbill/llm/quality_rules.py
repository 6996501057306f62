"""Quality by the log-likelihood ratio of hashed word n-grams, after plain rules.

Only DataFrame functions. The words and word pairs of all documents are hashed to a fixed number of
slots and counted twice, over all documents (the raw corpus) and over the trusted ones (the target).
With additive smoothing the counts are two multinomials; a document's score is the mean over its words
and pairs of log target / raw. Each document is judged by its own score against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townbill.llm import common

SLOTS = 1 << 15
SYMBOLS = "#*$%&|<>"
WINDOW = 8
THRESHOLD = -0.08
NO_PLACES = "array<int>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _windows(words: Column, n: int) -> Column:
    """Hashes of all windows of n words, in order."""
    last = F.size(words) - n
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast(NO_PLACES))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(at, lambda i: F.xxhash64(F.slice(h, i + 1, n))))


def _covered(hashes: Column, n: int) -> Column:
    """Words in windows whose hash occurs twice or more: the windows are sorted by hash, those with an
    equal neighbour go back to the order of their places, and each covers the words up to the next."""

    def places(pairs: Column) -> Column:
        twin = lambda p, k: F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(pairs, twin), lambda p: p["i"]))

    def spans(at: Column) -> Column:
        new = F.transform(at, lambda i, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - i, F.lit(n))))
        return F.aggregate(new, F.lit(0), lambda s, x: s + x)

    return _let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda p: _let(places(p), spans))


def repeat_words(words: Column, n: int = WINDOW) -> Column:
    """Number of words in n-word windows found twice or more in the text, the first included."""
    return _let(_windows(words, n), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, n)))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(common.WORD))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def slots(words: Column) -> Column:
    """Slots of the words and of the pairs of neighbouring words."""
    of = lambda *x: F.pmod(F.xxhash64(*x), F.lit(SLOTS)).cast("int")

    def both(h: Column) -> Column:
        pairs = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.when(b.isNotNull(), of(a, b)))
        return F.concat(F.transform(h, lambda x: of(x)), F.filter(pairs, lambda x: x.isNotNull()))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), both)


def weights(docs: DataFrame, trusted: DataFrame, smooth: float = 1.0) -> DataFrame:
    """(slot, weight): log of target over raw probability of each slot; SLOTS rows whatever the input.

    `trusted` holds the doc_ids of the target. Counts combine by slot before the exchange;
    texts meet the ids by a sorted join at every size. Slots that no
    document has are missing; without trusted documents all weights follow from the smoothing.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("trusted", F.lit(1))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(ids.hint("merge"), "doc_id", "left")
    seen = rows.select("trusted", F.explode(slots(words_of(F.col("text")))).alias("slot"))
    counts = seen.groupBy("slot").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    both = common.stored(counts, "slots")
    raw, target = both.agg(F.sum("raw"), F.sum("target")).first()
    size = smooth * SLOTS
    share = lambda c, total: (F.col(c) + F.lit(smooth)) / F.lit(float((total or 0) + size))
    return both.select("slot", F.log(share("target", target) / share("raw", raw)).alias("weight"))


def judge(docs: DataFrame, slot_weights: DataFrame, threshold: float = THRESHOLD, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept.

    A null or empty text has zeros and fails by its words. Repeated and null ids keep their own rows.
    `slot_weights` has at most SLOTS rows and is broadcast.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    words = words_of(F.col("text"))
    base = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"), slots(w).alias("slots")))
    told = rows.select(
        "row", "doc_id", F.explode(F.array(base)).alias("b"),
        F.length(F.translate("text", common.SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(F.col("text")).cast("long").alias("n_dup_lines"),
    )
    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    told = told.select("row", "doc_id", "b.n_words", "word_chars", "n_symbols", "n_dup_lines", "b.n_repeat_words", "b.slots")
    # the rows of a document are in one task, which adds them up before the exchange
    each = told.select("row", *own, F.explode_outer("slots").alias("slot")).join(F.broadcast(slot_weights), "slot", "left")
    summed = each.groupBy("row", *own).agg(F.avg(F.coalesce("weight", F.lit(0.0))).alias("score")).drop("row")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return summed.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
