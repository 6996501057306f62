"""Mixing sources to target weights without sorting documents.

Every document has a hash. Sizes are summed by source and hash bucket; the running sum over the buckets
of a source finds the one in which the budget ends, and only that bucket is summed again, by the next
bits of the hash, until all its bits are used. What remains is a threshold per source, and a filter. A
larger budget gives a larger threshold, so mixes of growing budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townbill.llm import common

BITS = 60
STEP = 12
#: up to so many sources, a table with a row for each is sent to all tasks
FEW = 10_000
SALTS = 64


def _beside(rows: DataFrame, by_source: DataFrame, few: int = FEW) -> DataFrame:
    """The rows with what a stored table holds for their source.

    Up to `few` sources, counted, the table is broadcast and no row moves. Beyond, every source has
    SALTS rows in it and a document looks for one of them by its hash, so that a large source is spread.
    """
    if by_source.count() <= few:
        return rows.join(F.broadcast(by_source), "key")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = rows.withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int"))
    return salted.join(by_source.withColumn("salt", salts), ["key", "salt"]).drop("salt")


def weight_of(rank: Column, weights: list[float]) -> Column:
    """Weights by place in the order of the sources, repeating."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources are ordered by code point, null last. `share` times all sizes is dealt by weight; a target
    above `most` times its source's size stops there and its excess is dealt again. A level L such that
    the sum of min(weight * L, most * size) is the budget says the same; it follows from the sources in
    the order of most * size / weight by running sums.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    filling = Window.orderBy("full", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = sizes.withColumn("rank", F.row_number().over(ordered)).withColumn("weight", weight_of(F.col("rank"), weights))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full", F.col("cap") / F.col("weight"))
    w = w.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    w = w.withColumn("capped", F.coalesce(F.sum("cap").over(filling), F.lit(0.0)))
    w = w.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0)))
    # the level, were this source the first that is not full; the smallest place where that holds is right
    w = w.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    w = w.withColumn("at", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "rank", "level"))).over(everything))
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("at.level")))
    return w.select("source", "source_size", target.alias("target"))


def _thresholds(rows: DataFrame, budgets: DataFrame, few: int = FEW) -> DataFrame:
    """(key, threshold): documents of a source with hash < threshold hold about its budget.

    `rows`: (key, hash, size); `budgets`: (key, budget), one row per source. Both are read once a level.
    Of the documents with the hash at which the budget ends all are taken or none, whichever is nearer.
    """
    state = common.stored(budgets.select("key", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("taken")), "state")
    for used in range(0, BITS, STEP):
        low = BITS - used - STEP
        part = F.shiftright(F.col("hash"), low)
        inside = _beside(rows, state.select("key", "prefix"), few) if used else rows.withColumn("prefix", F.lit(0).cast("long"))
        sums = inside.where(F.shiftright(part, STEP) == F.col("prefix")).groupBy("key", part.alias("bucket")).agg(F.sum("size").alias("size"))
        running = Window.partitionBy("key").orderBy("bucket")
        # at most 4096 rows per source: the first bucket in which the budget would be passed
        over = sums.withColumn("upto", F.sum("size").over(running)).join(state, "key").where(F.col("taken") + F.col("upto") > F.col("budget"))
        hit = over.groupBy("key").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "upto"), "bucket").alias("hit"))
        boundary = F.col("hit.bucket")
        if not low:
            nearer = F.col("taken") + F.col("hit.upto") - F.col("budget") < F.col("budget") - F.col("taken") - F.col("hit.before")
            boundary = boundary + nearer.cast("long")
        state = common.stored(
            state.join(hit, "key", "left").select(
                "key", "budget",
                # a source that is taken whole has no boundary: a prefix past all hashes of this level
                F.coalesce(boundary, F.shiftleft(F.col("prefix"), STEP) + (1 << STEP)).alias("prefix"),
                (F.col("taken") + F.coalesce(F.col("hit.before"), F.lit(0))).alias("taken"),
            ),
            "state",
        )
    return state.select("key", F.col("prefix").alias("threshold"))


def _key(source: Column) -> Column:
    """Tells a source from null and from the text of any other."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _hash(doc_id: Column, text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), doc_id.cast("long"), text), 64 - BITS)


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, key, hash, size) of every document, as a stored narrow table."""
    source = docs[source_col].cast("string")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), source.alias("source"), _key(source).alias("key"),
        _hash(docs[id_col], docs[text_col]).alias("hash"), common.n_words(text_col).alias("size"),
    )
    return common.stored(rows, "mix")


def plan(sizes: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, few: int = FEW) -> DataFrame:
    """(key, source_size, target, whole, threshold), one row per source: how often its documents are
    taken whole, and below which hash once more. A stored table, which stays within the caller's scope."""
    with common.scratch(sizes.sparkSession):
        return common.stored(_planned(sizes, weights, share, most, few), "plan", leaves=True)


def _planned(sizes: DataFrame, weights: list[float], share: float, most: float, few: int) -> DataFrame:
    by_source = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    goals = common.stored(targets(by_source, weights, share, most).withColumn("key", _key(F.col("source"))), "goals")
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    budgets = goals.select("key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    return goals.join(_thresholds(sizes, budgets, few), "key").select("key", "source_size", "target", "whole", "threshold")


def mix(sizes: DataFrame, by_source: DataFrame, most: float = 2.0, few: int = FEW) -> DataFrame:
    """Adds source_size, target and copies, how often the mix takes each document, to the rows of `sizes`.

    Null texts have size 0; null sources are a source of their own; equal rows are taken alike. An empty
    table gives an empty table.
    """
    copies = F.least(F.col("whole") + (F.col("hash") < F.col("threshold")).cast("long"), F.lit(int(most)))
    return _beside(sizes, by_source, few).withColumn("copies", copies).drop("whole", "threshold")


def take(docs: DataFrame, by_source: DataFrame, most: float = 2.0, few: int = FEW) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with their own columns only.

    Each row is judged by its source's threshold where it stands. Up to `few` sources no row moves; with
    more, rows are dealt by source and a salt from their hash.
    """
    own = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), _key(docs["source"].cast("string")).alias("key"), _hash(docs["doc_id"], docs["text"]).alias("hash"))
    taken = mix(rows, by_source, most, few).where(F.col("copies") > 0)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
