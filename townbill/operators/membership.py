"""Which rows of a large table have their key in a batch, moving only the rows that may.

A Bloom filter of the batch's keys, 64-bit words with four bits a key, is a small table (word number,
bits). The large side meets it in a broadcast join where it is read; rows it lets through, the batch's
own and about one in a hundred others, go on to the exact join. So the shuffle follows the batch and
not the stored history.

The filter has 16 bits a distinct key, at most `MOST_WORDS` words (16 MB of rows). A batch of more
keys, and keys of another type than the stored ones, take the plain join: the result is the same.
A missing key is in no batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEYS_A_WORD = 4
BITS_A_KEY = 4
MOST_WORDS = 1 << 20


def among(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key occurs in `keys`; repeated keys there repeat nothing."""
    wanted = keys.select(key)
    kept = _filter_of(rows, wanted, key)
    if kept is None:
        return rows.join(wanted, key, "left_semi").select(*rows.columns)
    return _exact(_met(rows, key, *kept, "inner").filter(_passes(key)), wanted, key, "left_semi")


def not_among(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The complement of `among`: rows the filter rejects are in no batch and stay where they are."""
    wanted = keys.select(key)
    kept = _filter_of(rows, wanted, key)
    if kept is None:
        return rows.join(wanted, key, "left_anti").select(*rows.columns)
    met, passes = _met(rows, key, *kept, "left"), F.coalesce(_passes(key), F.lit(False))
    return met.filter(~passes).select("r.*").unionByName(_exact(met.filter(passes), wanted, key, "left_anti"))


def _met(rows: DataFrame, key: str, words: DataFrame, n: int, how: str) -> DataFrame:
    return rows.alias("r").join(F.broadcast(words).alias("w"), _word(F.col(f"r.{key}"), n) == F.col("w.word"), how)


def _exact(met: DataFrame, wanted: DataFrame, key: str, how: str) -> DataFrame:
    """The key is taken from both sides of the filter's join, else the optimizer would join exactly below it."""
    probe = F.when(_passes(key), F.col(f"r.{key}"))
    return met.join(wanted.alias("k"), probe == F.col(f"k.{key}"), how).select("r.*")


def _filter_of(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, int] | None:
    if rows.schema[key].dataType != wanted.schema[key].dataType:
        return None
    distinct = wanted.agg(F.approx_count_distinct(key)).first()[0]
    n = 1 << (max(1, distinct // KEYS_A_WORD) - 1).bit_length()
    if n > MOST_WORDS:
        return None
    known = wanted.filter(F.col(key).isNotNull())
    words = known.select(_word(F.col(key), n).alias("word"), _mask(F.col(key)).alias("bits"))
    return words.groupBy("word").agg(F.bit_or("bits").alias("bits")), n


def _word(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def _mask(key: Column) -> Column:
    """Four bits of a word, chosen by a hash of its own."""
    chosen = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for i in range(BITS_A_KEY):
        place = F.shiftright(chosen, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def _passes(key: str) -> Column:
    mask = _mask(F.col(f"r.{key}"))
    return F.col("w.bits").bitwiseAND(mask) == mask
