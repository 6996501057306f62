"""First occurrences, id merges and recurring series.

A window over an id or a title would send a whole group to one task. These operators use
aggregates that combine before the shuffle, and joins against one row per key, whose large
side adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from townbill import fixed
from townbill.functions.text import normalise_title


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in the given order; the order must be unique within a key."""
    others = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, "first.*").select(*df.columns)


def newest(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """One row (key, value) per key: the value of the latest `at`, which may be missing; the greatest on a tie."""
    order = F.struct(at, value) if at in df.columns else F.col(value)
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def merge_by_id(batch: DataFrame, seq: str = "seq", spread: int = 16) -> DataFrame:
    """One row per id: the first row wins and its age range widens over the later ones.

    Rows in `seq` order widen the range when both their bounds are known, until the running
    lowest age is exactly 18, which then stays. As the running minimum only falls, it can
    halt at 18 only if no earlier row was lower: the position of the first 18 and of the
    first lower age decide that, so the ordered merge becomes aggregates plus, for the ids
    that halt after their first row, one more maximum over their rows up to the halt. That
    step's join is spread over `spread` salts, so the rows of one id go to several tasks.
    """
    adult = fixed.ADULT_AGE
    others = [c for c in batch.columns if c != "id"]
    age, top = F.col("age_min"), F.col("age_max")
    ranged = batch.withColumn("both", age.isNotNull() & top.isNotNull())
    both = F.col("both")
    merged = ranged.groupBy("id").agg(
        F.min_by(F.struct(*others), F.col(seq)).alias("first"),
        F.min(F.when(both & (age == adult), F.col(seq))).alias("at_adult"),
        F.min(F.when(both & (age < adult), F.col(seq))).alias("at_lower"),
        F.min(F.when(both, age)).alias("low"),
        F.max(F.when(both, top)).alias("high"),
    )
    head, head_top = F.col("first.age_min"), F.col("first.age_max")
    halt = (
        F.when(head <= adult, F.lit(None))
        .when(F.col("at_lower").isNull() | (F.col("at_adult") < F.col("at_lower")), F.col("at_adult"))
    )
    merged = merged.withColumn("halt", halt)
    salts = F.array(*[F.lit(i) for i in range(spread)])
    halted = merged.filter(F.col("halt").isNotNull()).select("id", "halt", F.explode(salts).alias("salt"))
    capped = (
        ranged.filter(both)
        .select("id", seq, "age_max", F.pmod(F.hash(seq), F.lit(spread)).alias("salt"))
        .join(halted, ["id", "salt"])
        .filter(F.col(seq) <= F.col("halt"))
        .groupBy("id")
        .agg(F.max("age_max").alias("high_at_halt"))
    )
    out = merged.join(capped, "id", "left")
    new_min = F.when((head == adult) | F.col("halt").isNotNull(), adult).otherwise(F.least(head, F.col("low")))
    new_max = F.when(head == adult, head_top).otherwise(
        F.greatest(head_top, F.when(F.col("halt").isNotNull(), F.col("high_at_halt")).otherwise(F.col("high")))
    )
    replaced = {"age_min": new_min, "age_max": new_max}
    return out.select(
        *[replaced[c].alias(c) if c in replaced else F.col("id") if c == "id" else F.col(f"first.{c}").alias(c)
          for c in batch.columns]
    )


def mark_recurring(batch: DataFrame, source: str = "source", title: str = "title") -> DataFrame:
    """Flag rows whose title occurs at least twice within their source; flags are never cleared."""
    keyed = batch.withColumn("series_title", normalise_title(F.col(title)))
    repeated = (
        keyed.groupBy(source, "series_title").count().filter(F.col("count") >= 2)
        .select(source, "series_title", F.lit(True).alias("in_series"))
    )
    joined = keyed.join(repeated, [source, "series_title"], "left")
    series = F.coalesce(F.col("in_series"), F.lit(False))
    label = F.col("recurrence_label")
    return (
        joined.withColumn("is_recurring", F.coalesce(F.col("is_recurring"), F.lit(False)) | series)
        .withColumn("recurrence_label", F.when(series & (F.coalesce(label, F.lit("")) == ""), "Recurring").otherwise(label))
        .select(*batch.columns)
    )
