"""Carrying classifications forward, the spend cap, and applying classifier answers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from townbill import fixed
from townbill.functions import prices
from townbill.functions.model_output import parse_answer
from townbill.functions.text import joined, let, matches_any
from townbill.operators.series import newest

CARRIED = (
    "kid_relevant", "age_buckets", "age_confidence", "age_reasoning", "is_free", "price_text",
    "price_class", "price_confidence", "price_reasoning",
)
UNAVAILABLE = "classification unavailable (hidden)"


def call_cap(raw: str | None, default: int | None = None) -> int | None:
    """A configured cap; a missing, malformed or negative one means the default, none; 0 is allowed."""
    try:
        number = float(raw) if raw is not None and raw.strip() else math.nan
    except ValueError:
        number = math.nan
    return math.floor(number) if math.isfinite(number) and number >= 0 else default


def carry_forward(batch: DataFrame, prior: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Copy the stored classification, price included, onto known rows; `carried` marks them.

    A stored failed classification counts as known unless retry_failed is set.
    """
    known = prior.filter(F.col("kid_relevant").isNotNull())
    if retry_failed:
        known = known.filter(~F.col("age_reasoning").eqNullSafe(UNAVAILABLE))
    known = known.select("id", F.struct(*CARRIED).alias("prior"))
    hit = F.col("prior").isNotNull()
    own = set(batch.columns)
    merged = batch.join(known, "id", "left")
    values = {
        c: F.when(hit, F.col(f"prior.{c}")).otherwise(F.col(c)) if c in own else F.col(f"prior.{c}") for c in CARRIED
    }
    return merged.withColumns(values).withColumn("carried", hit).drop("prior")


def with_spend_cap(carried: DataFrame, cap: int | None = None, seq: str = "seq") -> DataFrame:
    """Mark pending rows past the first `cap` in batch order as `budget_skipped`; without a cap none is.

    The cap is a top-k over the pending rows; its last position is the cut-off for the rest. The rows
    are read twice, so a run writes them before it caps them.
    """
    if cap is None:
        return carried.withColumn("budget_skipped", F.lit(False))
    pending = carried.filter(~F.col("carried")).select(seq)
    last = pending.orderBy(seq).limit(cap).agg(F.max(seq).alias("last")).scalar()
    beyond = F.coalesce(F.col(seq) > last, F.lit(True))
    return carried.withColumn("budget_skipped", ~F.col("carried") & beyond)


def to_classify(capped: DataFrame) -> DataFrame:
    """The rows a classifier is to answer for."""
    return capped.filter(~F.col("carried") & ~F.col("budget_skipped")).select("id", "title", "description")


def skipped(capped: DataFrame) -> DataFrame:
    """The rows that a cap left unclassified, for a later run."""
    return capped.filter("budget_skipped").drop("budget_skipped", "carried")


def apply_answers(capped: DataFrame, answers: DataFrame) -> DataFrame:
    """Join classifier answers (id, answer[, answered_at]) onto the rows that were up for classification.

    An unusable or missing answer hides the row. A locked price stays as the source stated it. Of
    several answers for an id the latest counts, and without times the greatest text.
    """
    found = F.col("found")
    answers = newest(answers, "id", "answered_at", "answer")
    rows = capped.join(answers.select("id", parse_answer(F.col("answer")).alias("found")), "id", "left")
    due = ~F.col("carried") & ~F.col("budget_skipped")
    answered = due & found.isNotNull()
    unlocked = answered & ~F.coalesce(F.col("price_locked"), F.lit(False))
    rows = rows.withColumn(
        "resolved",
        prices.resolve_price(
            F.col("found.price"), F.col("found.price_confidence"),
            joined(F.col("title"), F.col("description")), F.col("registration_required"),
        ),
    )
    resolved_class = F.col("resolved.price_class")
    take = lambda c: F.when(answered, F.col(f"found.{c}")).otherwise(F.col(c))
    price = lambda value, c: F.when(unlocked, value).otherwise(F.col(c))
    return rows.withColumns(
        {
            "kid_relevant": F.when(due & found.isNull(), False).otherwise(take("kid_relevant")),
            "age_buckets": take("age_buckets"),
            "age_confidence": take("age_confidence"),
            "age_reasoning": F.when(due & found.isNull(), UNAVAILABLE).otherwise(take("age_reasoning")),
            "is_free": price(prices.is_free_of(resolved_class), "is_free"),
            "price_text": price(prices.price_text_of(resolved_class), "price_text"),
            "price_class": price(resolved_class, "price_class"),
            "price_confidence": price(F.col("resolved.price_confidence"), "price_confidence"),
            "price_reasoning": price(F.col("found.price_reasoning"), "price_reasoning"),
        }
    ).drop("found", "resolved")


def hide_adult(rows: DataFrame, patterns=fixed.ADULT_OVERRIDE_PATTERNS) -> DataFrame:
    """Hide low-confidence rows and those whose text says adults only, carried ones included."""
    text = F.lower(joined(F.col("title"), F.col("description")))
    hide = F.col("age_confidence").eqNullSafe("low") | let(text, lambda t: matches_any(t, patterns))
    return rows.withColumn("kid_relevant", F.when(hide, False).otherwise(F.col("kid_relevant")))


def calibration_matrix(labelled: DataFrame, expected: str = "expected", got: str = "got") -> DataFrame:
    """Count of cases per expected and produced class."""
    return labelled.groupBy(expected, got).agg(
        F.count("*").alias("cases"), F.count_if(F.col(expected).eqNullSafe(F.col(got))).alias("passed")
    )
