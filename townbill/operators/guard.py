"""Screening a batch against the stored snapshot before it is published."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, functions as F

from townbill import fixed
from townbill.functions.maths import half_up, percent_text, safe_ratio
from townbill.functions.wallclock import implausible_start


@dataclasses.dataclass(frozen=True)
class Thresholds:
    max_implausible_share: float = fixed.MAX_IMPLAUSIBLE_SHARE
    min_overlap: int = fixed.MIN_OVERLAP
    min_agreement: float = fixed.MIN_AGREEMENT
    min_shift_minutes: int = fixed.MIN_SHIFT_MINUTES
    max_shrink_share: float = fixed.MAX_SHRINK_SHARE


def with_screen(batch: DataFrame, zone: str = fixed.LOCAL_ZONE) -> DataFrame:
    """Mark rows whose start cannot be published: unknown, or in the small hours."""
    return batch.withColumn("implausible", implausible_start(F.col("start_datetime"), unknown_is_bad=True, zone=zone))


def moved_minutes(before: Column, after: Column) -> Column:
    return half_up((F.unix_millis(after) - F.unix_millis(before)) / 60000.0).cast("bigint")


def _shift_counts(kept: DataFrame, stored: DataFrame) -> DataFrame:
    """Matched rows per exact minute offset; this is the only join, on the id."""
    old = stored.select("id", F.col("start_datetime").alias("stored_start")).filter(F.col("stored_start").isNotNull())
    new = kept.select("id", "start_datetime").filter(F.col("start_datetime").isNotNull())
    offset = moved_minutes(F.col("stored_start"), F.col("start_datetime"))
    return new.join(old, "id").groupBy(offset.alias("offset_min")).agg(F.count("*").alias("n"))


def _shift_measures(offsets: DataFrame, t: Thresholds) -> DataFrame:
    moved = F.abs("offset_min") >= t.min_shift_minutes
    # the most frequent offset; on a tie the smaller one, then the negative one
    rank = F.when(moved, F.struct("n", -F.abs("offset_min"), -F.col("offset_min")))
    return offsets.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("overlap"),
        F.coalesce(F.sum(F.when(moved, F.col("n"))), F.lit(0)).alias("moved"),
        F.max_by(F.when(moved, F.col("offset_min")), rank).alias("dominant_offset_min"),
        F.coalesce(F.max(F.when(moved, F.col("n"))), F.lit(0)).alias("agreeing"),
    )


def _with_shift_verdict(df: DataFrame, t: Thresholds) -> DataFrame:
    agreement = safe_ratio(F.col("agreeing"), F.col("overlap"))
    return df.withColumn("agreement", agreement).withColumn(
        "systemic", (F.col("overlap") >= t.min_overlap) & (F.col("agreement") >= t.min_agreement)
    )


def uniform_shift(kept: DataFrame, stored: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row: overlap, moved, dominant offset, agreement and whether the shift is systemic."""
    measures = _shift_measures(_shift_counts(kept, stored), thresholds)
    return _with_shift_verdict(measures, thresholds).drop("agreeing")


def guard_verdict(
    batch: DataFrame,
    stored: DataFrame,
    allow_time_shift: bool = False,
    thresholds: Thresholds = Thresholds(),
    zone: str = fixed.LOCAL_ZONE,
) -> DataFrame:
    """One row with all counts, the abort decision and its reasons.

    Three single-row measures are stacked and folded into one, so no join between them is needed.
    """
    t = thresholds
    screened = with_screen(batch, zone)
    shift = _shift_measures(_shift_counts(screened.filter(~F.col("implausible")), stored), t)
    title = F.col("title").cast("string") if "title" in batch.columns else F.lit(None).cast("string")
    order = F.col("seq") if "seq" in batch.columns else title
    bad = screened.agg(
        F.count("*").alias("incoming"),
        F.count_if("implausible").alias("dropped"),
        F.min_by(title, F.when(F.col("implausible"), order)).alias("example"),
    )
    held = stored.agg(F.count("*").alias("stored"))
    stacked = shift.unionByName(bad, allowMissingColumns=True).unionByName(held, allowMissingColumns=True)
    one = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    n_in, n_drop, n_stored = F.col("incoming"), F.col("dropped"), F.col("stored")
    one = _with_shift_verdict(one, t).withColumn("kept", n_in - n_drop)
    share = safe_ratio(n_drop, n_in)
    broken = share > t.max_implausible_share
    shifted = F.col("systemic") & F.lit(not allow_time_shift)
    shrunk = (n_stored >= t.min_overlap) & (F.col("kept") < n_stored * (1 - t.max_shrink_share))
    shift_text = F.concat(
        F.lit("uniform "), F.col("dominant_offset_min").cast("string"), F.lit("min shift across "),
        percent_text(F.col("agreement")), F.lit("% of "), F.col("overlap").cast("string"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(
                n_drop > 0,
                F.concat(
                    F.lit("dropped "), n_drop.cast("string"), F.lit(" rows with unpublishable start times, e.g. "),
                    F.coalesce(F.col("example"), F.lit("?")),
                ),
            ),
            F.when(
                broken,
                F.concat(
                    F.lit("ABORT: "), percent_text(share), F.lit("% of rows had implausible times (max "),
                    percent_text(F.lit(t.max_implausible_share)), F.lit("%)"),
                ),
            ),
            F.when(shifted, F.concat(F.lit("ABORT: "), shift_text, F.lit(" stored rows"))).when(
                F.col("systemic"), F.concat(shift_text, F.lit(" rows, allowed"))
            ),
            F.when(
                shrunk,
                F.concat(
                    F.lit("ABORT: batch has "), F.col("kept").cast("string"), F.lit(" rows against "),
                    n_stored.cast("string"), F.lit(" stored"),
                ),
            ),
        )
    )
    return one.select(
        "incoming", "dropped", "kept", "stored", "overlap", "moved", "dominant_offset_min", "agreement", "systemic",
        share.alias("implausible_share"),
        (broken | shifted | shrunk).alias("abort"),
        reasons.alias("reasons"),
    )


def write_set(batch: DataFrame, verdict: DataFrame, zone: str = fixed.LOCAL_ZONE) -> DataFrame:
    """The rows to publish: the plausible ones, and none of them when the verdict says abort.

    The verdict enters as a scalar subquery, evaluated once before the scan.
    """
    abort = verdict.select("abort").scalar()
    return with_screen(batch, zone).filter(~F.col("implausible") & ~abort).drop("implausible")


def dropped_set(batch: DataFrame, zone: str = fixed.LOCAL_ZONE) -> DataFrame:
    return with_screen(batch, zone).filter("implausible").drop("implausible")
