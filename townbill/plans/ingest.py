"""One source's nightly run: classify, merge, screen, publish, log."""

from __future__ import annotations

import dataclasses
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from townbill import fixed
from townbill.functions.wallclock import instant
from townbill.operators import classify, guard, publish, series
from townbill.session import materialise, measured, staging
from townbill.sources import landings, sinks, tables


@dataclasses.dataclass(frozen=True)
class SourceRule:
    """What a source's run does beyond screening and upserting."""

    classified: bool = False
    purge: bool = False
    cleanup_words: tuple = ()
    fetched_column: str | None = None


RULES = {
    "frisco-library": SourceRule(cleanup_words=fixed.ADULT_PROGRAM_KEYWORDS, fetched_column="frisco_fetched"),
    "plano-library": SourceRule(fetched_column="plano_fetched"),
    "play-frisco": SourceRule(
        classified=True, purge=True, cleanup_words=fixed.ADMIN_KEYWORDS, fetched_column="play_frisco_fetched"
    ),
    "kaleidoscope-park": SourceRule(classified=True, purge=True),
}


@dataclasses.dataclass(frozen=True)
class RunResult:
    source: str
    fetched: int
    upserted: int
    llm_calls: int
    errors: list
    aborted: bool = False
    capped: bool = False


CAP_ERROR = "spend cap reached; the remaining rows were left out rather than classified"
FALLBACK_ERROR = "{fallback} of {total} listings fell back to all ages"
MERGED = ("is_recurring", "recurrence_label")


def classify_batch(
    batch: DataFrame, prior: DataFrame, answers_for, cap: int | None = None, retry_failed: bool = False
) -> DataFrame:
    """Carry forward, cap, ask and apply; `answers_for` maps the due rows to (id, answer).

    The carried and the capped batch are materialised: the join with the stored rows runs once, and
    the classifier is costly and must see each row once.
    """
    capped = materialise(classify.with_spend_cap(materialise(classify.carry_forward(batch, prior, retry_failed)), cap))
    answers = materialise(answers_for(classify.to_classify(capped)))
    return classify.hide_adult(classify.apply_answers(capped, answers))


def prepare(batch: DataFrame) -> DataFrame:
    """Merge rows of one id and flag series."""
    return series.mark_recurring(series.merge_by_id(batch))


def run_source(
    spark: SparkSession,
    source: str,
    batch: DataFrame,
    catalogue_path: str,
    runs_path: str,
    now,
    answers_for=None,
    cap: int | None = None,
    allow_time_shift: bool = False,
    errors: tuple = (),
    rules: dict = RULES,
    partial: bool = False,
    pending_path: str | None = None,
) -> RunResult:
    """Run one source on its landed batch and append the run log.

    An empty batch writes nothing and is not an abort, so its clean-up still runs. An aborted
    batch leaves the stored rows exactly as they are, as does one that fails: the failure becomes
    an error of the logged run. A `partial` batch holds only some of the source's rows, so neither
    its missing ids nor its size say anything. Rows that a cap skipped are appended to
    `pending_path`, if there is one.
    """
    rule, began = rules[source], time.monotonic()
    if rule.classified and answers_for is None:
        raise ValueError(f"source {source} needs a classifier")
    try:
        with staging(spark):
            result = _publish(
                spark, source, rule, batch, catalogue_path, now, answers_for, cap, allow_time_shift, list(errors), partial, pending_path
            )
    except Exception as error:
        told = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:500]
        result = RunResult(source, 0, 0, 0, [*errors, f"{source}: {told}"], aborted=True)
    took = int((time.monotonic() - began) * 1000)
    sinks.append_run(run_log(spark, result, now, rule, took), runs_path)
    return result


def _publish(
    spark, source, rule, batch, catalogue_path, now, answers_for, cap, allow_time_shift, errors, partial, pending_path
) -> RunResult:
    stored = tables.scan_catalogue(spark, catalogue_path, sources=[source])
    given = {*batch.columns, *MERGED, *(classify.CARRIED if rule.classified else ())}
    rows, landed = measured(tables.as_batch(batch), fetched=F.count(F.lit(1)))
    calls, capped, scraped, fetched = 0, False, rows, landed["fetched"]
    if "age_resolved" in rows.columns:
        verdict = landings.audience_fallback(rows).first()
        if verdict["warn"]:
            errors.append(FALLBACK_ERROR.format(**verdict.asDict()))
        rows = rows.drop("age_resolved")
    if rule.classified:
        rows, tally = measured(
            classify_batch(rows, stored, answers_for, cap),
            calls=F.count_if(~F.col("carried") & ~F.col("budget_skipped")),
            capped=F.coalesce(F.bool_or("budget_skipped"), F.lit(False)),
        )
        calls, capped = tally["calls"], tally["capped"]
        if capped:
            errors.append(CAP_ERROR)
            if pending_path:
                classify.skipped(rows).write.mode("append").parquet(pending_path)
        rows = rows.filter(~F.col("budget_skipped"))
    ready, merged = measured(prepare(rows), total=F.count(F.lit(1)))
    upserted, aborted = 0, False
    if not merged["total"]:
        write = ready
    else:
        limits = guard.Thresholds(max_shrink_share=1.0) if partial else guard.Thresholds()
        verdict = materialise(guard.guard_verdict(ready, stored, allow_time_shift, limits))
        decision = verdict.first()
        errors += [f"guard ({source}): {r}" for r in decision["reasons"]]
        aborted = decision["abort"]
        upserted = 0 if aborted else decision["kept"]
        write = guard.write_set(ready, verdict)
    if not aborted:
        listed = tables.as_listings(write)
        written = listed.select(*[c for c in listed.columns if c in given])
        purge = rule.purge and fetched > 0 and not partial
        sinks.publish_source(spark, catalogue_path, source, written, scraped, rule.cleanup_words, purge, {"created_at": instant(now)})
    return RunResult(source, fetched, upserted, calls, errors, aborted, capped)


def run_all(
    spark: SparkSession,
    batches: dict,
    catalogue_path: str,
    runs_path: str,
    now,
    answers_for=None,
    rules: dict = RULES,
    **options,
) -> list[RunResult]:
    """Run every source; `batches` maps it to its landed batch, or to a function that reads it.

    A source that fails, in reading its pages or later, is a logged error; the others go on.
    """
    results = []
    for source, batch in batches.items():
        began = time.monotonic()
        try:
            rows = batch() if callable(batch) else batch
            result = run_source(spark, source, rows, catalogue_path, runs_path, now, answers_for, rules=rules, **options)
        except Exception as error:
            result = RunResult(source, 0, 0, 0, [f"{source}: {type(error).__name__}: {error}"[:500]], aborted=True)
            took = int((time.monotonic() - began) * 1000)
            sinks.append_run(run_log(spark, result, now, rules[source], took), runs_path)
        results.append(result)
    return results


def run_log(spark: SparkSession, result: RunResult, now, rule: SourceRule, duration_ms: int = 0) -> DataFrame:
    fetched: dict[str, Column] = {
        c: F.lit(result.fetched if c == rule.fetched_column else 0)
        for c in ("frisco_fetched", "plano_fetched", "play_frisco_fetched")
    }
    base = spark.range(1).select(
        F.lit(str(uuid.uuid4())).alias("id"),
        instant(now).alias("ran_at"),
        F.lit(duration_ms).alias("duration_ms"),
        *[v.alias(c) for c, v in fetched.items()],
        F.lit(result.upserted).alias("total_upserted"),
        F.lit(result.llm_calls).alias("llm_calls"),
        F.array(*[F.lit(e) for e in result.errors]).cast("array<string>").alias("errors"),
    )
    return publish.run_log_row(base)


def summarise(results: list[RunResult], spark: SparkSession) -> DataFrame:
    """Per-source totals of a combined run."""
    rows = [(r.source, r.fetched, r.upserted, r.capped) for r in results]
    return publish.run_summary(
        spark.createDataFrame(rows, "source STRING, fetched BIGINT, upserted BIGINT, capped BOOLEAN")
    )
