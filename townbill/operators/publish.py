"""Turning a stored snapshot and a screened batch into the next snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from townbill import fixed
from townbill.functions.maths import call_cost
from townbill.functions.text import contains_any
from townbill.operators import membership


def upsert(stored: DataFrame, batch: DataFrame, key: str = "id", new: dict[str, Column] | None = None) -> DataFrame:
    """Batch rows replace stored rows of the same id; all others survive.

    Columns that the batch lacks keep their stored values; for new ids they are null, or as `new` says.
    """
    return _merged(stored, batch.select(key, F.struct(*batch.columns).alias("written")), batch.columns, key, new)


def _merged(stored: DataFrame, marks: DataFrame, own: list[str], key: str, new: dict[str, Column] | None) -> DataFrame:
    """One join of the stored rows with `marks` (key, written): what was written wins column by column."""
    s, m = stored.alias("s"), marks.alias("m")
    hit, known = F.col("m.written").isNotNull(), F.col(f"s.{key}").isNotNull()

    def value(c: str) -> Column:
        if c in own:
            return F.when(hit, F.col(f"m.written.{c}")).otherwise(F.col(f"s.{c}") if c in stored.columns else F.lit(None))
        at_first = (new or {}).get(c, F.lit(None))
        return F.when(hit & ~known, at_first).otherwise(F.col(f"s.{c}"))

    columns = stored.columns + [c for c in own if c not in stored.columns]
    rows = s.join(m, F.col(f"s.{key}") == F.col(f"m.{key}"), "full_outer").filter(hit | known)
    return rows.select(*[value(c).alias(c) for c in columns])


def purge_stale(stored: DataFrame, scraped: DataFrame, key: str = "id") -> DataFrame:
    """Keep the stored rows whose id was in the scraped batch, written or not."""
    return membership.among(stored, scraped, key)


def stale_rows(stored: DataFrame, scraped: DataFrame, key: str = "id") -> DataFrame:
    """The complement of purge_stale: what a purge deletes."""
    return membership.not_among(stored, scraped, key)


def keyword_cleanup(stored: DataFrame, words, title: str = "title") -> DataFrame:
    """Drop rows whose title holds any of the words; a row without a title stays."""
    return stored.filter(~F.coalesce(contains_any(F.col(title), words), F.lit(False)))


def cleanup_hits(stored: DataFrame, words, title: str = "title") -> DataFrame:
    """The complement of keyword_cleanup: the rows it drops."""
    return stored.filter(contains_any(F.col(title), words))


def next_snapshot(
    stored: DataFrame,
    write: DataFrame,
    scraped: DataFrame | None = None,
    cleanup_words=(),
    purge: bool = False,
    new: dict[str, Column] | None = None,
) -> DataFrame:
    """Upsert, keyword clean-up and purge of one source, for a batch that was not aborted.

    The written rows are among the scraped ones; with a purge, stored rows whose id was not scraped go.
    The stored rows, the large side, are shuffled once, by id. Columns that the written rows lack keep
    their stored values; for new ids they are null, or as `new` says.
    """
    marks = write.select("id", F.struct(*write.columns).alias("written"))
    if purge and scraped is not None:
        seen = purge_stale(stored, scraped)
        rows = _merged(seen, marks, write.columns, "id", new)
    else:
        rows = _merged(stored, marks, write.columns, "id", new)
    return keyword_cleanup(rows, cleanup_words) if cleanup_words else rows


def run_status(upserted: Column, errors: Column) -> Column:
    return F.when(upserted == 0, "err").when(errors > 0, "warn").otherwise("ok")


def run_log_row(runs: DataFrame, per_call: str = fixed.COST_PER_CALL) -> DataFrame:
    """Status and cost of finished runs (total_upserted, llm_calls, errors ARRAY)."""
    calls = F.coalesce(F.col("llm_calls"), F.lit(0))
    return runs.withColumns(
        {
            "status": run_status(F.col("total_upserted"), F.size("errors")),
            "llm_calls": calls,
            "llm_cost_usd": call_cost(calls, per_call),
        }
    )


def union_sources(batches: list[DataFrame]) -> DataFrame:
    """Concatenate the batches (or error rows) of several sources."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def run_summary(results: DataFrame) -> DataFrame:
    """Totals per source over run results (source, fetched, upserted, capped), and whether each failed."""
    return results.groupBy("source").agg(
        F.sum("fetched").alias("fetched"),
        F.sum("upserted").alias("upserted"),
        (F.coalesce(F.sum("upserted"), F.lit(0)) == 0).alias("nothing_written"),
        F.coalesce(F.bool_or("capped"), F.lit(False)).alias("capped"),
    ).withColumn("failed", F.col("nothing_written") | F.col("capped"))
