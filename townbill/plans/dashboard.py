"""The two metric tabs, each from shared aggregates."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from townbill import fixed
from townbill.operators import engagement, pipeline_metrics


def functional_metrics(rows: DataFrame, listings: DataFrame | None = None, top: int = 10) -> dict[str, DataFrame]:
    """Engagement metrics. The session rows serve the funnel and the referral share; they are
    persisted, and recomputed from the scan should an executor that holds some be lost."""
    sessions = engagement.sessionise(rows).persist(StorageLevel.MEMORY_AND_DISK)
    weekly = engagement.weekly_active(rows)
    leaders = engagement.top_items(engagement.item_tallies(rows), top)
    return {
        "sessions": sessions,
        "funnel": engagement.funnel_of(sessions),
        "weekly_active": weekly,
        "weekly_delta": engagement.weekly_delta(weekly),
        "return_rate": engagement.return_rate(rows),
        "weekly_shares": engagement.weekly_shares(rows),
        "referral": engagement.converted_share_of(sessions),
        "top_items": engagement.with_titles(leaders, listings) if listings is not None else leaders,
        "actions": engagement.conversion_actions(rows),
        "filters": engagement.filter_usage(rows),
    }


def technical_metrics(listings: DataFrame, runs: DataFrame, today, sources=fixed.COUNTED_SOURCES) -> dict[str, DataFrame]:
    """Catalogue and pipeline metrics; each scan reads only the columns it counts."""
    return {
        "source_totals": pipeline_metrics.source_totals(listings, sources),
        "price_totals": pipeline_metrics.tri_state_totals(listings),
        "age_visibility": pipeline_metrics.age_visibility(listings),
        "price_visibility": pipeline_metrics.price_visibility(listings),
        "latest_run": pipeline_metrics.latest_run(runs),
        "history": pipeline_metrics.status_history(runs, today),
        "cost": pipeline_metrics.cost_summary(runs),
        "last_runs": pipeline_metrics.last_runs(runs),
    }
