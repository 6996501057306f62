"""Builders for small tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql.types import StructType

from townbill import schemas


def utc(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(dt.timezone.utc)


def table(spark, ddl: str, rows: list[dict]):
    """Rows given as dicts; columns left out are null."""
    schema = StructType.fromDDL(ddl)
    return spark.createDataFrame([tuple(r.get(n) for n in schema.fieldNames()) for r in rows], schema)


def listing(**kw) -> dict:
    base = dict(
        id="x", source="frisco-library", title="Story time", description="", start_datetime=utc("2026-08-14T15:00:00Z"),
        location_name="Frisco Public Library", is_free=True, price_text="Free", is_recurring=False,
        event_url="https://town.example.org/x", category="library", registration_required=False,
        ingested_at=utc("2026-08-01T00:00:00Z"), created_at=utc("2026-08-01T00:00:00Z"),
    )
    return {**base, **kw}


def listings(spark, rows: list[dict], extra: str = ""):
    return table(spark, schemas.LISTINGS + extra, [listing(**r) for r in rows])


def dicts(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def column(df, name: str, by: str = "id") -> list:
    return [r[name] for r in df.orderBy(by).collect()]


def one(df) -> dict:
    rows = dicts(df)
    assert len(rows) == 1
    return rows[0]


def plan_of(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)
