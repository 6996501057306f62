"""Declared table schemas; nothing is inferred."""

LISTINGS = """
id STRING, source STRING, title STRING, description STRING,
start_datetime TIMESTAMP, end_datetime TIMESTAMP,
location_name STRING, location_address STRING, location_lat DOUBLE, location_lng DOUBLE,
is_free BOOLEAN, price_text STRING, age_min INT, age_max INT, age_label STRING,
is_recurring BOOLEAN, recurrence_label STRING, thumbnail_url STRING, event_url STRING,
category STRING, registration_required BOOLEAN,
kid_relevant BOOLEAN, age_buckets ARRAY<STRING>, age_confidence STRING, age_reasoning STRING,
price_class STRING, price_confidence STRING, price_reasoning STRING,
raw_json STRING, ingested_at TIMESTAMP, created_at TIMESTAMP
"""

STORED = "id STRING, start_datetime TIMESTAMP"

INGEST_RUNS = """
id STRING, ran_at TIMESTAMP, duration_ms INT, status STRING,
frisco_fetched INT, plano_fetched INT, play_frisco_fetched INT, total_upserted INT,
llm_calls INT, llm_cost_usd DECIMAL(10,4), errors ARRAY<STRING>
"""

ANALYTICS = """
visitor_id STRING, session_id STRING, event_name STRING, timestamp BIGINT,
channel STRING, event_id STRING, method STRING, filter_fields STRING, city STRING
"""

ANALYTICS_EXPORT = """
event_date DATE, user_pseudo_id STRING, event_name STRING, event_timestamp BIGINT,
traffic_source STRUCT<medium: STRING>,
event_params ARRAY<STRUCT<key: STRING, value: STRUCT<string_value: STRING, int_value: BIGINT>>>
"""

RAW_PAGES = "source STRING, url STRING, page_no INT, fetched_at TIMESTAMP, body STRING"

SUPERVISION_POLICIES = """
source STRING, tier INT, unattended_age_min INT, display_text STRING,
policy_url STRING, verified_date DATE, notes STRING
"""

LIKE_LOG = "event_id STRING, ts TIMESTAMP, seq BIGINT, delta INT"


def columns(ddl: str) -> list[str]:
    """Column names of one of the flat schemas above, in order."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fieldNames()
