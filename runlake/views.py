"""Stand-in tables for the queries: pipeline runs and incidents made from the events table.

One text for each, which Spark and DuckDB both read. Ids are whole numbers as text, never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RUNS = """
SELECT event_id, 'run-' || CAST(event_id AS STRING) AS run_id,
       'pip-' || CAST(user_id AS STRING) AS pipeline_id,
       CASE WHEN user_id % 7 = 0 THEN '0a1b2c3d-0000-4000-8000-' || substring(CAST(1000000000000 + user_id AS STRING), 2)
            ELSE 'pipeline_' || CAST(user_id AS STRING) END AS pipeline_name,
       'ws-' || CAST(user_id % 3 AS STRING) AS workspace_id,
       CASE event_type WHEN 'error' THEN 'Failed' WHEN 'purchase' THEN 'Succeeded' WHEN 'signup' THEN 'Canceled'
                       WHEN 'view' THEN 'Running' ELSE 'Unmapped' END AS raw_status,
       ts AS start_time,
       CASE WHEN event_type = 'view' THEN NULL ELSE ts + (event_id % 10) * INTERVAL '1' MINUTE END AS end_time,
       CASE WHEN event_type <> 'error' THEN NULL ELSE CASE event_id % 12
         WHEN 0 THEN 'OperationTimeout: step waited too long' WHEN 1 THEN 'source said 429, slow down'
         WHEN 2 THEN 'TokenExpired while reading' WHEN 3 THEN 'ServiceUnavailable from store'
         WHEN 4 THEN 'Connection reset by peer' WHEN 5 THEN 'ColumnNotFound: amount'
         WHEN 6 THEN 'FileNotFound: day.parquet' WHEN 7 THEN 'AccessDenied on folder'
         WHEN 8 THEN 'DuplicateKey on id' WHEN 9 THEN 'worker stopped, no detail'
         WHEN 10 THEN 'Forbidden, then 503 on retry' END END AS error_message,
       CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN CAST(400 + event_id % 110 AS STRING) END AS error_code
FROM {events}
"""

CANDIDATES = """
SELECT event_id AS n, run_id, pipeline_id, pipeline_name, workspace_id, error_message, start_time,
       CASE event_id % 8 WHEN 0 THEN 'transient' WHEN 1 THEN 'auth' WHEN 2 THEN 'infra' WHEN 3 THEN 'schema'
            WHEN 4 THEN 'permission' WHEN 5 THEN 'data_quality' WHEN 6 THEN 'source_missing' ELSE 'unknown' END AS error_category,
       event_id % 8 < 3 AS is_auto_fixable, event_id % 11 <> 0 AS triggered
FROM {runs} WHERE raw_status = 'Failed'
"""

INCIDENTS = """
SELECT start_time + INTERVAL '2' MINUTE AS timestamp, pipeline_name, pipeline_id, run_id, workspace_id, error_category, is_auto_fixable,
       error_message, 'cause of ' || error_category AS root_cause,
       CASE WHEN n % 9 = 8 THEN 'max_retries_exceeded' WHEN is_auto_fixable AND triggered THEN 'auto_rerun' ELSE 'alert_sent' END AS action_taken,
       n % 9 <> 8 AND is_auto_fixable AND triggered AS success,
       CASE WHEN n % 9 <> 8 AND is_auto_fixable AND triggered THEN 'run-' || CAST(n + 1 AS STRING) END AS new_run_id,
       CASE WHEN n % 9 <> 8 AND is_auto_fixable AND triggered AND n % 10 <> 0 THEN n % 10 > 2 END AS rerun_succeeded,
       CAST(CASE WHEN n % 9 = 8 THEN 3 ELSE n % 3 END AS INT) AS retry_count,
       CAST(0.72 AS DOUBLE) + (n % 28) / CAST(100 AS DOUBLE) AS confidence_score,
       'handled ' || run_id AS message
FROM {candidates}
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed runs with a given category and whether a rerun could be triggered."""
    return spark.sql(CANDIDATES, runs=runs(spark, sf_dir))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(INCIDENTS, candidates=candidates(spark, sf_dir))


def duckdb_views() -> str:
    """The same tables as the start of a WITH list."""
    return f"r AS ({RUNS.format(events='events')}), c AS ({CANDIDATES.format(runs='r')}), i AS ({INCIDENTS.format(candidates='c')})"
