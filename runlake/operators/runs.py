"""Pipeline runs: normalised status, filters, counts, joins with logs and with what was handled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.functions.text import chosen, last_segment
from runlake.schemas import CANCELLED, FAILED, STATUSES


def with_status(runs: DataFrame, raw: str = "raw_status") -> DataFrame:
    """Adds status: the five known spellings by their meaning, anything else (also null) Failed."""
    return runs.withColumn("status", chosen(F.col(raw), STATUSES, F.lit(FAILED)))


def failed(runs: DataFrame, cancelled_too: bool = False) -> DataFrame:
    """Runs with status Failed, or also Cancelled."""
    return runs.where(F.col("status").isin([FAILED, CANCELLED] if cancelled_too else [FAILED]))


def items_of(items: DataFrame, kind: str) -> DataFrame:
    """Items of one type; an item without a name has its id as name."""
    return items.where(F.col("type") == kind).select("id", F.coalesce("display_name", "id").alias("name"), "type")


def item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("type").agg(F.count("*").alias("n"))


def within_minutes(runs: DataFrame, minutes: int, anchor: Column, time: str = "end_time") -> DataFrame:
    """Runs whose time is at most so many minutes before the anchor; those without a time are not."""
    return runs.where(F.col(time) >= anchor - F.make_dt_interval(mins=F.lit(minutes)))


def not_handled(runs: DataFrame, handled: DataFrame) -> DataFrame:
    """Runs whose id is not among the handled ones, once each; runs without an id (null, or ``unknown`` as ingested) are always new, every row."""
    known = F.coalesce(F.col("run_id") != "unknown", F.lit(False))
    new = runs.where(known).dropDuplicates(["run_id"]).join(handled.select("run_id"), "run_id", "left_anti")
    return new.unionByName(runs.where(~known))


def by_workspace(runs: DataFrame) -> DataFrame:
    return runs.groupBy("workspace_id").agg(F.count("*").alias("new_failures"))


#: Fixed value: what stands for a log that there is not.
NO_LOGS = "No detailed logs available."


def accepted(requests: DataFrame) -> DataFrame:
    """Adds new_run_id to rerun requests: what follows the last slash of the accepted request's location.

    Without a location, or with one that ends in a slash, the id is null: the rerun is not followed up.
    """
    return requests.withColumn("new_run_id", last_segment(F.col("location")))


def with_logs(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Adds log_text of ``logs`` (run_id, log_text); runs without one have the fixed sentence."""
    found = runs.join(logs.select("run_id", "log_text"), "run_id", "left")
    return found.withColumn("log_text", F.coalesce("log_text", F.lit(NO_LOGS)))


def run_counts(runs: DataFrame) -> DataFrame:
    """Runs and failed runs of each pipeline."""
    return runs.groupBy("pipeline_id").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == FAILED).alias("failed"))


def successful_pipelines(runs: DataFrame) -> DataFrame:
    """One row: pipelines, pipelines with a failure, and the others."""
    per = runs.groupBy("pipeline_id").agg(F.max(F.col("status") == FAILED).alias("bad"))
    return per.agg(F.count("*").alias("pipelines"), F.count_if("bad").alias("with_failures")).withColumn("successful", F.col("pipelines") - F.col("with_failures"))


def union_of(*parts: DataFrame) -> DataFrame:
    """Runs of several workspaces or pipelines as one frame, by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
