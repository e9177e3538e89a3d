"""Run records and the incident log as JSON text: tolerant readers, writer, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.operators.incidents import export, valid_timestamps
from runlake.operators.runs import with_status
from runlake.schemas import INCIDENT_LOG, RUN_RECORD


def _time(text: Column) -> Column:
    """An ISO time as a timestamp without zone in UTC; what does not parse is null."""
    return text.try_cast("timestamp").cast("timestamp_ntz")


def ingest_runs(records: DataFrame, anchor: Column) -> tuple[DataFrame, DataFrame]:
    """Typed runs from records (workspace_id, pipeline_id, pipeline_name, record: JSON text), and the rejects.

    The id falls back from id to runId to ``unknown``, an empty pipeline name to the record's id, then
    ``Unknown``; the message from failureReason to errorMessage. A record without a start gets the
    anchor. Text that is no JSON object, and times that do not parse, are rejects.
    """
    parsed = records.withColumn("r", F.from_json("record", f"{RUN_RECORD}, _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    start, end = F.col("r.startTimeUtc"), F.col("r.endTimeUtc")
    given = lambda x: x.isNotNull() & (x != "")
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | F.trim(F.coalesce("record", F.lit(""))).rlike(r"^[^{]|^$") | (given(start) & _time(start).isNull()) | (given(end) & _time(end).isNull())
    marked = parsed.withColumn("bad", F.coalesce(bad, F.lit(True)))
    good = marked.where("not bad").select(
        "pipeline_id",
        F.coalesce(F.nullif("pipeline_name", F.lit("")), "r.id", F.lit("Unknown")).alias("pipeline_name"),
        F.coalesce("r.id", "r.runId", F.lit("unknown")).alias("run_id"),
        "workspace_id",
        F.col("r.status").alias("raw_status"),
        F.when(given(start), _time(start)).otherwise(anchor).alias("start_time"),
        F.when(given(end), _time(end)).alias("end_time"),
        F.coalesce("r.failureReason", "r.errorMessage").alias("error_message"),
        F.col("r.errorCode").alias("error_code"),
    )
    return with_status(good).drop("raw_status"), marked.where("bad").select("workspace_id", "pipeline_id", "record")


def incidents_from_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Incidents from JSON lines; blank lines, broken ones, those that hold no object and those without a valid time go.

    An incident without a run id stays, with a null one.
    is_auto_fixable may be a boolean or a number: true and numbers other than 0 are true.
    """
    parsed = lines.where(F.trim(F.col(value)).startswith("{")).select(F.from_json(value, INCIDENT_LOG, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("i")).select("i.*")
    clean = parsed.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    fixable = F.coalesce(F.col("is_auto_fixable").try_cast("boolean"), F.col("is_auto_fixable").try_cast("double") != 0)
    return valid_timestamps(clean.withColumn("is_auto_fixable", fixable))


def read_incidents(spark, path: str) -> DataFrame:
    """The incident log at a path: text files of JSON lines, split like any text."""
    return incidents_from_lines(spark.read.text(path))


def flattened(results: DataFrame) -> DataFrame:
    """Flat incidents from nested results: diagnosis (with its run), action, outcome."""
    run = "diagnosis.pipeline_run"
    return results.select(
        "timestamp",
        f"{run}.pipeline_name",
        f"{run}.pipeline_id",
        f"{run}.run_id",
        f"{run}.workspace_id",
        "diagnosis.error_category",
        "diagnosis.is_auto_fixable",
        f"{run}.error_message",
        "diagnosis.root_cause",
        "action_taken",
        "success",
        "new_run_id",
        "rerun_succeeded",
        "retry_count",
        "diagnosis.confidence_score",
        "message",
    )


#: How times are written to the log: all digits, in UTC.
LOG_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def append_incidents(incidents: DataFrame, path: str) -> None:
    """Appends to the incident log as JSON lines."""
    incidents.write.mode("append").options(**LOG_TIME).json(path)


def write_export(incidents: DataFrame, path: str) -> None:
    """The export as CSV with a header, newest first; range-partitioned files keep the order."""
    export(incidents).write.mode("overwrite").csv(path, header=True)
