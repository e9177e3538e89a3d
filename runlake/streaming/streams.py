"""Streams over landed run records. Each equals its batch operator on the rows that have arrived.

A batch is written under its batch id, replacing what a failed attempt of the same batch left, so that a
restart from the checkpoint repeats nothing. What a stream must remember is in its state store (runs seen,
retry counters, reruns awaited), in the store of the table it grows, or in the result itself where that is
small; no batch rereads what earlier ones wrote. Watermarks are given where order or waiting matters, and
nowhere else: other streams count late rows like any.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlake.operators.runs import failed, within_minutes
from runlake.plans.knowledge import incident_docs
from runlake.plans.store import Store, names
from runlake.schemas import CANCELLED, FAILED, RETRY_BUDGET, SUCCEEDED, VERIFY_SECONDS
from runlake.sources.records import LOG_TIME, flattened
from runlake.streaming.retry_state import in_event_order, keep_state_in_rocksdb, state_layout


def land(rows: DataFrame, path: str, time: str, part: int, parts: int) -> None:
    """Appends one of several equal spans of time to a folder, as files that a stream then finds."""
    ends = rows.agg(F.min(time).alias("a"), F.max(time).alias("b")).first()
    from_, to = (ends["a"] + (ends["b"] - ends["a"]) * i / parts for i in (part, part + 1))
    span = (F.lit(part == 0) | (F.col(time) >= F.lit(from_))) & (F.lit(part == parts - 1) | (F.col(time) < F.lit(to)))
    rows.where(span).write.mode("append").parquet(path)


def beat(spark: SparkSession, path: str, **values: Column) -> None:
    """Lands one row of the given columns, all others null: a beat moves the event time on where no run does."""
    schema = spark.read.parquet(path).schema
    row = [values[f.name].cast(f.dataType).alias(f.name) if f.name in values else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*row).write.mode("append").parquet(path)


def arrived(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """The files of a folder as a stream; what has arrived since the last batch is one batch, or several of so many files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def drain(stream: DataFrame, base: str, each: Callable[[DataFrame, int], None], mode: str = "append", stateful: bool = False) -> StreamingQuery:
    """Hands every batch that has arrived to ``each`` (rows, batch id) and ends; a later call goes on from there.

    ``stateful``: the stream itself keeps a state, in few stores (``state_layout``).
    """
    with state_layout(stream.sparkSession) if stateful else nullcontext():
        query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def put(rows: DataFrame, base: str, table: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{base}/{table}/batch={batch}")


def all_of(spark: SparkSession, base: str, table: str) -> DataFrame:
    """What all batches have put into a table."""
    return spark.read.option("basePath", f"{base}/{table}").parquet(f"{base}/{table}").drop("batch")


def newest(spark: SparkSession, base: str, table: str) -> DataFrame:
    """What the last finished batch has put into a table, also when a call found nothing new."""
    done = [int(n.split("=")[1]) for n in names(spark, f"{base}/{table}/batch=*") if names(spark, f"{base}/{table}/{n}/_SUCCESS")]
    return spark.read.parquet(f"{base}/{table}/batch={max(done)}")


def ingest(runs: DataFrame, base: str) -> DataFrame:
    """Runs appended as they arrive, by the file sink: exactly once over restarts."""
    runs.writeStream.format("parquet").option("path", f"{base}/runs").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return runs.sparkSession.read.schema(runs.schema).parquet(f"{base}/runs")


def tolerant(each: Callable[[DataFrame, int], None], base: str) -> Callable[[DataFrame, int], None]:
    """``each``, but a batch for which it fails is kept as it came, with the error, and the next one goes on.

    The batch is in ``quarantine``, the error in ``errors`` (batch, error). What fails to be kept still ends the stream.
    """

    def guarded(rows: DataFrame, batch: int) -> None:
        try:
            each(rows, batch)
        except Exception as e:  # noqa: BLE001  any failure of a cycle is its own; the loop outlives it
            text = str(e.getCondition() or e) if isinstance(e, PySparkException) else f"{type(e).__name__}: {e}"
            put(rows, base, "quarantine", batch)
            put(rows.sparkSession.createDataFrame([(text[:1000],)], "error string"), base, "errors", batch)

    return guarded


def quarantined(spark: SparkSession, base: str) -> list[int]:
    """The batches that wait in quarantine: kept in full and not yet replayed."""
    here = lambda table: {int(n.split("=")[1]) for n in names(spark, f"{base}/{table}/batch=*") if names(spark, f"{base}/{table}/{n}/_SUCCESS")}
    return sorted(here("errors") - here("replayed"))


def replay(spark: SparkSession, base: str, each: Callable[[DataFrame, int], None]) -> list[int]:
    """Hands the batches of the quarantine to ``each`` again, under their ids; gives those that now succeeded."""
    done = []
    for batch in quarantined(spark, base):
        each(spark.read.parquet(f"{base}/quarantine/batch={batch}"), batch)
        put(spark.createDataFrame([(batch,)], "batch_id long"), base, "replayed", batch)
        done.append(batch)
    return done


def poll(stream: DataFrame, base: str, each: Callable[[DataFrame, int], None], every: str = "300 seconds", stop: str | None = None, look: float = 1.0) -> StreamingQuery:
    """Polls until a file named ``stop`` is there: a batch every so often, failed ones into quarantine.

    The batch in progress is finished first. Without ``stop`` it goes on until the query is stopped elsewhere.
    """
    query = stream.writeStream.foreachBatch(tolerant(each, base)).option("checkpointLocation", f"{base}/checkpoint").trigger(processingTime=every).start()
    while query.isActive and not (stop and names(stream.sparkSession, stop)):
        time.sleep(look)
    if query.isActive:
        query.processAllAvailable()
        query.stop()
    elif query.exception():
        raise query.exception()
    return query


def ingest_tolerant(runs: DataFrame, base: str, check: Callable[[DataFrame], None]) -> DataFrame:
    """Runs appended batch by batch; a batch that ``check`` raises for goes into quarantine as a whole."""

    def each(rows: DataFrame, batch: int) -> None:
        check(rows)
        put(rows, base, "runs", batch)

    drain(runs, base, tolerant(each, base))
    return all_of(runs.sparkSession, base, "runs")


def once_each(runs: DataFrame, base: str, within: str | None = None) -> DataFrame:
    """Every run once: repeats within a batch and of earlier batches go; of differing rows of a run, any one stays.

    The ids seen are in the state store, partitioned and indexed by id: a batch looks up its own ids and
    opens nothing that earlier batches wrote. Without ``within`` a run is handled once ever and the state
    holds every id; with it, repeats are known for so long after the run's start, and the state is bounded.
    """
    keep_state_in_rocksdb(runs.sparkSession)
    if within is None:
        once = runs.dropDuplicates(["run_id"])
    else:
        timed = runs.withColumn("_start", F.col("start_time").cast("timestamp")).withWatermark("_start", within)
        once = timed.dropDuplicatesWithinWatermark(["run_id"]).drop("_start")
    drain(once, base, lambda rows, batch: put(rows, base, "seen", batch), stateful=True)
    return all_of(runs.sparkSession, base, "seen")


def retry_decisions(candidates: DataFrame, base: str, lateness: str, budget: int = RETRY_BUDGET) -> DataFrame:
    """The retry policy on runs that arrive in any order, within ``lateness``; what the watermark has passed is decided."""
    drain(in_event_order(candidates, lateness, budget), base, lambda rows, batch: put(rows, base, "decisions", batch), stateful=True)
    return all_of(candidates.sparkSession, base, "decisions")


def awaited_outcomes(incidents: DataFrame, runs: DataFrame, lateness: str, early: str = "0 seconds", verify_seconds: int = VERIFY_SECONDS) -> DataFrame:
    """run_id, new_run_id, timestamp and outcome of incidents, both sides streams.

    A rerun counts if it ends at most ``verify_seconds`` after its incident, and at most ``early`` before
    it (a clock that is behind): true succeeded, false failed or cancelled. An incident whose rerun has not
    ended by then, or never appears, comes out with null once both watermarks, ``lateness`` behind what has
    arrived, have passed that time. Ended runs and incidents are held no longer than that. Incidents
    without a rerun come out at once and are never held. Rows later than the watermark are dropped.
    """
    keep_state_in_rocksdb(incidents.sparkSession)
    asked = incidents.where("new_run_id is not null").select("run_id", "new_run_id", "timestamp", F.col("timestamp").cast("timestamp").alias("_asked")).withWatermark("_asked", lateness)
    final = runs.where(F.col("status").isin(SUCCEEDED, FAILED, CANCELLED) & F.col("end_time").isNotNull() & F.col("run_id").isNotNull())
    ended = final.select(F.col("run_id").alias("_rerun"), (F.col("status") == SUCCEEDED).alias("outcome"), F.col("end_time").cast("timestamp").alias("_ended")).withWatermark("_ended", lateness)
    in_time = F.expr(f"new_run_id = _rerun AND _ended >= _asked - INTERVAL {early} AND _ended <= _asked + INTERVAL {int(verify_seconds)} seconds")
    columns = ["run_id", "new_run_id", "timestamp", "outcome"]
    rest = incidents.where("new_run_id is null").withColumn("outcome", F.lit(None).cast("boolean"))
    return asked.join(ended, in_time, "leftOuter").select(columns).unionByName(rest.select(columns))


def outcomes(incidents: DataFrame, runs: DataFrame, base: str, lateness: str, early: str = "0 seconds", verify_seconds: int = VERIFY_SECONDS) -> DataFrame:
    """Outcomes of reruns as incidents and runs arrive; what is still awaited is not in the result yet."""
    drain(awaited_outcomes(incidents, runs, lateness, early, verify_seconds), base, lambda rows, batch: put(rows, base, "outcomes", batch), stateful=True)
    return all_of(incidents.sparkSession, base, "outcomes")


def audit(results: DataFrame, base: str) -> str:
    """Appends flat incidents as JSON lines by the file sink and gives the log's path."""
    flattened(results).writeStream.format("json").options(**LOG_TIME).option("path", f"{base}/log").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{base}/log"


def recent_failures(runs: DataFrame, base: str, minutes: int) -> DataFrame:
    """Failures that ended at most so many minutes before the newest end of their batch."""

    def each(rows: DataFrame, batch: int) -> None:
        newest = rows.agg(F.max("end_time").alias("anchor"))  # one row
        near = failed(rows).crossJoin(F.broadcast(newest))
        put(within_minutes(near, minutes, F.col("anchor")).drop("anchor"), base, "recent", batch)

    drain(runs, base, each)
    return all_of(runs.sparkSession, base, "recent")


def daily_counts(incidents: DataFrame, base: str) -> DataFrame:
    """Incidents by UTC day and category, refreshed with every batch; the state is one row a day and category."""
    counts = incidents.groupBy(F.to_date("timestamp").alias("date"), "error_category").agg(F.count("*").alias("n"))
    drain(counts, base, lambda rows, batch: put(rows, base, "daily", batch), "complete", stateful=True)
    return newest(incidents.sparkSession, base, "daily")


def grow_knowledge(incidents: DataFrame, base: str) -> DataFrame:
    """Resolved incidents merged into the knowledge store; the newest incident of a text wins over batches."""
    spark = incidents.sparkSession
    store = Store(spark, f"{base}/knowledge")

    def each(rows: DataFrame, batch: int) -> None:
        store.merge(incident_docs(rows, versioned=True), batch)

    drain(incidents, base, each)
    found = store.read()
    return spark.createDataFrame([], "id string, document string, source string, type string") if found is None else found.drop("version")
