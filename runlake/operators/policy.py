"""Retry decisions, kept safe for one pipeline that has most of the runs.

What earlier runs of a pipeline decide is never a running window over all its rows. It is reduced to a
bounded state a pipeline by partial aggregates (the first attempts, an earliest or a latest key) and
joined back; Spark splits the join where a pipeline is hot. Order is (start_time, event order), total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlake.schemas import ALERT_SENT, AUTO_RERUN, BACKOFF_SECONDS, CANCELLED, FAILED, MAX_RETRIES, RETRY_BUDGET, RUNNING, SUCCEEDED, VERIFY_SECONDS


def order_key() -> Column:
    return F.struct("start_time", "run_id")


def first_attempts(runs: DataFrame, budget: int = RETRY_BUDGET) -> DataFrame:
    """pipeline_id and attempts: the order keys of its first ``budget`` runs that are fixable and triggered.

    The rank limit goes below the shuffle, so that each task sends at most ``budget`` rows a pipeline.
    """
    tried = runs.where(F.col("is_auto_fixable") & F.col("triggered")).select("pipeline_id", order_key().alias("k"))
    rank = F.row_number().over(Window.partitionBy("pipeline_id").orderBy("k"))
    return tried.withColumn("rank", rank).where(F.col("rank") <= budget).groupBy("pipeline_id").agg(F.array_sort(F.collect_list("k")).alias("attempts"))


def decide(runs: DataFrame, budget: int = RETRY_BUDGET, attempts: DataFrame | None = None) -> DataFrame:
    """Adds action_taken, success and retry_count to failed runs that have is_auto_fixable and triggered.

    ``attempts`` are the pipelines' first attempts where they are known already, as in a stream. With n attempts before it: n = budget gives max_retries_exceeded; a run that is not fixable or whose
    rerun was not triggered gives alert_sent; any other gives auto_rerun and counts as an attempt.
    """
    joined = runs.join(first_attempts(runs, budget) if attempts is None else attempts, "pipeline_id", "left")
    k = order_key()
    before = F.coalesce(F.size(F.filter("attempts", lambda a: a < k)), F.lit(0))
    tries = F.col("is_auto_fixable") & F.col("triggered")
    out = joined.withColumn("_n", F.when(F.col("attempts").isNull(), 0).otherwise(before))
    action = F.when(F.col("_n") >= budget, MAX_RETRIES).when(tries, AUTO_RERUN).otherwise(ALERT_SENT)
    out = out.withColumn("action_taken", action).withColumn("success", F.col("action_taken") == AUTO_RERUN)
    return out.withColumn("retry_count", (F.col("_n") + F.col("success").cast("int")).cast("int")).drop("_n", "attempts")


def backoff(decisions: DataFrame, time: str = "timestamp") -> DataFrame:
    """Adds next_attempt_at: the incident's time and the wait before its attempt; null without an attempt."""
    waits = F.array(*[F.lit(s) for s in BACKOFF_SECONDS])
    seconds = F.when(F.col("action_taken") == AUTO_RERUN, F.get(waits, F.col("retry_count") - 1))
    return decisions.withColumn("next_attempt_at", F.col(time) + F.make_dt_interval(secs=seconds))


def retry_once(attempts: DataFrame) -> DataFrame:
    """Adds escalate: whether an earlier attempt in the pipeline has failed for good.

    ``attempts`` has start_time, run_id and outcome: true succeeded, false failed, null still running;
    one that still runs is checked again in the next cycle and does not use the budget up yet.
    """
    bad = attempts.where(~F.col("outcome")).groupBy("pipeline_id").agg(F.min(order_key()).alias("_bad"))
    joined = attempts.join(bad, "pipeline_id", "left")
    return joined.withColumn("escalate", F.coalesce(F.col("_bad") < order_key(), F.lit(False))).drop("_bad")


def one_a_cycle(runs: DataFrame, cycle: str = "5 minutes") -> DataFrame:
    """Of the runs of a pipeline that start in one cycle, the latest."""
    own = F.window(F.col("start_time"), cycle)["start"]
    latest = F.max_by(F.struct(*runs.columns), F.struct("start_time", "run_id"))
    return runs.groupBy("pipeline_id", own.alias("cycle_start")).agg(latest.alias("r")).select("cycle_start", "r.*")


def not_superseded(failures: DataFrame, runs: DataFrame) -> DataFrame:
    """Failures without a later run of the pipeline that is running or has succeeded."""
    later = runs.where(F.col("status").isin(RUNNING, SUCCEEDED)).groupBy("pipeline_id").agg(F.max("start_time").alias("_last"))
    joined = failures.join(later, "pipeline_id", "left")
    return joined.where(F.col("_last").isNull() | (F.col("_last") <= F.col("start_time"))).drop("_last")


def rerun_outcome(incidents: DataFrame, runs: DataFrame, verify_seconds: int | None = VERIFY_SECONDS) -> DataFrame:
    """Adds outcome of the incident's rerun: true succeeded, false failed or cancelled, else null.

    With ``verify_seconds`` only an end within so many seconds of the incident counts; None takes the
    final status. Incidents without a rerun are not shuffled for the join.
    """
    asked, rest = incidents.where("new_run_id is not null"), incidents.where("new_run_id is null")
    ends = runs.select(F.col("run_id").alias("new_run_id"), F.col("status").alias("_status"), F.col("end_time").alias("_end"))
    joined = asked.join(ends, "new_run_id", "left")
    timely = F.lit(True) if verify_seconds is None else F.coalesce(F.col("_end") <= F.col("timestamp") + F.make_dt_interval(secs=F.lit(verify_seconds)), F.lit(False))
    outcome = F.when(timely & (F.col("_status") == SUCCEEDED), True).when(timely & F.col("_status").isin(FAILED, CANCELLED), False)
    judged = joined.withColumn("outcome", outcome).drop("_status", "_end")
    return judged.unionByName(rest.withColumn("outcome", F.lit(None).cast("boolean")))
