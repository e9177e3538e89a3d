"""Incident analytics: cleaning, filters by day, display columns, indicators, summaries.

Counts stay whole numbers; a rate is derived from them to one digit, halves to even. Times are UTC; the
zone of days and display is an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.functions.text import UUID, chosen, shortened, tenths
from runlake.schemas import ACTION_LABELS, ALERT_SENT, AUTO_RERUN, CRITICAL, ESCALATION_SECONDS, FIX_SECONDS, MAX_RETRIES, RESPONSE_SECONDS, RETRY_BUDGET, WARNING

ZONE = "Asia/Kolkata"
#: Columns of the export, in their order.
EXPORT = ("timestamp", "pipeline_name", "error_category", "action_taken", "success", "retry_count", "confidence_score", "root_cause")


def local(time: Column, zone: str = ZONE) -> Column:
    """A UTC time without zone as wall-clock time of a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), time)


def valid_timestamps(incidents: DataFrame, text: str = "timestamp") -> DataFrame:
    """Rows whose timestamp parses, as a timestamp without zone in UTC; others go."""
    parsed = F.col(text).try_cast("timestamp").cast("timestamp_ntz")
    return incidents.withColumn(text, parsed).where(F.col(text).isNotNull())


def last_days(incidents: DataFrame, days: int, anchor: Column) -> DataFrame:
    """Incidents from ``days`` days before the anchor on, without an upper end."""
    return incidents.where(F.col("timestamp") >= anchor - F.make_dt_interval(days=F.lit(days)))


def on_day(incidents: DataFrame, day: Column, zone: str = ZONE) -> DataFrame:
    """Incidents of one calendar day of a zone."""
    return incidents.where(F.to_date(local(F.col("timestamp"), zone)) == day)


def repaired_names(incidents: DataFrame) -> DataFrame:
    """A pipeline name that is an id in lower-case hex gives way to pipeline_id; null names stay null.

    A frame without the column gets the name Unknown.
    """
    if "pipeline_name" not in incidents.columns:
        return incidents.withColumn("pipeline_name", F.lit("Unknown"))
    name = F.col("pipeline_name")
    return incidents.withColumn("pipeline_name", F.when(name.rlike(UUID), F.col("pipeline_id")).otherwise(name))


def with_calendar(incidents: DataFrame) -> DataFrame:
    """Adds date, hour and weekday (three letters) in UTC."""
    time = F.col("timestamp")
    return incidents.withColumns({"date": F.to_date(time), "hour": F.hour(time), "weekday": F.date_format(time, "EEE")})


def severity(category: Column) -> Column:
    return F.when(category.isin(*CRITICAL), "CRITICAL").when(category.isin(*WARNING), "WARNING").otherwise("INFO")


def action_label(action: Column) -> Column:
    return chosen(action, ACTION_LABELS, F.upper(action))


def local_text(time: Column, zone: str = ZONE, suffix: str = "IST") -> Column:
    """Like ``05 Jan 2024, 07:08:09 PM IST``."""
    return F.concat(F.date_format(local(time, zone), "dd MMM yyyy, hh:mm:ss a"), F.lit(f" {suffix}"))


def newest(incidents: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest incidents; equal times by run_id."""
    return incidents.orderBy(F.desc("timestamp"), "run_id").limit(n)


def feed(incidents: DataFrame, n: int = 10, error_chars: int = 240, cause_chars: int = 200, budget: int = RETRY_BUDGET) -> DataFrame:
    """Display columns of the newest incidents; the texts are cut for display only, the incident rows keep them."""
    category, action = F.coalesce("error_category", F.lit("unknown")), F.coalesce("action_taken", F.lit("unknown"))
    confidence = F.coalesce("confidence_score", F.lit(0.0))
    return newest(incidents, n).select(
        "run_id",
        F.coalesce("pipeline_name", F.lit("Unknown Pipeline")).alias("name"),
        severity(category).alias("severity"),
        F.upper(F.replace(category, F.lit("_"), F.lit(" "))).alias("category"),
        action_label(action).alias("action"),
        F.when(F.col("retry_count") > 0, F.concat(F.lit("Retries: "), F.col("retry_count").cast("string"), F.lit(f"/{budget}"))).alias("retries"),
        F.when(confidence != 0, F.concat(F.lit("Confidence: "), F.floor(confidence * 100).cast("string"), F.lit("%"))).alias("confidence"),
        shortened(F.nullif(F.col("error_message"), F.lit("")), error_chars).alias("error"),
        shortened(F.nullif(F.col("root_cause"), F.lit("")), cause_chars).alias("cause"),
        local_text(F.col("timestamp")).alias("local_time"),
    )


def with_links(incidents: DataFrame, base_url: str) -> DataFrame:
    """Adds the portal links of the workspace and, if there is one, of the pipeline."""
    group = F.concat(F.lit(f"{base_url.rstrip('/')}/groups/"), F.col("workspace_id"))
    pipeline = F.concat(group, F.lit("/datapipelines/"), F.nullif(F.col("pipeline_id"), F.lit("")))
    return incidents.withColumns({"workspace_url": F.concat(group, F.lit("/list")), "pipeline_url": F.coalesce(pipeline, F.concat(group, F.lit("/list")))})


def alert_outbox(incidents: DataFrame, base_url: str, budget: int = RETRY_BUDGET) -> DataFrame:
    """run_id, title, facts and texts of the alert for each incident: rows that a sender takes from a table."""
    done = F.coalesce("success", F.lit(False))
    linked = with_links(incidents, base_url)
    return linked.select(
        "run_id",
        F.initcap(F.replace(F.col("action_taken"), F.lit("_"), F.lit(" "))).alias("title"),
        "pipeline_name",
        "workspace_id",
        "error_category",
        F.concat(F.floor(F.coalesce("confidence_score", F.lit(0.0)) * 100).cast("string"), F.lit("%")).alias("confidence"),
        F.concat(F.col("retry_count").cast("string"), F.lit(f"/{budget}")).alias("retry_attempt"),
        F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm"), F.lit(" UTC")).alias("time"),
        "root_cause",
        F.col("message").alias("action"),
        F.when(done, F.col("new_run_id")).alias("new_run"),
        F.when(~done, F.coalesce(F.col("recommended_action") if "recommended_action" in incidents.columns else F.lit(None).cast("string"), F.lit("Investigate manually"))).alias("recommended"),
        "pipeline_url",
        "workspace_url",
    )


def _counts() -> list[Column]:
    action = F.col("action_taken")
    return [F.count_if(action == AUTO_RERUN).alias("fixed"), F.count_if(action == ALERT_SENT).alias("escalated"), F.count_if(action == MAX_RETRIES).alias("maxr")]


def kpis(incidents: DataFrame, anchor: Column) -> DataFrame:
    """One row of indicators; rates are 0 where their whole is 0. avg_conf is in percent."""
    one = incidents.agg(
        F.count("*").alias("total"),
        *_counts(),
        F.count_if(F.col("rerun_succeeded")).alias("recovered"),
        F.count_if(F.col("timestamp") >= anchor - F.make_dt_interval(days=F.lit(1))).alias("last_day"),
        F.countDistinct("pipeline_name").alias("with_failures"),
        F.round(F.coalesce(F.avg(F.col("confidence_score").cast("decimal(20,6)")), F.lit(0)) * 100, 1).cast("double").alias("avg_conf"),
    )
    return one.withColumns({"fix_rate": tenths(F.col("fixed"), F.col("total")), "recover_rate": tenths(F.col("recovered"), F.col("fixed")), "recovery_ratio": tenths(F.col("recovered"), F.col("total"))})


def daily_trend(incidents: DataFrame) -> DataFrame:
    """Per UTC date: incidents that have a run_id, and how many had each action."""
    return incidents.groupBy(F.to_date("timestamp").alias("date")).agg(F.count("run_id").alias("total"), *_counts())


def category_breakdown(incidents: DataFrame) -> DataFrame:
    """Incidents by category with their share in percent, most first; null categories are left out."""
    per = incidents.where("error_category is not null").groupBy("error_category").agg(F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("whole"))  # one row
    return per.crossJoin(F.broadcast(whole)).select("error_category", "n", tenths(F.col("n"), F.col("whole")).alias("share")).orderBy(F.desc("n"), "error_category")


def daily_summary(incidents: DataFrame) -> DataFrame:
    """The daily trend with distinct pipelines, mean confidence and fix rate as numbers and as text, newest first."""
    per = incidents.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count("run_id").alias("total"),
        *_counts(),
        F.countDistinct("pipeline_name").alias("pipelines"),
        F.bround(F.avg(F.col("confidence_score").cast("decimal(20,6)")) * 100, 0).cast("int").alias("conf"),
    )
    rate = tenths(F.col("fixed"), F.col("total"))
    text = F.concat(F.col("conf").cast("string"), F.lit("%"))
    return per.withColumns({"fix_rate": rate, "conf_text": text, "fix_rate_text": F.concat(F.format_string("%.1f", rate), F.lit("%"))}).orderBy(F.desc("date"))


def date_bounds(incidents: DataFrame, zone: str = ZONE) -> DataFrame:
    """First and last local date."""
    day = F.to_date(local(F.col("timestamp"), zone))
    return incidents.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def export(incidents: DataFrame) -> DataFrame:
    """The columns of the export that there are, newest first; equal times by run_id where there is one."""
    kept = [c for c in EXPORT if c in incidents.columns]
    order = [F.desc("timestamp"), *(["run_id"] if "run_id" in incidents.columns else [])]
    return incidents.orderBy(*order).select(kept)


def sla(incidents: DataFrame, runs: DataFrame) -> DataFrame:
    """Per category: incidents, and how many met the targets for response, automatic fix and escalation.

    The response is the incident's time after its run's start, the fix the end of a rerun that succeeded,
    the escalation the response of what was not rerun.
    """
    start = runs.select("run_id", F.col("start_time").alias("_start"))
    ends = runs.select(F.col("run_id").alias("new_run_id"), F.col("end_time").alias("_end"))
    timed = incidents.join(start, "run_id", "left")
    asked = timed.where("new_run_id is not null").join(ends, "new_run_id", "left")
    timed = asked.unionByName(timed.where("new_run_id is null").withColumn("_end", F.lit(None).cast(runs.schema["end_time"].dataType)))
    seconds = lambda a, b: F.timestamp_diff("SECOND", a, b)
    response, fix = seconds(F.col("_start"), F.col("timestamp")), seconds(F.col("_start"), F.col("_end"))
    rerun = F.col("action_taken") == AUTO_RERUN
    return timed.groupBy("error_category").agg(
        F.count("*").alias("incidents"),
        F.count_if(response < RESPONSE_SECONDS).alias("response_met"),
        F.count_if(rerun & F.col("rerun_succeeded")).alias("fixes"),
        F.count_if(rerun & F.col("rerun_succeeded") & (fix < FIX_SECONDS)).alias("fix_met"),
        F.count_if(~rerun).alias("escalations"),
        F.count_if(~rerun & (response <= ESCALATION_SECONDS)).alias("escalation_met"),
    )
