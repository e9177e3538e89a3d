"""One query for each operator, over whole tables, and the DuckDB SQL that says what it should give.

QUERIES maps a name to a function of (spark, sf_dir); ORACLE maps most names to SQL. ``r``, ``c`` and
``i`` are the stand-in runs, failed runs and incidents of ``views``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake import views
from runlake.operators import budget, classify, incidents as inc, policy, rollup, rule_index, runs as ops
from runlake.plans import knowledge as kb, medallion as med, vectors
from runlake.plans.search import ranked, search
from runlake.plans.store import Store
from runlake.schemas import ERROR_RULES, ESCALATION, PHRASE_RULES
from runlake.sources import raw, records
from runlake.storage import new_path
from runlake.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BASE_URL = "https://portal.example"


def query(sql: str | None = None, views_too: bool = True):
    """Registers a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            if views_too:
                with_ = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.startswith(w)), None)
                body = f"{with_}{views.duckdb_views()}, {body[len(with_):]}" if with_ else f"WITH {views.duckdb_views()} {body}"
            ORACLE[f.__name__] = body
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _runs(spark, sf_dir):
    return ops.with_status(views.runs(spark, sf_dir))


def _failed(spark, sf_dir):
    return ops.failed(_runs(spark, sf_dir))


def _newest(df: DataFrame, column: str = "timestamp"):
    """The fixed "now" of a query: the newest time, one value."""
    return F.lit(df.agg(F.max(column)).first()[0])


STATUS = "CASE raw_status WHEN 'Failed' THEN 'Failed' WHEN 'Succeeded' THEN 'Succeeded' WHEN 'Running' THEN 'Running' WHEN 'Cancelled' THEN 'Cancelled' WHEN 'Canceled' THEN 'Cancelled' ELSE 'Failed' END"
RUN = "run_id, pipeline_id, pipeline_name, workspace_id, start_time, end_time, error_message, error_code"
INCIDENT = "timestamp, pipeline_name, pipeline_id, run_id, workspace_id, error_category, is_auto_fixable, error_message, root_cause, action_taken, success, new_run_id, rerun_succeeded, retry_count, confidence_score, message"


def _columns(text: str) -> list[str]:
    return text.split(", ")


# ---------------------------------------------------------------- sources


@query("SELECT * FROM orders", views_too=False)
def raw_copy(spark, sf_dir):
    path = raw.copy_table(table(spark, sf_dir, "orders"), new_path(spark, "raw"), "orders", date(2024, 1, 31))
    return spark.read.parquet(path)


@query("SELECT *, DATE '2024-01-30' AS _ingest_date FROM orders UNION ALL SELECT *, DATE '2024-02-01' FROM orders", views_too=False)
def raw_scan(spark, sf_dir):
    base = new_path(spark, "raw")
    for day in (date(2024, 1, 30), date(2024, 2, 1)):
        raw.copy_table(table(spark, sf_dir, "orders"), base, "orders", day)
    return raw.scan_snapshots(spark, base, "orders")


@query("SELECT *, DATE '2024-02-01' AS _ingest_date FROM orders", views_too=False)
def raw_scan_since(spark, sf_dir):
    base = new_path(spark, "raw")
    for day in (date(2024, 1, 30), date(2024, 2, 1)):
        raw.copy_table(table(spark, sf_dir, "orders"), base, "orders", day)
    return raw.scan_snapshots(spark, base, "orders", date(2024, 1, 31))


@query(
    """SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, CAST(o_orderkey % 100 AS BIGINT) AS batch, DATE '2024-01-30' AS _ingest_date FROM orders
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, NULL, DATE '2024-01-31' FROM orders
    UNION ALL SELECT o_orderkey, NULL, o_orderstatus, o_totalprice, o_orderdate, NULL, o_orderkey + 5000000000, DATE '2024-02-01' FROM orders""",
    views_too=False,
)
def raw_scan_evolved(spark, sf_dir):
    """Three days: a column more and one less, narrow numbers that widen, a date that becomes a time."""
    base, o = new_path(spark, "raw"), table(spark, sf_dir, "orders")
    raw.copy_table(o.drop("o_orderstatus").withColumn("batch", (F.col("o_orderkey") % 100).cast("int")), base, "orders", date(2024, 1, 30))
    raw.copy_table(o.withColumn("o_totalprice", F.col("o_totalprice").cast("double")), base, "orders", date(2024, 1, 31))
    raw.copy_table(o.drop("o_custkey", "o_orderpriority").withColumn("batch", F.col("o_orderkey") + 5000000000), base, "orders", date(2024, 2, 1))
    found = raw.scan_snapshots(spark, base, "orders")
    return found.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "batch", "_ingest_date")


@query("SELECT c_custkey, true AS has_time, true AS from_table FROM customer", views_too=False)
def bronze_provenance(spark, sf_dir):
    found = raw.with_provenance(table(spark, sf_dir, "customer"))
    return found.select("c_custkey", F.col("_ingested_at").isNotNull().alias("has_time"), F.col("_source_file").contains("customer.parquet").alias("from_table"))


@query("SELECT *, DATE '2024-01-31' AS _ingest_date FROM customer", views_too=False)
def bronze_load(spark, sf_dir):
    base = new_path(spark, "lake")
    raw.copy_table(table(spark, sf_dir, "customer"), f"{base}/raw", "customer", date(2024, 1, 31))
    med.save(med.bronze(spark, f"{base}/raw", "customer"), f"{base}/bronze_customer")
    return spark.read.parquet(f"{base}/bronze_customer").drop("_ingested_at", "_source_file")


@query(
    """SELECT 'customer' AS table_name, 'OK' AS status, count(*) AS n_rows FROM customer UNION ALL SELECT 'orders', 'OK', count(*) FROM orders
    UNION ALL SELECT 'lineitem', 'OK', count(*) FROM lineitem UNION ALL SELECT 'missing', 'SKIP', NULL""",
    views_too=False,
)
def load_report(spark, sf_dir):
    base = new_path(spark, "lake")
    load = lambda name: lambda: med.save(raw.with_provenance(table(spark, sf_dir, name)), f"{base}/bronze_{name}")
    return med.load_report(spark, {n: load(n) for n in ("customer", "orders", "lineitem", "missing")}).drop("error")


def _lines(spark, sf_dir):
    """The incidents as JSON lines, after each one without a run id (absent or null), a blank, a broken one and one that is no object."""
    line = lambda names, nulls: F.to_json(F.struct(*names), {"ignoreNullFields": nulls, **records.LOG_TIME})
    nameless = [F.lit(None).cast("string").alias(c) if c == "run_id" else F.col(c) for c in _columns(INCIDENT)]
    good = views.incidents(spark, sf_dir).select(line(_columns(INCIDENT), "false").alias("value"), F.when(F.col("success"), line(nameless, "false")).otherwise(line(nameless, "true")).alias("nameless"))
    return good.select(F.explode(F.array("value", "nameless", F.lit("  "), F.left("value", F.lit(25)), F.concat(F.lit("["), "value", F.lit("]")))).alias("value"))


@query(f"SELECT {INCIDENT} FROM i UNION ALL SELECT {INCIDENT.replace('run_id, workspace', 'NULL, workspace')} FROM i")
def incident_log_read(spark, sf_dir):
    return records.incidents_from_lines(_lines(spark, sf_dir))


def _results(incidents: DataFrame) -> DataFrame:
    """Incidents nested as a healer reports them."""
    run = F.struct("pipeline_name", "pipeline_id", "run_id", "workspace_id", "error_message").alias("pipeline_run")
    return incidents.select("timestamp", F.struct(run, "error_category", "is_auto_fixable", "root_cause", "confidence_score").alias("diagnosis"), "action_taken", "success", "new_run_id", "rerun_succeeded", "retry_count", "message")


@query(f"SELECT {INCIDENT} FROM i")
def incident_flatten(spark, sf_dir):
    return records.flattened(_results(views.incidents(spark, sf_dir)))


@query("SELECT timestamp, pipeline_name, error_category, action_taken, success, retry_count, confidence_score, root_cause FROM i ORDER BY timestamp DESC, run_id")
def incident_export(spark, sf_dir):
    return inc.export(views.incidents(spark, sf_dir))


@query(f"SELECT pipeline_id, pipeline_name, run_id, workspace_id, {STATUS} AS status, start_time, end_time, error_message, error_code FROM r")
def run_ingest(spark, sf_dir):
    r = views.runs(spark, sf_dir)
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    record = F.to_json(F.struct(F.col("run_id").alias("id"), F.col("raw_status").alias("status"), iso("start_time").alias("startTimeUtc"), iso("end_time").alias("endTimeUtc"), F.col("error_message").alias("failureReason"), F.col("error_code").alias("errorCode")))
    each = r.select("workspace_id", "pipeline_id", "pipeline_name", F.explode(F.array(record, F.lit("{broken"))).alias("record"))
    return records.ingest_runs(each, F.lit(None).cast("timestamp_ntz"))[0]


# ---------------------------------------------------------------- runs


@query(f"SELECT {RUN}, raw_status, {STATUS} AS status FROM r")
def run_status_normalised(spark, sf_dir):
    return _runs(spark, sf_dir).drop("event_id")


@query(f"SELECT {RUN} FROM r WHERE {STATUS} = 'Failed'")
def failed_runs(spark, sf_dir):
    return _failed(spark, sf_dir).select(*_columns(RUN))


@query(f"SELECT {RUN} FROM r WHERE {STATUS} IN ('Failed', 'Cancelled')")
def failed_or_cancelled_runs(spark, sf_dir):
    return ops.failed(_runs(spark, sf_dir), cancelled_too=True).select(*_columns(RUN))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("item-"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") > 5, F.col("p_name")).alias("display_name"), F.col("p_type").alias("type"))


@query("SELECT 'item-' || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size > 5 THEN p_name ELSE 'item-' || CAST(p_partkey AS VARCHAR) END AS name, p_type AS type FROM part WHERE p_type = 'ECONOMY'", views_too=False)
def pipeline_items(spark, sf_dir):
    return ops.items_of(_items(spark, sf_dir), "ECONOMY")


@query("SELECT p_type AS type, count(*) AS n FROM part GROUP BY p_type", views_too=False)
def total_pipelines(spark, sf_dir):
    return ops.item_counts(_items(spark, sf_dir))


@query(f"SELECT {RUN} FROM r WHERE {STATUS} = 'Failed' AND end_time >= (SELECT max(end_time) FROM r) - INTERVAL '60' MINUTE")
def failed_runs_lookback(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return ops.within_minutes(ops.failed(r), 60, _newest(r, "end_time")).select(*_columns(RUN))


@query(f"SELECT {RUN} FROM r WHERE {STATUS} = 'Failed' AND run_id NOT IN (SELECT run_id FROM i WHERE action_taken = 'alert_sent')")
def new_failures(spark, sf_dir):
    handled = views.incidents(spark, sf_dir).where("action_taken = 'alert_sent'")
    return ops.not_handled(_failed(spark, sf_dir), handled).select(*_columns(RUN))


@query(f"SELECT workspace_id, count(*) AS new_failures FROM r WHERE {STATUS} = 'Failed' AND run_id NOT IN (SELECT run_id FROM i WHERE action_taken = 'alert_sent') GROUP BY workspace_id")
def new_failures_by_workspace(spark, sf_dir):
    handled = views.incidents(spark, sf_dir).where("action_taken = 'alert_sent'")
    return ops.by_workspace(ops.not_handled(_failed(spark, sf_dir), handled))


@query("SELECT run_id, CASE WHEN event_id % 4 = 1 OR event_id % 4 = 2 THEN NULL ELSE 'run-' || CAST(event_id + 1 AS VARCHAR) END AS new_run_id FROM r")
def rerun_ids(spark, sf_dir):
    """Requests with a location, with an empty last part, without one, and with a bare id."""
    ident, n = F.concat(F.lit("run-"), (F.col("event_id") + 1).cast("string")), F.col("event_id") % 4
    location = F.when(n == 0, F.concat(F.lit(f"{BASE_URL}/workspaces/"), "workspace_id", F.lit("/jobs/"), ident)).when(n == 1, F.lit(f"{BASE_URL}/jobs/")).when(n == 3, ident)
    return ops.accepted(_runs(spark, sf_dir).withColumn("location", location)).select("run_id", "new_run_id")


def _logs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("run-"), F.col("doc_id").cast("string")).alias("run_id"), F.col("text").alias("log_text"))


@query("SELECT r.run_id, pipeline_id, coalesce(d.text, 'No detailed logs available.') AS log_text FROM r LEFT JOIN documents d ON r.run_id = 'run-' || CAST(d.doc_id AS VARCHAR)")
def run_logs_join(spark, sf_dir):
    return ops.with_logs(_runs(spark, sf_dir), _logs(spark, sf_dir)).select("run_id", "pipeline_id", "log_text")


@query(f"SELECT pipeline_id, count(*) AS runs, count(CASE WHEN {STATUS} = 'Failed' THEN 1 END) AS failed FROM r GROUP BY pipeline_id")
def run_counts(spark, sf_dir):
    return ops.run_counts(_runs(spark, sf_dir))


@query(f"SELECT count(*) AS pipelines, count(CASE WHEN bad THEN 1 END) AS with_failures, count(CASE WHEN NOT bad THEN 1 END) AS successful FROM (SELECT pipeline_id, bool_or({STATUS} = 'Failed') AS bad FROM r GROUP BY pipeline_id)")
def successful_pipelines(spark, sf_dir):
    return ops.successful_pipelines(_runs(spark, sf_dir))


@query(f"SELECT {RUN} FROM r")
def runs_union(spark, sf_dir):
    r = views.runs(spark, sf_dir).select(*_columns(RUN))
    return ops.union_of(*[r.where(F.col("workspace_id") == f"ws-{i}") for i in range(3)])


# ---------------------------------------------------------------- classification

TEXT = "coalesce(error_message, '') || ' ' || coalesce(error_code, '')"


def _case(rules, test, value, otherwise):
    return "CASE " + " ".join(f"WHEN {test(x)} THEN {value(i, x)}" for i, x in enumerate(rules)) + f" ELSE {otherwise} END"


def _found(rule):
    return f"regexp_matches({TEXT}, '{rule[0]}')"


def _held(rule):
    return f"contains(coalesce(error_message, ''), '{rule[0]}')"


@query(
    f"""SELECT run_id, CAST({_case(ERROR_RULES, _found, lambda i, x: i, 'NULL')} AS INTEGER) AS rule_id, {_case(ERROR_RULES, _found, lambda i, x: f"'{x[1]}'", "'unknown'")} AS error_category,
    {_case(ERROR_RULES, _found, lambda i, x: str(x[2]).lower(), 'false')} AS is_auto_fixable, CAST({_case(ERROR_RULES, _found, lambda i, x: 1, 0)} AS DOUBLE) AS confidence_score FROM r WHERE {STATUS} = 'Failed'"""
)
def classify_errors(spark, sf_dir):
    return classify.classify(_failed(spark, sf_dir)).select("run_id", "rule_id", "error_category", "is_auto_fixable", "confidence_score")


@query(
    f"""SELECT doc_id, CAST({_case(PHRASE_RULES, _held, lambda i, x: i, 'NULL')} AS INTEGER) AS phrase_id, {_case(PHRASE_RULES, _held, lambda i, x: f"'{x[1]}'", "'unknown'")} AS phrase_category,
    {_case(PHRASE_RULES, _held, lambda i, x: str(x[2]).lower(), 'false')} AS phrase_fixable, CAST({_case(PHRASE_RULES, _held, lambda i, x: x[3] or 'NULL', 'NULL')} AS INTEGER) AS wait_minutes
    FROM (SELECT doc_id, text || CASE doc_id % 9 {' '.join(f"WHEN {i} THEN ' {x[0]}'" for i, x in enumerate(PHRASE_RULES))} ELSE '' END AS error_message FROM documents)""",
    views_too=False,
)
def classify_phrases(spark, sf_dir):
    phrases = F.array(*[F.lit(f" {x[0]}") for x in PHRASE_RULES], F.lit(""))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.get(phrases, (F.col("doc_id") % 9).cast("int"))).alias("error_message"))
    return classify.classify_phrases(texts).select("doc_id", "phrase_id", "phrase_category", "phrase_fixable", "wait_minutes")


UNIT_TEXT = "coalesce(error_message, '') || ' in unit-' || CAST(event_id % (SELECT 2 * count(*) FROM customer) AS VARCHAR) || CASE WHEN event_id % 3 = 0 THEN '-low' ELSE '-high' END"


@query(
    f"""WITH t AS (SELECT run_id, {UNIT_TEXT} AS m, event_id, coalesce(error_code, '') AS k FROM r WHERE {STATUS} = 'Failed'),
    u AS (SELECT t.run_id, min(c_custkey) AS rule_id FROM t JOIN customer ON contains(m || ' ' || k, 'unit-' || CAST(c_custkey AS VARCHAR) || '-low ') OR contains(m || ' ' || k, 'unit-' || CAST(c_custkey AS VARCHAR) || '-high ') GROUP BY 1),
    g AS (SELECT run_id, 1000000000 + {_case(ERROR_RULES, lambda x: f"regexp_matches(m || ' ' || k, '{x[0]}')", lambda i, x: i, 'NULL')} AS rule_id FROM t)
    SELECT t.run_id, CAST(coalesce(u.rule_id, g.rule_id) AS BIGINT) AS rule_id, CASE WHEN u.rule_id IS NOT NULL THEN lower(c_mktsegment) ELSE coalesce({_case(ERROR_RULES, lambda x: f"regexp_matches(m || ' ' || k, '{x[0]}')", lambda i, x: f"'{x[1]}'", 'NULL')}, 'unknown') END AS error_category
    FROM t JOIN g USING (run_id) LEFT JOIN u USING (run_id) LEFT JOIN customer ON c_custkey = u.rule_id"""
)
def classify_by_index(spark, sf_dir):
    """A rule for each customer, as a unit that errors name, before the nine general ones."""
    customer = table(spark, sf_dir, "customer")
    own = customer.select(F.col("c_custkey").cast("long").alias("rule_id"), F.concat(F.lit("unit-"), F.col("c_custkey").cast("string"), F.lit("-(?:low|high) ")).alias("error_pattern"), F.lower("c_mktsegment").alias("category"), F.lit(True).alias("is_auto_fixable"))
    general = spark.createDataFrame([(10**9 + i, *x) for i, x in enumerate(ERROR_RULES)], "rule_id long, error_pattern string, category string, is_auto_fixable boolean")
    units = customer.agg((2 * F.count("*")).alias("units"))  # one row
    unit = F.concat(F.lit(" in unit-"), (F.col("event_id") % F.col("units")).cast("string"), F.when(F.col("event_id") % 3 == 0, "-low").otherwise("-high"))
    failed = _failed(spark, sf_dir).join(F.broadcast(units)).withColumn("error_message", F.concat(F.coalesce("error_message", F.lit("")), unit))
    return rule_index.classify_by_table(failed, own.unionByName(general)).select("run_id", "rule_id", "error_category")


def _route(k):
    return f"CASE error_category {' '.join(f"WHEN '{x[0]}' THEN '{x[k]}'" for x in ESCALATION)} END"


@query(f"SELECT run_id, error_category, {_route(1)} AS l1_action, {_route(2)} AS l2_action, {_route(3)} AS team FROM i")
def escalation_routing(spark, sf_dir):
    return classify.routed(views.incidents(spark, sf_dir)).select("run_id", "error_category", "l1_action", "l2_action", "team")


# ---------------------------------------------------------------- retry policy

BEFORE = "coalesce(sum(CASE WHEN is_auto_fixable AND triggered THEN 1 ELSE 0 END) OVER (PARTITION BY pipeline_id ORDER BY start_time, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
POLICY = f"""WITH w AS (SELECT *, CAST(least(3, {BEFORE}) AS INTEGER) AS n_before FROM c),
    p AS (SELECT *, CASE WHEN n_before >= 3 THEN 'max_retries_exceeded' WHEN is_auto_fixable AND triggered THEN 'auto_rerun' ELSE 'alert_sent' END AS action_taken FROM w)"""
DECISION = "run_id, pipeline_id, start_time, action_taken, action_taken = 'auto_rerun' AS success, CAST(n_before + CASE WHEN action_taken = 'auto_rerun' THEN 1 ELSE 0 END AS INTEGER) AS retry_count"


@query(f"{POLICY} SELECT {DECISION} FROM p")
def retry_policy(spark, sf_dir):
    return policy.decide(views.candidates(spark, sf_dir)).select("run_id", "pipeline_id", "start_time", "action_taken", "success", "retry_count")


@query(
    f"""{POLICY} SELECT run_id, action_taken, CAST(n_before + CASE WHEN action_taken = 'auto_rerun' THEN 1 ELSE 0 END AS INTEGER) AS retry_count,
    CASE WHEN action_taken = 'auto_rerun' THEN start_time + CASE n_before WHEN 0 THEN INTERVAL '60' SECOND WHEN 1 THEN INTERVAL '300' SECOND ELSE INTERVAL '900' SECOND END END AS next_attempt_at FROM p"""
)
def retry_backoff(spark, sf_dir):
    return policy.backoff(policy.decide(views.candidates(spark, sf_dir)), "start_time").select("run_id", "action_taken", "retry_count", "next_attempt_at")


@query(
    f"""WITH j AS (SELECT i.run_id, i.pipeline_id, c.start_time, CASE {STATUS} WHEN 'Succeeded' THEN true WHEN 'Failed' THEN false WHEN 'Cancelled' THEN false END AS outcome
      FROM i JOIN c USING (run_id) LEFT JOIN r ON i.new_run_id = r.run_id WHERE i.new_run_id IS NOT NULL)
    SELECT run_id, pipeline_id, outcome, coalesce(bool_or(NOT outcome) OVER (PARTITION BY pipeline_id ORDER BY start_time, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS escalate FROM j"""
)
def retry_once_policy(spark, sf_dir):
    i = views.incidents(spark, sf_dir).where("new_run_id is not null")
    judged = policy.rerun_outcome(i, _runs(spark, sf_dir), verify_seconds=None)
    starts = views.candidates(spark, sf_dir).select("run_id", "start_time")
    return policy.retry_once(judged.join(starts, "run_id").select("run_id", "pipeline_id", "start_time", "outcome")).select("run_id", "pipeline_id", "outcome", "escalate")


ATTEMPTS = f"""j AS (SELECT c.run_id, c.pipeline_id, c.start_time, CASE {STATUS} WHEN 'Succeeded' THEN true WHEN 'Failed' THEN false WHEN 'Cancelled' THEN false END AS outcome
      FROM c LEFT JOIN r ON r.run_id = 'run-' || CAST(c.n + 1 AS VARCHAR))"""
#: Row by row: what an attempt that was made comes to decides what the next run of the pipeline finds.
STEPS = """n AS (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY start_time, kind, run_id) AS rn FROM e),
    s AS (SELECT *, 0 AS used FROM n WHERE rn = 1 UNION ALL
      SELECT n.*, CASE WHEN s.kind = 0 THEN 0 WHEN s.used = {budget} OR s.outcome IS NULL THEN s.used WHEN s.outcome THEN 0 ELSE s.used + 1 END FROM s JOIN n ON n.pipeline_id = s.pipeline_id AND n.rn = s.rn + 1)
    SELECT run_id, pipeline_id, outcome, CAST(used AS INTEGER) AS used, used = {budget} AS escalate FROM s WHERE kind = 1"""


def _attempts(spark, sf_dir):
    """Every failed run with what its rerun, the next run by number, came to."""
    c = views.candidates(spark, sf_dir).withColumn("new_run_id", F.concat(F.lit("run-"), (F.col("n") + 1).cast("string"))).withColumn("timestamp", F.col("start_time"))
    return policy.rerun_outcome(c, _runs(spark, sf_dir), verify_seconds=None).select("run_id", "pipeline_id", "start_time", "outcome")


@query(f"WITH RECURSIVE {ATTEMPTS}, e AS (SELECT *, 1 AS kind FROM j), {STEPS.format(budget=2)}")
def retry_budget_policy(spark, sf_dir):
    return budget.with_resets(_attempts(spark, sf_dir), 2).select("run_id", "pipeline_id", "outcome", "used", "escalate")


@query(
    f"""WITH RECURSIVE {ATTEMPTS}, e AS (SELECT *, 1 AS kind FROM j UNION ALL SELECT NULL, pipeline_id, end_time, NULL, 0 FROM r WHERE raw_status = 'Succeeded'), {STEPS.format(budget=2)}"""
)
def retry_budget_resets(spark, sf_dir):
    """A run of the pipeline that succeeds by itself makes its budget whole."""
    succeeded = _runs(spark, sf_dir).where("status = 'Succeeded'").select("pipeline_id", "end_time")
    return budget.with_resets(_attempts(spark, sf_dir), 2, succeeded).select("run_id", "pipeline_id", "outcome", "used", "escalate")


@query(
    f"""SELECT cycle_start, run_id, pipeline_id, start_time FROM (SELECT *, time_bucket(INTERVAL '5' MINUTE, start_time) AS cycle_start,
    row_number() OVER (PARTITION BY pipeline_id, time_bucket(INTERVAL '5' MINUTE, start_time) ORDER BY start_time DESC, run_id DESC) AS rn FROM r WHERE {STATUS} = 'Failed') WHERE rn = 1"""
)
def incident_dedup_cycle(spark, sf_dir):
    return policy.one_a_cycle(_failed(spark, sf_dir)).select("cycle_start", "run_id", "pipeline_id", "start_time")


@query(f"SELECT {RUN} FROM r a WHERE {STATUS} = 'Failed' AND NOT EXISTS (SELECT 1 FROM r b WHERE b.pipeline_id = a.pipeline_id AND b.start_time > a.start_time AND b.raw_status IN ('Running', 'Succeeded'))")
def duplicate_guard(spark, sf_dir):
    return policy.not_superseded(_failed(spark, sf_dir), _runs(spark, sf_dir)).select(*_columns(RUN))


OUTCOME = "CASE WHEN {timely} THEN CASE " + STATUS + " WHEN 'Succeeded' THEN true WHEN 'Failed' THEN false WHEN 'Cancelled' THEN false END END AS outcome"


@query(f"SELECT i.run_id, i.new_run_id, {OUTCOME.format(timely='r.run_id IS NOT NULL')} FROM i LEFT JOIN r ON i.new_run_id = r.run_id")
def rerun_outcome(spark, sf_dir):
    return policy.rerun_outcome(views.incidents(spark, sf_dir), _runs(spark, sf_dir), None).select("run_id", "new_run_id", "outcome")


@query(f"SELECT i.run_id, i.new_run_id, {OUTCOME.format(timely="r.end_time <= i.timestamp + INTERVAL '100' SECOND")} FROM i LEFT JOIN r ON i.new_run_id = r.run_id")
def rerun_outcome_in_time(spark, sf_dir):
    return policy.rerun_outcome(views.incidents(spark, sf_dir), _runs(spark, sf_dir)).select("run_id", "new_run_id", "outcome")


# ---------------------------------------------------------------- incidents


@query("SELECT run_id, timestamp FROM i WHERE timestamp >= (SELECT max(timestamp) FROM i) - INTERVAL '7' DAY")
def incidents_last_n_days(spark, sf_dir):
    i = views.incidents(spark, sf_dir)
    return inc.last_days(i, 7, _newest(i)).select("run_id", "timestamp")


@query("SELECT run_id, timestamp FROM i WHERE CAST(timestamp + INTERVAL '330' MINUTE AS DATE) = (SELECT CAST(max(timestamp) + INTERVAL '330' MINUTE AS DATE) FROM i)")
def incidents_on_local_day(spark, sf_dir):
    i = views.incidents(spark, sf_dir)
    return inc.on_day(i, F.to_date(inc.local(_newest(i)))).select("run_id", "timestamp")


@query("SELECT run_id, CASE WHEN regexp_matches(pipeline_name, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') THEN pipeline_id ELSE pipeline_name END AS pipeline_name FROM i")
def pipeline_name_repair(spark, sf_dir):
    return inc.repaired_names(views.incidents(spark, sf_dir)).select("run_id", "pipeline_name")


@query("SELECT run_id, CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INTEGER) AS hour, strftime(timestamp, '%a') AS weekday FROM i")
def incident_calendar(spark, sf_dir):
    return inc.with_calendar(views.incidents(spark, sf_dir)).select("run_id", "date", "hour", "weekday")


@query("SELECT run_id, timestamp FROM i WHERE error_category <> 'unknown'")
def valid_timestamps(spark, sf_dir):
    text = F.when(F.col("error_category") == "unknown", F.lit("not a time")).otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return inc.valid_timestamps(views.incidents(spark, sf_dir).withColumn("timestamp", text)).select("run_id", "timestamp")


SEVERITY = "CASE WHEN error_category IN ('schema', 'permission', 'source_missing') THEN 'CRITICAL' WHEN error_category = 'data_quality' THEN 'WARNING' ELSE 'INFO' END"
LABEL = "CASE action_taken WHEN 'auto_rerun' THEN 'AUTO-FIXED' WHEN 'alert_sent' THEN 'ESCALATED' WHEN 'max_retries_exceeded' THEN 'MAX RETRIES' WHEN 'investigating' THEN 'INVESTIGATING' ELSE upper(action_taken) END"
LOCAL_TEXT = "strftime(timestamp + INTERVAL '330' MINUTE, '%d %b %Y, %I:%M:%S %p') || ' IST'"


@query(f"SELECT run_id, {SEVERITY} AS severity, {LABEL} AS action FROM i")
def incident_severity(spark, sf_dir):
    return views.incidents(spark, sf_dir).select("run_id", inc.severity(F.col("error_category")).alias("severity"), inc.action_label(F.col("action_taken")).alias("action"))


@query(
    f"""SELECT run_id, pipeline_name AS name, {SEVERITY} AS severity, upper(replace(error_category, '_', ' ')) AS category, {LABEL} AS action,
    CASE WHEN retry_count > 0 THEN 'Retries: ' || CAST(retry_count AS VARCHAR) || '/3' END AS retries,
    CASE WHEN confidence_score <> 0 THEN 'Confidence: ' || CAST(CAST(floor(confidence_score * 100) AS BIGINT) AS VARCHAR) || '%' END AS confidence,
    error_message AS error, root_cause AS cause, {LOCAL_TEXT} AS local_time FROM i ORDER BY timestamp DESC, run_id LIMIT 10"""
)
def incident_feed(spark, sf_dir):
    return inc.feed(views.incidents(spark, sf_dir))


@query(f"SELECT run_id, {LOCAL_TEXT} AS local_time FROM i")
def incident_local_time(spark, sf_dir):
    return views.incidents(spark, sf_dir).select("run_id", inc.local_text(F.col("timestamp")).alias("local_time"))


@query(f"SELECT run_id, '{BASE_URL}/groups/' || workspace_id || '/list' AS workspace_url, '{BASE_URL}/groups/' || workspace_id || '/datapipelines/' || pipeline_id AS pipeline_url FROM i")
def incident_links(spark, sf_dir):
    return inc.with_links(views.incidents(spark, sf_dir), BASE_URL).select("run_id", "workspace_url", "pipeline_url")


@query(
    f"""SELECT run_id, CASE action_taken WHEN 'auto_rerun' THEN 'Auto Rerun' WHEN 'alert_sent' THEN 'Alert Sent' ELSE 'Max Retries Exceeded' END AS title, pipeline_name, workspace_id, error_category,
    CAST(CAST(floor(confidence_score * 100) AS BIGINT) AS VARCHAR) || '%' AS confidence, CAST(retry_count AS VARCHAR) || '/3' AS retry_attempt, strftime(timestamp, '%Y-%m-%d %H:%M') || ' UTC' AS time,
    root_cause, message AS action, CASE WHEN success THEN new_run_id END AS new_run, CASE WHEN NOT success THEN 'Investigate manually' END AS recommended,
    '{BASE_URL}/groups/' || workspace_id || '/datapipelines/' || pipeline_id AS pipeline_url, '{BASE_URL}/groups/' || workspace_id || '/list' AS workspace_url FROM i"""
)
def alert_outbox(spark, sf_dir):
    return inc.alert_outbox(views.incidents(spark, sf_dir), BASE_URL)


def _tenths(part, whole):
    return f"CASE WHEN {whole} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(round_even(CAST(100 * {part} AS DECIMAL(20, 6)) / CAST({whole} AS DECIMAL(20, 6)), 1) AS DOUBLE) END"


ACTIONS = "count(CASE WHEN action_taken = 'auto_rerun' THEN 1 END) AS fixed, count(CASE WHEN action_taken = 'alert_sent' THEN 1 END) AS escalated, count(CASE WHEN action_taken = 'max_retries_exceeded' THEN 1 END) AS maxr"


@query(
    f"""WITH k AS (SELECT count(*) AS total, {ACTIONS}, count(CASE WHEN rerun_succeeded THEN 1 END) AS recovered,
      count(CASE WHEN timestamp >= (SELECT max(timestamp) FROM i) - INTERVAL '1' DAY THEN 1 END) AS last_day, count(DISTINCT pipeline_name) AS with_failures,
      CAST(round(avg(confidence_score) * 100, 1) AS DOUBLE) AS avg_conf FROM i)
    SELECT *, {_tenths('fixed', 'total')} AS fix_rate, {_tenths('recovered', 'fixed')} AS recover_rate, {_tenths('recovered', 'total')} AS recovery_ratio FROM k"""
)
def kpi_overview(spark, sf_dir):
    i = views.incidents(spark, sf_dir)
    return inc.kpis(i, _newest(i))


@query(f"SELECT CAST(timestamp AS DATE) AS date, count(run_id) AS total, {ACTIONS} FROM i GROUP BY 1")
def daily_trend(spark, sf_dir):
    return inc.daily_trend(views.incidents(spark, sf_dir))


@query(f"WITH n AS (SELECT error_category, count(*) AS n FROM i GROUP BY 1), s AS (SELECT *, sum(n) OVER () AS whole FROM n) SELECT error_category, n, {_tenths('n', 'whole')} AS share FROM s ORDER BY n DESC, error_category")
def category_breakdown(spark, sf_dir):
    return inc.category_breakdown(views.incidents(spark, sf_dir))


SUMMARY = f"""k AS (SELECT CAST(timestamp AS DATE) AS date, count(run_id) AS total, {ACTIONS}, count(DISTINCT pipeline_name) AS pipelines, CAST(round_even(avg(confidence_score) * 100, 0) AS INTEGER) AS conf FROM i GROUP BY 1),
    t AS (SELECT *, {_tenths('fixed', 'total')} AS fix_rate FROM k)
    SELECT *, CAST(conf AS VARCHAR) || '%' AS conf_text, printf('%.1f%%', fix_rate) AS fix_rate_text FROM t ORDER BY date DESC"""


@query(f"WITH {SUMMARY}")
def daily_summary(spark, sf_dir):
    return inc.daily_summary(views.incidents(spark, sf_dir))


@query("SELECT min(CAST(timestamp + INTERVAL '330' MINUTE AS DATE)) AS first_day, max(CAST(timestamp + INTERVAL '330' MINUTE AS DATE)) AS last_day FROM i")
def date_bounds(spark, sf_dir):
    return inc.date_bounds(views.incidents(spark, sf_dir))


SECONDS = "(epoch_us({b}) - epoch_us({a})) // 1000000"


@query(
    f"""WITH t AS (SELECT i.*, {SECONDS.format(a='s.start_time', b='i.timestamp')} AS response, {SECONDS.format(a='s.start_time', b='e.end_time')} AS fix
      FROM i LEFT JOIN r s ON i.run_id = s.run_id LEFT JOIN r e ON i.new_run_id = e.run_id)
    SELECT error_category, count(*) AS incidents, count(CASE WHEN response < 300 THEN 1 END) AS response_met, count(CASE WHEN action_taken = 'auto_rerun' AND rerun_succeeded THEN 1 END) AS fixes,
    count(CASE WHEN action_taken = 'auto_rerun' AND rerun_succeeded AND fix < 900 THEN 1 END) AS fix_met, count(CASE WHEN action_taken <> 'auto_rerun' THEN 1 END) AS escalations,
    count(CASE WHEN action_taken <> 'auto_rerun' AND response <= 1800 THEN 1 END) AS escalation_met FROM t GROUP BY 1"""
)
def sla_attainment(spark, sf_dir):
    return inc.sla(views.incidents(spark, sf_dir), _runs(spark, sf_dir))


FIX = f"""f AS (SELECT i.error_category, CAST(s.start_time AS DATE) AS day, CAST({SECONDS.format(a='s.start_time', b='e.end_time')} AS BIGINT) AS fix
      FROM i JOIN r s ON i.run_id = s.run_id JOIN r e ON i.new_run_id = e.run_id WHERE e.end_time IS NOT NULL)"""
RANKS = "CAST(quantile_disc(fix, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(fix, 0.9) AS BIGINT) AS p90, CAST(quantile_disc(fix, 0.99) AS BIGINT) AS p99"


def _fix_seconds(spark, sf_dir):
    starts = views.runs(spark, sf_dir).select("run_id", "start_time")
    ends = views.runs(spark, sf_dir).where("end_time is not null").select(F.col("run_id").alias("new_run_id"), "end_time")
    both = views.incidents(spark, sf_dir).join(starts, "run_id").join(ends, "new_run_id")
    return both.select("error_category", F.to_date("start_time").alias("day"), rollup.whole_seconds("start_time", "end_time").alias("fix"))


@query(f"WITH {FIX} SELECT error_category, day, count(*) AS n, {RANKS} FROM f GROUP BY ALL")
def sla_percentiles(spark, sf_dir):
    return rollup.percentiles(rollup.sketches(_fix_seconds(spark, sf_dir), ["error_category", "day"], "fix"))


@query(f"WITH {FIX} SELECT error_category, count(*) AS n, {RANKS} FROM f GROUP BY ALL")
def sla_percentiles_merged(spark, sf_dir):
    """By category from the sketches by category and day, without a second look at incidents."""
    daily = rollup.sketches(_fix_seconds(spark, sf_dir), ["error_category", "day"], "fix")
    return rollup.percentiles(rollup.merged_up(daily, ["error_category"]))


@query(
    """WITH d AS (SELECT CAST(timestamp AS DATE) AS day, pipeline_name FROM i), a AS (SELECT DISTINCT day AS anchor FROM d), s AS (SELECT unnest([1, 7, 14, 30]) AS days)
    SELECT anchor, CAST(days AS INTEGER) AS days, count(DISTINCT pipeline_name) AS pipelines FROM a, s JOIN d ON day <= anchor AND day > anchor - CAST(days AS INTEGER) GROUP BY ALL"""
)
def distinct_pipelines_by_span(spark, sf_dir):
    i = views.incidents(spark, sf_dir)
    names = rollup.dictionary(i, "pipeline_name")
    return rollup.distinct_over_spans(rollup.daily_bitmaps(i, names, "pipeline_name"), (1, 7, 14, 30), "pipelines")


# ---------------------------------------------------------------- medallion


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer", views_too=False)
def project_existing(spark, sf_dir):
    return med.existing(table(spark, sf_dir, "customer"), ["c_custkey", "c_title", "c_name", "c_phone", "c_mktsegment"])


@query("SELECT s_suppkey, trim(s_name) AS s_name, s_nationkey, s_acctbal FROM supplier", views_too=False)
def silver_clean(spark, sf_dir):
    padded = raw.with_provenance(table(spark, sf_dir, "supplier")).withColumn("s_name", F.concat(F.lit("  "), "s_name", F.lit(" ")))
    return med.silver_clean(padded.unionByName(padded))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 0", views_too=False)
def silver_drop_empty(spark, sf_dir):
    kept = F.col("s_acctbal") >= 0
    return med.silver_clean(table(spark, sf_dir, "supplier").select(F.when(kept, F.col("s_suppkey")).alias("s_suppkey"), F.when(kept, F.col("s_name")).alias("s_name")))


@query("SELECT DISTINCT trim(text, ' ') AS text FROM documents", views_too=False)
def silver_distinct(spark, sf_dir):
    return med.silver_clean(table(spark, sf_dir, "documents").select("text"))


@query("SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey", views_too=False)
def dim_left_lookup(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").select("s_suppkey", "s_name", "n_name")


def _customer(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("CustomerID"), F.col("c_name").alias("CompanyName"), F.col("c_mktsegment").alias("Title"))


@query("SELECT c_custkey AS CustomerID, c_mktsegment AS Title, c_name AS CompanyName FROM customer", views_too=False)
def dim_customer(spark, sf_dir):
    c = _customer(spark, sf_dir)
    old = c.withColumns({"CompanyName": F.lit("old name"), "_ingest_date": F.lit(date(2024, 1, 30))})
    return med.dim_customer(old.unionByName(c.withColumn("_ingest_date", F.lit(date(2024, 2, 1)))))


@query("SELECT s_suppkey AS ProductID, s_name AS Name, s_acctbal AS ListPrice, n_name AS CategoryName FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND s_suppkey % 5 <> 0", views_too=False)
def dim_product(spark, sf_dir):
    known = F.when(F.col("s_suppkey") % 5 == 0, -1).otherwise(F.col("s_nationkey"))  # some products of a category that is missing
    product = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ProductID"), F.col("s_name").alias("Name"), F.col("s_acctbal").alias("ListPrice"), known.alias("ProductCategoryID"))
    category = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ProductCategoryID"), F.col("n_name").alias("Name"))
    return med.dim_product(product.unionByName(product), category)


def _detail(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("SalesOrderID"), F.col("l_linenumber").alias("SalesOrderDetailID"), F.col("l_partkey").alias("ProductID"), F.col("l_quantity").alias("OrderQty"), F.col("l_extendedprice").alias("LineTotal"))


def _header(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("SalesOrderID"), F.col("o_orderdate").alias("OrderDate"), F.col("o_custkey").alias("CustomerID"), F.col("o_totalprice").alias("TotalDue"))


FACT = "SELECT l_orderkey AS SalesOrderID, l_linenumber AS SalesOrderDetailID, l_partkey AS ProductID, l_quantity AS OrderQty, l_extendedprice AS LineTotal, o_orderdate AS OrderDate, o_custkey AS CustomerID, o_totalprice AS TotalDue FROM {lineitem} JOIN orders ON l_orderkey = o_orderkey"


@query(FACT.format(lineitem="lineitem"), views_too=False)
def fact_salesorder(spark, sf_dir):
    return med.fact_sales(_detail(spark, sf_dir), _header(spark, sf_dir))


LINE = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query(f"SELECT l_orderkey, l_linenumber, {LINE} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(f'{c} DESC' for c in _columns(LINE))}) AS rn FROM lineitem) WHERE rn = 1", views_too=False)
def dedup_by_key(spark, sf_dir):
    """The newest row of a key, whole; among equal dates the greatest by the other columns, in their order."""
    kept = med.newest_by_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], F.struct(*_columns(LINE)))
    return kept.select("l_orderkey", "l_linenumber", *_columns(LINE))


@query(FACT.format(lineitem="(SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem)"), views_too=False)
def medallion_end_to_end(spark, sf_dir):
    tables = {"Customer": _customer(spark, sf_dir), "SalesOrderHeader": _header(spark, sf_dir), "SalesOrderDetail": _detail(spark, sf_dir)}
    return med.chain(spark, tables, new_path(spark, "lake"), date(2024, 1, 31))["gold_fact_salesorder"]


# ---------------------------------------------------------------- knowledge


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("kb/guide_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")


def _rule_files(spark, sf_dir):
    listed = F.when(F.col("event_type") == "error", F.concat(F.lit("["), "props", F.lit(", "), "props", F.lit("]"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("kb/rules_"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), listed.alias("text"))


GUIDE = "SELECT 'runbook_guide_' || CAST(doc_id AS VARCHAR) AS id, text AS document, 'kb/guide_' || CAST(doc_id AS VARCHAR) || '.md' AS source, 'runbook' AS type FROM documents"
RULE = """SELECT 'error_pattern_rules_' || CAST(event_id AS VARCHAR) || '_' || CAST(e AS VARCHAR) AS id, replace(props, ': ', ':') AS document, 'kb/rules_' || CAST(event_id AS VARCHAR) || '.json' AS source, 'error_pattern' AS type
    FROM events, (SELECT 0 AS e UNION ALL SELECT 1) x WHERE e = 0 OR event_type = 'error'"""
PAST = """SELECT id, document, 'incident_history' AS source, 'resolved_incident' AS type FROM (SELECT 'incident_' || substring(md5(coalesce(error_message, '')), 1, 12) AS id,
    'Pipeline: ' || coalesce(pipeline_name, '') || chr(10) || 'Error: ' || coalesce(error_message, '') || chr(10) || 'Root Cause: ' || coalesce(root_cause, '') || chr(10) || 'Resolution: ' || message AS document,
    row_number() OVER (PARTITION BY coalesce(error_message, '') ORDER BY timestamp DESC, run_id DESC) AS rn FROM i) WHERE rn = 1"""


@query(GUIDE, views_too=False)
def kb_text_docs(spark, sf_dir):
    return kb.text_docs(_files(spark, sf_dir))


@query(RULE, views_too=False)
def kb_rule_docs(spark, sf_dir):
    return kb.rule_docs(_rule_files(spark, sf_dir)).withColumn("document", F.replace("document", F.lit(": "), F.lit(":")))


@query(PAST)
def resolved_incident_docs(spark, sf_dir):
    return kb.incident_docs(views.incidents(spark, sf_dir).withColumn("resolution", F.col("message")))


@query(f"{GUIDE} UNION ALL {RULE} UNION ALL {PAST}")
def kb_corpus(spark, sf_dir):
    past = kb.incident_docs(views.incidents(spark, sf_dir).withColumn("resolution", F.col("message")))
    rules = kb.rule_docs(_rule_files(spark, sf_dir)).withColumn("document", F.replace("document", F.lit(": "), F.lit(":")))
    return kb.corpus(kb.text_docs(_files(spark, sf_dir)), rules, past)


@query("SELECT source AS id, CAST(max(doc_id) AS BIGINT) AS doc_id, arg_max(text, doc_id) AS document FROM documents GROUP BY source", views_too=False)
def kb_upsert(spark, sf_dir):
    return kb.upsert(table(spark, sf_dir, "documents").select(F.col("source").alias("id"), "doc_id", F.col("text").alias("document")), "doc_id")


@query()
def kb_vectorise(spark, sf_dir):
    found = vectors.vectorise(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return found.select("doc_id", F.size("embedding").alias("length"), F.round(norm, 4).alias("norm"))


@query()
def kb_term_weights(spark, sf_dir):
    """Every text's sparse row: its hashed words and their weights."""
    found = vectors.sparse(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.posexplode("indices").alias("at", "term"), "weights").select("doc_id", "term", F.round(F.get("weights", "at"), 9).alias("weight"))


@query()
def kb_text_search(spark, sf_dir):
    """Texts searched by meaning end to end: every hundredth text against all, by their leading directions."""
    found = vectors.text_vectors(table(spark, sf_dir, "documents").where("doc_id is not null"), "doc_id", "text")
    path = new_path(spark, "text-vectors")
    found.write.parquet(path)
    v = spark.read.parquet(path)
    hits = search(v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding"), v.select(F.col("doc_id").alias("id"), "embedding"))
    return hits.select("query_id", "id", F.round("score", 3).alias("score"), "rank")


@query("SELECT source AS id, CAST(max(doc_id) AS BIGINT) AS version, arg_max(text, doc_id) AS document FROM documents GROUP BY source", views_too=False)
def kb_store(spark, sf_dir):
    """Merged in four batches, of which one comes twice; read as one version."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("version"), F.col("text").alias("document"))
    store = Store(spark, new_path(spark, "store"), compact=2)
    for number, part in enumerate((0, 1, 1, 2, 3)):
        store.merge(docs.where(F.pmod("version", F.lit(4)) == part), number)
    return store.read()


SCORED = """q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE {asked}), s AS (SELECT query_id, vec_id AS id,
      list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) AS score FROM q, embeddings e),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""
HITS, LABEL_HITS = SCORED.format(asked="vec_id % 100 = 0"), SCORED.format(asked="label = 0")


def _hits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return search(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"))


def _label_hits(spark, sf_dir, k=5):
    """Every vector of label 0 against all. Ids may repeat or be null: each vector is asked, and the hits of an id are ranked together."""
    e, path = table(spark, sf_dir, "embeddings"), new_path(spark, "asked")
    e.where("label = 0").select(F.col("vec_id").alias("query_id"), "embedding").distinct().withColumn("number", F.monotonically_increasing_id()).write.parquet(path)
    asked = spark.read.parquet(path)
    found = search(asked.select(F.col("number").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), k)
    return ranked(found.select(F.col("query_id").alias("number"), "id", "score").join(asked.select("number", "query_id"), "number"), k)


@query(f"WITH {LABEL_HITS} SELECT query_id, id, CAST(round(score, 3) AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 5", views_too=False)
def kb_search(spark, sf_dir):
    return _label_hits(spark, sf_dir).select("query_id", "id", F.round("score", 3).alias("score"), "rank")


def _vector_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "runbook").otherwise("resolved_incident")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("document"), "source", kind.alias("type"))


@query(
    f"""WITH {HITS} SELECT q.query_id, coalesce(x.context, 'No similar past errors found in knowledge base.') AS context FROM q LEFT JOIN (SELECT query_id, '## Relevant Knowledge Base Entries' || chr(10) || chr(10) || string_agg('**Source**: ' || source || ' (relevance: ' || printf('%.3f', round(score, 3)) || ')' || chr(10) || left(text, 500) || chr(10) || '---', chr(10) ORDER BY rank) AS context
    FROM h JOIN documents ON id = doc_id WHERE rank <= 3 GROUP BY query_id) x ON q.query_id = x.query_id""",
    views_too=False,
)
def kb_context(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return kb.context(hits, _vector_docs(spark, sf_dir), hits.select("query_id").distinct())


@query(
    f"""WITH {LABEL_HITS} SELECT query_id, coalesce(string_agg(CASE WHEN id % 2 = 1 THEN CAST(id AS VARCHAR) END, ',' ORDER BY rank), '') AS similar, coalesce(string_agg(CASE WHEN id % 2 = 0 THEN source END, ',' ORDER BY rank), '') AS runbooks
    FROM h JOIN documents ON id = doc_id WHERE rank <= 5 GROUP BY query_id""",
    views_too=False,
)
def diagnosis_refs(spark, sf_dir):
    found = kb.references(_label_hits(spark, sf_dir), _vector_docs(spark, sf_dir))
    return found.select("query_id", F.array_join(F.transform("similar", lambda x: x.cast("string")), ",").alias("similar"), F.array_join("runbooks", ",").alias("runbooks"))


REQUEST = """'Pipeline: ' || pipeline_name || chr(10) || 'Pipeline ID: ' || pipeline_id || chr(10) || 'Run ID: ' || r.run_id || chr(10) || 'Workspace: ' || workspace_id || chr(10)
    || 'Failed At: ' || coalesce(strftime(end_time, '%Y-%m-%d %H:%M:%S'), '') || chr(10) || 'Error Message: ' || coalesce(error_message, 'No error message available') || chr(10) || 'Error Code: ' || coalesce(error_code, 'N/A') || chr(10)
    || 'Run Logs (last 2000 chars): ' || right(coalesce(nullif(d.text, ''), 'No detailed logs available.'), 2000) || chr(10) || 'none'"""


@query(f"SELECT r.run_id, {REQUEST} AS request FROM r LEFT JOIN documents d ON r.run_id = 'run-' || CAST(d.doc_id AS VARCHAR) WHERE {STATUS} = 'Failed'")
def diagnosis_context(spark, sf_dir):
    logged = ops.with_logs(_failed(spark, sf_dir), _logs(spark, sf_dir))
    return kb.diagnosis_requests(logged.withColumn("context", F.lit("none")))


@query(
    """SELECT event_id, event_type <> 'click' AS parsed, CASE event_type WHEN 'error' THEN 'schema' ELSE 'unknown' END AS error_category, event_type = 'error' AS is_auto_fixable,
    CASE WHEN event_type = 'click' THEN 'Response parsing failed' WHEN event_type = 'error' THEN props ELSE 'Unknown' END AS root_cause, 'Investigate manually' AS recommended_action, CAST(CASE WHEN event_type = 'error' THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence_score FROM events""",
    views_too=False,
)
def diagnosis_parse(spark, sf_dir):
    kind = F.col("event_type")
    body = F.to_json(F.struct(F.lit("schema").alias("error_category"), F.lit(True).alias("is_auto_fixable"), F.col("props").alias("root_cause"), F.lit(0.5).alias("confidence_score")))
    reply = F.when(kind == "error", F.concat(F.lit("Here it is:\n```json\nsee "), body, F.lit(" as asked\n```\n"))).when(kind == "click", F.lit("no object here")).otherwise(F.lit('```\n{"error_category": "weather", "root_cause": null}\n```'))
    found = kb.parse_replies(table(spark, sf_dir, "events").select("event_id", reply.alias("reply"), "props"))
    return found.drop("reply", "props")


# ---------------------------------------------------------------- streams


#: A run far in the future: it moves the event time on, so that what waits is decided. Its rows are left out.
BEAT, BEAT_AT = 10**12, datetime(2100, 1, 1)


def _by_span(spark, sf_dir, f, spans=3, order="ts", beat=False):
    """Lands the events span by span and lets ``f`` (runs as a stream, base) go on from its checkpoint after each."""
    landed, base = new_path(spark, "landed"), new_path(spark, "stream")
    events = table(spark, sf_dir, "events").withColumn("arrival", F.expr(order))
    for i in range(spans):
        streams.land(events, landed, "arrival", i, spans)
        out = f(ops.with_status(spark.sql(views.RUNS, events=streams.arrived(spark, landed))), base)
    if beat:
        streams.beat(spark, landed, event_id=F.lit(BEAT), ts=F.lit(BEAT_AT), user_id=F.lit(-1), event_type=F.lit("error"))
        out = f(ops.with_status(spark.sql(views.RUNS, events=streams.arrived(spark, landed))), base).where(F.col("run_id") != f"run-{BEAT}")
    return out


def _candidates(spark, runs):
    return spark.sql(views.CANDIDATES, runs=runs)


def _incidents(spark, runs):
    return spark.sql(views.INCIDENTS, candidates=_candidates(spark, runs))


@query(f"SELECT {RUN}, raw_status, {STATUS} AS status FROM r")
def stream_ingest(spark, sf_dir):
    return _by_span(spark, sf_dir, lambda r, base: streams.ingest(r.drop("event_id"), base))


@query(f"SELECT {RUN} FROM r")
def stream_dedup(spark, sf_dir):
    twice = F.explode(F.array(F.lit(1), F.lit(2)))
    return _by_span(spark, sf_dir, lambda r, base: streams.once_each(r.withColumn("again", twice), base)).select(*_columns(RUN))


@query(f"SELECT {RUN}, raw_status, {STATUS} AS status FROM r")
def stream_quarantine(spark, sf_dir):
    """The second batch fails, the third goes on, and the second is replayed."""
    bases, calls = set(), []

    def check(rows):
        calls.append(rows)
        if len(calls) == 2:
            raise ValueError("a poisoned batch")

    def step(r, base):
        bases.add(base)
        return streams.ingest_tolerant(r.drop("event_id"), base, check)

    _by_span(spark, sf_dir, step)
    (base,) = bases
    streams.replay(spark, base, lambda rows, batch: streams.put(rows, base, "runs", batch))
    return streams.all_of(spark, base, "runs")


@query(f"{POLICY} SELECT {DECISION} FROM p")
def stream_retry_policy(spark, sf_dir):
    """Runs arrive up to two days late, so that batches overlap in time."""
    late = "ts + make_dt_interval(CAST(event_id % 3 AS INT))"
    return _by_span(spark, sf_dir, lambda r, base: streams.retry_decisions(_candidates(spark, r), base, "3 days"), order=late, beat=True)


@query(
    f"""SELECT i.run_id, i.new_run_id, i.timestamp, {OUTCOME.format(timely='r.run_id IS NOT NULL')} FROM i
    LEFT JOIN r ON i.new_run_id = r.run_id AND {STATUS} <> 'Running' AND r.end_time BETWEEN i.timestamp - INTERVAL '2' DAY AND i.timestamp + INTERVAL '100' SECOND"""
)
def stream_rerun_outcome(spark, sf_dir):
    return _by_span(spark, sf_dir, lambda r, base: streams.outcomes(_incidents(spark, r), r, base, "1 hour", "2 days"), beat=True)


@query(f"SELECT {INCIDENT} FROM i")
def stream_audit(spark, sf_dir):
    return records.read_incidents(spark, _by_span(spark, sf_dir, lambda r, base: streams.audit(_results(_incidents(spark, r)), base)))


@query(
    f"""WITH x AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events), b AS (SELECT r.*, CASE WHEN epoch_us(start_time) < a + (b - a) / 3 THEN 0 WHEN epoch_us(start_time) < a + 2 * (b - a) / 3 THEN 1 ELSE 2 END AS span FROM r, x)
    SELECT {RUN} FROM (SELECT *, max(end_time) OVER (PARTITION BY span) AS anchor FROM b) WHERE {STATUS} = 'Failed' AND end_time >= anchor - INTERVAL '60' MINUTE"""
)
def stream_lookback(spark, sf_dir):
    """Three batches, each against its own newest end."""
    return _by_span(spark, sf_dir, lambda r, base: streams.recent_failures(r, base, 60)).select(*_columns(RUN))


@query("SELECT CAST(timestamp AS DATE) AS date, error_category, count(*) AS n FROM i GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    return _by_span(spark, sf_dir, lambda r, base: streams.daily_counts(_incidents(spark, r), base))


@query(PAST)
def stream_kb_upsert(spark, sf_dir):
    return _by_span(spark, sf_dir, lambda r, base: streams.grow_knowledge(_incidents(spark, r).withColumn("resolution", F.col("message")), base))
