"""Operators on rows made by hand: ties, nulls, hot keys, late outcomes, broken input."""

import datetime as dt
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from runlake import schemas
from runlake.functions.text import tenths
from runlake.operators import classify, incidents as inc, policy, runs as ops
from runlake.plans import knowledge as kb, medallion as med
from runlake.plans.search import search
from runlake.sources import files, raw, records
from runlake.storage import new_path

T0 = dt.datetime(2024, 1, 1)
CANDIDATE = "run_id string, pipeline_id string, start_time timestamp_ntz, is_auto_fixable boolean, triggered boolean"


def simulated(rows, budget=3):
    """The retry policy, row by row in order."""
    count, out = {}, {}
    for run, pipeline, start, fixable, triggered in sorted(rows, key=lambda r: (r[2], r[0])):
        n = count.get(pipeline, 0)
        if n >= budget:
            out[run] = (schemas.MAX_RETRIES, False, n)
        elif fixable and triggered:
            count[pipeline] = n + 1
            out[run] = (schemas.AUTO_RERUN, True, n + 1)
        else:
            out[run] = (schemas.ALERT_SENT, False, n)
    return out


def candidate_rows(n=400, seed=5):
    """Half of all runs belong to one pipeline; many start at the same time."""
    rng = random.Random(seed)
    return [(f"run-{i:04}", "hot" if i % 2 else f"p{rng.randint(0, 9)}", T0 + dt.timedelta(minutes=rng.randint(0, 60)), rng.random() < 0.5, rng.random() < 0.7) for i in range(n)]


@pytest.mark.parametrize("budget", [1, 3])
def test_retry_policy_equals_the_simulation(spark, budget):
    rows = candidate_rows()
    found = policy.decide(spark.createDataFrame(rows, CANDIDATE), budget).collect()
    assert {r["run_id"]: (r["action_taken"], r["success"], r["retry_count"]) for r in found} == simulated(rows, budget)


def test_retry_policy_ranks_below_the_shuffle(spark):
    plan = policy.decide(spark.createDataFrame(candidate_rows(50), CANDIDATE))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_retry_once_waits_for_what_still_runs(spark):
    rows = [("1", "p", T0, None), ("2", "p", T0 + dt.timedelta(1), True), ("3", "p", T0 + dt.timedelta(2), False), ("4", "p", T0 + dt.timedelta(3), True), ("5", "q", T0, True)]
    df = spark.createDataFrame(rows, "run_id string, pipeline_id string, start_time timestamp_ntz, outcome boolean")
    assert {r["run_id"]: r["escalate"] for r in policy.retry_once(df).collect()} == {"1": False, "2": False, "3": False, "4": True, "5": False}


def test_rerun_outcome_in_time_and_final(spark):
    late = T0 + dt.timedelta(seconds=101)
    runs = spark.createDataFrame([("n1", "Succeeded", T0 + dt.timedelta(seconds=100)), ("n2", "Succeeded", late), ("n3", "Cancelled", T0), ("n4", "Running", None)], "run_id string, status string, end_time timestamp_ntz")
    asked = spark.createDataFrame([(k, k if k != "n0" else None, T0) for k in ("n0", "n1", "n2", "n3", "n4", "n9")], "run_id string, new_run_id string, timestamp timestamp_ntz")
    timely = {r["run_id"]: r["outcome"] for r in policy.rerun_outcome(asked, runs).collect()}
    final = {r["run_id"]: r["outcome"] for r in policy.rerun_outcome(asked, runs, None).collect()}
    assert timely == {"n0": None, "n1": True, "n2": None, "n3": False, "n4": None, "n9": None}
    assert final == timely | {"n2": True}


def test_status_spellings(spark):
    df = spark.createDataFrame([(x,) for x in ("Failed", "Succeeded", "Running", "Cancelled", "Canceled", "Queued", None)], "raw_status string")
    assert [r["status"] for r in ops.with_status(df).collect()] == ["Failed", "Succeeded", "Running", "Cancelled", "Cancelled", "Failed", "Failed"]


def test_first_rule_wins_and_case_counts(spark):
    texts = {
        "OperationTimeout after 429": ("transient", 0),
        "got 429": ("transient", 1),
        "AuthenticationFailed": ("auth", 2),
        "Connection refused": ("infra", 3),
        "Connection reset": ("transient", 4),
        "ColumnNotFound": ("schema", 5),
        "ResourceNotFound": ("source_missing", 6),
        "AccessDenied": ("permission", 7),
        "DuplicateKey": ("data_quality", 8),
        "operationtimeout": ("unknown", None),
        None: ("unknown", None),
    }
    df = spark.createDataFrame([(t, None) for t in texts], "error_message string, error_code string")
    found = {r["error_message"]: (r["error_category"], r["rule_id"]) for r in classify.classify(df).collect()}
    assert found == texts
    coded = spark.createDataFrame([("x", "503")], "error_message string, error_code string")
    assert classify.classify(coded).first()["error_category"] == "infra"


def test_too_many_rules_are_an_error(spark):
    df = spark.createDataFrame([("x", None)], "error_message string, error_code string")
    with pytest.raises(ValueError):
        classify.classify(df, [("a", "unknown", False)] * (classify.MOST_RULES + 1))


def test_incident_lines_tolerate_what_is_broken(spark):
    lines = [
        '{"run_id": "1", "timestamp": "2024-01-01T00:00:00", "is_auto_fixable": true, "retry_count": 1}',
        '{"run_id": "2", "timestamp": "2024-01-01T00:00:00Z", "is_auto_fixable": 0.35}',
        '{"run_id": "3", "timestamp": "2024-01-01 00:00:00", "is_auto_fixable": false}',
        '{"run_id": "4", "timestamp": "soon"}',
        '{"run_id": null, "timestamp": "2024-01-01T00:00:00", "is_auto_fixable": true}',
        '  {"timestamp": "2024-01-01T00:00:00", "is_auto_fixable": 0}',
        '[{"run_id": "6", "timestamp": "2024-01-01T00:00:00"}]',
        "17",
        "",
        "   ",
        '{"run_id": "5", ',
        "nonsense",
    ]
    found = records.incidents_from_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((str(r["run_id"]), r["is_auto_fixable"]) for r in found) == [("1", True), ("2", True), ("3", False), ("None", False), ("None", True)]
    assert {r["timestamp"] for r in found} == {T0}


def test_run_records_fall_back_and_are_rejected(spark):
    texts = ['{"runId": "r2", "status": "Odd", "errorMessage": "m"}', '{"startTimeUtc": "2024-01-01T00:00:00Z"}', "[1]", "oops", None, '{"id": "r5", "startTimeUtc": "someday"}']
    df = spark.createDataFrame([("w", "p", "", t) for t in texts], "workspace_id string, pipeline_id string, pipeline_name string, record string")
    good, bad = records.ingest_runs(df, F.lit(T0).cast("timestamp_ntz"))
    assert sorted((r["run_id"], r["pipeline_name"], r["status"], r["start_time"], r["error_message"]) for r in good.collect()) == [("r2", "Unknown", "Failed", T0, "m"), ("unknown", "Unknown", "Failed", T0, None)]
    assert bad.count() == 4


def test_names_are_repaired_only_where_they_are_ids(spark):
    uid = "0a1b2c3d-0000-4000-8000-000000000014"
    df = spark.createDataFrame([("p", uid), ("p", uid.upper()), ("p", None), ("p", "x " + uid)], "pipeline_id string, pipeline_name string")
    assert [r["pipeline_name"] for r in inc.repaired_names(df).collect()] == ["p", uid.upper(), None, "x " + uid]
    assert inc.repaired_names(df.drop("pipeline_name")).first()["pipeline_name"] == "Unknown"


def test_texts_are_cut_for_display_only(spark):
    row = ("r", T0, None, "schema", "x" * 241, "c" * 200, None, 0, 0.999)
    df = spark.createDataFrame([row], "run_id string, timestamp timestamp_ntz, pipeline_name string, error_category string, error_message string, root_cause string, action_taken string, retry_count int, confidence_score double")
    card = inc.feed(df).first()
    assert card["error"] == "x" * 240 + "..." and card["cause"] == "c" * 200 and card["confidence"] == "Confidence: 99%" and card["retries"] is None
    assert card["severity"] == "CRITICAL" and card["local_time"] == "01 Jan 2024, 05:30:00 AM IST" and card["action"] == "UNKNOWN"


def test_rates_round_halves_to_even(spark):
    cases = {(1, 16): 6.2, (3, 16): 18.8, (1, 3): 33.3, (0, 0): 0.0, (1, 1): 100.0, (9, 400): 2.2}
    found = spark.range(1).select(*[tenths(F.lit(a).cast("long"), F.lit(b).cast("long")).alias(f"{a}_{b}") for a, b in cases]).first()
    assert list(found) == list(cases.values())


def test_indicators_of_no_incidents(spark):
    df = spark.createDataFrame([], "run_id string, timestamp timestamp_ntz, action_taken string, rerun_succeeded boolean, pipeline_name string, confidence_score double")
    one = inc.kpis(df, F.lit(T0)).first()
    assert one["total"] == 0 and one["fix_rate"] == 0 and one["avg_conf"] == 0


def test_newest_row_of_a_key_stays(spark):
    d = [dt.date(2024, 1, x) for x in (1, 2, 3)]
    df = spark.createDataFrame([(1, "a", d[0]), (1, "b", d[2]), (1, "c", d[1]), (2, "x", d[0]), (2, "x", d[0])], "k int, v string, _ingest_date date")
    assert sorted((r["k"], r["v"]) for r in med.newest_by_key(df, ["k"], F.col("_ingest_date")).collect()) == [(1, "b"), (2, "x")]


def test_snapshots_keep_all_days_and_prune(spark):
    base = new_path(spark, "raw")
    for day in (1, 2, 3):
        raw.copy_table(spark.range(day), base, "t", dt.date(2024, 1, day))
    assert raw.scan_snapshots(spark, base, "t").count() == 6
    late = raw.scan_snapshots(spark, base, "t", dt.date(2024, 1, 3))
    assert late.count() == 3 and all("dd=03" in f for f in late.inputFiles())
    assert raw.scan_snapshots(spark, base, "t", dt.date(2025, 1, 1)).count() == 0
    with pytest.raises(AnalysisException):
        raw.scan_snapshots(spark, base, "none")


def test_bronze_carries_day_and_file(spark):
    base = new_path(spark, "raw")
    path = raw.copy_table(spark.range(3), base, "t", dt.date(2024, 1, 5))
    row = med.bronze(spark, base, "t").first()
    assert row["_ingest_date"] == dt.date(2024, 1, 5) and path.split("/")[-4] in row["_source_file"]


def test_failed_loads_are_reported(spark):
    report = med.load_report(spark, {"a": lambda: 3, "b": lambda: med.save(spark.read.parquet(new_path(spark, "none")), "x")}).collect()
    assert [(r["table_name"], r["status"], r["n_rows"]) for r in report] == [("a", "OK", 3), ("b", "SKIP", None)] and report[1]["error"]


def test_source_tables_and_silver_names(spark):
    listing = spark.createDataFrame([("s", "t", "BASE TABLE"), ("s", "v", "VIEW"), ("u", "w", "BASE TABLE")], "table_schema string, table_name string, table_type string")
    assert {r["table_name"] for r in raw.source_tables(listing).collect()} == {"t", "w"}
    assert {r["table_name"] for r in raw.source_tables(listing, "s").collect()} == {"t"}
    assert med.bronze_tables(["bronze_a", "silver_a", "bronze_bronze_b"]) == {"bronze_a": "silver_a", "bronze_bronze_b": "silver_bronze_b"}


def test_replies(spark):
    texts = {
        "fence": 'so:\n```json\nhere {"error_category": "auth", "is_auto_fixable": true, "confidence_score": 0.5} bye\n```\n{"error_category": "infra"}',
        "plain fence": '```\n{"error_category": "schema"}\n```',
        "braces": 'I say {"error_category": "infra", "root_cause": "x"} indeed',
        "null": '{"error_category": null, "root_cause": null}',
        "odd": '{"error_category": "weather"}',
        "none": "no idea",
        "broken": '{"error_category": ',
        "missing": None,
    }
    df = spark.createDataFrame(list(texts.items()), "name string, reply string")
    found = {r["name"]: (r["parsed"], r["error_category"], r["is_auto_fixable"], r["root_cause"], r["confidence_score"]) for r in kb.parse_replies(df).collect()}
    bad = (False, "unknown", False, "Response parsing failed", 0.0)
    assert found == {
        "fence": (True, "auth", True, "Unknown", 0.5),
        "plain fence": (True, "schema", False, "Unknown", 0.0),
        "braces": (True, "infra", False, "x", 0.0),
        "null": (True, "unknown", False, "Unknown", 0.0),
        "odd": (True, "unknown", False, "Unknown", 0.0),
        "none": bad,
        "broken": bad,
        "missing": bad,
    }


def test_one_id_for_one_error_text(spark):
    rows = [("a", "E", "c1", "r1", T0, "1"), ("b", "E", "c2", "r2", T0 + dt.timedelta(1), "2"), ("c", None, None, None, T0, "3")]
    df = spark.createDataFrame(rows, "pipeline_name string, error_message string, root_cause string, resolution string, timestamp timestamp_ntz, run_id string")
    docs = {r["document"].split("\n")[0]: r["id"] for r in kb.incident_docs(df).collect()}
    assert set(docs) == {"Pipeline: b", "Pipeline: c"} and all(len(i) == len("incident_") + 12 for i in docs.values())


def test_tables_are_copied_side_by_side_and_failures_named(spark):
    base = new_path(spark, "raw")
    jobs = {f"t{i}": (lambda i=i: spark.range(i)) for i in range(5)} | {"gone": lambda: spark.read.parquet(new_path(spark, "none"))}
    report = raw.copy_tables(jobs, base, dt.date(2024, 1, 1))
    assert report.pop("gone") == "PATH_NOT_FOUND" and set(report.values()) == {"OK"}
    assert raw.scan_snapshots(spark, base, "t3").count() == 3


def test_whole_files_become_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "guide.md").write_text("# one\n\ntwo\n")
    (tmp_path / "rules.json").write_text('[{"p": 1},\n {"p": 2}]')
    (tmp_path / "single.json").write_text('{"p": 3}')
    texts = kb.text_docs(files.whole_files(spark, str(tmp_path), ".md")).collect()
    assert [(r["id"], r["document"], r["type"]) for r in texts] == [("runbook_guide", "# one\n\ntwo\n", "runbook")]
    rules = kb.rule_docs(files.whole_files(spark, str(tmp_path), ".json")).collect()
    assert {r["id"] for r in rules} == {"error_pattern_rules_0", "error_pattern_rules_1", "error_pattern_single_0"}
    (tmp_path / "broken.json").write_text('[{"p": 1},')
    (tmp_path / "odd.json").write_text('{"p": ')
    bad = kb.broken_rules(files.whole_files(spark, str(tmp_path), ".json")).collect()
    assert {r["path"].split("/")[-1] for r in bad} == {"broken.json", "odd.json"}


def test_log_and_export_round_trip(spark, tiny):
    from runlake import views

    path, out = new_path(spark, "log"), new_path(spark, "export")
    incidents = views.incidents(spark, tiny)
    records.append_incidents(incidents, path)
    records.append_incidents(incidents.limit(1), path)
    assert records.read_incidents(spark, path).count() == incidents.count() + 1
    records.write_export(incidents, out)
    back = spark.read.csv(out, header=True)
    assert back.columns == list(inc.EXPORT) and back.count() == incidents.count()


def test_items_without_a_name(spark):
    df = spark.createDataFrame([("1", None, "A"), ("2", "n", "A"), ("3", "x", "B")], "id string, display_name string, type string")
    assert [r["name"] for r in ops.items_of(df, "A").collect()] == ["1", "n"]
    assert {r["type"]: r["n"] for r in ops.item_counts(df).collect()} == {"A": 2, "B": 1}


def test_accepted_reruns_are_named_by_their_location(spark):
    df = spark.createDataFrame([("https://x/y/run-7",), ("https://x/y/",), ("run-8",), ("",), (None,)], "location string")
    assert [r["new_run_id"] for r in ops.accepted(df).collect()] == ["run-7", None, "run-8", None, None]


def test_lookback_leaves_out_what_has_not_ended(spark):
    df = spark.createDataFrame([("a", T0), ("b", T0 - dt.timedelta(minutes=61)), ("c", None)], "run_id string, end_time timestamp_ntz")
    assert [r["run_id"] for r in ops.within_minutes(df, 60, F.lit(T0)).collect()] == ["a"]


def test_new_failures_of_repeated_runs(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "run_id string")
    assert [r["run_id"] for r in ops.not_handled(df, spark.createDataFrame([("b",), (None,)], "run_id string")).collect()] == ["a"]


def test_runs_without_an_id_are_all_new(spark):
    df = spark.createDataFrame([(None, "w"), (None, "w"), ("unknown", "w"), ("unknown", "w"), ("a", "w"), ("a", "w"), ("b", "w")], "run_id string, workspace_id string")
    new = ops.not_handled(df, spark.createDataFrame([("b",), ("unknown",), (None,)], "run_id string"))
    assert sorted(str(r["run_id"]) for r in new.collect()) == ["None", "None", "a", "unknown", "unknown"]
    assert ops.by_workspace(new).first()["new_failures"] == 5


def test_context_without_hits(spark):
    queries = spark.createDataFrame([(1, [0.0])], "query_id int, embedding array<double>")
    docs = spark.createDataFrame([], "id int, document string, source string, type string, embedding array<double>")
    hits = search(queries, docs)
    assert kb.context(hits, docs, queries).first()["context"] == "No similar past errors found in knowledge base."
    assert kb.references(hits, docs).count() == 0
