"""Streams: disorder, restarts, late and missing reruns, poisoned batches, idle calls, bounded state."""

import datetime as dt
import random
import threading
import time

import pytest
from pyspark.sql import functions as F
from test_operators import CANDIDATE, T0, candidate_rows, simulated

from runlake.operators import policy
from runlake.storage import new_path
from runlake.streaming import retry_state, streams

HOURS = lambda h: T0 + dt.timedelta(hours=h)


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def decisions(found):
    return {r["run_id"]: (r["action_taken"], r["success"], r["retry_count"]) for r in found.collect()}


@pytest.mark.parametrize("budget", [1, 3])
def test_retry_state_orders_shuffled_batches_over_restarts(spark, budget):
    rows = candidate_rows()
    random.Random(1).shuffle(rows)
    landed, base = new_path(spark, "landed"), new_path(spark, "stream")
    for i in range(3):
        land(spark, landed, rows[i::3], CANDIDATE)
        streams.retry_decisions(streams.arrived(spark, landed), base, "2 hours", budget)  # each call is a restart
    streams.beat(spark, landed, start_time=F.lit(HOURS(24)))
    found = streams.retry_decisions(streams.arrived(spark, landed), base, "2 hours", budget)
    assert decisions(found) == simulated(rows, budget)
    batch = {r["run_id"]: (r["action_taken"], r["success"], r["retry_count"]) for r in policy.decide(spark.createDataFrame(rows, CANDIDATE), budget).collect()}
    assert decisions(found) == batch


def test_retry_state_is_bounded_and_counts_what_came_too_late(spark):
    landed, base = new_path(spark, "landed"), new_path(spark, "stream")
    rows = [(f"r{i:03}", f"p{i % 3}", HOURS(i), True, True) for i in range(60)]
    held = []
    for i in range(0, 60, 12):
        land(spark, landed, rows[i : i + 12], CANDIDATE)
        query = streams.drain(retry_state.in_event_order(streams.arrived(spark, landed), "3 hours"), base, lambda rows, batch: streams.put(rows, base, "decisions", batch))
        held.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert max(held[1:]) <= max(held[0], 3 + 3 * 4)  # counters, and no more than the last hours' runs and timers
    land(spark, landed, [("late", "p0", HOURS(2), True, True), ("r060", "p0", HOURS(60), True, True)], CANDIDATE)
    query = streams.drain(retry_state.in_event_order(streams.arrived(spark, landed), "3 hours"), base, lambda rows, batch: streams.put(rows, base, "decisions", batch))
    assert retry_state.dropped(query) == 1
    assert "late" not in decisions(streams.all_of(spark, base, "decisions"))


def test_retry_state_holds_nothing_that_is_decided_and_a_pipeline_once(spark):
    """Runs with the budget's attempts before them do not wait, whatever the watermark; the others are one value."""
    landed, base = new_path(spark, "landed"), new_path(spark, "stream")
    rows = [(f"r{i:03}", f"p{i % 3}", HOURS(i), True, True) for i in range(60)]
    land(spark, landed, rows[30:], CANDIDATE)
    land(spark, landed, rows[:30], CANDIDATE)
    query = streams.drain(retry_state.in_event_order(streams.arrived(spark, landed), "100 hours"), base, lambda rows, batch: streams.put(rows, base, "decisions", batch))
    operator = query.recentProgress[-1]["stateOperators"][0]
    assert operator["numRowsTotal"] <= 3 and operator["customMetrics"]["numRegisteredTimers"] <= 3
    early = decisions(streams.all_of(spark, base, "decisions"))
    assert len(early) == 60 - 3 * 3 and set(early.values()) == {("max_retries_exceeded", False, 3)}
    streams.beat(spark, landed, start_time=F.lit(HOURS(1000)))
    found = streams.retry_decisions(streams.arrived(spark, landed), base, "100 hours")
    assert decisions(found) == simulated(rows, 3) and found.count() == 60


def test_many_waiting_runs_of_one_pipeline_go_to_blocks(spark):
    rows = [(f"r{i:04}", f"p{i % 50 == 0}", HOURS(i % 977 / 49), i % 1300 == 1299, True) for i in range(4000)]
    late = random.Random(2)
    rows.sort(key=lambda r: r[2] + dt.timedelta(hours=late.uniform(0, 6)))  # of 20 hours
    landed, base = new_path(spark, "landed"), new_path(spark, "stream")
    for i in range(3):
        part = rows[i * 1400 : (i + 1) * 1400]
        land(spark, landed, late.sample(part, len(part)), CANDIDATE)
        streams.retry_decisions(streams.arrived(spark, landed), base, "8 hours")
    some = streams.all_of(spark, base, "decisions").count()
    assert 0 < some < 4000  # the first of them had their turn, blocks in part
    streams.beat(spark, landed, start_time=F.lit(HOURS(100)))
    found = streams.retry_decisions(streams.arrived(spark, landed), base, "8 hours")
    assert decisions(found) == simulated(rows, 3) and found.count() == 4000


def test_runs_are_handled_once_over_batches(spark):
    landed, base = new_path(spark, "landed"), new_path(spark, "stream")
    schema = "run_id string, start_time timestamp_ntz"
    for rows in ([("a", T0), ("a", T0), ("b", T0)], [("b", T0), ("c", T0)], [("a", T0)]):
        land(spark, landed, rows, schema)
        found = streams.once_each(streams.arrived(spark, landed), base)
    assert sorted(r["run_id"] for r in found.collect()) == ["a", "b", "c"]
    assert sorted(r["run_id"] for r in streams.once_each(streams.arrived(spark, landed), base).collect()) == ["a", "b", "c"]  # nothing new


def test_repeats_are_known_for_a_while_only_and_the_state_stays_small(spark):
    landed, base = new_path(spark, "landed"), new_path(spark, "stream")
    schema, held = "run_id string, start_time timestamp_ntz", []
    for i in range(6):
        land(spark, landed, [(f"r{i}-{k}", HOURS(i * 10)) for k in range(5)] * 2, schema)
        found = streams.once_each(streams.arrived(spark, landed), base, within="1 hour")
        held.append(streams.names(spark, f"{base}/seen/batch=*"))
    assert found.count() == 30 and len(held[-1]) >= 6


def test_a_batch_touches_its_own_ids_in_the_state_only(spark):
    landed, base, schema = new_path(spark, "landed"), new_path(spark, "stream"), "run_id string, start_time timestamp_ntz"
    retry_state.keep_state_in_rocksdb(spark)
    touched = []
    for i in range(4):
        land(spark, landed, [(f"r{k}", T0) for k in range(100)] + [(f"new{i}", T0)], schema)
        query = streams.drain(streams.arrived(spark, landed).dropDuplicates(["run_id"]), base, lambda rows, batch: streams.put(rows, base, "seen", batch))
        operator = query.recentProgress[-1]["stateOperators"][0]
        touched.append((operator["numRowsUpdated"], operator["numRowsTotal"]))
    assert touched == [(101, 101), (1, 102), (1, 103), (1, 104)]
    assert "rocksdbGetCount" in operator["customMetrics"]


RUN = "run_id string, status string, end_time timestamp_ntz"
ASKED = "run_id string, new_run_id string, timestamp timestamp_ntz"


def test_reruns_are_awaited_and_given_up(spark):
    minutes = lambda m: T0 + dt.timedelta(minutes=m)
    asked = [("i1", "n1", minutes(0)), ("i2", "n2", minutes(1)), ("i3", "n3", minutes(2)), ("i4", None, minutes(2)), ("i5", "n5", minutes(3)), ("i6", "n6", minutes(500))]
    runs = [("n1", "Succeeded", minutes(1)), ("n2", "Failed", minutes(2)), ("n3", "Succeeded", minutes(9)), ("n5", "Running", None), ("n6", "Cancelled", minutes(501)), ("other", "Failed", minutes(502))]
    a, b, base = new_path(spark, "asked"), new_path(spark, "runs"), new_path(spark, "stream")
    go = lambda: streams.outcomes(streams.arrived(spark, a), streams.arrived(spark, b), base, "10 minutes")
    land(spark, a, asked[:3], ASKED)
    land(spark, b, runs[1:2], RUN)  # the rerun before its incident's batch has company
    first = {r["run_id"]: r["outcome"] for r in go().collect()}
    assert first == {"i2": False}
    land(spark, a, asked[3:5], ASKED)
    land(spark, b, [runs[0], *runs[2:4]], RUN)
    second = {r["run_id"]: r["outcome"] for r in go().collect()}
    assert second == {"i1": True, "i2": False, "i4": None}
    land(spark, a, asked[5:], ASKED)
    land(spark, b, runs[4:], RUN)
    go()
    for path, schema, row in ((a, ASKED, ("end", "none", minutes(5000))), (b, RUN, ("end", "Failed", minutes(5000)))):
        land(spark, path, [row], schema)
    found = {r["run_id"]: r["outcome"] for r in go().where("run_id <> 'end'").collect()}
    batch = policy.rerun_outcome(spark.createDataFrame(asked, ASKED), spark.createDataFrame(runs, RUN))
    assert found == {r["run_id"]: r["outcome"] for r in batch.collect()} == {"i1": True, "i2": False, "i3": None, "i4": None, "i5": None, "i6": False}


def test_awaiting_state_goes_when_the_bound_has_passed(spark):
    a, b, base = new_path(spark, "asked"), new_path(spark, "runs"), new_path(spark, "stream")
    held = []
    for i in range(5):
        at = T0 + dt.timedelta(hours=i)
        land(spark, a, [(f"i{i}-{k}", f"n{i}-{k}", at) for k in range(20)], ASKED)
        land(spark, b, [(f"n{i}-{k}", "Succeeded", at + dt.timedelta(seconds=30)) for k in range(0, 20, 2)], RUN)
        query = streams.drain(streams.awaited_outcomes(streams.arrived(spark, a), streams.arrived(spark, b), "1 minute"), base, lambda rows, batch: streams.put(rows, base, "outcomes", batch))
        held.append(sum(op["numRowsTotal"] for op in query.recentProgress[-1]["stateOperators"]))
    assert held[-1] <= held[0]


def test_states_have_few_stores_however_many_partitions_a_shuffle_has(spark):
    a, b, runs, both, one = (new_path(spark, x) for x in ("asked", "runs", "retry", "both", "one"))
    land(spark, a, [("i", "n", T0)], ASKED)
    land(spark, b, [("n", "Succeeded", T0)], RUN)
    land(spark, runs, [("r", "p", T0, True, True)], CANDIDATE)
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, "24")
    try:
        streams.outcomes(streams.arrived(spark, a), streams.arrived(spark, b), both, "1 minute")
        streams.retry_decisions(streams.arrived(spark, runs), one, "1 minute")
        assert spark.conf.get(name) == "24"
    finally:
        spark.conf.set(name, was)
    for base in (both, one):
        partitions = streams.names(spark, f"{base}/checkpoint/state/0/[0-9]*")
        assert 0 < len(partitions) <= 2 * spark.sparkContext.defaultParallelism
    assert not streams.names(spark, f"{both}/checkpoint/state/0/0/*-key*")  # the join's tables share a store


def failing_on(word):
    def check(rows):
        if rows.where(F.col("run_id") == word).count():
            raise ValueError(f"cannot handle {word}")

    return check


def test_a_poisoned_batch_goes_into_quarantine_and_can_be_replayed(spark):
    landed, base = new_path(spark, "landed"), new_path(spark, "stream")
    for name in "abxde":
        land(spark, landed, [(name, T0)], "run_id string, start_time timestamp_ntz")
        time.sleep(0.05)  # files are taken in the order of their times
    found = streams.ingest_tolerant(streams.arrived(spark, landed, files_at_once=1), base, failing_on("x"))
    assert sorted(r["run_id"] for r in found.collect()) == list("abde")
    (batch,) = streams.quarantined(spark, base)
    assert [r["run_id"] for r in spark.read.parquet(f"{base}/quarantine/batch={batch}").collect()] == ["x"]
    assert "cannot handle x" in spark.read.parquet(f"{base}/errors/batch={batch}").first()["error"]
    with pytest.raises(ZeroDivisionError):
        streams.replay(spark, base, lambda rows, batch: 1 / 0)
    assert streams.quarantined(spark, base) == [batch]
    assert streams.replay(spark, base, lambda rows, batch: streams.put(rows, base, "runs", batch)) == [batch]
    assert streams.quarantined(spark, base) == [] == streams.replay(spark, base, None)
    assert sorted(r["run_id"] for r in streams.all_of(spark, base, "runs").collect()) == list("abdex")


def test_polling_outlives_a_failed_cycle_and_ends_on_a_signal(spark, tmp_path):
    landed, base, stop = new_path(spark, "landed"), new_path(spark, "stream"), tmp_path / "stop"
    schema = "run_id string, start_time timestamp_ntz"
    land(spark, landed, [("a", T0)], schema)

    def feed():
        for name in "xb":
            time.sleep(4)
            land(spark, landed, [(name, T0)], schema)
        time.sleep(4)
        stop.write_text("")

    feeder = threading.Thread(target=feed)
    feeder.start()
    check = failing_on("x")

    def each(rows, batch):
        check(rows)
        streams.put(rows, base, "runs", batch)

    query = streams.poll(streams.arrived(spark, landed), base, each, every="500 milliseconds", stop=str(stop), look=0.2)
    feeder.join()
    assert not query.isActive and query.exception() is None
    assert sorted(r["run_id"] for r in streams.all_of(spark, base, "runs").collect()) == ["a", "b"] and len(streams.quarantined(spark, base)) == 1


INCIDENT = "pipeline_name string, error_message string, root_cause string, resolution string, timestamp timestamp_ntz, run_id string, error_category string"


def test_idle_calls_give_the_last_state(spark):
    landed, base, other = new_path(spark, "landed"), new_path(spark, "stream"), new_path(spark, "stream")
    for rows in ([("new", "E", "", "", HOURS(5), "9", "auth")], [("old", "E", "", "", T0, "1", "auth"), ("x", "F", "", "", T0, "2", "infra")]):
        land(spark, landed, rows, INCIDENT)
        docs = streams.grow_knowledge(streams.arrived(spark, landed), base)
        counts = streams.daily_counts(streams.arrived(spark, landed), other)
    for _ in range(2):
        assert {r["document"].split("\n")[0] for r in docs.collect()} == {"Pipeline: new", "Pipeline: x"}
        assert {(r["error_category"], r["n"]) for r in counts.collect()} == {("auth", 2), ("infra", 1)}
        docs = streams.grow_knowledge(streams.arrived(spark, landed), base)
        counts = streams.daily_counts(streams.arrived(spark, landed), other)
