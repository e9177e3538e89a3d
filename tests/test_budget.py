"""Retry budgets with resets against a simulation row by row, and the parts of the prefix scan."""

import datetime as dt
import random
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runlake.operators import budget as bd, policy

T0 = dt.datetime(2024, 1, 1)
ATTEMPT = "run_id string, pipeline_id string, start_time timestamp_ntz, outcome boolean, used_before string, `a.b` int"


def simulated(rows, budget, resets=()):
    """(used, escalate) of each run, one row after the other."""
    events = [(p, t, 1, run, outcome) for run, p, t, outcome, *_ in rows] + [(p, t, 0, "", None) for p, t in resets]
    used, out = {}, {}
    for pipeline, _, kind, run, outcome in sorted(events, key=lambda e: (e[0] or "", e[1], e[2], e[3])):
        if pipeline is None:
            out[run] = (0, False)
            continue
        n = used.get(pipeline, 0)
        if kind == 0:
            used[pipeline] = 0
            continue
        out[run] = (n, n == budget)
        if n < budget and outcome is not None:
            used[pipeline] = 0 if outcome else n + 1
    return out


def attempts(n=600, seed=2, hot=0.5):
    """Half of all runs in one pipeline; successes, failures and reruns that go on."""
    rng = random.Random(seed)
    name = lambda: "hot" if rng.random() < hot else rng.choice([*"abcdefgh", None])
    return [(f"r{i:05}", name(), T0 + dt.timedelta(minutes=rng.randint(0, 300)), rng.choice((True, False, False, False, None)), "x", i) for i in range(n)]


@pytest.mark.parametrize("budget", [1, 2, 3, 4, 5])
def test_equals_the_simulation_with_one_pipeline_in_many_ranges(spark, budget):
    rows = attempts()
    rng = random.Random(budget)
    resets = [(rng.choice(["hot", "a", "never"]), T0 + dt.timedelta(minutes=rng.randint(0, 300))) for _ in range(12)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        given_ = spark.createDataFrame(resets + [(None, T0), ("a", None)], "pipeline_id string, end_time timestamp_ntz")
        df = spark.createDataFrame(rows, ATTEMPT).repartition(3)
        found = bd.with_resets(df, budget, given_)
        assert found.columns == [*df.columns, "used", "escalate"]
        assert {r["run_id"]: (r["used"], r["escalate"]) for r in found.collect()} == simulated(rows, budget, resets)
        plain = bd.with_resets(df, budget)
        assert {r["run_id"]: (r["used"], r["escalate"]) for r in plain.collect()} == simulated(rows, budget)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_budget_of_one_is_the_policy_without_resets(spark):
    rows = [r for r in attempts(200) if r[1]]
    df = spark.createDataFrame(rows, ATTEMPT)
    once = {r["run_id"]: r["escalate"] for r in policy.retry_once(df).collect()}
    mine = {r["run_id"]: r["escalate"] for r in bd.with_resets(df, 1).collect()}
    # a success that was never tried, after the budget was used up, gives nothing back
    assert mine == {run: e for run, (_, e) in simulated(rows, 1).items()} == once


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5), st.lists(st.lists(st.integers(0, 3), max_size=6), max_size=5))
def test_composition_is_what_the_rows_do(budget, parts):
    table = bd.transitions(budget)
    whole = [reduce(lambda s, x: table[x][s], sum(parts, []), s) for s in range(budget + 1)]
    state = list(range(budget + 1))
    for part in parts:
        f = bd.composed(part, budget)
        state = [f[s] for s in state]
    assert state == whole


def test_entry_states_follow_a_pipeline_over_partitions():
    f = bd.composed([bd.FAILED], 3)
    parts = [
        {"part": 2, "first": "p", "last": "p", "function": f, "final": 0},
        {"part": 0, "first": "a", "last": "p", "function": f, "final": 1},
        {"part": 5, "first": "p", "last": "q", "function": f, "final": 2},
        {"part": 9, "first": "r", "last": "r", "function": f, "final": 0},
    ]
    assert bd.entry_states(parts, 3) == {0: 0, 2: 1, 5: 2, 9: 0}


def test_no_attempts(spark):
    assert bd.with_resets(spark.createDataFrame([], ATTEMPT), 2).count() == 0
    with pytest.raises(ValueError):
        bd.with_resets(spark.createDataFrame([], ATTEMPT), 0)
