"""Retry budgets that a success gives back, as an automaton run over range partitions.

What a run finds depends on all earlier decisions of its pipeline: an attempt is made only while the budget
lasts, and only an attempt that was made can succeed and give the budget back. That is a small automaton
whose state is the number of attempts used. Rows are dealt to range partitions of (pipeline, time), so that
one busy pipeline lies in many of them. Each partition reduces its first pipeline's rows to a function from
the state before to the state after; one row a partition is composed in order; then each partition runs
through its rows from its own entry state. No task holds more than a range partition, whatever a pipeline has.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from runlake.storage import new_path

#: What a row tells the automaton.
RUNNING, FAILED, SUCCEEDED, RESET = range(4)
ORDER = ("_rb_pipeline", "_rb_time", "_rb_kind", "_rb_id")


def transitions(budget: int) -> list[list[int]]:
    """For each symbol, the state after each state: 0 to ``budget`` attempts used.

    A used-up budget makes no attempt, so only a reset leaves it. An attempt that still runs is not counted yet.
    """
    states = range(budget + 1)
    return [
        [s for s in states],
        [min(s + 1, budget) for s in states],
        [s if s == budget else 0 for s in states],
        [0 for _ in states],
    ]


def composed(symbols: Iterable[int], budget: int) -> list[int]:
    """The function that a row of symbols is: the state after them for each state before."""
    table, known = transitions(budget), {}
    now = tuple(range(budget + 1))
    for symbol in symbols:
        after = known.get((now, symbol))
        if after is None:
            after = known[now, symbol] = tuple(table[symbol][s] for s in now)
        now = after
    return list(now)


def entry_states(parts: Iterable, budget: int) -> dict[int, int]:
    """The state in which each partition's first pipeline comes in, from one row for each partition.

    A row has part, first and last (pipelines), function (of the first one's rows) and final (state of the
    last one, if it is another). Only the first pipeline of a partition can have rows in an earlier one.
    """
    out, pipeline, state = {}, None, 0
    for row in sorted(parts, key=lambda r: r["part"]):
        out[row["part"]] = entering = state if row["first"] == pipeline else 0
        pipeline, state = row["last"], row["function"][entering] if row["first"] == row["last"] else row["final"]
    return out


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ORDER], null_placement="at_start"))


def with_resets(attempts: DataFrame, budget: int, resets: DataFrame | None = None, reset_time: str = "end_time") -> DataFrame:
    """Adds used (attempts that the run finds used) and escalate (whether that is the whole budget).

    ``attempts`` has pipeline_id, start_time, run_id and outcome: what its rerun came to, or would have:
    true succeeded (the budget is whole again), false failed (one more is used), null still running (it is
    checked again and uses nothing yet). ``resets`` (pipeline_id and a time) make a budget whole whatever
    it is, before runs that start at that time or later. Order is (start_time, run_id), nulls first; runs
    equal in both are taken in any order. Runs without a pipeline have a budget of their own each.
    """
    if budget < 1:
        raise ValueError("a budget is 1 or more")
    own = StructType(attempts.schema.fields)
    symbol = F.when(F.col("outcome").isNull(), RUNNING).when(F.col("outcome"), SUCCEEDED).otherwise(FAILED)
    key = [F.col("pipeline_id").alias("_rb_pipeline"), F.col("start_time").alias("_rb_time"), F.lit(1).alias("_rb_kind"), F.col("run_id").alias("_rb_id")]
    rows = attempts.where("pipeline_id is not null").select(*key, symbol.alias("_rb_symbol"), F.struct(*[F.col(f"`{c}`") for c in attempts.columns]).alias("_rb_row"))
    if resets is not None:
        time, ident = attempts.schema["start_time"].dataType, attempts.schema["run_id"].dataType
        given = resets.where(F.col("pipeline_id").isNotNull() & F.col(reset_time).isNotNull())
        rows = rows.unionByName(given.select(F.col("pipeline_id").alias("_rb_pipeline"), F.col(reset_time).cast(time).alias("_rb_time"), F.lit(0).alias("_rb_kind"), F.lit(None).cast(ident).alias("_rb_id"), F.lit(RESET).alias("_rb_symbol"), F.lit(None).cast(own).alias("_rb_row")))
    path = new_path(attempts.sparkSession, "budget")  # written once: both passes must see the same partitions
    rows.repartitionByRange(*ORDER).withColumn("_rb_part", F.spark_partition_id()).write.parquet(path)
    dealt = attempts.sparkSession.read.parquet(path)

    def reduce_part(rows: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        pipelines, symbols = rows.column("_rb_pipeline"), rows.column("_rb_symbol").to_pylist()
        first, last = pipelines[0], pipelines[-1]
        head = pc.sum(pc.equal(pipelines, first)).as_py()
        tail = 0 if first == last else pc.sum(pc.equal(pipelines, last)).as_py()
        final = composed(symbols[len(symbols) - tail :], budget)[0]
        return pa.table({"part": rows.column("_rb_part")[:1], "first": pipelines[:1], "last": pipelines[-1:], "function": pa.array([composed(symbols[:head], budget)], pa.list_(pa.int32())), "final": pa.array([final], pa.int32())})

    name = attempts.schema["pipeline_id"].dataType.simpleString()
    parts = dealt.drop("_rb_row").groupBy("_rb_part").applyInArrow(reduce_part, f"part int, first {name}, last {name}, function array<int>, final int")
    entering = entry_states(parts.collect(), budget)  # one row for each range partition

    def run_part(rows: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        table, pipeline, used = transitions(budget), None, []
        state = entering[rows.column("_rb_part")[0].as_py()]
        for now, symbol in zip(rows.column("_rb_pipeline").to_pylist(), rows.column("_rb_symbol").to_pylist()):
            if now != pipeline:
                state, pipeline = (state if pipeline is None else 0), now
            used.append(state)
            state = table[symbol][state]
        return pa.table({"row": rows.column("_rb_row"), "used": pa.array(used, pa.int32())}).filter(pc.equal(rows.column("_rb_kind"), 1))

    done = dealt.groupBy("_rb_part").applyInArrow(run_part, StructType([StructField("row", own), StructField("used", IntegerType())])).select("row.*", "used")
    alone = attempts.where("pipeline_id is null").withColumn("used", F.lit(0))
    return done.unionByName(alone).withColumn("escalate", F.col("used") >= budget)
