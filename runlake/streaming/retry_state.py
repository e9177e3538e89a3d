"""The retry policy as a keyed state: runs may arrive out of order, decisions are made in event order.

Each pipeline holds a counter of its attempts and the runs whose turn has not come, as one value in RocksDB
that is read and written once a batch. A run waits until the watermark has passed its second; the pipeline's
one timer then hands on all runs whose turn has come, in the order of (start_time, run_id), so that batches in
any order, within the allowed lateness, give the decisions of ``policy.decide``. A run that has the whole
budget of attempts before it among those that have arrived needs no order: whatever still comes cannot change
it, it is decided at once and never held. So the state is one number a pipeline, and the runs of the last
while up to the attempt that uses the budget up. Where more than ``FEW`` runs that try nothing wait in one
pipeline, they go to blocks by hour, which are written once and read when their turn comes.

Runs without a start are decided on arrival. Runs later than the allowed lateness are dropped by the
watermark and counted (``dropped``); a run without an id is a beat that only moves the time on.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from runlake.schemas import ALERT_SENT, AUTO_RERUN, MAX_RETRIES, RETRY_BUDGET

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISION = "run_id string, pipeline_id string, start_us long, action_taken string, success boolean, retry_count int"
DECIDED = Row(*(c.split(" ")[0] for c in DECISION.split(", ")))
#: A waiting run, as its pipeline's order sorts it.
RUNS = "runs array<struct<start_us: long, run_id: string, tries: boolean>>"
#: Milliseconds of runs that come due together.
TICK = 1000
#: Waiting runs that a pipeline's value holds, and milliseconds of a block of more.
FEW, BLOCK = 1000, 3_600_000


def due_at(run: tuple) -> int:
    """The watermark in milliseconds at which a run's turn has come."""
    return (run[0] // 1000 // TICK + 1) * TICK


def block_of(run: tuple) -> int:
    return run[0] // 1000 // BLOCK


class RetryBudget(StatefulProcessor):
    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", f"n int, due long, parts int, {RUNS}")
        self.blocks = handle.getMapState("blocks", "block long, part int", RUNS)

    def decided(self, key, n: int, run: tuple) -> tuple[int, Row]:
        """The attempts after a run, and its decision."""
        start, run_id, tries = run
        action = MAX_RETRIES if n >= self.budget else AUTO_RERUN if tries else ALERT_SENT
        n += action == AUTO_RERUN
        return n, DECIDED(run_id, key[0], start, action, action == AUTO_RERUN, n)

    def put_away(self, runs: list[tuple], parts: int) -> int:
        """Writes runs to their blocks, as parts that no earlier one has the number of; gives the parts so far."""
        for block, some in groupby(sorted(runs), block_of):
            parts += 1
            self.blocks.updateValue((block, parts), (list(some),))
        return parts

    def hold(self, was: int | None, n: int, due: int | None, parts: int, runs: list[tuple]) -> None:
        """Writes a pipeline's value, and moves its timer from ``was`` to ``due``."""
        if due != was:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)
        self.own.update((n, due, parts, runs))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, due, parts, held = self.own.get() or (0, None, 0, ())
        held = [tuple(r) for r in held]
        # no more waiting tries than the budget has left; the last of these uses it up, and what comes after it is decided
        tries, others = sorted(r for r in held if r[2]), [r for r in held if not r[2]]
        before, was, away = (n, parts, tries + others), due, []
        beyond = lambda run: len(tries) == self.budget - n and (not tries or run > tries[-1])
        for row in rows:
            if row.run_id is None:
                continue
            run = (row.start_us, row.run_id, row.tries)
            if row.start_us is None:
                n, out = self.decided(key, n, run)
                yield out
            elif beyond(run):
                yield self.decided(key, self.budget, run)[1]
            elif row.tries:
                insort(tries, run)
            else:
                others.append(run)
            if len(tries) > self.budget - n:
                yield self.decided(key, self.budget, tries.pop())[1]
            if len(others) >= FEW:
                for run in filter(beyond, others):
                    yield self.decided(key, self.budget, run)[1]
                others = [r for r in others if not beyond(r)]
                if len(others) >= FEW:
                    parts = self.put_away(others, parts)
                    away.append(min(map(due_at, others)))
                    others = []
        for run in filter(beyond, others):
            yield self.decided(key, self.budget, run)[1]
        others = [r for r in others if not beyond(r)]
        if (n, parts, tries + others) != before:
            due = min([*map(due_at, tries + others), *away, *([was] if before[1] else [])], default=None)
            self.hold(was, n, due, parts, tries + others)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        n, was, parts, held = self.own.get()
        held = sorted(tuple(r) for r in held)
        ready, rest = [r for r in held if due_at(r) <= now], [r for r in held if due_at(r) > now]
        dues = [due_at(r) for r in rest[:1]]
        if parts:
            places = sorted(tuple(p) for p in self.blocks.keys())
            open_ = [p for p in places if p[0] * BLOCK < now]
            dues += [p[0] * BLOCK + TICK for p in places[len(open_) :][:1]]
            parts = max((p[1] for p in places[len(open_) :]), default=0)
            for block, some in groupby(open_, lambda p: p[0]):
                runs = []
                for place in some:
                    runs += [tuple(r) for r in self.blocks.getValue(place)[0]]
                    self.blocks.removeKey(place)
                here = [r for r in ready if block_of(r) <= block]
                ready = ready[len(here) :]
                for run in sorted(here + [r for r in runs if due_at(r) <= now]):
                    n, out = self.decided(key, n, run)
                    yield out
                later = [r for r in runs if due_at(r) > now]
                parts = self.put_away(later, parts)
                dues += [min(map(due_at, later))] if later else []
        for run in ready:
            n, out = self.decided(key, n, run)
            yield out
        self.hold(None if was == expiredTimerInfo.getExpiryTimeInMs() else was, n, min(dues, default=None), parts, rest)


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Sets the session's state store, unless one is chosen already; its files are below a query's checkpoint."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, ROCKSDB)


@contextmanager
def state_layout(spark: SparkSession) -> Iterator[None]:
    """How a query that starts meanwhile keeps its state; its checkpoint holds on to it, other queries are not touched.

    Each store is loaded, committed and copied to the checkpoint in every batch, whatever it holds, and a
    state keeps its number of partitions for ever. So that number follows the cores and is no larger than
    ``spark.sql.shuffle.partitions``, which may grow with the rows; stores in RocksDB are on disk and take any
    number of rows. A join keeps its four tables in one store a partition.
    """
    partitions, version = "spark.sql.shuffle.partitions", "spark.sql.streaming.join.stateFormatVersion"
    before = {name: spark.conf.get(name) for name in (partitions, version)}
    spark.conf.set(partitions, min(int(before[partitions]), 2 * spark.sparkContext.defaultParallelism))
    spark.conf.set(version, max(int(before[version]), 3))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def in_event_order(candidates: DataFrame, lateness: str, budget: int = RETRY_BUDGET) -> DataFrame:
    """Decisions (run_id, pipeline_id, start_time, action_taken, success, retry_count) on a stream of failed runs.

    ``candidates`` has run_id, pipeline_id, start_time, is_auto_fixable and triggered; a null flag is no try.
    """
    keep_state_in_rocksdb(candidates.sparkSession)
    start = F.col("start_time").cast("timestamp")
    tries = F.coalesce(F.col("is_auto_fixable") & F.col("triggered"), F.lit(False))
    rows = candidates.select("run_id", "pipeline_id", start.alias("start_time"), F.unix_micros(start).alias("start_us"), tries.alias("tries"))
    found = rows.withWatermark("start_time", lateness).groupBy("pipeline_id").transformWithState(RetryBudget(budget), DECISION, "Append", "EventTime")
    return found.select("run_id", "pipeline_id", F.timestamp_micros("start_us").cast("timestamp_ntz").alias("start_time"), "action_taken", "success", "retry_count")


def dropped(query: StreamingQuery) -> int:
    """Rows that a query's recent batches have dropped because they came too late."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
