"""Roll-ups by merged sketches and bitmaps against exact counts over the rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from runlake.operators import rollup as ru

T0 = dt.datetime(2024, 1, 1)


def test_merged_sketches_stay_within_their_rank_error(spark):
    n, k = 60_000, 256
    rows = spark.range(n).select((F.col("id") % 3).cast("string").alias("kind"), (F.col("id") % 40).alias("day"), (F.pmod(F.xxhash64("id"), F.lit(10**9))).alias("v"))
    rows = rows.unionByName(rows.limit(50).withColumn("v", F.lit(None).cast("long")))
    daily = ru.sketches(rows, ["kind", "day"], "v", k)
    exact = {r["kind"]: sorted(x["v"] for x in rows.where((F.col("kind") == r["kind"]) & F.col("v").isNotNull()).select("v").collect()) for r in rows.select("kind").distinct().collect()}
    for found in (ru.percentiles(ru.merged_up(daily, ["kind"], k)), ru.percentiles(ru.merged_up(ru.merged_up(daily, ["kind", "day"], k), ["kind"], k))):
        for r in found.collect():
            own = exact[r["kind"]]
            assert r["n"] == len(own)
            for name, rank in ru.PERCENTILES.items():
                below = sum(x <= r[name] for x in own) / len(own)
                assert abs(below - rank) <= 4 * 1.7 / k


def test_few_values_are_exact(spark):
    rows = spark.createDataFrame([("a", x) for x in (5, 1, 9, 3)] + [("b", None)], "kind string, v long")
    found = {r["kind"]: r for r in ru.percentiles(ru.sketches(rows, ["kind"], "v")).collect()}
    assert set(found) == {"a"} and (found["a"]["n"], found["a"]["p50"], found["a"]["p90"], found["a"]["p99"]) == (4, 3, 9, 9)


def test_distinct_names_of_any_span(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *(f"p{i}" for i in range(60))]), T0 + dt.timedelta(days=rng.choice((0, 1, 2, 5, 9, 30, 31)), hours=rng.randint(0, 23))) for _ in range(500)]
    rows += [(None, T0 + dt.timedelta(days=50)), ("p1", None)] + [("hot", T0 + dt.timedelta(days=5))] * 300
    df = spark.createDataFrame(rows, "pipeline_name string, timestamp timestamp_ntz")
    names = ru.dictionary(df, "pipeline_name")
    assert names.count() == names.select("number").distinct().count()
    daily = ru.daily_bitmaps(df, names, "pipeline_name")
    spans = (1, 7, 14, 30)
    found = {(r["anchor"], r["days"]): r["n"] for r in ru.distinct_over_spans(daily, spans, "n").collect()}
    days = {t.date() for _, t in rows if t}
    expected = {(a, s): len({n for n, t in rows if n and t and a - dt.timedelta(days=s) < t.date() <= a}) for a in days for s in spans}
    assert found == expected


def test_names_beyond_one_bucket(spark):
    df = spark.range(70_000).select(F.concat(F.lit("p"), "id").alias("name"), F.lit(T0).cast("timestamp_ntz").alias("timestamp"))
    daily = ru.daily_bitmaps(df, ru.dictionary(df, "name"), "name")
    assert daily.count() > 2
    assert {r["n"] for r in ru.distinct_over_spans(daily, (1, 7), "n").collect()} == {70_000}
