"""Roll-ups that merge: quantile sketches and exact distinct counts, kept by day and combined without the rows.

A day's quantile sketch (KLL) is a few kilobytes whatever the day holds; sketches of days add up to one of
a month or of a category. A day's distinct names are a bitmap over a dictionary of names, and the names of
any span of days are the union of its bitmaps, exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.storage import new_path

#: Accuracy of a sketch: exact for up to so many values, beyond that about 1.7 / K of all ranks.
K = 4096
#: Names as ranks in percent.
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def whole_seconds(start: str, end: str) -> Column:
    """Whole seconds between two times, rounded down."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return F.floor((micros(end) - micros(start)) / 1_000_000)


def sketches(rows: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """The keys and a sketch of the values of each group, built by partial aggregates; groups without a value go."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_bigint(F.col(value).cast("long"), k).alias("sketch"))


def merged_up(daily: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return daily.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch", k).alias("sketch"))


def percentiles(sketched: DataFrame, ranks: dict[str, float] = PERCENTILES) -> DataFrame:
    """The number of values and the smallest value that reaches each rank, in place of the sketch."""
    found = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(r)).alias(name) for name, r in ranks.items()]
    return sketched.select(*[c for c in sketched.columns if c != "sketch"], F.kll_sketch_get_n_bigint("sketch").alias("n"), *found)


def dictionary(rows: DataFrame, name: str) -> DataFrame:
    """name and number of each distinct name that is not null: a written table, so that numbers stay.

    Numbers are dense within a task's share, so that bitmaps are full.
    """
    path = new_path(rows.sparkSession, "dictionary")
    names = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    names.withColumn("number", F.monotonically_increasing_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def daily_bitmaps(rows: DataFrame, names: DataFrame, name: str, time: str = "timestamp") -> DataFrame:
    """day, bucket and bitmap: which names a day has, 32,768 of them in a bucket. Days without a name have an empty one."""
    days = rows.select(F.to_date(time).alias("day"), F.col(name).alias("name")).where("day is not null").distinct()
    numbered = days.join(names, "name", "left")
    bucket = F.coalesce(F.bitmap_bucket_number("number"), F.lit(0).cast("long"))
    own = numbered.groupBy("day", bucket.alias("bucket"))
    return own.agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))


def distinct_over_spans(daily: DataFrame, spans: Sequence[int], counted: str) -> DataFrame:
    """anchor, days and the number of distinct names in the ``days`` days that end with the anchor, for every day and span.

    Each day's bitmaps go to the anchors whose span they are in; incidents are not read again.
    """
    path = new_path(daily.sparkSession, "bitmaps")
    daily.write.parquet(path)
    kept = daily.sparkSession.read.parquet(path)
    anchors = kept.select(F.col("day").alias("anchor")).distinct()
    each = kept.select("bucket", "bitmap", "day", F.explode(F.array(*[F.lit(int(s)) for s in spans])).alias("days"))
    to = each.select("bucket", "bitmap", "days", F.explode(F.sequence(F.col("day"), F.date_add("day", F.col("days") - 1))).alias("anchor"))
    union = to.join(anchors, "anchor").groupBy("anchor", "days", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
    return union.groupBy("anchor", "days").agg(F.sum("n").alias(counted))
