"""What several operators use: scratch tables, global prefix sums, components, size-checked joins.

Scratch tables are Parquet folders below ``spark.checkpoint.dir``, the folder that all executors
share; they cut lineage and survive a lost executor. ``storage.drop_tables`` removes those of a session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlake.storage import new_path

#: Runs of these characters separate words.
SPACES = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast only after its rows were counted and are no more than this.
BROADCAST_ROWS = 500_000


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as a scratch table and reads it back, so that its lineage ends there."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``_runlake_row``, different for each row and in the order of the id column, null last: what a file's rows are.

    Rows that come from no file, or no longer plainly, are written to a scratch table first.
    """
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select("*", name.alias("_runlake_row"))
    except AnalysisException:
        return stash(docs, "rows").select("*", name.alias("_runlake_row"))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``limit`` rows; else Spark shuffles. Give it a scratch table."""
    return F.broadcast(df) if df.count() <= limit else df


def bounded_sample(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows of least hash of ``keys``, or nearly so; all rows where there are no more.

    A cut on the hash leaves about twice as many before they are sorted, however many rows and partitions there are.
    """
    total = max(df.count(), 1)
    order = F.xxhash64(*keys)
    return df.where(F.pmod(order, F.lit(total)) < 2 * n).orderBy(order, *keys).limit(n)


def with_prefix(df: DataFrame, order: Sequence[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Adds to each row, for each (name, value), the sum of the values of all rows before it in ``order``.

    The rows are range-partitioned by it; each partition has its own running sum, and the totals of the
    partitions, one row each, give what comes before a partition. Rows equal in ``order`` follow by their
    place in the input, so that any number of them is split over partitions like others; then which of
    them comes first is left open. Null values count as 0. Columns that start with ``_px`` are taken.
    """
    order = [*[F.col(x) if isinstance(x, str) else x for x in order], F.monotonically_increasing_id()]
    keys = [f"_px_k{i}" for i in range(len(order))]
    values = {name: f"_px_v{i}" for i, name in enumerate(sums)}
    own = df.columns
    base = df.select(*own, *[x.alias(k) for x, k in zip(order, keys)], *[F.coalesce(v, F.lit(0)).cast("long").alias(values[n]) for n, v in sums.items()])
    dealt = stash(base.repartitionByRange(*keys).withColumn("_px_p", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_px_p").agg(*[F.sum(v).alias(f"{v}_t") for v in values.values()])
    before = Window.orderBy("_px_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = totals.select("_px_p", *[F.coalesce(F.sum(f"{v}_t").over(before), F.lit(0)).alias(f"{v}_b") for v in values.values()])
    within = Window.partitionBy("_px_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"{v}_r") for v in values.values()])
    return run.join(F.broadcast(bases), "_px_p").select(*own, *[(F.col(f"{v}_r") + F.col(f"{v}_b")).alias(n) for n, v in values.items()])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Alternates large-star and small-star rounds (Kiveris et al. 2014). Each round writes its edges, at
    most as many as it had; the driver sees only their number and checksum. Minima are partial
    aggregates, and the joins have a scratch table on each side, so that Spark splits a hot node.
    """
    e = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = stash(large.distinct(), "large")
        least = stash(e.groupBy("u").agg(F.min("v").alias("m")), "least")
        tied = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stash(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == seen:
            break
        seen = (now["n"], now["h"])
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return e.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
