"""Mixing sources to target weights by entropy balancing.

Rates r minimise the size-weighted entropy sum of size * (r log r - r) under one token constraint for
each source, sum of size * r = target. The dual is sum of size * exp(l) - target * l, convex; its
gradient and Hessian need only each source's total size, which one distributed aggregate gives, so that
Newton's steps run on one row a source, and every document's rate is the exponential tilt exp(l) of its
source. Rates become copies: the whole part for all, one more for the documents that fill the rest,
taken in a hashed order by their prefix sums; the gap that the first one too long leaves, less than its
size, is filled with the source's smallest documents, again by prefix sums. Only DataFrame functions; a source of any size is range-partitioned by hash.

Rows: null text has size 0 and takes nothing; the null source is a source, the last. Equal ids and
repeated rows are single rows. With no words at all every target is 0. An empty table gives an empty
result. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.llm.shared import small, stash, with_prefix

#: Newton's steps; from 0 they gain at least 1 in l until they converge quadratically.
STEPS = 80


def word_count(text: str) -> Column:
    """Number of words: each is replaced by one mark, and the marks are counted."""
    marks = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return (F.length(marks) - F.length(F.replace(marks, F.lit("x"), F.lit("")))).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """A row for each source of ``sizes`` (source, size): rank, source_size, before (sizes of lower ranks), target.

    Sources rank by code point, null last; weights repeat over the ranks. Targets share the total by
    weight; those above cap times the source's size stop there, and the excess is shared anew. In the
    order of cap / weight the capped sources come first, so that prefix sums find them at once.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = stash(with_prefix(sums, [F.col("source").isNull(), "source"], {"rank": F.lit(1), "before": F.col("source_size")}), "ranked")
    weight = F.array(*[F.lit(float(w)) for w in weights])[(F.col("rank") % len(weights)).cast("int")]
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # weights are kept as thousandths here, because prefix sums are whole numbers
    run = with_prefix(ranked, [F.col("most") / F.col("weight"), "rank"], {"sizes": F.col("source_size"), "weights": F.round(F.col("weight") * 1000)})
    all_of = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()
    left, share = F.lit(float(all_of["n"])) - F.col("sizes") * float(cap), F.lit(float(all_of["w"])) - F.col("weights") / 1000
    run = stash(run.withColumn("capped", F.col("most") * share <= F.col("weight") * left), "capped")
    stopped = run.where("capped").agg(F.coalesce(F.sum("most"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()
    level = (all_of["n"] - stopped["n"]) / max(all_of["w"] - stopped["w"], 1e-9)
    return run.select("source", "rank", "source_size", "before", F.when(F.col("capped"), F.col("most")).otherwise(F.least("most", F.col("weight") * F.lit(level))).alias("target"))


def tilt(size: Column, target: Column) -> Column:
    """exp(l) for the l that minimises size * exp(l) - target * l, by Newton's steps from 0."""
    step = lambda l, _: l - (size * F.exp(l) - target) / (size * F.exp(l))  # noqa: E731, E741
    l = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), step)  # noqa: E741
    return F.when((size > 0) & (target > 0), F.exp(l)).otherwise(F.lit(0.0))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", order_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, rate, copies (0 to cap), taken = copies * size.

    ``order_col`` (default the id) and the text's checksum give the hashed order, the same at each run.
    """
    sizes = stash(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.col(order_col or id_col).alias("name"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc")), "sizes")
    per = targets(sizes, weights, cap).withColumn("rate", F.least(F.lit(float(cap)), tilt(F.col("source_size"), F.col("target"))))
    per = stash(per.withColumnRenamed("source", "s"), "rates")
    rows = sizes.join(small(per), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("order", F.xxhash64("name", "crc"))
    whole = F.floor(F.col("rate") + 1e-9)
    rest = F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size"))
    run = with_prefix(rows, ["rank", "order", "id", "crc"], {"start": F.col("size")})
    run = stash(run.withColumns({"whole": whole, "more": (F.col("start") - F.col("before") + F.col("size") <= rest).cast("int"), "rest": rest}), "rounded")
    gaps = stash(run.groupBy("rank").agg((F.first("rest") - F.sum(F.col("more") * F.col("size"))).alias("gap")), "gaps")
    run = run.join(small(gaps), "rank")
    fits = (F.col("more") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
    fill = stash(with_prefix(run.where(fits), ["rank", "size", "order", "id", "crc"], {"at": F.col("size")}), "fill")
    fill = fill.join(small(stash(fill.groupBy("rank").agg(F.min("at").alias("first")), "firsts")), "rank")
    fill = fill.withColumn("more", (F.col("at") - F.col("first") + F.col("size") / 2 < F.col("gap")).cast("int"))
    run = run.where(~fits).unionByName(fill.select(run.columns))
    copies = F.least(F.lit(cap), F.col("whole") + F.col("more")).cast("long")
    return run.withColumn("copies", copies).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
