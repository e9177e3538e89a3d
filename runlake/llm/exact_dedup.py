"""Exact deduplication by progressive refinement: length, then hash of a prefix, then hash of the whole text.

Only DataFrame functions. The first scan reduces each text to its length and prefix hash and keeps the
pairs that occur twice; the second takes the full hash of the texts that share such a pair, and only
those meet in a shuffle, as digests. No text is shuffled unless the surviving pairs are too many to
broadcast. Groups are partial aggregates; a group of any size joins back by Spark's skew join.

Rows: null text counts as empty; empty texts are equal to each other; equal ids (also null ids, which
sort last) are told apart row by row, so that exactly one row of a group stays. An empty table gives an
empty result. Further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.llm.shared import SPACES, small, stash


def normalised(text: str | Column) -> Column:
    """The text with every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, all_digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id (id of the row that stays), group_size, kept, text_sha256.

    text_sha256 is null for rows that an earlier level has shown to be alone: their text was not hashed.
    With ``all_digests`` the same scan hashes those too, for callers that want every digest.
    """
    text = normalised(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", "t", F.octet_length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix)).alias("p"))
    lengths = rows.groupBy("n", "p").agg(F.count("*").alias("c"))
    shared = small(stash(lengths.where("c > 1").select("n", "p", F.lit(True).alias("more")), "lengths"))
    survives = F.coalesce(F.col("more"), F.lit(False))
    digest = F.when(F.lit(True) if all_digests else survives, F.sha2(F.col("t").cast("binary"), 256))
    full = rows.join(shared, ["n", "p"], "left").select("id", survives.alias("more"), digest.alias("h"))
    full = stash(full.withColumn("row", F.monotonically_increasing_id()), "digests")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    groups = stash(full.where("more").groupBy("h").agg(first, F.count("*").alias("group_size")), "groups")
    alone = full.where("not more").select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("h").alias("text_sha256"))
    together = full.where("more").join(groups, "h").select(F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.col("h").alias("text_sha256"))
    return alone.unionByName(together)
