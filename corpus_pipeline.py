"""From raw documents to packed sequences: five stages, each one operator over all rows that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents. A stage names rows by their
place in a file, so that null and repeated ids are rows like others. Whatever further columns are called,
with dots, or like names that Spark or a stage uses itself, they come out as they went in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm.exact_dedup import exact_groups
from runlake.llm.language_id import accepted, fit
from runlake.llm.minhash import near_duplicates
from runlake.llm.mixing import mix
from runlake.llm.packing import pack
from runlake.llm.shared import numbered, small, stash

#: A document stays if its language is known and this likely.
LEAST_POSTERIOR = 0.5
#: Source weights by rank, and the most copies of a document.
WEIGHTS, MOST_COPIES = (5, 2, 1), 3
#: Near duplicates share 80 percent of their shingles of five words.
SHINGLE_WORDS, PERCENT = 5, 80
CAPACITY = 4096
#: Columns that stages look at.
USED = ("doc_id", "text", "lang", "source")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _own_names(stage: Stage) -> Stage:
    """``stage`` on documents whose further columns have names that clash with none, under their old names again."""

    @wraps(stage)
    def renamed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in USED else f"other_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(names).toDF(*docs.columns)

    return renamed


def _without(rows: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """The rows but those that ``found`` (_runlake_row, kept) drops."""
    dropped = stash(found.where("not kept").select("_runlake_row"), "dropped")
    return rows.join(small(dropped), "_runlake_row", "left_anti").select(columns)


@_own_names
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without a letter, and undecided ones, go."""
    return accepted(docs, fit(docs), LEAST_POSTERIOR)


@_own_names
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to white space, the one of smallest id."""
    rows = numbered(docs)
    return _without(rows, exact_groups(rows, "_runlake_row"), docs.columns)


@_own_names
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of near equality connect, the one of smallest id."""
    rows = numbered(docs)
    return _without(rows, near_duplicates(rows, SHINGLE_WORDS, PERCENT, "_runlake_row"), docs.columns)


@_own_names
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = numbered(docs)
    copies = mix(rows, WEIGHTS, MOST_COPIES, "_runlake_row", order_col="doc_id").where("copies > 0").select("_runlake_row", F.col("copies").alias("_copies"))
    taken = rows.join(small(stash(copies, "copies")), "_runlake_row")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return pack(docs, CAPACITY)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the language model nor the packing; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
