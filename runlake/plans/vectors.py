"""Vectors of texts: sparse TF-IDF rows, and their leading singular directions as short dense vectors.

Words are hashed to FEATURES columns and weighted by rarity; rows stay sparse, as indices and weights. The
leading right singular vectors come from randomised subspace iteration: a random matrix of FEATURES rows
is multiplied by AᵀA a few times, each time as partial products of Spark tasks that are added up by row, and
orthonormalised on the driver. The driver and the tasks hold matrices of FEATURES by the rank, whatever the
number of texts; texts are tokenised once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.storage import new_path

FEATURES, RANK, OVERSAMPLED, ROUNDS = 4096, 64, 16, 6
#: Cells of rows that a task writes out in full at once.
CELLS = 1 << 20


def _counted(docs: DataFrame, text: str, features: int) -> DataFrame:
    words = Tokenizer(inputCol="_text", outputCol="_words").transform(docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    some = words.withColumn("_words", F.filter("_words", lambda w: w != ""))
    return HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features).transform(some).drop("_text", "_words")


def _weighted(counted: DataFrame) -> tuple[DataFrame, IDFModel]:
    model = IDF(inputCol="_tf", outputCol="_idf").fit(counted)
    return Normalizer(inputCol="_idf", outputCol="_unit").transform(model.transform(counted)).drop("_tf", "_idf"), model


def vectorise(docs: DataFrame, text: str = "document", features: int = FEATURES) -> DataFrame:
    """Adds embedding: hashed words weighted by rarity, of length 1 (or 0 for texts without words), all columns of it."""
    return _weighted(_counted(docs, text, features))[0].withColumn("embedding", vector_to_array("_unit", "float32")).drop("_unit")


def sparse(docs: DataFrame, ident: str, text: str, features: int = FEATURES) -> DataFrame:
    """The id column, indices and weights of each text's row of length 1; a text without words has none.

    The weight of a column is its count in the text times log((texts + 1) / (texts with it + 1)), before
    the row is scaled. A scratch table: texts are tokenised once, for rarity and rows together.
    """
    path = new_path(docs.sparkSession, "counts")
    _counted(docs.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("text")), "text", features).write.parquet(path)
    unit, _ = _weighted(docs.sparkSession.read.parquet(path))
    parts = unit.select("id", F.unwrap_udt("_unit").alias("u"))
    return parts.select(F.col("id").alias(ident), F.col("u.indices").alias("indices"), F.col("u.values").alias("weights"))


def _dense(batch: pa.RecordBatch, features: int) -> Iterator[np.ndarray]:
    """The batch's rows in full, some at a time: at most CELLS cells, or one row."""
    lengths = batch.column("indices").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    columns = batch.column("indices").flatten().to_numpy(zero_copy_only=False)
    weights = batch.column("weights").flatten().to_numpy(zero_copy_only=False)
    ends, step = np.concatenate([[0], np.cumsum(lengths)]), max(1, CELLS // features)
    for at in range(0, batch.num_rows, step):
        some = lengths[at : at + step]
        a, b = ends[at], ends[at + len(some)]
        out = np.zeros((len(some), features))
        out[np.repeat(np.arange(len(some)), some), columns[a:b]] = weights[a:b]
        yield out


def right_products(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """AᵀA times ``basis``: a task adds up its rows, Spark adds up the tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for batch in batches:
            for some in _dense(batch, len(basis)):
                total += some.T @ (some @ basis)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(list(total[used]), pa.list_(pa.float64()))], ["i", "r"])

    partial = rows.select("indices", "weights").mapInArrow(part, "i int, r array<double>")
    added = partial.groupBy("i").agg(F.array(*[F.sum(F.get("r", F.lit(j))) for j in range(basis.shape[1])]).alias("r")).toArrow()  # at most FEATURES rows
    out = np.zeros(basis.shape)
    if len(added):
        out[added.column("i").to_numpy()] = np.array(added.column("r").to_pylist())
    return out


def leading_directions(rows: DataFrame, features: int = FEATURES, rank: int = RANK, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``rank`` greatest singular values of the sparse rows, falling, and their right singular vectors as columns."""
    wide = min(features, rank + OVERSAMPLED)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, wide)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(right_products(rows, basis))[0]
    small = basis.T @ right_products(rows, basis)  # Rayleigh-Ritz
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    return np.sqrt(np.maximum(values[order], 0)), basis @ turn[:, order]


def embedded(rows: DataFrame, ident: str, directions: np.ndarray) -> DataFrame:
    """The id column and embedding: the sparse rows in the given directions; zero for a text without words."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row for some in _dense(batch, len(directions)) for row in some @ directions]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.float64()))], ["id", "embedding"])

    kind = rows.schema[ident].dataType.simpleString()
    return rows.select(F.col(f"`{ident}`").alias("id"), "indices", "weights").mapInArrow(project, f"id {kind}, embedding array<double>").withColumnRenamed("id", ident)


def text_vectors(docs: DataFrame, ident: str = "id", text: str = "document", features: int = FEATURES, rank: int = RANK) -> DataFrame:
    """The id column and embedding of every text: its place among the leading directions of all texts."""
    path = new_path(docs.sparkSession, "sparse")
    sparse(docs, ident, text, features).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    _, directions = leading_directions(rows, features, rank)
    return embedded(rows, ident, directions)
