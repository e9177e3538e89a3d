"""Exact search by cosine with pruning: whole blocks of documents are ruled out without a product.

Documents are dealt to balls around pivots (k-means on a bounded sample), and a ball to blocks. A ball's
least and greatest angle to its pivot bound the angle of a query to any of its documents by the triangle
inequality. A query first meets the balls around its nearest pivots that hold k documents; its k-th score
there is a bar that the best can only exceed. Then it meets just those balls whose bound reaches the bar.
Blocks and pivots change nothing in the result.

Queries are sent to documents, never all to all: a pair of a query and a ball that survives is one row, and
a block meets its queries in sets of QUERY_BLOCK. Pivots and bounds (at most MOST_PIVOTS of them) go to all
tasks; documents are never broadcast or collected.

Scores are rounded to twelve digits, so that copies tie; ties go by id. A collection has one vector length,
the most frequent one (the longest of equally frequent ones): vectors of another length, null ones, and
those that are zero or not finite have no direction and score 0 with everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from runlake.storage import new_path

#: Documents of a block; queries that a block meets at once; wanted documents of a ball; pivots; sampled documents a pivot.
DOC_BLOCK, QUERY_BLOCK, BALL, MOST_PIVOTS, SAMPLED = 4096, 4096, 256, 2048, 16
DIGITS, SLACK = 12, 1e-9


def _stash(df: DataFrame, tag: str) -> DataFrame:
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vector_length(docs: DataFrame) -> int:
    """The most frequent length of the documents' vectors; 0 if there are none."""
    size = docs.where("embedding is not null").groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"))
    found = size.orderBy(F.desc("n"), F.desc("width")).first()
    return found["width"] if found else 0


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column without nulls as one row a vector."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def directed(df: DataFrame, ident: str, width: int) -> DataFrame:
    """The id and v: the vector with length one, or null if it has no direction."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, usable = batch.column("embedding"), np.zeros(batch.num_rows, bool)
            fitting = np.flatnonzero(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width) if width else np.zeros(0, int)
            x = matrix(vectors.take(pa.array(fitting)), width) if len(fitting) else np.zeros((0, max(width, 1)))  # a null component is nan
            most = np.abs(x).max(axis=1)
            some = np.isfinite(most) & (most > 0)
            usable[fitting[some]] = True
            x = x[some] / most[some, None]  # so that no square is lost
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            ends = np.concatenate([[0], np.cumsum(usable * width)]).astype(np.int32)
            v = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()), mask=pa.array(~usable))
            yield pa.RecordBatch.from_arrays([batch.column(ident), v], [ident, "v"])

    schema = StructType([df.schema[ident], StructField("v", ArrayType(DoubleType()))])
    return df.select(ident, F.col("embedding").cast("array<double>")).mapInArrow(scale, schema)


def pivots_of(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means: unit pivots, of those that keep a row."""
    pivots = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (sample @ pivots.T).argmax(1)
        sums = np.zeros((len(pivots), sample.shape[1]))
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1)
        pivots = sums[norms > 1e-9] / norms[norms > 1e-9, None]
    return pivots if len(pivots) else sample[:1]


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


class Balls:
    """The documents by ball and block, and what is known of each ball: documents, least and greatest angle."""

    def __init__(self, docs: DataFrame, width: int):
        """``docs`` has id and v, all with a direction."""
        spark, n = docs.sparkSession, docs.count()
        self.width, self.n = width, n
        k = max(1, min(MOST_PIVOTS, n // BALL))
        order = F.xxhash64("id", "v")
        few = docs.where(F.pmod(order, F.lit(max(n, 1))) < 2 * SAMPLED * k).orderBy(order).limit(SAMPLED * k).select("v").toArrow() if n else None
        sample = matrix(few.column("v"), width) if n else np.zeros((0, width))
        self.pivots = pivots = pivots_of(sample, min(k, len(sample))) if len(sample) else np.eye(1, max(width, 1))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                to = angles(matrix(batch.column("v"), width), pivots)
                own = to.argmin(1)
                angle = to[np.arange(len(to)), own]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(angle), batch.column("id"), batch.column("v")], ["ball", "angle", "id", "v"])

        ident = StructField("id", docs.schema["id"].dataType)
        schema = StructType([StructField("ball", IntegerType()), StructField("angle", DoubleType()), ident, StructField("v", ArrayType(DoubleType()))])
        dealt = _stash(docs.mapInArrow(deal, schema), "balls")
        sizes = {r["ball"]: r for r in dealt.groupBy("ball").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()}  # at most MOST_PIVOTS
        known = [sizes.get(i) for i in range(len(pivots))]
        self.sizes = np.array([r["n"] if r else 0 for r in known])
        self.low = np.array([r["low"] if r else 0.0 for r in known])
        self.high = np.array([r["high"] if r else 0.0 for r in known])
        self.blocks = -(-self.sizes // DOC_BLOCK)
        per_ball = spark.createDataFrame([(i, int(b)) for i, b in enumerate(self.blocks)], "ball int, blocks int")
        self.rows = dealt.join(F.broadcast(per_ball), "ball").withColumn("block", F.pmod(F.xxhash64("id", "v", "angle"), "blocks").cast("int")).select("ball", "block", "id", "v")

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The greatest cosine that each row can have with a document of each ball; -2 for empty balls."""
        to = angles(x, self.pivots)
        least = np.maximum(np.maximum(to - self.high, self.low - to), 0)
        return np.where(self.sizes > 0, np.cos(least) + SLACK, -2.0)

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        """For each row, which balls around the nearest pivots it takes until they hold ``k`` documents."""
        order = np.argsort(np.where(self.sizes > 0, angles(x, self.pivots), 9), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        take = np.zeros(order.shape, bool)
        np.put_along_axis(take, order, held < k, axis=1)
        return take & (self.sizes > 0)


def _pairs(queries: DataFrame, balls: Balls, k: int, barred: bool) -> DataFrame:
    """(query_id, v, ball) that must be scored: the nearest balls, or with a bar all others whose bound reaches it."""
    facts = (balls.pivots, balls.sizes, balls.low, balls.high)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Balls.__new__(Balls)
        own.pivots, own.sizes, own.low, own.high = facts
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = matrix(batch.column("v"), own.pivots.shape[1])
                near = own.nearest(x, k)
                if barred:
                    near = ~near & (own.bounds(x) >= batch.column("bar").to_numpy(zero_copy_only=False)[:, None])
                row, ball = np.nonzero(near)
                to = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(to), batch.column("v").take(to), pa.array(ball.astype(np.int32))], ["query_id", "v", "ball"])

    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("v", ArrayType(DoubleType())), StructField("ball", IntegerType())])
    return queries.mapInArrow(choose, schema)


def _scored(pairs: DataFrame, balls: Balls, k: int) -> DataFrame:
    """query_id, id, score: the best ``k`` of each block that a query meets."""
    spark, width = pairs.sparkSession, balls.width
    pairs = _stash(pairs, "pairs")
    met = pairs.groupBy("ball").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("sets"))  # at most MOST_PIVOTS
    per_ball = spark.createDataFrame([(i, int(b)) for i, b in enumerate(balls.blocks)], "ball int, blocks int")
    dealt = pairs.join(F.broadcast(met), "ball").join(F.broadcast(per_ball), "ball")
    left = dealt.select("ball", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id", "v"), "sets").cast("int").alias("part"), "query_id", "v")
    right = balls.rows.join(F.broadcast(met), "ball").select("ball", "block", F.explode(F.sequence(F.lit(0), F.col("sets") - 1)).alias("part"), "id", "v")
    schema = StructType([StructField("query_id", pairs.schema["query_id"].dataType), StructField("id", balls.rows.schema["id"].dataType), StructField("score", DoubleType())])

    def best(queries: pa.Table, docs: pa.Table) -> pa.Table:
        if not len(queries) or not len(docs):
            return pa.table([queries.column("query_id")[:0], docs.column("id")[:0], pa.array([], pa.float64())], names=schema.names)
        docs = docs.sort_by("id")
        x, out = matrix(docs.column("v"), width), []
        for at in range(0, len(queries), 256):
            some = queries.slice(at, 256)
            cosine = np.round(matrix(some.column("v"), width) @ x.T, DIGITS) + 0.0
            top = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(some)), top.shape[1])
            out.append(pa.table([some.column("query_id").take(pa.array(rows)), docs.column("id").take(pa.array(top.ravel())), pa.array(cosine[rows, top.ravel()])], names=schema.names))
        return pa.concat_tables(out)

    keys = ("ball", "block", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search_and_visits(queries: DataFrame, docs: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame, int]:
    """The hits (query_id, id, score, rank), the pairs of a query and a ball that were scored, and the number of balls."""
    queries = queries.select("query_id", "embedding").dropDuplicates(["query_id"])
    width = vector_length(docs)
    every, asked = _stash(directed(docs, "id", width), "documents"), _stash(directed(queries, "query_id", width), "queries")
    balls = Balls(every.where("v is not null"), width)
    with_direction = asked.where("v is not null")
    first_pairs = _stash(_pairs(with_direction, balls, k, False), "first-pairs")
    first = _stash(ranked(_scored(first_pairs, balls, k), k), "first")
    bars = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("bar"))
    more_pairs = _stash(_pairs(with_direction.join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0))), balls, k, True), "more-pairs")
    found = first.drop("rank").unionByName(_scored(more_pairs, balls, k))
    ident, zeros = docs.schema["id"].dataType, []
    for some, to in ((every.where("v is null"), with_direction), (every, asked.where("v is null"))):
        ids = [r["id"] for r in some.orderBy("id").limit(k).select("id").collect()]  # k of them: the first by id, all score 0
        if ids:
            zeros.append(to.select("query_id", F.explode(F.array(*[F.lit(i).cast(ident) for i in ids])).alias("id"), F.lit(0.0).alias("score")))
    for extra in zeros:
        found = found.unionByName(extra)
    return ranked(found, k), first_pairs.unionByName(more_pairs).select("query_id", "ball"), int((balls.sizes > 0).sum())


def search(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id, score, rank: the ``k`` documents of highest cosine of every query, exactly.

    ``queries`` has query_id (of equal ones, one is asked) and embedding, ``docs`` id and embedding.
    """
    return search_and_visits(queries, docs, k)[0]
