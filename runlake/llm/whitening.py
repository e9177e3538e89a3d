"""Whitening of vectors by the leading components of their covariance, found by QDWH divide and conquer.

1. Vectors become whole numbers, floor(256 c); each distinct one counts once in the fit. Their number,
   sums and centred products are partial sums of Spark tasks; the driver holds one matrix of the vectors'
   width, whatever the number of rows.
2. The covariance is divided: the orthogonal polar factor of (V - s I), found by QR- and Cholesky-based
   dynamically weighted Halley steps (QDWH), is the matrix sign, and (sign + I) / 2 projects on the
   eigenvectors above s. An orthonormal basis of each invariant subspace gives a smaller matrix, which is
   divided in turn, until a part is a single component or a multiple of the identity. Only parts that
   hold wanted components are divided further.
3. The components, a few times the vectors' width, go to all tasks, which whiten every row in one scan.

Rows: null vectors and those with null or non-finite entries are dropped. Repeated rows, equal ids and
null ids are rows of their own. Where lengths differ, the most frequent one (of equally frequent ones the
longest) is the space; rows of another length stay, with null deviation and whitened. Equal eigenvalues
leave the choice of their components open; one choice holds for all rows. Components without variance
are left out, so one distinct vector, empty vectors and an empty table give no rows. A deviation beyond
64 bits is null. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from runlake.llm.shared import stash

#: Steps of a unit; whole numbers of a component.
SCALE = 256
EPS = float(np.finfo(float).eps)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its sign, by QDWH."""
    n = len(a)
    x = a / np.linalg.norm(a, 1)
    low = EPS  # a lower bound of the singular values; too low only costs a step
    eye = np.eye(n)
    for _ in range(40):
        sq = low * low
        d = np.cbrt(4 * (1 - sq) / sq**2)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - sq) / (sq * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        low = min(1.0, low * (wa + wb * sq) / (1 + wc * sq))
        before = x
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            z = np.linalg.cholesky(eye + wc * x.T @ x)
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(z.T, np.linalg.solve(z, x.T)).T
        x = (x + x.T) / 2
        if abs(low - 1) < 10 * EPS and np.linalg.norm(x - before) < np.cbrt(EPS):
            break
    return x


def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces of a symmetric matrix, greater eigenvalues first; None if none part them."""
    n, diagonal = len(v), np.diag(v)
    scale = max(np.abs(v).max(), np.finfo(float).tiny)
    if np.linalg.norm(v - diagonal.mean() * np.eye(n)) <= 4 * EPS * n * scale:
        return None
    spread = np.linalg.norm(v - diagonal.mean() * np.eye(n)) / n
    # the mean of the eigenvalues always lies between two of them; the median splits more evenly
    for shift in (np.median(diagonal), diagonal.mean(), diagonal.mean() + spread / 7, diagonal.mean() - spread / 11):
        sign = polar(v - shift * np.eye(n)) if (v != shift * np.eye(n)).any() else np.eye(n)
        projector = (sign + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n or abs(np.trace(projector) - k) > 0.01:
            continue
        q = np.random.default_rng(n).standard_normal((n, k))
        for _ in range(3):
            full = np.linalg.qr(projector @ q, mode="complete")[0]
            q, rest = full[:, :k], full[:, k:]
        if np.linalg.norm(rest.T @ v @ q) <= 1e-11 * np.linalg.norm(v):
            return q, rest
    return None


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    values, vectors, parts = [], [], [((v + v.T) / 2, np.eye(len(v)))]
    while parts and len(values) < k:
        part, basis = parts.pop()
        two = halves(part) if len(part) > 1 else None
        if two is None:  # a single component, or a multiple of the identity: any basis will do
            values += np.diag(part).tolist()
            vectors += list(basis.T)
            continue
        for q in reversed(two):  # the greater ones are taken next
            parts.append((q.T @ part @ q, basis @ q))
    order = np.argsort(-np.array(values), kind="stable")[:k]
    found = np.array(vectors).reshape(-1, len(v))[order].T
    found = found * np.where(found[np.abs(found).argmax(0), np.arange(found.shape[1])] < 0, -1, 1) if found.size else found
    found = found / np.linalg.norm(found, axis=0)
    return np.einsum("ij,ik,kj->j", found, v, found), found


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as whole numbers, one row a vector."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(rows: DataFrame, width: int, each: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all of ``rows`` (x) of a matrix that ``each`` makes of a batch: one a task, added up by Spark row by row."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = each(matrix(batch.column("x"), width))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "r"])

    found = rows.select("x").mapInArrow(part, "i int, r array<double>").groupBy("i").agg(F.array(*[F.sum(F.get("r", F.lit(j))) for j in range(shape[1])]).alias("r"))
    out = np.zeros(shape)
    for row in found.collect():  # one for each row of the matrix
        out[row["i"]] = row["r"]
    return out


def whole_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums."""
    row = fit.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(j)).cast("decimal(19,0)")).alias(f"s{j}") for j in range(width)]).first()
    return row["n"], [int(row[f"s{j}"] or 0) for j in range(width)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the sum of (n x - S)^2 over the dimensions, exact; None beyond 64 bits."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) if x.size else 0
    if most < 2**63 and most**2 * max(1, x.shape[1]) < 2**63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(1).tolist()
    off = x.astype(object) * n - np.array(sums, object)
    return [d if d < 2**63 else None for d in (off * off).sum(1).tolist()]


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The id column, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = vectors.sparkSession
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    given = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.coalesce(F.forall("v", finite), F.lit(False)))
    rows = stash(given.select("id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x")), "whole")
    schema = StructType([StructField(id_col, vectors.schema[id_col].dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    widths = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("width")).first()
    width = widths["width"] if widths else 0
    if not width:
        return spark.createDataFrame([], schema)
    fit = stash(rows.where(F.size("x") == width).select("x").distinct(), "fit")
    n, sums = whole_sums(fit, width)
    mean = np.array([s / n for s in sums])
    covariance = summed(fit, width, lambda x: (x - mean).T @ (x - mean), (width, width)) / n
    values, basis = leading(covariance, min(components, width))
    varied = values > EPS * width * max(values.max(initial=0), 0)
    values, basis = values[varied], basis[:, varied]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    axes = basis / np.sqrt(values)
    centre = summed(fit, width, lambda x: ((x - mean) @ axes).sum(0, keepdims=True), (1, k))[0] / n

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ axes - centre
        return y.T @ y

    error = float(np.abs(summed(fit, width, products, (k, k)) / n - np.eye(k)).max())
    explained = values / np.trace(covariance)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            fits = np.array([len(x) == width for x in batch.column("x")], bool)
            x = matrix(batch.column("x").filter(pa.array(fits)), width)
            deviation, white = np.full(size, None, object), np.full((size, k), np.nan)
            deviation[fits] = deviations(x, n, sums)
            white[fits] = (x - mean) @ axes
            at = np.repeat(np.arange(size), k)
            ids = batch.column("id").take(pa.array(at))
            each = [np.tile(np.arange(1, k + 1, dtype=np.int32), size), np.full(size * k, n), deviation[at], None, np.tile(explained, size), np.full(size * k, error)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            columns = [pa.array(white.ravel(), pa.float64(), mask=~fits[at]) if c is None else pa.array(c, t) for c, t in zip(each, kinds)]
            yield pa.RecordBatch.from_arrays([ids, *columns], schema.names)

    return rows.mapInArrow(project, schema)
