"""Toxicity by non-negative positive-unlabelled learning.

Texts confirmed as toxic are the positives. The unlabelled are drawn from all given texts without regard
to any label; a label of 0 is never looked at. A numpy classifier (logistic, linear in hashed features)
minimises the prior-corrected risk of Kiryo et al. 2017,

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]),

and where the corrected part turns negative its step climbs out of it instead. The class prior, the toxic
share of the unlabelled, is given or estimated from the two samples: whatever region a classifier marks
holds at least prior times the positives' share of it, so that the least ratio of the unlabelled's share to
the positives' over a sweep of thresholds, on halves that it was not fitted on, bounds the prior from above
and meets it where a region holds positives alone.

Spark counts features over all positives and all texts, each task into one count a feature, and keeps those
that positives hold more often than chance explains. The classifier is fitted on at most MAX_POSITIVE and
MAX_UNLABELLED rows, drawn apart; the bound is on rows, so that an id that many documents share changes
nothing. Features are a text's distinct words and word beginnings of 4 to 6 bytes (ASCII lower-cased, runs
of letters), whole texts. Scoring takes a sum over the features that have a weight.

Rows: null or empty text has no features and the score of the bias alone. Null labels and null ids confirm
nothing; a repeated label id counts once, and confirms every document of that id. Without any positive
every score is 0. Repeated rows and equal ids are rows of their own; ties in the draw go by place in the
input. An empty table gives an empty result. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.language_id import GAPS
from runlake.llm.shared import small, stash
from runlake.llm.words import LOWER, hashes, slices, spans

#: Positive and unlabelled rows that the fit may take.
MAX_POSITIVE, MAX_UNLABELLED = 8_000, 24_000
#: Bits of a feature; word beginnings in bytes.
BITS, BEGINNINGS = 20, (4, 5, 6)
#: A feature is used if it is in so many positives at least, in so many more than its share of all texts explains
#: that twice the log likelihood ratio (of a Poisson count) reaches so much, and if its lift (its share of the
#: positives by its share of all) is at least so much of the greatest lift of a feature that LEAST_SHARE of the
#: positives have: topic or language lift a little, what only toxic texts have lifts by one over the prior.
LEAST_TEXTS, EVIDENCE, LEAST_LIFT, LEAST_SHARE = 3, 16, 0.35, 0.01
STEPS, RATE, DECAY = 200, 0.05, 1e-4


def features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct features of each row, sorted; of those that ``wanted`` marks, if given."""
    data = LOWER[data]
    starts, ends, bounds = spans(data, offsets, GAPS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    found = [(row, hashes(data, starts, ends))]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n)
        found.append((row[long], hashes(data, starts[long], starts[long] + n) ^ np.uint64(n << 50)))
    row = np.concatenate([x for x, _ in found])
    feature = (np.concatenate([x for _, x in found]) >> np.uint64(64 - BITS)).astype(np.int64)
    if wanted is not None:
        own = wanted[feature]
        row, feature = row[own], feature[own]
    both = np.unique((row << BITS) | feature)
    return both >> BITS, both & ((1 << BITS) - 1)


def slopes(f: np.ndarray, p: int, prior: float) -> tuple[np.ndarray, float]:
    """The risk's slope by each text's output, positives first, and the corrected part of the risk.

    With the logistic loss l(f) = log(1 + exp(-f)). Where the corrected part is negative, the slope is that
    of its opposite alone.
    """
    u = len(f) - p
    s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))  # the slope of l(-f); that of l(f) is s - 1
    loss = np.logaddexp(0, f)
    corrected = loss[p:].mean() - prior * loss[:p].mean()
    if corrected >= 0:
        return np.concatenate([np.full(p, -prior / p), s[p:] / u]), corrected
    return np.concatenate([prior * s[:p] / p, -s[p:] / u]), corrected


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int) -> tuple[np.ndarray, float]:
    """Weights of ``size`` features and the bias that minimise the non-negative risk over two lists of feature sets."""
    texts = positive + unlabelled
    column = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    weight, bias = np.zeros(size), np.log(prior / (1 - prior))
    moment, square = np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, STEPS + 1):
        slope, _ = slopes(np.bincount(row, weight[column], len(texts)) + bias, len(positive), prior)
        gradient = np.append(np.bincount(column, slope[row], size) + DECAY * weight, slope.sum())
        moment, square = 0.9 * moment + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        step = RATE * (moment / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
        weight, bias = weight - step[:-1], bias - step[-1]
    return weight, float(bias)


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of the unlabelled's share above a threshold to the positives', over thresholds that a fifth of the positives pass.

    The unlabelled's share counts one standard deviation more than seen, so that chance does not make it small.
    """
    marks = np.unique(np.quantile(positive, np.linspace(0, 0.8, 81)))
    p = 1 - np.searchsorted(np.sort(positive), marks) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), marks) / len(unlabelled)
    return float(((u + np.sqrt(u * (1 - u) / len(unlabelled))) / p).min())


def class_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int) -> float:
    """The toxic share of the unlabelled: the mean over both ways of fitting on one half and measuring on the other."""
    found = []
    for own in (0, 1):
        p, u = (x[own::2] or x for x in (positive, unlabelled))
        weight, bias = train(p, u, 0.5, size)
        p, u = (x[1 - own :: 2] or x for x in (positive, unlabelled))
        found.append(least_ratio(*[np.array([weight[t].sum() + bias for t in x]) for x in (p, u)]))
    return float(np.clip(np.mean(found), 1 / (len(unlabelled) + 1), 0.95))


class Model:
    """Weights by feature, the bias and the prior; no weights if there was no positive."""

    def __init__(self, weights: np.ndarray | None, bias: float, prior: float = 0.0):
        self.weights, self.bias, self.prior = weights, bias, prior


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, p and u: the positives and all rows that have it; feature -1 counts rows. ``rows``: positive, text.

    A task adds up its rows in one array of 2**BITS counts, and sends on what it has seen.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows_seen = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            marked = batch.column("positive").to_numpy(zero_copy_only=False)
            for at, data, offsets in slices(batch.column("text")):
                own = marked[at : at + len(offsets) - 1]
                row, feature = features(data, offsets)
                seen[0] += np.bincount(feature[own[row]], minlength=1 << BITS)
                seen[1] += np.bincount(feature, minlength=1 << BITS)
                rows_seen += (own.sum(), len(own))
        used = np.flatnonzero(seen[1])
        for at in range(0, len(used), 1 << 16):
            some = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[0, some]), pa.array(seen[1, some])], ["feature", "p", "u"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array(rows_seen[:1]), pa.array(rows_seen[1:])], ["feature", "p", "u"])

    return rows.select("positive", "text").mapInArrow(count, "feature int, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def drawn(rows: DataFrame, n: int, total: int, chosen: np.ndarray) -> list[np.ndarray]:
    """The chosen features of ``n`` of the rows (id, text), or of all if there are no more, by hash of id and place."""
    order = F.xxhash64("id", "place")
    few = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("order", order)
    few = few.where(F.pmod("order", F.lit(max(1, total // (2 * n)))) == 0)
    few = few.orderBy("order", "place").limit(n).select("order", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_of = np.full(1 << BITS, -1, np.int32)
        at_of[chosen] = np.arange(len(chosen))
        for batch in batches:
            for at, data, offsets in slices(batch.column("text")):
                n = len(offsets) - 1
                row, feature = features(data, offsets, at_of >= 0)
                bounds = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("order").slice(at, n), pa.ListArray.from_arrays(pa.array(bounds), pa.array(at_of[feature]))], ["order", "features"])

    found = few.mapInArrow(extract, "order long, features array<int>").toArrow().sort_by("order")  # n rows
    return [np.array(x, np.int64) for x in found["features"].to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None) -> Model:
    """A model from ``docs``, the unlabelled, and the ids that ``labels`` confirms (label 1). The prior is estimated unless given."""
    confirmed = stash(labels.where(F.col(label_col).cast("int") == 1).select(F.col(id_col).alias("key")).where("key is not null").distinct(), "confirmed")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(small(confirmed), F.col("id") == F.col("key"), "left").select("id", "text", F.col("key").isNotNull().alias("positive"))
    counts = stash(feature_counts(rows), "counts")
    size = counts.where("feature = -1").first()
    if not size or not size["p"]:
        return Model(None, 0.0)
    chance = (F.col("u") + 0.5) * size["p"] / size["u"]
    evidence = 2 * (F.col("p") * F.ln(F.col("p") / chance) - (F.col("p") - chance))
    lifted = counts.where("feature >= 0").withColumn("lift", F.col("p") / chance).where((F.col("p") >= LEAST_TEXTS) & (F.col("lift") > 1) & (evidence >= EVIDENCE))
    best = lifted.where(F.col("p") >= LEAST_SHARE * size["p"]).agg(F.coalesce(F.max("lift"), F.lit(1.0))).first()[0]
    telling = lifted.where(F.col("lift") >= LEAST_LIFT * best).select("feature")
    chosen = np.sort(telling.toArrow()["feature"].to_numpy())  # at most 2**BITS
    positive = drawn(rows.where("positive").select("id", "text"), MAX_POSITIVE, size["p"], chosen)
    unlabelled = drawn(texts, MAX_UNLABELLED, size["u"], chosen)
    prior = class_prior(positive, unlabelled, len(chosen)) if prior is None else prior
    weight, bias = train(positive, unlabelled, prior, len(chosen))
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = weight
    return Model(weights, bias, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row of ``docs``, from its whole text alone."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if model.weights is None else np.abs(model.weights) > 1e-4
        for batch in batches:
            for at, data, offsets in slices(batch.column(1)):
                n, total = len(offsets) - 1, np.zeros(len(offsets) - 1)
                if wanted is not None:
                    row, feature = features(data, offsets, wanted)
                    total = 1 / (1 + np.exp(-np.clip(np.bincount(row, model.weights[feature], n) + model.bias, -50, 50)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(total)], [id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(rate, f"`{id_col}` {kind}, score double")
