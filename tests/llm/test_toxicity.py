"""The non-negative risk against a plain version, the prior on a planted share, and what the fit may read."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import frame

from runlake.llm import queries, toxicity as tx


def risk(f, p, prior):
    """The two parts of the risk, one text after the other."""
    l = lambda x: math.log1p(math.exp(-x))  # noqa: E731, E741
    first = prior * sum(l(x) for x in f[:p]) / p
    return first, sum(l(-x) for x in f[p:]) / (len(f) - p) - prior * sum(l(-x) for x in f[:p]) / p


@pytest.mark.parametrize("prior, lift", [(0.1, 0.0), (0.4, 0.0), (0.6, 3.0), (0.9, 5.0)])
def test_slopes_are_those_of_the_risk(prior, lift):
    rng = np.random.default_rng(3)
    f = rng.standard_normal(30)
    f[:12] += lift
    f[12:] -= lift
    slope, corrected = tx.slopes(f, 12, prior)
    first, second = risk(f, 12, prior)
    assert abs(corrected - second) < 1e-12 and (second < 0) == (lift > 0)
    for i in range(30):
        up, down = f.copy(), f.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        a, b = risk(up, 12, prior), risk(down, 12, prior)
        change = (sum(a) - sum(b) if second >= 0 else -(a[1] - b[1])) / 2e-6
        assert abs(slope[i] - change) < 1e-7


def plain_train(positive, unlabelled, prior, size):
    """The same steps on dense rows, one text after the other."""
    texts = positive + unlabelled
    x = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        x[i, t] = 1
    p, u = len(positive), len(unlabelled)
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    theta[-1] = math.log(prior / (1 - prior))
    negative = 0
    for k in range(1, tx.STEPS + 1):
        f = [float(row @ theta[:-1] + theta[-1]) for row in x]
        s = [1 / (1 + math.exp(-a)) for a in f]
        below = risk(f, p, prior)[1] < 0
        negative += below
        g = np.zeros(size + 1)
        for i, row in enumerate(x):
            if below:
                slope = prior / p * s[i] if i < p else -s[i] / u
            else:
                slope = prior / p * (s[i] - 1) - prior / p * s[i] if i < p else s[i] / u
            g += slope * np.append(row, 1)
        g[:-1] += tx.DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= tx.RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta[:-1], theta[-1], negative


def sets(rng, n, toxic, size=12):
    """Feature sets: each of the first three features marks toxicity, the others are noise."""
    return [np.array(sorted({*np.flatnonzero(rng.random(size) < 0.3).tolist()} - {0, 1, 2} | ({int(rng.integers(3))} if rng.random() < toxic else set())), np.int64) for _ in range(n)]


@pytest.mark.parametrize("prior", [0.02, 0.15, 0.6])
def test_fit_equals_the_plain_version(prior):
    rng = np.random.default_rng(4)
    positive, unlabelled = sets(rng, 25, 1.0), sets(rng, 60, 0.15)
    weight, bias = tx.train(positive, unlabelled, prior, 12)
    expected, other, negative = plain_train(positive, unlabelled, prior, 12)
    assert np.allclose(weight, expected, atol=1e-6) and abs(bias - other) < 1e-6
    assert 0 < negative < tx.STEPS  # steps of both kinds were taken


@pytest.mark.parametrize("share", [0.05, 0.15, 0.4])
def test_prior_is_the_planted_share(share):
    rng = np.random.default_rng(8)
    positive, unlabelled = sets(rng, 600, 1.0), sets(rng, 4000, share)
    assert abs(tx.class_prior(positive, unlabelled, 12) - share) < 0.25 * share


def words(n=500, bad=0.15, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < bad
        own = [word() for _ in range(60)]
        for _ in range(rng.randint(2, 5) if toxic else 0):
            own[rng.randrange(60)] = rng.choice(("zwurm", "zwurmig", "yolk"))
        rows.append((i, " ".join(own), None, None))
        labels.append((i, int(toxic)))
    return rows, labels


LABEL = "doc_id long, toxic int"


def test_labels_of_zero_are_never_read(spark):
    rows, labels = words()
    docs = frame(spark, rows)
    models = [tx.fit(docs, spark.createDataFrame(own, LABEL)) for own in (labels, [x for x in labels if x[1]], [(i, y if y else None) for i, y in labels] + [(i, y) for i, y in labels if y])]
    assert models[0].weights.any() and 0.05 < models[0].prior < 0.3
    for m in models[1:]:
        assert np.array_equal(m.weights, models[0].weights) and m.bias == models[0].bias and m.prior == models[0].prior


def test_a_given_prior_is_taken(spark):
    rows, labels = words(200)
    assert tx.fit(frame(spark, rows), spark.createDataFrame(labels, LABEL), prior=0.2).prior == 0.2


def test_the_draw_is_bounded_by_rows_and_whole_on_one_key(spark):
    rows = frame(spark, [(7, "same text zwurm", None, None)] * 300).selectExpr("doc_id AS id", "text").repartition(4)
    chosen = np.unique(tx.features(np.frombuffer(b"same text zwurm", np.uint8), np.array([0, 15]))[1])
    for n in (10, 64, 299, 300, 500):
        found = tx.drawn(rows, n, 300, chosen)
        assert len(found) == min(n, 300) and all(len(x) == len(chosen) for x in found)


def test_features_are_counted_over_all_rows(spark):
    rows, labels = words(60)
    marked = spark.createDataFrame([(y == 1, t) for (_, t, _, _), (_, y) in zip(rows, labels)], "positive boolean, text string").repartition(5)
    found = {r["feature"]: (r["p"], r["u"]) for r in tx.feature_counts(marked).collect()}
    expected = {-1: [sum(y for _, y in labels), len(rows)]}
    for (_, t, _, _), (_, y) in zip(rows, labels):
        for f in np.unique(tx.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1]).tolist():
            own = expected.setdefault(f, [0, 0])
            own[0] += y
            own[1] += 1
    assert found == {k: tuple(v) for k, v in expected.items()}


def test_repeated_label_ids_and_documents_that_share_an_id(spark):
    rows, labels = words(300)
    bad = [i for i, y in labels if y]
    docs = frame(spark, rows + [(bad[0], rows[bad[1]][1], None, None), (None, rows[bad[2]][1], None, None)])
    once = tx.fit(docs, spark.createDataFrame([(i, 1) for i in bad] + [(None, 1)], LABEL))
    again = tx.fit(docs, spark.createDataFrame([(i, 1) for i in bad * 3], LABEL))
    assert np.array_equal(once.weights, again.weights) and once.bias == again.bias
    assert tx.score(docs, once).count() == 302


def test_held_out_recall(spark):
    base = "/root/testdata/sf0.1"
    scores = queries.op9_toxicity(spark, base).where("held_out").join(queries.table(spark, base, "labels").where(F.col("toxic").isNotNull()), "doc_id")
    seen = {r["toxic"]: (r["flagged"], r["n"]) for r in scores.groupBy("toxic").agg(F.avg("predicted").alias("flagged"), F.count("*").alias("n")).collect()}
    assert seen[1][0] >= 0.8 and seen[0][0] <= 0.02 and seen[1][1] > 100  # from 329 positives; more of them find more
