"""Exact search with pruning against brute force, and vectors of texts against numpy."""

import math
import random
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from oracle import assert_same
from runlake.plans import search as sr, vectors as vc
from runlake.queries import ORACLE, QUERIES


def brute(queries, docs, k):
    """The best k of every query, by (score, id); vectors without a direction score 0."""
    width = Counter(len(v) for _, v in docs if v is not None).most_common(1)[0][0]

    def unit(v):
        if v is None or len(v) != width or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        scaled = np.array(v) / max(map(abs, v))
        return scaled / np.linalg.norm(scaled)

    known, out = [(i, unit(v)) for i, v in docs], {}
    for q, v in queries:
        own = unit(v)
        scores = [(-round(float(own @ d), 12) if own is not None and d is not None else 0.0, i) for i, d in known]
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def found_of(hits):
    out = {}
    for r in hits.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    return {q: [i for _, i in sorted(v)] for q, v in out.items()}


def frames(spark, queries, docs):
    return spark.createDataFrame(queries, "query_id long, embedding array<double>"), spark.createDataFrame(docs, "id long, embedding array<double>").repartition(3)


def clustered(n=1500, clusters=30, d=12, seed=0, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, d))
    return [(i, (centres[i % clusters] + spread * rng.standard_normal(d)).tolist()) for i in range(n)]


@pytest.mark.parametrize("ball, doc_block, query_block, k", [(256, 4096, 4096, 5), (8, 7, 3, 4)])
def test_search_is_exact_whatever_the_blocks(spark, monkeypatch, ball, doc_block, query_block, k):
    for name, value in (("BALL", ball), ("DOC_BLOCK", doc_block), ("QUERY_BLOCK", query_block)):
        monkeypatch.setattr(sr, name, value)
    rng = random.Random(3)
    docs = [(i, [rng.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(3)]) for i in range(60)]
    docs += [(60, [0.0, 0.0, 0.0]), (61, None), (62, [1.0]), (63, [float("nan"), 1.0, 0.0]), (64, [None, 1.0, 0.0]), (65, [1e200, 0.0, 0.0]), (66, [1e-200, 1e-200, 0.0])]
    queries = [(i, v) for i, v in docs if i < 20 or i >= 60]
    assert found_of(sr.search(*frames(spark, queries, docs), k)) == brute(queries, docs, k)


def test_whole_blocks_are_ruled_out_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(sr, "BALL", 30)
    docs = clustered()
    queries = docs[::100]
    hits, visits, balls = sr.search_and_visits(*frames(spark, queries, docs), 5)
    assert found_of(hits) == brute(queries, docs, 5)
    scored = visits.count()
    assert balls >= 30 and scored < 0.25 * balls * len(queries)
    assert visits.distinct().count() == scored  # no ball is scored twice for a query


def test_copies_tie_by_id(spark, monkeypatch):
    monkeypatch.setattr(sr, "DOC_BLOCK", 16)
    v = [0.1, 0.7, -0.3]
    docs = [(i, v) for i in range(100)] + [(200, [1.0, 0.0, 0.0])]  # a hot group of copies
    assert found_of(sr.search(*frames(spark, [(1, v)], docs), 3)) == {1: [0, 1, 2]}


def test_few_documents_and_none(spark):
    docs = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    assert found_of(sr.search(*frames(spark, [(9, [1.0, 0.1]), (9, [1.0, 0.1])], docs), 5)) == {9: [1, 2]}
    assert sr.search(*frames(spark, [(9, [1.0, 0.1])], []), 5).count() == 0
    assert sr.search(*frames(spark, [], docs), 5).count() == 0
    assert found_of(sr.search(*frames(spark, [(9, [1.0])], [(4, None), (3, None)]), 5)) == {9: [3, 4]}


def texts(spark, tiny):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}


def test_weights_are_those_of_a_plain_count(spark, tiny):
    from pyspark.ml.feature import HashingTF

    docs, column = texts(spark, tiny), HashingTF(numFeatures=vc.FEATURES)
    at = {w: column.indexOf(w) for t in docs.values() for w in t.lower().split()}
    counts = {i: Counter(at[w] for w in t.lower().split()) for i, t in docs.items()}
    having = Counter(c for own in counts.values() for c in own)
    found = {}
    for r in QUERIES["kb_term_weights"](spark, tiny).collect():
        found.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    for i, own in counts.items():
        raw = {c: n * math.log((len(docs) + 1) / (having[c] + 1)) for c, n in own.items()}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1
        assert set(found.get(i, {})) == {c for c in raw if True} and all(abs(found[i][c] - x / norm) < 2e-9 for c, x in raw.items())


def dense(rows, features):
    collected = rows.collect()
    a = np.zeros((len(collected), features))
    for k, r in enumerate(collected):
        a[k, r["indices"]] = r["weights"]
    return a


def test_directions_are_those_of_the_singular_value_decomposition(spark, tiny):
    rows = vc.sparse(spark.read.parquet(f"{tiny}/documents.parquet"), "doc_id", "text", 512)
    a = dense(rows, 512)
    values, directions = vc.leading_directions(rows, 512, rank=8, rounds=12)
    _, s, vt = np.linalg.svd(a)
    assert np.allclose(values, s[:8], rtol=1e-5)
    assert np.allclose(directions.T @ directions, np.eye(8), atol=1e-9)
    gap = s[:8] - s[1:9] > 0.02 * s[0]
    cosines = np.abs((directions * vt[:8].T).sum(0))
    assert gap[:4].all() and (cosines[gap] > 1 - 1e-4).all()
    # what the directions keep of the rows is the most that so many can
    assert np.linalg.norm(a @ directions) ** 2 >= (1 - 1e-6) * (s[:8] ** 2).sum()


def test_sparse_products_do_not_depend_on_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c a", "", None, "b", "c d e f g"] * 7)], "id int, document string").repartition(3)
    rows = vc.sparse(docs, "id", "document", 64)
    basis = np.random.default_rng(1).standard_normal((64, 5))
    a = dense(rows, 64)
    assert np.allclose(vc.right_products(rows, basis), a.T @ a @ basis)
    embedded = {r["id"]: r["embedding"] for r in vc.embedded(rows, "id", basis).collect()}
    assert len(embedded) == 35 and np.allclose(embedded[1], 0) and np.allclose(embedded[2], 0) and np.linalg.norm(embedded[0]) > 0


def test_texts_find_their_near_copies(spark, tiny):
    """A planted near copy of each asked text is among its best hits."""
    docs = texts(spark, tiny)
    rows = [(i, t) for i, t in docs.items()]
    rng = random.Random(5)
    planted = {}
    for i in [i for i, t in docs.items() if len(t.split()) > 60][:25]:
        words = docs[i].split()
        for _ in range(len(words) // 25):
            words[rng.randrange(len(words))] = "changed"
        planted[i] = 10_000 + i
        rows.append((planted[i], " ".join(words)))
    v = vc.text_vectors(spark.createDataFrame(rows, "id long, document string")).cache()
    hits = found_of(sr.search(v.where(v["id"].isin(list(planted))).withColumnRenamed("id", "query_id"), v, 20))  # some texts have a group of copies
    assert sum(planted[i] in hits[i] for i in planted) >= 24


def test_text_search_query_finds_itself_first(spark, tiny):
    docs = texts(spark, tiny)
    first = {r["query_id"]: (r["id"], r["score"]) for r in QUERIES["kb_text_search"](spark, tiny).where("rank = 1").collect()}
    assert set(first) == {i for i in docs if i % 100 == 0}
    assert all(docs[i].lower().split() == docs[q].lower().split() or score == 1.0 for q, (i, score) in first.items() if docs[q].strip())


def test_directions_of_long_vectors_take_no_power_of_their_length(spark):
    """Once each component of a vector cost work by the square of the vector's length: 2,048 of them would not end."""
    rng = np.random.default_rng(4)
    docs = [(i, rng.standard_normal(2048).tolist()) for i in range(40)] + [(40, None), (41, [0.0] * 2048), (42, [1.0])]
    started = time.monotonic()
    found = {r["id"]: r["v"] for r in sr.directed(frames(spark, [], docs)[1], "id", 2048).collect()}
    assert time.monotonic() - started < 60
    assert [found[i] for i in (40, 41, 42)] == [None, None, None]
    assert all(np.allclose(found[i], np.array(v) / np.linalg.norm(v), atol=1e-12) for i, v in docs[:40])


def labelled(folder):
    """Vectors of label 0 and others, with ids that repeat, are null or divisible by 100; and a database that reads them."""
    rng = np.random.default_rng(8)
    ids = [*range(95, 135), 7, 7, None, None, 300, 400]
    labels = [0 if i % 3 == 0 else None if i % 7 == 0 else 1 for i in range(40)] + [0, 0, 0, 0, 0, 2]
    vectors = pa.array([rng.standard_normal(6).tolist() for _ in ids], pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": vectors, "label": pa.array(labels, pa.int32())}), f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return {i for i, label in zip(ids, labels) if label == 0}, con


def test_every_vector_of_label_0_is_searched(spark, tmp_path):
    asked, con = labelled(tmp_path)
    hits = QUERIES["kb_search"](spark, str(tmp_path)).cache()
    assert {r["query_id"] for r in hits.collect()} == asked and {7, 95, 300, None} <= asked and not {100, 400} & asked
    assert hits.count() == 5 * len(asked)
    assert_same(hits, con, ORACLE["kb_search"])
    hits.unpersist()


def test_every_vector_of_label_0_gets_its_references(spark, tmp_path):
    asked, con = labelled(tmp_path)
    pq.write_table(pa.table({"doc_id": pa.array([*range(90, 140), 7, 300, 400], pa.int64()), "text": [f"text {i}" for i in range(53)], "source": [f"source {i}" for i in range(53)]}), f"{tmp_path}/documents.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    found = QUERIES["diagnosis_refs"](spark, str(tmp_path)).cache()
    assert {r["query_id"] for r in found.collect()} == asked
    assert_same(found, con, ORACLE["diagnosis_refs"])
    found.unpersist()
