"""The pipeline's stages against plain versions, over the odd documents of the operator tests."""

import collections

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_llm_operators import DOC, documents, frame, ids_of, normal, words_of

from runlake.llm.shared import stash


def written(spark, df):
    return stash(df, "docs")


def test_stage_by_stage(spark):
    rows = documents()
    docs = written(spark, frame(spark, rows).repartition(3))
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(spark, stage(spark, docs, ""))
        assert docs.columns == [x.split()[0] for x in DOC.split(", ")]
        seen[name] = sorted((str(r["doc_id"]), r["text"]) for r in docs.collect())

    lettered = sorted((str(i), t) for i, t, *_ in rows if any(map(str.isalpha, t or "")))
    assert set(seen["language_id"]) <= set(lettered) and len(seen["language_id"]) >= 0.9 * len(lettered)

    # of copies, the row of smallest id stays, null last
    order = lambda r: (r[0] == "None", int(r[0]) if r[0] != "None" else 0)
    groups = collections.defaultdict(list)
    for r in seen["language_id"]:
        groups[normal(r[1])].append(r)
    assert sorted(normal(t) for _, t in seen["exact_dedup"]) == sorted(groups)
    assert sorted(i for i, _ in seen["exact_dedup"]) == sorted(min(g, key=order)[0] for g in groups.values())

    # no two that stay are near, and each that went is connected to one that stays
    sets = [(r, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for r in seen["exact_dedup"] for w in [words_of(r[1])]]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    kept = [s for r, s in sets if r in seen["near_dedup"]]
    assert not any(near(a, b) for i, a in enumerate(kept) for b in kept[:i])
    reached = list(kept)
    for s in reached:
        reached += [x for _, x in sets if near(s, x) and x not in reached]
    assert all(s in reached for _, s in sets)

    counts = collections.Counter(seen["mixing"])
    assert set(counts) <= set(seen["near_dedup"]) and max(counts.values()) <= 3
    rows_of_last = seen["near_dedup"]
    size = lambda rows: sum(len(words_of(t)) for _, t in rows)
    assert abs(size(seen["mixing"]) - size(seen["near_dedup"])) <= max(len(words_of(t)) for _, t in rows_of_last) + 60  # one document may not fit

    found = pipeline.STAGES[-1][1](spark, docs, "").collect()
    tokens = sum(len(ids_of(t)) * n for (_, t), n in counts.items())
    assert sum(r["length"] for r in found) == tokens and all(r["offset"] + r["length"] <= pipeline.CAPACITY for r in found)


def test_nothing_in_nothing_out(spark):
    docs = written(spark, spark.createDataFrame([], DOC))
    for _, stage in pipeline.STAGES:
        docs = written(spark, stage(spark, docs, ""))
        assert docs.count() == 0


def test_rows_without_a_file(spark):
    docs = frame(spark, [(1, "a b c", "en", "s"), (1, "a  b c", "en", "s"), (None, "d e f", None, None)])
    kept = pipeline.without_copies(spark, docs.where(F.col("n_chars") > 0), "")
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"]


def test_run_keeps_clean_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert pipeline.known_language(spark, docs, tiny).count() == docs.where(F.col("text").rlike("\\p{L}")).count()
    found = pipeline.run(spark, tiny)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 100


def test_columns_named_like_inner_ones_come_out_as_they_went_in(spark):
    odd = ["_metadata", "_runlake_row", "_copies", "_copy", "a.b", "other_4", "_px_p", "kept", "copies"]
    rows = documents()[:60]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` {'long' if i % 2 else 'string'}" for i, c in enumerate(odd))
    data = [(i, t, lang, s, *[n * 100 + k if k % 2 else f"{n}-{k}" for k in range(len(odd))]) for n, (i, t, lang, s) in enumerate(rows)]
    docs = written(spark, spark.createDataFrame(data, schema).repartition(3))
    known = {tuple(r) for r in docs.collect()}
    for _, stage in pipeline.STAGES[:-1]:
        docs = written(spark, stage(spark, docs, ""))
        assert docs.columns == schema_names(schema) and {tuple(r) for r in docs.collect()} <= known and docs.count() > 10
    assert pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()


def schema_names(schema):
    return [x.strip().rsplit(" ", 1)[0].strip("`") for x in schema.split(",")]
