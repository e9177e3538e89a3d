"""The knowledge store: merges in proportion to their rows, one version for a reader, repeated and failed merges."""

import random

from pyspark.sql import functions as F

from runlake.plans.store import Store
from runlake.storage import new_path

DOC = "id string, document string, version long"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def held(store, version=None):
    return {r["id"]: (r["document"], r["version"]) for r in store.read(version).collect()}


def test_merges_equal_a_plain_upsert_at_every_version(spark):
    store, plain, rng, versions = Store(spark, new_path(spark, "store"), buckets=4, compact=2), {}, random.Random(1), {}
    assert store.read() is None
    for number in range(1, 8):
        rows = [(f"k{rng.randrange(30)}", f"text {number}-{i}", rng.randrange(1000)) for i in range(rng.choice((0, 3, 20)))]
        rows = list({(i, v): (i, d, v) for i, d, v in rows}.values())
        store.merge(docs(spark, rows), number)
        for i, d, v in rows:
            if i not in plain or v > plain[i][1]:
                plain[i] = (d, v)
        versions[number] = dict(plain)
        if plain:
            assert held(store) == plain
    assert held(store, 7) == versions[7] and store.versions() == list(range(1, 8))


def test_rows_written_are_in_proportion_to_the_rows_merged(spark):
    store = Store(spark, new_path(spark, "store"), buckets=8, compact=8)
    store.merge(docs(spark, [(f"k{i}", "x", 0) for i in range(4000)]), 0)
    for number in range(1, 6):
        manifest = store.merge(docs(spark, [(f"k{number}", "y", number)]), number)
        assert spark.read.parquet(f"{store.path}/data/{number}").count() == 1
    assert sum(len(own) for own in manifest.values()) == 8 + 5
    assert held(store)["k3"] == ("y", 3) and len(held(store)) == 4000


def test_buckets_with_many_versions_are_rewritten_alone(spark):
    store = Store(spark, new_path(spark, "store"), buckets=8, compact=3)
    store.merge(docs(spark, [(f"k{i}", "x", 0) for i in range(400)]), 0)
    for number in range(1, 9):
        manifest = store.merge(docs(spark, [("k1", f"y{number}", number)]), number)
    assert max(len(own) for own in manifest.values()) <= 3 and held(store)["k1"] == ("y8", 8)
    touched = [b for b, own in manifest.items() if own != [f"data/0/_bucket={b}"]]
    assert len(touched) == 1  # the others are the files of the first merge


def test_a_reader_keeps_its_version_while_others_are_merged(spark):
    store = Store(spark, new_path(spark, "store"), buckets=2, compact=1)
    store.merge(docs(spark, [("a", "old", 0), ("b", "old", 0)]), 0)
    reading = store.read()
    for number in range(1, 5):
        store.merge(docs(spark, [("a", f"new {number}", number)]), number)
    assert {r["document"] for r in reading.collect()} == {"old"} and held(store)["a"] == ("new 4", 4)


def test_a_failed_or_repeated_merge_leaves_nothing_that_counts(spark, monkeypatch):
    store = Store(spark, new_path(spark, "store"))
    store.merge(docs(spark, [("a", "one", 1)]), 1)
    monkeypatch.setattr(Store, "_publish", lambda self, number, folders: (_ for _ in ()).throw(OSError("lost")))
    try:
        store.merge(docs(spark, [("a", "wrong", 9), ("z", "wrong", 9)]), 2)
    except OSError:
        pass
    monkeypatch.undo()
    assert held(store) == {"a": ("one", 1)}
    for _ in range(2):
        store.merge(docs(spark, [("a", "two", 2)]), 2)
    assert held(store) == {"a": ("two", 2)} and store.versions() == [1, 2]


def test_a_hot_id_is_one_row(spark):
    store = Store(spark, new_path(spark, "store"))
    many = spark.range(3000).select(F.lit("hot").alias("id"), F.col("id").cast("string").alias("document"), F.col("id").alias("version"))
    store.merge(many, 0)
    assert spark.read.parquet(f"{store.path}/data/0").count() == 1 and held(store) == {"hot": ("2999", 2999)}
