"""Each operator against a brute-force version, on rows with nulls, empty and very long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import inspect
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from tokenizers import Tokenizer

from oracle import assert_same, connect
from runlake.llm import exact_dedup, language_id, minhash, mixing, packing, queries, shared, sharding, suffix_dedup, token_store, tokens, toxicity, vector_dedup
from runlake.storage import new_path

CLASH = "id string, n long, h1 string, row int, cls double, size long, start string, kept string, key int, label2 string, part int, word string, vec binary"
EXTRA = ("x", 1, "y", 2, 0.5, 3, "z", "no", 4, "l", 5, "w", b"v")
DOC = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def frame(spark, rows):
    """Documents (doc_id, text, lang, source) with further columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *EXTRA) for i, t, lang, s in rows], DOC)


def documents():
    """Texts with every odd case: nulls, blanks, copies, near copies, one very long, repeated rows and ids, null ids."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.choice((1, 2, 5, 30, 80, 120)))) for _ in range(40)]
    passage = " ".join(word() for _ in range(60))
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(100 + i, t.replace(" ", " \n\t"), "en", "s1") for i, t in enumerate(base[:9])]
    for i, t in enumerate(base[10:25]):
        near = t.split(" ")
        near[rng.randrange(len(near))] = "changed"
        rows.append((200 + i, " ".join(near).upper(), None, None))
    rows += [(300 + i, f"{word()} {passage} {word()}", "de", "s2") for i in range(5)]
    rows += [(400, None, None, None), (401, "", "en", None), (402, "  \n ", "en", "s0"), (403, None, "en", "s3"), (404, "12 34 !?", "en", "s0")]
    rows += [(500, " ".join(word() for _ in range(9000)), "en", "s0"), (501, "q" * 70_000, "en", "s0")]
    return rows + rows[:4] + [(7, "another text with an old id", "en", "s9"), (None, base[3], "en", "s0"), (None, "no id at all", "en", "s0")]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, documents()).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def words_of(text):
    return (text or "").encode().lower().split()


def smallest(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def test_exact_groups(docs, nothing):
    groups = collections.defaultdict(list)
    for i, t, *_ in documents():
        groups[normal(t)].append(i)
    expected = sorted(((str(i), str(smallest(g)), len(g)) for t, g in groups.items() for i in g))
    found = exact_dedup.exact_groups(docs, prefix=4).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in found) == expected
    assert sum(r["kept"] for r in found) == len(groups)
    digests = {hashlib.sha256(t.encode()).hexdigest() for t, g in groups.items() if len(g) > 1}
    assert digests <= {r["text_sha256"] for r in found}
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_exact_groups_without_broadcast(docs, monkeypatch):
    one = sorted(map(str, exact_dedup.exact_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "small", lambda df: df)
    assert sorted(map(str, exact_dedup.exact_groups(docs).collect())) == one


def check_shards(found, rows, shards):
    assert sorted((r["size"], r["text_crc32"]) for r in found) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    by, group, homes = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    for r in found:
        by[r["shard"]].append(r)
        group[r["size"], r["text_crc32"]] += r["size"]
        homes[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(r["slot"] for r in g) == list(range(len(g))) for g in by.values())
    order = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in order] == list(itertools.accumulate([0] + [r["size"] for r in order[:-1]]))
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in order)
    share = sum(r["size"] for r in found) / shards
    assert all(len(own) == 1 or group[k] > share * (1 - 1 / sharding.PARTS) for k, own in homes.items())
    return share, {k: sum(r["size"] for r in g) for k, g in by.items()}, homes


def test_shards(docs, nothing):
    share, sizes, _ = check_shards(sharding.byte_shards(docs, 8).collect(), documents(), 8)
    assert sharding.byte_shards(nothing, 8).count() == 0


def test_shards_keep_equal_texts_together_unless_they_exceed_a_share(spark):
    rng = random.Random(6)
    rows = [(i, f"t{rng.randrange(700)} " * rng.randint(1, 3), "en", "s") for i in range(1500)]
    rows += [(2000 + i, "often " * 40, "en", "s") for i in range(20)] + [(3000 + i, "hot text", "en", "s") for i in range(2000)] + [(None, "hot text", "en", "s"), (5000, None, "en", "s"), (5001, "", "en", "s")]
    share, sizes, homes = check_shards(sharding.byte_shards(frame(spark, rows).repartition(5), 8).collect(), rows, 8)
    hot = homes[9, zlib.crc32(b"hot text")]
    assert len(hot) > 1 and sum(len(own) > 1 for own in homes.values()) == 1
    assert all(abs(size - share) <= 2 * share / sharding.PARTS for size in sizes.values())
    assert len(homes[1, 0]) == 1  # null and empty texts


def test_large_groups_are_placed_first():
    homes, room = sharding.place([90, 60, 50, 40, 5], 3, 80.0)
    assert homes == [None, 0, 1, 2, 2] and room == [20.0, 30.0, 35.0]


def test_equal_rows_do_not_share_one_range(spark, monkeypatch):
    """A third of all rows are equal in every column; ranges stay near the mean."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("k"), F.lit(1).alias("v"))
    taken = []
    monkeypatch.setattr(shared, "stash", lambda df, tag: taken.append(df) or df)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        total = shared.with_prefix(rows, ["k"], {"before": F.col("v")}).agg(F.countDistinct("before"), F.max("before")).first()
        assert tuple(total) == (30_000, 29_999)
        sizes = [r["count"] for r in taken[0].groupBy("_px_p").count().collect()]
        assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def filled(sizes, weights, cap):
    """Shares by weight, capped one round after the other."""
    target, open_, rest = {}, dict(zip(sizes, weights)), sum(sizes.values())
    while open_:
        level = rest / sum(open_.values())
        over = [s for s in open_ if open_[s] * level >= cap * sizes[s]]
        if not over:
            return target | {s: w * level for s, w in open_.items()}
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
            del open_[s]
    return target


def test_mix(spark, nothing):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), None, rng.choice(["é", "a", "b", "Z", None])) for i in range(600)] + [(600, "w w", None, "tiny"), (601, None, None, "none"), (1, "w w w", None, "a"), (1, "w w w", None, "a")]
    found = mixing.mix(frame(spark, rows)).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted([s for s in sizes if s is not None], key=str.encode) + [None]
    expected = filled({s: sizes[s] for s in order}, [(5, 2, 1)[i % 3] for i in range(len(order))], 3)
    taken = collections.Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], expected[r["source"]], abs_tol=1e-6)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        assert sizes[r["source"]] == 0 or math.isclose(r["rate"], r["target"] / sizes[r["source"]], abs_tol=1e-9)
        taken[r["source"]] += r["taken"]
    assert len(found) == len(rows) and all(abs(taken[s] - expected[s]) <= 6 for s in order)
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    key = lambda r: str((r["doc_id"], r["size"], r["copies"]))
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert mixing.mix(nothing).count() == 0
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, None, None, "a"), (2, " ", None, None)])).collect()] == [0, 0]


def ids_of(text):
    return np.array(Tokenizer.from_file(tokens.TOKENIZER).encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_store_gives_back_every_id(spark, docs, nothing):
    path = new_path(spark, "store")
    token_store.write_tokens(docs, path)
    found = sorted(token_store.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in found) == sorted((str(i), ids_of(t).tobytes()) for i, t, *_ in documents())
    assert [r["start"] for r in found] == list(itertools.accumulate([0] + [r["n_tokens"] for r in found[:-1]]))
    ids = [r["doc_id"] for r in found if r["doc_id"] is not None]
    assert ids == sorted(ids)
    some = token_store.read_some(spark, path, spark.createDataFrame([(5,), (200,), (-1,)], "doc_id long")).collect()
    assert sorted((r["doc_id"], r["start"]) for r in some) == sorted((r["doc_id"], r["start"]) for r in found if r["doc_id"] in (5, 200))
    hashes = {r["dict_hash"] for r in spark.read.parquet(f"{path}/blocks").select("dict_hash").collect()}
    assert hashes == {hashlib.sha256(bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])).hexdigest()}
    empty = new_path(spark, "store")
    token_store.write_tokens(nothing, empty)
    assert token_store.read_tokens(spark, empty).count() == 0


def test_another_dictionary_is_refused(spark, docs):
    path, other = new_path(spark, "store"), new_path(spark, "store")
    token_store.write_tokens(docs.limit(3), path)
    token_store.write_tokens(docs, other)
    spark.read.parquet(f"{other}/dictionary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        token_store.read_tokens(spark, path).collect()


def test_packing(docs, nothing):
    found = packing.pack(docs, 512).collect()
    texts = collections.Counter((str(i), ids_of(t).tobytes()) for i, t, *_ in documents())
    want = collections.Counter()
    for (i, raw), many in texts.items():
        ids = np.frombuffer(raw, "<u4")
        for p in range(-(-len(ids) // 512)):
            part = ids[p * 512 : (p + 1) * 512]
            want[i, p, p * 512, len(part), zlib.crc32(part.tobytes())] += many
    assert collections.Counter((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) <= 1.05 * sum(r["length"] for r in found) / 512 + 2
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece_and_waste_little(seed):
    rng = np.random.default_rng(seed)
    lengths = (rng.integers(1, 4097, 3000), np.clip(rng.lognormal(6.5, 1.2, 20_000).astype(int), 1, 4096), rng.choice([1500, 1300, 1200, 900, 2000], 3000), rng.integers(1, 30, 500), rng.integers(2049, 4097, 300), np.array([4096] * 5))[seed]
    histogram = collections.Counter(lengths.tolist())
    plan = packing.plan(histogram, 4096)
    held = collections.Counter()
    for rows, many in plan:
        assert sum(n * c for n, c in rows) <= 4096 and many > 0
        for n, c in rows:
            held[n] += c * many
    assert held == histogram
    least = max(-(-int(lengths.sum()) // 4096), int((lengths > 2048).sum()))
    assert sum(many for _, many in plan) <= 1.09 * least + 2


def brute_components(sets, linked):
    """Smallest id reachable, by index, for sets that are linked pairwise."""
    root = list(range(len(sets)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(sets)), 2):
        if linked(sets[a], sets[b]):
            root[up(a)] = up(b)
    groups = collections.defaultdict(list)
    for i in range(len(sets)):
        groups[up(i)].append(i)
    return groups


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, nothing, words):
    rows = documents()
    sets = []
    for _, t, *_ in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    groups = brute_components(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b))
    expected = sorted((str(rows[i][0]), len(sets[i]), str(smallest([rows[j][0] for j in g]))) for g in groups.values() for i in g)
    found = minhash.near_duplicates(docs, words).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == expected
    assert sum(r["kept"] for r in found) == len(groups)
    assert minhash.near_duplicates(nothing).count() == 0


def test_links_are_found_within_a_large_group(spark):
    """Variants of one text, many linked only through others, in blocks far smaller than the group."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(own), None, None))
    sets = [set(zip(t.split(), t.split()[1:])) for _, t, *_ in rows]
    groups = brute_components(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    old, minhash.BLOCK = minhash.BLOCK, 16
    try:
        found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows), 2).collect()}
    finally:
        minhash.BLOCK = old
    assert found == {i: min(g) for g in groups.values() for i in g} and 1 < len(groups) < 300


def test_keys_guarantee_pairs_within_the_threshold():
    rng = np.random.default_rng(1)
    cuts, limit = minhash.chunk_bounds(80), minhash.threshold(80)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, (1, minhash.SYMBOLS), dtype=np.uint16)
        b = a.copy()
        b[0, rng.choice(minhash.SYMBOLS, limit, replace=False)] ^= 1
        assert set(minhash.keys(a, cuts)[0]) & set(minhash.keys(b, cuts)[0])


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5), (301, 300)]
    found = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200 + i: 200 for i in range(9)} | {300: 300, 301: 300}
    assert found == expected
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTOR = f"vec_id long, embedding array<float>, label int, {CLASH.replace('vec binary', 'x binary')}"


def vectors():
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=12).tolist(), i % 3) for i in range(240)]
    ball = rng.normal(size=12)
    rows += [(1000 + i, (ball + rng.normal(size=12) * 0.05).tolist(), 1) for i in range(150)]
    rows += [(2000 + i, [x * 3 for x in rows[i][1]], rows[i][2]) for i in range(20)] + [(2100 + i, rows[i][1], rows[i][2]) for i in range(20)]
    odd = [(3000, None, 1), (3001, [0.0] * 12, 1), (3002, [float("nan")] + [1.0] * 11, 1), (3003, [None] + [1.0] * 11, 1), (3004, [float("inf")] + [1.0] * 11, 1), (3005, rows[0][1], None), (3006, [], 1), (3007, [1.0, 2.0], 1), (3008, [2.0, 4.0], 1)]
    return rows + odd + [rows[5], rows[5], (None, rows[6][1], rows[6][2])]


def test_near_vectors(spark):
    rows = vectors()

    def unit(v, label):
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(float)
        return label, x / np.linalg.norm(x)

    points = [unit(v, label) for _, v, label in rows]
    linked = lambda a, b: a is not None and b is not None and a[0] == b[0] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.98
    links = collections.Counter()
    for a, b in itertools.combinations(range(len(rows)), 2):
        if linked(points[a], points[b]):
            links[a] += 1
            links[b] += 1
    groups = brute_components(points, linked)
    expected = sorted((str(rows[i][0]), links[i], str(smallest([rows[j][0] for j in g]))) for g in groups.values() for i in g)
    df = spark.createDataFrame([(i, v, label, *EXTRA) for i, v, label in rows], VECTOR)
    old = vector_dedup.SHARD
    for size in (old, 40):  # one shard a label, then many that overlap, and a ball that can't be split
        vector_dedup.SHARD = size
        try:
            found = vector_dedup.near_vectors(df).collect()
        finally:
            vector_dedup.SHARD = old
        assert len(found) == len(rows) and sum(r["kept"] for r in found) >= len(groups)
        total = sum(r["n_links"] for r in found)
        assert 0.9 * sum(links.values()) <= total <= sum(links.values())
        if size == old:
            assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in found) == expected
    assert vector_dedup.near_vectors(spark.createDataFrame([], VECTOR)).count() == 0


def test_groups_of_a_dense_ball_are_bounded(spark, monkeypatch):
    size, n = 50, 400
    monkeypatch.setattr(vector_dedup, "SHARD", size)

    def bounded(run):
        def spied(grouped, func, schema):
            def checked(*sides):
                assert func.__name__ == "fit" or sum(map(len, sides)) <= 2.5 * size, "a group grows with the ball"  # a fit has its sample
                return func(*sides)

            names = len(inspect.signature(func).parameters)
            return run(grouped, (lambda a: checked(a)) if names == 1 else (lambda a, b: checked(a, b)), schema)

        return spied

    for kind in (GroupedData, PandasCogroupedOps):
        monkeypatch.setattr(kind, "applyInPandas", bounded(kind.applyInPandas))
    rng = np.random.default_rng(3)
    ball = rng.normal(size=12)
    rows = [(i, (ball + rng.normal(size=12) * 0.01).tolist(), 1, *EXTRA) for i in range(n)]
    found = vector_dedup.near_vectors(spark.createDataFrame(rows, VECTOR)).collect()
    assert {(r["n_links"], r["component_id"]) for r in found} == {(n - 1, 0)} and len(found) == n


def test_recall_counts_queries_not_links():
    hot = {i: 1000 for i in range(400)}
    sparse = {1000 + i: 1 for i in range(20)}
    assert vector_dedup.recalled(hot | sparse, hot | sparse) and vector_dedup.recalled({}, {}) and vector_dedup.recalled({1: 0}, {})
    assert not vector_dedup.recalled(hot | sparse, hot)  # more than 0.99 of all links


def test_lost_links_are_found_in_whole_groups(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=12)) for i in range(300)]
    rows = [(i, v.tolist(), 1, *EXTRA) for i, v in rows] + [(1000 + i, (v + rng.normal(size=12) * 0.04).tolist(), 1, *EXTRA) for i, v in rows]
    points = np.array([np.array(r[1], np.float32).astype(float) for r in rows])
    points /= np.linalg.norm(points, axis=1)[:, None]
    expected = {r[0]: int(n) - 1 for r, n in zip(rows, (points @ points.T >= 0.98).sum(1))}
    monkeypatch.setattr(vector_dedup, "SHARD", 30)
    monkeypatch.setattr(vector_dedup, "recalled", lambda exact, found: False)
    found = vector_dedup.near_vectors(spark.createDataFrame(rows, VECTOR)).collect()
    assert {r["vec_id"]: r["n_links"] for r in found} == expected


def test_audit_counts_exactly(spark):
    df = spark.createDataFrame([(0, "k", np.array([1.0, 0.0]).tobytes(), 2), (1, "k", np.array([1.0, 0.0]).tobytes(), 3), (2, "m", np.array([1.0, 0.0]).tobytes(), 5)], "cls long, kind string, vec binary, copies long")
    assert {r["cls"]: r["n"] for r in vector_dedup.exact_links(df, df, 0.98).collect()} == {0: 3, 1: 2, 2: 0}


def brute_passages(rows, words=50):
    where = collections.defaultdict(set)
    lists = [words_of(t) for _, t, *_ in rows]
    for i, w in enumerate(lists):
        for a in range(len(w) - words + 1):
            where[tuple(w[a : a + words])].add(i)
    out = []
    for i, w in enumerate(lists):
        spans = []
        for a in range(len(w) - words + 1):
            if len(where[tuple(w[a : a + words])]) > 1:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + words
                else:
                    spans.append([a, a + words])
        out += [(str(rows[i][0]), a, b - a) for a, b in spans]
    return sorted(out)


def test_passages(spark, docs, nothing):
    rows = documents()
    found = suffix_dedup.repeated_passages(docs).collect()
    assert sorted((str(r["doc_id"]), r["start_word"], r["n_words"]) for r in found) == brute_passages(rows)
    texts = collections.defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append((t or "").encode())
    for r in found:
        cut = [t[r["start_byte"] : r["start_byte"] + r["n_bytes"]].split() for t in texts[r["doc_id"]]]
        assert any(len(c) == r["n_words"] for c in cut)
    assert suffix_dedup.repeated_passages(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_any_length_and_place(spark, seed):
    """Shared runs of 45 to 70 words among words that repeat often, so that matches begin and end anywhere."""
    rng = random.Random(seed)
    pool = [[rng.choice("ab") + str(rng.randrange(12)) for _ in range(rng.randint(45, 70))] for _ in range(6)]
    rows = []
    for i in range(40):
        w = [rng.choice("cd") + str(rng.randrange(12)) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w += rng.choice(pool)[rng.randint(0, 5) :] + [f"u{rng.randrange(50)}"]
        rows.append((i, " ".join(w), None, None))
    found = suffix_dedup.repeated_passages(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["start_word"], r["n_words"]) for r in found) == brute_passages(rows)


def test_each_text_meets_its_own_class_only(spark, monkeypatch):
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randrange(500)}" for _ in range(60))
    rows = [(i, f"a{k} b{k} {passage} c{k}", "en", "s0") for k, i in enumerate([None] * 30 + [7] * 30)]
    read, run = [], type(spark.range(1)).mapInArrow

    def counted(df, *args):
        read.append(df.count())
        return run(df, *args)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", counted)
    found = suffix_dedup.repeated_passages(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["start_word"], r["n_words"]) for r in found) == sorted((str(i), 2, 60) for i, *_ in rows)
    assert read == [60, 60]  # texts outlined, texts with shared heads


def test_forward_sums_all_segmentations():
    table = language_id.pieces(language_id.VOCABULARY)
    rng = np.random.default_rng(0)
    p = rng.random((table.size, 3))
    p /= p.sum(0)

    def number(piece):
        keys = table.keys.get(len(piece))
        if keys is None:
            return None
        h = language_id._hash(np.frombuffer(piece, np.uint8)[None])[0, len(piece)]
        i = np.searchsorted(keys, h)
        return table.numbers[len(piece)][i] if i < len(keys) and keys[i] == h else None

    for word in (b"the", "äh".encode(), b"thing", b"a"):
        text, total = b" " + word, np.zeros(3)
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
            parts = [number(text[a:b]) for a, b in zip([0, *ends], ends)]
            if None not in parts:
                total += np.prod(p[parts], axis=0)
        block = np.frombuffer(text, np.uint8)[None]
        assert np.allclose(language_id.forward(table.lattice(block), 1, p)[-1][0], total, rtol=1e-12)


def test_long_runs_are_cut_at_characters():
    data = np.frombuffer(("x" * 100 + " " + "é" * 90 + " ab").encode(), np.uint8)
    starts, ends, _ = language_id.cut_words(data, np.array([0, len(data)]))
    assert (ends - starts).max() <= language_id.BLOCK - 4 and (ends - starts).sum() == 282
    for a, b in zip(starts, ends):
        bytes(data[a:b]).decode()


def test_languages(spark, docs, nothing):
    model = language_id.fit(docs)
    assert model.langs == ["de", "en"] and np.allclose(model.p.sum(0), 1)
    found = language_id.predict(docs, model).collect()
    assert len(found) == len(documents()) and all(0 <= r["score"] <= 1 for r in found)
    none = {i for i, t, *_ in documents() if not any(map(str.isalpha, t or ""))}
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == none
    kept = language_id.accepted(docs, model)
    assert kept.columns == docs.columns and not {r["doc_id"] for r in kept.collect()} & none
    empty = language_id.fit(nothing)
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(nothing, model).count() == 0


def test_languages_held_out(spark, tiny):
    found = queries.op1_language_id(spark, tiny)
    truth = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_toxicity(spark, docs, nothing):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.15
        w = [word() for _ in range(60)]
        for _ in range(rng.randint(2, 5) if bad else 0):
            w[rng.randrange(60)] = rng.choice(("zwurm", "zwurmig", "yolk"))
        rows.append((i, " ".join(w), None, None))
        labels.append((i, int(bad)))
    train = spark.createDataFrame([x for x in labels if x[0] < 300] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), train)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, rows), model).collect()}
    held = [(found[i], y) for i, y in labels if i >= 300]
    assert sum((s >= 0.3) == bool(y) for s, y in held) >= 0.95 * len(held)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(documents()) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(nothing, model).count() == 0
    harmless = toxicity.fit(frame(spark, rows), train.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs, harmless).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(nothing, train)).collect()} == {0.0}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, tiny, name):
    assert_same(getattr(queries, name)(spark, tiny), connect(tiny), queries.ORACLE[name])


def test_native_operators_run_no_python(spark, tiny):
    for name in ("op3_exact_dedup", "op4_mixing", "op5_sharding"):
        plan = getattr(queries, name)(spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan), name


def test_prefix_sums(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(50), i, rng.choice((None, 0, 1, 7))) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    found = shared.with_prefix(df, ["k", "i"], {"before": F.col("v"), "place": F.lit(1)}).collect()
    at = 0
    for place, (k, i, v) in enumerate(sorted(rows)):
        row = next(r for r in found if r["i"] == i)
        assert (row["before"], row["place"]) == (at, place)
        at += v or 0
