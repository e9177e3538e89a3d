"""Near-duplicate documents: b-bit minhash signatures, joined under a Hamming threshold, links verified.

A document's set is its distinct shingles of some words (ASCII lower-cased). Its signature has SYMBOLS
symbols of 16 bits, each from the minimum of one hash over the set, so that two symbols differ with
probability 1 - similarity. The distance threshold T is the least that a pair at the wanted similarity
passes but once in 10,000; every pair within it is met. For that the signature is split into chunks, so
many that one of them has one error at most (pigeonhole), and each chunk enumerates its allowed errors:
one key for each symbol left out. Two documents within T share a key.

1. Equal sets form a class; only classes are joined. A key's hub is the smallest class that has it.
2. Each class is compared with its hubs: first signatures, then the full sets. Links give components.
3. Classes that share a hub but not a component are compared with each other in blocks: all that are not
   of the hub's largest component against all of the hub's classes. After that every pair within T has
   been compared or is connected already; pairs are neither capped nor written out.

A hub of any size is dealt out in blocks of BLOCK classes. Texts are read twice: for the signatures, and
for the sets of the classes that share a key with another.

Rows: null and empty texts have the empty set and are linked with nothing; a text of fewer words than a
shingle is one shingle. Repeated rows and equal ids are rows of their own, of which one is kept; null ids
sort last. An empty table gives an empty result. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.shared import components, small, stash
from runlake.llm.words import LOWER, gather, hashes, mix, slices, spans

SYMBOLS = 64
#: A pair at the wanted similarity exceeds the distance threshold with at most this probability.
MISS = 1e-4
#: Classes of a hub that are compared at once.
BLOCK = 512
_RNG = np.random.default_rng(8191)
_TIMES, _PLUS = _RNG.integers(0, 2**32, SYMBOLS, dtype=np.uint32) | np.uint32(1), _RNG.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
_PLACE = _RNG.integers(1, 2**63, SYMBOLS, dtype=np.uint64)


def threshold(percent: int) -> int:
    """The least T with P(more than T of SYMBOLS symbols differ) <= MISS at a similarity of ``percent`` / 100."""
    q, tail, t = 1 - percent / 100, 1.0, -1
    while tail > MISS and t < SYMBOLS:
        t += 1
        tail -= comb(SYMBOLS, t) * q**t * (1 - q) ** (SYMBOLS - t)
    return t


def chunk_bounds(percent: int) -> np.ndarray:
    """Bounds of the fewest chunks of which, with T errors in all, one has at most one."""
    return np.linspace(0, SYMBOLS, (threshold(percent) + 1 + 1) // 2 + 1).astype(int)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and their bounds by row."""
    data = LOWER[data]
    starts, ends, bounds = spans(data, offsets)
    count = np.diff(bounds)
    own = np.maximum(count - words + 1, np.minimum(count, 1))  # shingles, repeats counted
    row = np.repeat(np.arange(len(count)), own)
    first = gather(bounds[:-1], own)
    one = hashes(data, starts, ends)
    total, length = np.zeros(len(first), np.uint64), np.minimum(count, words)[row]
    for j in range(words):
        there = j < length
        total[there] = (total[there] + one[first[there] + j]) * np.uint64(0x9E3779B97F4A7C15)
    total = mix(total + length.astype(np.uint64))
    order = np.lexsort((total, row))
    total, row = total[order], row[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (row[1:] != row[:-1])
    return total[new], np.searchsorted(row[new], np.arange(len(count) + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of SYMBOLS 16-bit symbols; of empty sets 0."""
    out = np.zeros((len(bounds) - 1, SYMBOLS), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        short = (sets >> np.uint64(32)).astype(np.uint32)
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(short * _TIMES[k] + _PLUS[k], bounds[:-1][full])
            out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def set_hashes(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, as signed numbers."""
    out = []
    for salt in (np.uint64(0x51ED270B), np.uint64(0xB492B66F)):
        total = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(mix(sets ^ salt), out=total[1:])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def keys(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each signature its keys: each chunk with each one of its symbols left out."""
    own = mix(symbols.astype(np.uint64) + _PLACE)
    out = np.empty(symbols.shape, np.uint64)
    for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        part = own[:, a:b]
        out[:, a:b] = mix(part.sum(1, keepdims=True, dtype=np.uint64) - part + _PLACE[a:b] * np.uint64(2 * c + 1))
    return out.view(np.int64)


def _binary(rows: Iterator[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def _signed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n, h1, h2, sig of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column(1)):
                sets, bounds = shingles(data, offsets, words)
                h1, h2 = set_hashes(sets, bounds)
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(np.diff(bounds), pa.int64()), pa.array(h1), pa.array(h2), _binary(signatures(sets, bounds))], ["id", "n", "h1", "h2", "sig"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(sign, f"id {kind}, n long, h1 long, h2 long, sig binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """h1, h2, shingles (binary, 64 bits each) of every row of docs (text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                sets, bounds = shingles(data, offsets, words)
                h1, h2 = set_hashes(sets, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), _binary(sets[a:b] for a, b in zip(bounds[:-1], bounds[1:]))], ["h1", "h2", "shingles"])

    return docs.mapInArrow(make, "h1 long, h2 long, shingles binary")


def _keyed(classes: DataFrame, percent: int) -> DataFrame:
    """key, cls: every key of every class."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = chunk_bounds(percent)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys(symbols, cuts).ravel()), pa.array(np.repeat(own, SYMBOLS))], ["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(spread, "key long, cls long")


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: verified links of blocks of rows (part, query, cls, comp, sig, shingles), one for each two components.

    Within a part, queries are compared with the rows that aren't, and with each other.
    """
    limit = threshold(percent)

    def compare(q: list, o: list) -> Iterator[tuple[int, int]]:
        rows = q + o
        if not q or len(rows) < 2:
            return
        cls, comp = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        sig = np.array([np.frombuffer(r[2], np.uint16) for r in rows])
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        size, done = np.array(list(map(len, sets))), set()
        for i in range(len(q)):
            other = np.flatnonzero((comp != comp[i]) & ((np.arange(len(rows)) > i) | (np.arange(len(rows)) >= len(q))))
            other = other[(sig[other] != sig[i]).sum(1) <= limit]
            other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
            if not len(other):
                continue
            flat = np.concatenate([sets[j] for j in other])
            at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
            ends = np.cumsum(size[other])
            hits = np.concatenate([[0], np.cumsum(sets[i][at] == flat)])
            both = hits[ends] - hits[ends - size[other]]
            for j in other[100 * both >= percent * (size[i] + size[other] - both)]:
                if (pair := (min(comp[i], comp[j]), max(comp[i], comp[j]))) not in done:
                    done.add(pair)
                    yield int(cls[i]), int(cls[j])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, q, o, found = None, [], [], []
        for batch in batches:
            for own, query, *row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if own != part:
                    found += compare(q, o)
                    part, q, o = own, [], []
                (q if query else o).append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
            found = []
        found += compare(q, o)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    part = F.concat_ws(" ", *[F.col(k).cast("string") for k in ("hub", "i", "j")])
    dealt = rows.select(part.alias("part"), "query", "cls", "comp", "sig", "shingles").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(blocks, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links), kept (one row of a component).

    Rows are linked if 100 * shared shingles >= percent * shingles of either.
    """
    rows = stash(_signed(docs, id_col, text_col, words).withColumn("row", F.monotonically_increasing_id()), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = rows.where("n > 0").groupBy("h1", "h2").agg(first.alias("first"), F.min("sig").alias("sig"))
    classes = stash(classes.withColumn("cls", F.col("first.row")), "classes")
    keyed = _keyed(classes, percent)
    hubs = keyed.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("last")).where("hub < last").select("key", "hub")
    met = stash(_keyed(classes, percent).join(hubs, "key").select("hub", "cls").distinct(), "met")

    need = stash(met.select("cls").distinct().join(classes, "cls").select("cls", "h1", "h2", "sig", F.col("first.id").alias("own")), "need")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(small(stash(need.select("own").distinct(), "owners")), F.col("id").eqNullSafe(F.col("own")), "left_semi").select("text")
    sets = _sets(texts, words).dropDuplicates(["h1", "h2"])
    sets = stash(need.join(sets, ["h1", "h2"]).select("cls", "sig", "shingles"), "sets")

    block = lambda n: F.pmod(F.xxhash64("cls"), F.ceil(n / F.lit(BLOCK))).cast("int")
    sizes = stash(met.groupBy("hub").agg(F.count("*").alias("n")), "sizes")
    dealt = met.join(sizes, "hub")
    stars = dealt.where("cls <> hub").select("hub", block(F.col("n")).alias("i"), F.lit(False).alias("query"), "cls")
    centres = sizes.select("hub", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / BLOCK) - 1).cast("int"))).alias("i"), F.lit(True).alias("query"), F.col("hub").alias("cls"))
    stars = stars.unionByName(centres).withColumns({"j": F.lit(0), "comp": F.col("cls")}).join(sets, "cls")
    edges = stash(_links(stars, percent), "stars")

    comps = stash(components(edges), "components")
    own = stash(met.join(comps, F.col("cls") == F.col("node"), "left").select("hub", "cls", F.coalesce("component", "cls").alias("comp")), "own")
    counts = own.groupBy("hub", "comp").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("hub").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most")).where("most.n < n")
    mixed = stash(mixed.select("hub", "n", (F.col("n") - F.col("most.n")).alias("m"), F.col("most.comp").alias("major")), "mixed")
    rows_of = own.join(mixed, "hub").withColumns({"b": block(F.col("n")), "a": block(F.col("m"))})
    spread = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / BLOCK) - 1).cast("int")))
    queries = rows_of.where("comp <> major").select("hub", F.col("a").alias("i"), spread("n").alias("j"), F.lit(True).alias("query"), "cls", "comp")
    others = rows_of.select("hub", spread("m").alias("i"), F.col("b").alias("j"), F.lit(False).alias("query"), "cls", "comp")
    cross = _links(queries.unionByName(others).join(sets, "cls"), percent)
    comps = stash(components(edges.unionByName(cross)), "components")

    joined = classes.join(comps, F.col("cls") == F.col("node"), "left").select("h1", "h2", "first", F.coalesce("component", "cls").alias("comp"))
    joined = stash(joined, "joined")
    least = stash(joined.groupBy("comp").agg(F.min("first").alias("least")), "least")
    joined = stash(joined.join(least, "comp").select("h1", "h2", "least"), "least-of")
    full = rows.where("n > 0").select("id", "n", "h1", "h2", "row").join(joined, ["h1", "h2"])
    full = full.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("kept"))
    empty = rows.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return full.unionByName(empty)
