"""Packing documents into sequences of a fixed number of tokens, by linear grouping.

Documents longer than a sequence are cut into full pieces and a last one. What the packing needs to know
of the corpus is how many pieces there are of each length, at most one row a token of the capacity; on
that histogram the plan is made:

1. pieces above an eighth of the capacity are sorted and dealt into groups of equal cardinality, and
   each group's lengths are rounded up to its longest;
2. for these few sizes the configurations (what fills one sequence) are optimised by column generation:
   a linear program whose new columns are knapsacks, rounded down to whole sequences;
3. actual lengths take the places of the rounded ones, which leaves gaps;
4. what rounding left over and all smaller pieces go by best fit, longest first, into the gaps.

A plan counts alike sequences once, so its size does not grow with the corpus. The pieces, ranked by
length over the whole corpus (prefix sums, no group in one task), look up their place by rank.

Rows: null or empty text is its end id alone, one piece. Null ids and repeated rows are documents of
their own. An empty table gives an empty result. Further columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.shared import stash, with_prefix
from runlake.llm.tokens import TOKENIZER, crc32, encoded

#: Groups of large lengths, and the share of the capacity above which a length is large.
GROUPS, LARGE = 24, 1 / 8


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Whole sequences for few sizes: (pieces of each size, sequences), at most ``counts`` in all, near the LP optimum."""
    k, size = len(sizes), np.array(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    cost, x = np.ones(k), np.array(counts, float) / np.diag(basis)
    for _ in range(200 * k):
        dual = np.linalg.solve(basis.T, cost)
        if dual.min() < -1e-9:  # more of a size than is asked for
            column, price = -np.eye(k)[int(dual.argmin())], 0.0
        else:  # the most valuable sequence: a knapsack over the capacity
            best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
            for c in range(int(size.min()), capacity + 1):
                fit = np.where(size <= c, best[np.maximum(c - size, 0)] + dual, -1.0)
                j = int(fit.argmax())
                if fit[j] > best[c - 1] + 1e-12:
                    best[c], pick[c] = fit[j], j
                else:
                    best[c] = best[c - 1]
            if best[capacity] <= 1 + 1e-7:
                break
            column, price, c = np.zeros(k), 1.0, capacity
            while c > 0:
                if pick[c] < 0:
                    c -= 1
                else:
                    column[pick[c]] += 1
                    c -= int(size[pick[c]])
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out], cost[out] = column, price
    return [(basis[:, i].astype(int).tolist(), int(x[i] + 1e-6)) for i in range(k) if cost[i] and int(x[i] + 1e-6)]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequences for all pieces of a histogram (length: count): ([(length, times), ...], alike sequences)."""
    done: list[tuple[list[tuple[int, int]], int]] = []
    left = {n: c for n, c in histogram.items() if c and n < capacity}
    if histogram.get(capacity):
        done.append(([(capacity, 1)], histogram[capacity]))
    open_bins: dict[int, list[list]] = defaultdict(list)  # by room left: [[(length, times), ...], sequences]
    large = sorted((n for n in left if n > capacity * LARGE), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        # 1: runs (length, count) of each group, longest first
        groups, room = [[]], -(-total // GROUPS)
        for n in large:
            c = left.pop(n)
            while c:
                used = sum(x for _, x in groups[-1])
                if used == room:
                    groups.append([])
                    used = 0
                take = min(c, room - used)
                groups[-1].append((n, take))
                c -= take
        # 2
        rounded = [g[0][0] for g in groups]
        for config, times in configurations(rounded, [sum(x for _, x in g) for g in groups], capacity):
            # 3: each place of the configuration takes the next pieces of its group, in runs of alike ones
            places: list[list[tuple[int, int]]] = []
            for g, many in enumerate(config):
                for _ in range(many):
                    need, runs = times, []
                    while need and groups[g]:
                        n, c = groups[g].pop(0)
                        take = min(c, need)
                        runs.append((n, take))
                        need -= take
                        if c > take:
                            groups[g].insert(0, (n, c - take))
                    places.append(runs + [(0, need)] * bool(need))
            cuts = sorted({0, *(int(x) for runs in places for x in np.cumsum([c for _, c in runs]))})
            for a, b in zip(cuts, cuts[1:]):
                row = defaultdict(int)
                for runs in places:
                    at = 0
                    for n, c in runs:
                        if at <= a < at + c and n:
                            row[n] += 1
                        at += c
                if row:
                    open_bins[capacity - sum(n * c for n, c in row.items())].append([sorted(row.items(), reverse=True), b - a])
        for g in groups:
            for n, c in g:
                left[n] = left.get(n, 0) + c
    # 4
    rooms = np.zeros(capacity + 1, bool)
    rooms[[r for r, x in open_bins.items() if x]] = True

    def put(bins: list, room: int) -> None:
        open_bins[room].append(bins)
        rooms[room] = True

    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            found = np.flatnonzero(rooms[n:])
            if not len(found):
                each = capacity // n
                if c >= each:
                    put([[(n, each)], c // each], capacity - n * each)
                if c % each:
                    put([[(n, c % each)], 1], capacity - n * (c % each))
                break
            room = n + int(found[0])
            rows, many = open_bins[room].pop()
            rooms[room] = bool(open_bins[room])
            each = room // n
            full = min(many, c // each)
            if full:
                put([rows + [(n, each)], full], room - n * each)
                c -= full * each
                many -= full
            if many and c:
                put([rows + [(n, c)], 1], room - n * c)
                many, c = many - 1, 0
            if many:
                put([rows, many], room)
    return done + [(rows, many) for x in open_bins.values() for rows, many in x]


def pieces(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, bounds, ids in encoded(batch.column(1), path):
                rows = [(names[at + i], p, s - a, min(capacity, b - s), crc32(ids[s : min(s + capacity, b)])) for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) for p, s in enumerate(range(a, b, capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """Every piece with its sequence_id and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stash(pieces(docs, capacity, id_col, text_col, path), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    rank, at = {}, 0
    for n in sorted(histogram):
        rank[n] = at
        at += histogram[n]
    slots, sequence = [], 0
    for rows, many in plan(histogram, capacity):
        offset = 0
        for n, times in rows:
            slots.append((n, rank[n], rank[n] + times * many, times, sequence, offset))
            rank[n] += times * many
            offset += n * times
        sequence += many
    slots = F.broadcast(spark.createDataFrame(slots, "n long, first long, last long, times long, sequence long, place long"))  # bounded by the capacity, whatever the corpus
    ranked = with_prefix(cut, ["length", "doc_id", "piece", "ids_crc32"], {"rank": F.lit(1)})
    found = ranked.join(slots, (F.col("length") == F.col("n")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    nth = F.col("rank") - F.col("first")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(nth / F.col("times"))).alias("sequence_id"), (F.col("place") + nth % F.col("times") * F.col("length")).alias("offset"))
