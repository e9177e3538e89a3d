"""Near-duplicate vectors by a robust-pruned flat graph.

Two vectors of one label are linked if their cosine, in double precision, reaches a threshold.

1. Equal vectors form a class. The classes of a label are dealt to the cells of k-means centroids (fitted
   on a bounded sample), again and again until a shard has at most about SHARD of its own. A class has one
   home shard and is a guest in those whose boundary is within a margin of it: shards overlap.
2. Each shard builds a graph of its own members by robust pruning (alpha), in both directions.
3. Each member searches its home shard greedily, from the shard's medoids and its own place, and keeps
   expanding whatever lies within the range; guests search from the medoids. A link found counts for both
   its ends; where each end is a guest of the other's shard, both search. Each is verified by its cosine.
4. Recall is audited: AUDIT queries (smallest hash) are compared with all rows exactly. Its mean over the
   queries that have links, a class counting once whatever its copies, must reach RECALL, and so must the
   mean over those of at most SPARSE linked classes. Below that the margin doubles, up to the one at which
   no pair can be lost between shards; then each group compares all its pairs instead of searching.

A shard that cannot be split (one dense ball) is cut into blocks of its own members by hash, and all its
members search each block. Guests are dealt to a shard's graph in blocks of about SHARD: a group holds one
graph and one block, however many guests a shard has. Links are united within a group and leave it as
edges to one root each, never as all pairs. The driver sees counts and audited sums only; centroids come as one row a shard.

Rows: null labels, and vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths are not compared. Repeated rows and equal ids are rows of their own,
of which one is kept; null ids sort last. An empty table gives an empty result. Further columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.shared import bounded_sample, components, small, stash

#: Wanted members of a shard; centroids of one split at most; vectors a split is fitted on; levels of splits.
SHARD, SPLIT, SAMPLE, LEVELS = 1000, 64, 4096, 6
#: Edges of a member from one shard; how much longer a detour may be; candidates of a pruning.
DEGREE, ALPHA, POOL = 24, 1.2, 200
#: Width of the greedy search; entries of a shard; how far below the range it still expands.
BEAM, MEDOIDS, SLACK = 32, 8, 0.05
#: Exact queries; share of their links that must be found; first margin as a share of the exact one.
AUDIT, RECALL, MARGIN = 512, 0.9, 0.4
#: Linked classes of a query that lies in no dense ball.
SPARSE = 32


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means centroids from evenly spread rows; of the means that keep a member."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        c = np.array([x[own == i].mean(0) for i in np.unique(own)])
    return c


def cells(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every cell whose boundary to a row's nearest cell is within ``margin`` of it, and the nearest."""
    far = (c * c).sum(1) - 2 * x @ c.T
    near = far.argmin(1)
    between = np.sqrt(np.maximum(((c[near][:, None] - c) ** 2).sum(2), 1e-30))
    inside = (far - far[np.arange(len(x)), near][:, None]) / (2 * between) <= margin
    inside[np.arange(len(x)), near] = True
    row, cell = np.nonzero(inside)
    return row, cell


def prune(gram: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row, both directions; gram holds the cosines of unit vectors."""
    n = len(gram)
    edges: list[set] = [set() for _ in range(n)]
    for i in range(n):
        near = np.argpartition(-gram[i], min(POOL, n - 1))[: POOL + 1]
        near = near[np.argsort(-gram[i, near], kind="stable")]
        near = near[near != i]
        kept = 0
        while len(near) and kept < DEGREE:
            p = int(near[0])
            edges[i].add(p)
            edges[p].add(i)
            kept += 1
            near = near[1:]
            near = near[ALPHA**2 * (1 - gram[p, near]) > 1 - gram[i, near]]
    return [np.array(sorted(x), np.int64) for x in edges]


def entries(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Medoids of a few clusters, and one member of every part of the graph that they don't reach."""
    c = centres(x, min(MEDOIDS, len(x)), 3)
    found = list(dict.fromkeys((x @ c.T - (c * c).sum(1) / 2).argmax(0).tolist()))
    seen = np.zeros(len(x), bool)
    at = 0
    while at < len(found):
        front = np.array([found[at]])
        while len(front):
            seen[front] = True
            front = np.unique(np.concatenate([edges[i] for i in front]))
            front = front[~seen[front]]
        at += 1
        if at == len(found) and not seen.all():
            found.append(int(np.flatnonzero(~seen)[0]))
    return np.array(found)


def search(x: np.ndarray, edges: list[np.ndarray], starts: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Members whose cosine with ``q`` reaches ``least``, as a range-expanding greedy search finds them."""
    seen, seen_any = np.unique(starts), np.zeros(len(x), bool)
    seen_any[seen] = True
    cosine = x[seen] @ q
    open_ = np.ones(len(seen), bool)
    while True:
        bar = np.partition(cosine, -BEAM)[-BEAM] if len(cosine) > BEAM else -2.0
        front = np.flatnonzero(open_ & (cosine >= min(bar, least - SLACK)))
        if not len(front):
            return seen[cosine >= least]
        open_[front] = False
        new = np.unique(np.concatenate([edges[j] for j in seen[front]]))
        new = new[~seen_any[new]]
        seen_any[new] = True
        seen, cosine, open_ = np.append(seen, new), np.append(cosine, x[new] @ q), np.append(open_, np.ones(len(new), bool))


def unite(root: np.ndarray, at: np.ndarray) -> None:
    """Gives the members ``at`` and all that have their roots one root, the least."""
    own = np.unique(root[at])
    if len(own) > 1:
        root[np.isin(root, own)] = own[0]


def _matrix(column) -> np.ndarray:
    return np.array([np.frombuffer(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _split(members: DataFrame, margin: float) -> DataFrame:
    """(shard, cls, home, vec): members dealt to overlapping cells until shards have about SHARD of their own; guests without vec."""
    done = None
    for _ in range(LEVELS):
        sizes = stash(members.where("home").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 1.5 * SHARD), "large")
        if not sizes.limit(1).count():
            break
        joined = members.join(small(sizes), "shard", "left")
        settled = joined.where("n is null").drop("n")
        done = settled if done is None else done.unionByName(settled)
        large = stash(joined.where("n is not null"), "oversized")

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("cls")
            x = _matrix(rows["vec"])
            c = centres(x, min(SPLIT, len(x), int(np.ceil(rows["n"].iloc[0] / SHARD))))
            return pd.DataFrame({"at": [rows["shard"].iloc[0]], "centres": [c.tobytes()]})

        sample = large.where("home").where(F.pmod(F.xxhash64("cls"), F.col("n")) < SAMPLE).select("shard", "cls", "vec", "n")
        means = stash(sample.groupBy("shard").applyInPandas(fit, "at string, centres binary"), "centres")

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pandas()
                for _, own in rows.groupby("shard", sort=False):
                    x = _matrix(own["vec"])
                    c = np.frombuffer(own["centres"].iloc[0], np.float64).reshape(-1, x.shape[1])
                    row, cell = cells(x, c, margin)
                    near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
                    for a in range(0, len(row), 10_000):  # a row can be a guest of every cell
                        out, to = own.iloc[row[a : a + 10_000]], cell[a : a + 10_000]
                        home = out["home"].to_numpy() & (near[row[a : a + 10_000]] == to)
                        yield pa.RecordBatch.from_arrays([pa.array(out["shard"] + "/" + to.astype(str), pa.string()), pa.array(out["cls"], pa.int64()), pa.array(home), pa.array(out["vec"], pa.binary())], ["shard", "cls", "home", "vec"])

        members = stash(large.drop("n").join(small(means, 2000), F.col("shard") == F.col("at")).select("shard", "cls", "home", "vec", "centres").mapInArrow(deal, "shard string, cls long, home boolean, vec binary"), "cells")
    members = members if done is None else done.unionByName(members)
    # what no centroid could split: blocks of its own members, each with all members as guests
    sizes = stash(members.where("home").groupBy("shard").agg(F.ceil(F.count("*") / (1.5 * SHARD)).cast("int").alias("blocks")), "blocks")
    spread = members.join(small(sizes), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    home = F.col("home") & (F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")) == F.col("block"))
    return stash(spread.select(F.concat_ws("#", "shard", F.col("block").cast("string")).alias("shard"), "cls", home.alias("home"), F.when(home, F.col("vec")).alias("vec")), "shards")


def _linked(members: DataFrame, copies: DataFrame, least: float, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cls, n, m) rows that add up to a class's links and linked classes, and (a, b) edges that connect what is linked.

    ``whole`` compares all pairs of a group instead of searching its graph.
    """
    guests = members.where("not home").select("shard", "cls")
    also = guests.groupBy("cls").agg(F.collect_list(F.xxhash64("shard")).alias("also"))  # shards a class is a guest of
    own = members.where("home").select("shard", "cls", "vec").join(copies, "cls").join(also, "cls", "left")
    own = stash(own.withColumn("base", F.xxhash64("shard")), "own")
    blocks = stash(guests.groupBy("shard").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("blocks")), "guest-blocks")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cls")
        x = _matrix(rows["vec"])
        edges = prune(x @ x.T)
        also = [np.zeros(0, np.int64) if v is None else np.asarray(v, np.int64) for v in rows["also"]]
        packed = {"also": np.concatenate(also), "upto": np.cumsum([len(v) for v in also]), "cls": rows["cls"].to_numpy(np.int64), "copies": rows["copies"].to_numpy(np.int64), "vecs": x, "edges": np.concatenate(edges), "ends": np.cumsum([len(e) for e in edges]), "starts": entries(x, edges)}
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], **{k: [v.tobytes()] for k, v in packed.items()}})

    graphs = own.groupBy("shard").applyInPandas(build, "shard string, also binary, upto binary, cls binary, copies binary, vecs binary, edges binary, ends binary, starts binary")  # of home members: bounded
    graphs = stash(graphs, "graphs").join(small(blocks), "shard", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(0)))))
    asked = guests.join(small(blocks), "shard").select("shard", (F.pmod(F.xxhash64("cls", F.lit(5)), F.col("blocks")) + 1).cast("int").alias("block"), "cls")
    asked = asked.join(own.select("cls", "vec", "copies", "base"), "cls")

    def find(rows: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(graph):  # a cell without members of its own
            return pd.DataFrame({"cls": [], "n": [], "m": [], "root": []}, dtype=np.int64)
        graph = graph.iloc[0]
        cls, many, flat, ends, starts, also, upto = (np.frombuffer(graph[k], np.int64) for k in ("cls", "copies", "edges", "ends", "starts", "also", "upto"))
        x, edges, root = np.frombuffer(graph["vecs"], np.float64).reshape(len(cls), -1), np.split(flat, ends[:-1]), np.arange(len(cls))

        def near(starts: np.ndarray, q: np.ndarray) -> np.ndarray:
            return np.flatnonzero(x @ q >= least) if whole else search(x, edges, starts, q, least)

        if graph["block"] == 0:  # the shard's own members
            hit = np.zeros((len(cls), len(cls)), bool)
            for i in range(len(cls)):
                hit[i, near(np.append(starts, i), x[i])] = True
            hit |= hit.T
            np.fill_diagonal(hit, False)
            for i in range(len(cls)):
                unite(root, np.append(np.flatnonzero(hit[i]), i))
            return pd.DataFrame({"cls": cls, "n": hit @ many, "m": hit.sum(1), "root": cls[root]})
        ids, copies, base = (rows[k].to_numpy(np.int64) for k in ("cls", "copies", "base"))
        n, m, first = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), -1)
        back, backs = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
        at = np.repeat(np.arange(len(cls)), np.diff(upto, prepend=0))
        visits = {b: np.isin(np.arange(len(cls)), at[also == b]) for b in np.unique(base)}  # members that search b's shard themselves
        for i, q in enumerate(rows["vec"]):
            found = near(starts, np.frombuffer(q, np.float64))
            if len(found):
                n[i], m[i], first[i] = many[found].sum(), len(found), found[0]
                unite(root, found)
                one_way = found[~visits[base[i]][found]]
                back[one_way] += copies[i]
                backs[one_way] += 1
        told = (root != np.arange(len(cls))) | (backs > 0)
        tops = np.where(first < 0, ids, cls[root[first]])
        return pd.DataFrame({"cls": np.append(ids, cls[told]), "n": np.append(n, back[told]), "m": np.append(m, backs[told]), "root": np.append(tops, cls[root[told]])})

    pairs = asked.groupBy("shard", "block").cogroup(graphs.groupBy("shard", "block"))
    found = stash(pairs.applyInPandas(find, "cls long, n long, m long, root long"), "found")
    return found.select("cls", "n", "m"), found.where("root <> cls").select(F.col("cls").alias("a"), F.col("root").alias("b"))


def exact_links(classes: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(cls, n, m): exact numbers of links and of linked classes of ``queries`` (few classes, broadcast) to all of ``classes``, in blocks."""
    asked = [(r["cls"], r["kind"], bytes(r["vec"])) for r in queries.select("cls", "kind", "vec").collect()]  # AUDIT at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_kind: dict[str, list] = {}
        for cls, kind, vec in asked:
            by_kind.setdefault(kind, []).append((cls, np.frombuffer(vec, np.float64)))
        for batch in batches:
            rows = batch.to_pandas()
            for kind, own in rows.groupby("kind", sort=False):
                if kind in by_kind:
                    cls = np.array([c for c, _ in by_kind[kind]])
                    hit = np.array([v for _, v in by_kind[kind]]) @ _matrix(own["vec"]).T >= least
                    hit &= cls[:, None] != own["cls"].to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(hit @ own["copies"].to_numpy(), pa.int64()), pa.array(hit.sum(1), pa.int64())], ["cls", "n", "m"])

    return classes.select("kind", "cls", "vec", "copies").mapInArrow(count, "cls long, n long, m long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def recalled(exact: dict[int, int], found: dict[int, int]) -> bool:
    """Whether the mean recall of the queries that have links reaches RECALL, and that of those with few."""
    shares = {q: min(1.0, found.get(q, 0) / m) for q, m in exact.items() if m}
    sparse = [s for q, s in shares.items() if exact[q] <= SPARSE]
    return all(np.mean(x) >= RECALL for x in (list(shares.values()), sparse) if x)


def near_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id (smallest id reachable by links), kept (one row of a component)."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & whole, F.lit(False)))
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.when(F.col("ok"), F.sha2(F.to_json(F.struct("label", "v")), 256))), "vectors")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    classes = rows.where("ok").groupBy("h").agg(first, F.count("*").alias("copies"))
    classes = classes.withColumn("cls", F.col("first.row")).join(rows.select("row", "label", "v"), F.col("cls") == F.col("row")).drop("row")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                x = np.array(x, np.float64)
                x = x / np.abs(x).max()  # neither over- nor underflows
                out.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["cls", "vec"])

    kind = F.concat_ws("|", F.size("v").cast("string"), "label").alias("kind")
    unit_of = classes.select("cls", "v").mapInArrow(unit, "cls long, vec binary")
    classes = stash(classes.select("h", "cls", "first", "copies", kind).join(unit_of, "cls"), "units")

    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    audit = stash(bounded_sample(classes, ["cls"], AUDIT), "audit")
    exact = {r["cls"]: r["m"] for r in exact_links(classes, audit, least).collect()}
    share, whole = MARGIN, False
    while True:
        members = _split(classes.select(F.col("kind").alias("shard"), "cls", F.lit(True).alias("home"), "vec"), share * reach + 1e-9)
        counts, edges = _linked(members, classes.select("cls", "copies"), least, whole)
        counts = stash(counts.groupBy("cls").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "counts")
        found = {r["cls"]: r["m"] for r in counts.join(F.broadcast(audit.select("cls")), "cls").select("cls", "m").collect()}  # AUDIT at most
        if whole or recalled(exact, found):
            break
        share, whole = min(1.0, share * 2), share >= 1

    joined = classes.select("h", "cls", "first", "copies").join(counts.select("cls", "n"), "cls").join(components(edges), F.col("cls") == F.col("node"), "left")
    joined = stash(joined.select("h", "first", (F.col("n") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("comp")), "joined")
    leasts = stash(joined.groupBy("comp").agg(F.min("first").alias("least")), "least")
    joined = stash(joined.join(leasts, "comp").select("h", "n_links", "least"), "least-of")
    linked = rows.where("ok").select("id", "h", "row").join(joined, "h").select(F.col("id").alias(id_col), "n_links", F.col("least.id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("kept"))
    alone = rows.where("not ok").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
