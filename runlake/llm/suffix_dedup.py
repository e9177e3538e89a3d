"""Passages that repeat across documents, by sparse suffixes compared by hash.

A suffix is kept where its first GRAM words have the least hash of WINDOW neighbouring places: the
places depend on the content alone, so equal passages keep equal suffixes. A passage of ``words`` words
holds a kept suffix in its first WINDOW places, so that it shares at least ``words - WINDOW + 1`` words
of that suffix, its head. No suffix is sorted: heads are grouped by a hash, and suffixes stay whose head
occurs in another class of equal documents. A second pass hashes every window of ``words`` words whose
own least place has such a head; a window repeats if it occurs in another document. What repeated windows
cover, joined where they touch, are a document's passages. Comparing neighbours in a sorted sparse array
would not do: a window reaches to both sides of its kept suffix, and the neighbour with the longest
match to the right need not be the document that also agrees to the left.

Documents of equal words are one class, extended once; in a class of more than one, all its words repeat.
Equality is of 64-bit hashes of words (ASCII lower-cased) and their order, pairs of them for windows.
Heads and windows are counted by partial aggregates, however often one occurs; no group is collected.

Rows: null and empty texts, and texts of fewer than ``words`` words, have no passages. Repeated rows and
equal ids are documents of their own, told apart by row. An empty table gives an empty result. Further
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlake.llm.shared import numbered, small, stash
from runlake.llm.words import LOWER, hashes, mix, powers, slices, spans

GRAM, WINDOW = 8, 26


def sums(own: np.ndarray) -> np.ndarray:
    """Running polynomial sums of word hashes, from 0."""
    up, _ = powers(len(own) + 1)
    out = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(own * up[: len(own)], out=out[1:])
    return out


def runs(total: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each start on."""
    _, down = powers(len(total))
    return mix((total[starts + n] - total[starts]) * down[starts])


def leftmost(grams: np.ndarray, window: int) -> np.ndarray:
    """For each ``window`` neighbouring places, the place of the least value, the leftmost of equal ones."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.arange(len(view)) + view.argmin(1)


def whole_hashes(own: np.ndarray, total: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of all words of a text."""
    return int(runs(total, np.zeros(1, int), len(own)).view(np.int64)[0]), int(mix(own ^ np.arange(len(own), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64))


def documents_of(batch_text: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, word hashes, running sums, starts and ends in bytes) of every text of ``words`` words or more."""
    for at, data, offsets in slices(batch_text):
        starts, ends, bounds = spans(data, offsets)
        own = hashes(LOWER[data], starts, ends)
        for i in np.flatnonzero(np.diff(bounds) >= words).tolist():
            a, b = bounds[i], bounds[i + 1]
            yield at + i, own[a:b], sums(own[a:b]), starts[a:b] - offsets[i], ends[a:b] - offsets[i]


def repeated_passages(docs: DataFrame, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a passage: id, start_word, n_words, start_byte, n_bytes; whole texts, passages in order, none overlapping.

    Every run of ``words`` words that occurs in two rows lies in a passage of each, and a passage is
    covered by such runs.
    """
    head = words - WINDOW + 1
    if head < GRAM:
        raise ValueError(f"passages need at least {GRAM + WINDOW - 1} words")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    texts = texts.select("id", "text", F.col("_runlake_row.file").alias("file"), F.col("_runlake_row.row").alias("line"))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, own, total, starts, ends in documents_of(batch.column(1), words):
                places = np.unique(leftmost(runs(total, np.arange(len(own) - GRAM + 1), GRAM), WINDOW))
                places = places[places + head <= len(own)]
                found.append((i, len(own), *whole_hashes(own, total), int(starts[0]), int(ends[-1]), runs(total, places, head).view(np.int64), places.astype(np.int32)))
            at = pa.array([x[0] for x in found], pa.int64())
            ids, file, line = (batch.column(k).take(at) for k in (0, 2, 3))
            arrays = [pa.array([x[k] for x in found], pa.int64()) for k in range(1, 6)]
            lists = [pa.array([x[6] for x in found], pa.list_(pa.int64())), pa.array([x[7] for x in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([ids, file, line, *arrays, *lists], ["id", "file", "line", "n", "h1", "h2", "first", "last", "heads", "places"])

    rows = texts.mapInArrow(outline, f"id {kind}, file long, line long, n long, h1 long, h2 long, first long, last long, heads array<long>, places array<int>")
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "outlines")
    classes = stash(rows.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("row").alias("cls")), "classes")
    reps = stash(rows.join(classes.select("cls"), F.col("row") == F.col("cls")).select("cls", "file", "line", "h1", "h2", "heads", "places"), "suffixes")
    # heads that two classes have
    heads = reps.select("cls", F.explode("heads").alias("head")).groupBy("head").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b").select("head")
    each = reps.select("cls", F.explode(F.arrays_zip("heads", "places")).alias("s")).select("cls", F.col("s.heads").alias("head"), F.col("s.places").alias("place"))
    near = each.join(small(stash(heads, "heads")), "head", "left_semi").groupBy("cls").agg(F.collect_list("place").alias("shared"))  # of one document
    near = stash(near.join(reps.select("cls", "file", "line", "h1", "h2"), "cls"), "near")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["w1", "w2", "cls", "at", "first", "last"]
        for batch in batches:
            for i, own, total, starts, ends in documents_of(batch.column(0), words):
                cls, h1, h2, shared = (batch.column(k)[i].as_py() for k in range(1, 5))
                if (h1, h2) != whole_hashes(own, total):
                    continue  # another text made from the same row of a file
                kept = np.zeros(len(own), bool)
                kept[shared] = True
                least = leftmost(runs(total, np.arange(len(own) - GRAM + 1), GRAM), WINDOW)
                at = np.flatnonzero(kept[least[: len(own) - words + 1]])
                half = words // 2
                w1, w2 = runs(total, at, words), mix(runs(total, at, half) * np.uint64(3) + runs(total, at + half, words - half))
                yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(np.full(len(at), cls)), pa.array(at), pa.array(starts[at]), pa.array(ends[at + words - 1])], names)

    # by file and place in it, not by id: each class meets its one text, however many ids are null or equal
    some = texts.join(small(stash(near.select("file", "line").distinct(), "owners")), ["file", "line"], "left_semi")
    some = some.join(near, ["file", "line"]).select("text", "cls", "h1", "h2", "shared")
    found = stash(some.mapInArrow(windows, "w1 long, w2 long, cls long, at long, first long, last long"), "windows")
    twice = found.groupBy("w1", "w2").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b").select("w1", "w2")
    twice = small(stash(twice, "repeated"))  # read from a table, so that the join splits a window that very many documents share
    matched = found.join(twice, ["w1", "w2"], "left_semi").select("cls", "at", "first", "last")

    order = Window.partitionBy("cls").orderBy("at")  # one document each
    opens = F.col("at") > F.coalesce(F.lag("at").over(order), F.lit(-2 * words)) + words
    island = matched.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    passages = island.groupBy("cls", "island").agg(F.min("at").alias("start_word"), (F.max("at") + words - F.min("at")).alias("n_words"), F.min("first").alias("start_byte"), (F.max("last") - F.min("first")).alias("n_bytes"))

    alone = classes.where("copies = 1").join(rows.select("id", "row"), F.col("row") == F.col("cls")).select(F.col("id").alias(id_col), "cls")
    partly = passages.join(alone, "cls").select(id_col, "start_word", "n_words", "start_byte", "n_bytes")
    copied = rows.join(classes.where("copies > 1").select("h1", "h2"), ["h1", "h2"], "left_semi")
    wholly = copied.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("start_word"), F.col("n").alias("n_words"), F.col("first").alias("start_byte"), (F.col("last") - F.col("first")).alias("n_bytes"))
    return partly.unionByName(wholly)
