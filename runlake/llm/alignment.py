"""Alignment of two tokenizers over a corpus, with pair counts by external spill counting.

Tokenizer A (byte-level BPE) and B (pieces with byte fallback) cut the same bytes, a blank and the text.
Where tokens of both end at one byte, a group ends, and the last A token and the last B token of the group
are linked. A pair's count is how many links of the whole corpus hold it.

1. A task takes its texts chunk by chunk (some megabytes, never a part of a text), and reduces a chunk's
   links to pair-document records (b, a, document, times). They are dealt by radix, b modulo RADICES, and
   sorted side-major (b, then a): one run for each chunk and radix, a zstd stream of its pairs with their
   totals and one of its records. The runs are written as a table in the shared folder.
2. Runs of a radix meet FAN_IN at a time in a k-way heap merge that reads the streams piece by piece and
   writes one stream; levels follow until one is left. In side-major order all pairs of a B id are
   consecutive, so the last merge knows the id's greatest count when it leaves the id.
3. The counts of a radix go back to its runs in sets of about FAN_IN chunks; each run's records become
   contributions by document, and those of a chunk are added up next to its documents.

Memory: a merge holds compressed runs and one piece of each; a radix's counts are bounded by its B ids
times the A vocabulary, whatever the corpus; a chunk's documents by its bytes. A pair that a third of all
links share is one entry of each run. Every shuffle has as many rows as chunks and radices, so that no key
is hot, and lost tasks are repeated from written tables.

Rows: null and empty texts, and texts that either tokenizer does not give back byte by byte, have no
tokens: zeros, and an empty group text. Repeated rows, equal ids and null ids are rows of their own; ties
for a B id's highest count all count as best. Very long texts are aligned whole. An empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from runlake.llm.byte_bpe import BYTE_BPE, ByLookup, prove, token_bytes
from runlake.llm.shared import stash

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
#: Radix partitions of the B ids; runs of a merge; bytes of text of a chunk; entries read or written at once.
RADICES, FAN_IN, CHUNK, PIECE = 256, 64, 4 << 20, 4096
#: Bits of an id in a key: (b << BITS) | a.
BITS = 24
ENTRY = np.dtype([("key", "<u8"), ("n", "<u8")])


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece: U+2581 is a blank, <0xHH> the byte HH."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


class Aligner:
    """Both tokenizers, the bytes of their ids, and the decimal forms of ids with what follows them in a group text."""

    def __init__(self, path_a: str, path_b: str):
        self.lookup = ByLookup(path_a, True, {s: (i,) for s, i in prove(path_a).items()}, tuple)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = token_bytes(path_a), piece_bytes(self.model)
        if max(len(self.bytes_a), len(self.bytes_b)) >= 1 << BITS or not all(self.bytes_a) or not all(self.bytes_b):
            raise ValueError("a vocabulary is too large, or has a token without bytes")
        self.length_a, self.length_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        self.forms = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(n)]

    def ids_a(self, text: str) -> list[int]:
        found = self.lookup.pre_tokens(text)
        if found is None:
            return self.lookup.tokenizer.encode(text, add_special_tokens=False).ids
        self.lookup.learn(found)
        return list(chain.from_iterable(map(self.lookup.table.__getitem__, found)))

    def align(self, text: str, b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and of B, and the places in them that end a group; None if the bytes differ."""
        spaced = " " + text
        a, raw = self.ids_a(spaced), spaced.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at = np.searchsorted(ends_b, ends_a)  # both end with the text
        common = ends_b[at] == ends_a
        return a, b, np.flatnonzero(common), at[common]

    def group_text(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, A's and then B's."""
        groups = np.arange(len(last_a))
        group_a, group_b = (np.repeat(groups, np.diff(last, prepend=-1)) for last in (last_a, last_b))
        place_a = np.arange(len(a)) + np.concatenate([[0], last_b[:-1] + 1])[group_a]
        place_b = np.arange(len(b)) + last_a[group_b] + 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[place_a] = a
        codes[place_a[last_a]] += len(self.bytes_a)
        codes[place_b] = b + 2 * len(self.bytes_a)
        codes[place_b[last_b]] += len(self.bytes_b)
        return "".join(map(self.forms.__getitem__, codes.tolist()))[:-1]


@lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts of at most ``limit`` characters, or a single longer one."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or "") > limit:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).tobytes())


def _records(keys: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order and where the records of each begin; of each record (key, document) its document and times.

    Where the highest key and document fit 64 bits without the bits that no key uses, one sort of numbers does it.
    """
    used = int(np.bitwise_or.reduce(keys)) if len(keys) else 0
    parts, bits = _fields(used), max(n_docs - 1, 0).bit_length()
    if sum(n for _, n in parts) + bits > 64:
        own, which = np.unique(keys, return_inverse=True)
        record, times = np.unique(which.astype(np.int64) * n_docs + docs, return_counts=True)
        return own, np.searchsorted(record // n_docs, np.arange(len(own) + 1)), record % n_docs, times
    tight, to = docs.astype(np.uint64), bits
    for at, n in parts:
        tight |= ((keys >> np.uint64(at)) & np.uint64((1 << n) - 1)) << np.uint64(to)
        to += n
    tight.sort()
    starts = np.flatnonzero(np.concatenate([[True], tight[1:] != tight[:-1]])) if len(tight) else np.zeros(0, np.int64)
    record, times = tight[starts], np.diff(np.append(starts, len(tight)))
    high = record >> np.uint64(bits)
    new = np.concatenate([[True], high[1:] != high[:-1]]) if len(high) else np.zeros(0, bool)
    short, own, to = high[new], np.zeros(int(new.sum()), np.uint64), 0
    for at, n in parts:
        own |= ((short >> np.uint64(to)) & np.uint64((1 << n) - 1)) << np.uint64(at)
        to += n
    return own, np.append(np.flatnonzero(new), len(record)), (record & np.uint64((1 << bits) - 1)).astype(np.int64), times


def _fields(used: int) -> list[tuple[int, int]]:
    """(place, length) of each of a key's parts (a, b, radix) as far as its bits are used, lowest first."""
    parts = ((0, BITS), (BITS, BITS), (2 * BITS, 64 - 2 * BITS))
    return [(at, n) for at, most in parts if (n := ((used >> at) & ((1 << most) - 1)).bit_length())]


def runs_of(keys: np.ndarray, docs: np.ndarray, n_docs: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(radix, pairs, records) of a chunk's links: keys and the documents they are in.

    ``pairs`` has the sorted keys with their totals; ``records`` the number of records of each key, then the
    document of each record, then its times, all as unsigned 32-bit numbers.
    """
    radix = (keys >> np.uint64(BITS)) % np.uint64(RADICES)
    own, first, doc_of, times = _records((radix << np.uint64(2 * BITS)) | keys, docs, n_docs)
    pairs = np.empty(len(own), ENTRY)
    pairs["key"] = own & np.uint64((1 << 2 * BITS) - 1)
    pairs["n"] = np.add.reduceat(times, first[:-1]) if len(own) else 0
    each = (own >> np.uint64(2 * BITS)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(each)) + 1, [len(each)]]) if len(each) else np.zeros(1, np.int64)
    for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
        a, b = first[i], first[j]
        yield int(each[i]), packed(pairs[i:j]), packed(np.concatenate([np.diff(first[i : j + 1]), doc_of[a:b], times[a:b]]).astype("<u4"))


def entries(stream: bytes) -> Iterator[tuple[int, int]]:
    """(key, n) of a stream, read piece by piece."""
    with zstandard.ZstdDecompressor().stream_reader(stream) as reader:
        while raw := reader.read(PIECE * ENTRY.itemsize):
            while len(raw) % ENTRY.itemsize and (more := reader.read(ENTRY.itemsize - len(raw) % ENTRY.itemsize)):
                raw += more
            yield from np.frombuffer(raw, ENTRY).tolist()


def merged(streams: Iterable[bytes]) -> Iterator[tuple[int, int]]:
    """The k-way heap merge of sorted streams: each key once, with the sum of its numbers."""
    for key, same in groupby(heapq.merge(*map(entries, streams)), itemgetter(0)):
        yield key, sum(n for _, n in same)


def rated(counts: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(key, 2 n + best) in the same order; best is 1 if n is the highest count of the key's B id."""
    for _, same in groupby(counts, lambda x: x[0] >> BITS):
        own = list(same)  # at most one entry for each A id
        most = max(n for _, n in own)
        for key, n in own:
            yield key, 2 * n + (n == most)


def stream_of(counts: Iterable[tuple[int, int]]) -> bytes:
    writer, out, some = zstandard.ZstdCompressor(level=3).compressobj(), [], []
    for entry in counts:
        some.append(entry)
        if len(some) == PIECE:
            out.append(writer.compress(np.array(some, ENTRY).tobytes()))
            some = []
    return b"".join([*out, writer.compress(np.array(some, ENTRY).tobytes()), writer.flush()])


def whole(stream: bytes, kind) -> np.ndarray:
    """All of a stream that is bounded by a chunk or by a radix's ids."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(stream), kind)


def contributions(pairs: bytes, records: bytes, keys: np.ndarray, rates: np.ndarray) -> bytes:
    """By document of a chunk: the document, its links that are best, and the sum of its links' counts."""
    own, numbers = whole(pairs, ENTRY)["key"], whole(records, "<u4").astype(np.int64)
    per_key = numbers[: len(own)]
    docs, times = numbers[len(own) :].reshape(2, -1)
    rate = np.repeat(rates[np.searchsorted(keys, own)], per_key)
    order = np.argsort(docs, kind="stable")
    docs, times, rate = docs[order], times[order], rate[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(docs)) + 1])
    return packed(np.stack([docs[starts], np.add.reduceat(times * (rate & 1), starts), np.add.reduceat(times * (rate >> 1), starts)]))


DOCUMENT = [StructField("place", IntegerType()), StructField("n_a", LongType()), StructField("n_b", LongType()), StructField("n_groups", LongType()), StructField("groups", StringType())]


def _runs(docs: DataFrame, path_a: str, path_b: str, digest: bool) -> DataFrame:
    """Scratch table of two kinds of rows: runs (chunk, radix, pairs, records), and documents (radix -1)."""
    schema = StructType([StructField("chunk", LongType()), StructField("radix", IntegerType()), StructField("pairs", BinaryType()), StructField("records", BinaryType()), StructField("id", docs.schema["id"].dataType), *DOCUMENT])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, chunk = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        shape = None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in chunks(texts):
                own, keys, places, found = texts[start:end], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
                for place, (text, b) in enumerate(zip(own, tool.model.encode([t or "" for t in own], num_threads=1))):
                    aligned = tool.align(text, b) if text else None
                    if aligned is None:
                        found.append((place, 0, 0, 0, ""))
                        continue
                    a, b, last_a, last_b = aligned
                    groups = tool.group_text(a, b, last_a, last_b)
                    found.append((place, len(a), len(b), len(last_a), hashlib.sha256(groups.encode()).hexdigest() if digest else groups))
                    keys.append((b[last_b].astype(np.uint64) << np.uint64(BITS)) | a[last_a].astype(np.uint64))
                    places.append(np.full(len(last_a), place))
                tool.lookup.forget()
                ids = batch.column("id").slice(start, end - start)
                shape = shape or pa.schema([("chunk", pa.int64()), ("radix", pa.int32()), ("pairs", pa.binary()), ("records", pa.binary()), ("id", ids.type), ("place", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string())])
                n = len(found)
                columns = [pa.array(x, t) for x, t in zip(zip(*found), shape.types[5:])]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), ids, *columns], schema=shape)
                runs = list(runs_of(np.concatenate(keys), np.concatenate(places), n))
                if runs:
                    radix, pairs, records = zip(*runs)
                    rest = [pa.nulls(len(runs), t) for t in shape.types[4:]]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(runs), pa.int64()), pa.array(radix, pa.int32()), pa.array(pairs, pa.binary()), pa.array(records, pa.binary()), *rest], schema=shape)
                chunk += 1

    return stash(docs.mapInArrow(encode, schema), "runs")


def _one_stream(last: bool) -> Callable[[pa.Table], pa.Table]:
    def merge(rows: pa.Table) -> pa.Table:
        counts = merged([x.as_py() for x in rows.column("pairs")])
        return pa.table({"radix": rows.column("radix")[:1], "part": rows.column("part")[:1], "pairs": pa.array([stream_of(rated(counts) if last else counts)], pa.binary())})

    return merge


def _counts(runs: DataFrame, parts: int) -> DataFrame:
    """Scratch table (radix, pairs): one stream for each radix, of its pairs' counts and whether they are best."""
    level = runs.select("radix", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("part"), "pairs")
    while True:
        last = parts == 1
        level = level.groupBy("radix", "part").applyInArrow(_one_stream(last), "radix int, part int, pairs binary")
        if last:
            return stash(level.select("radix", "pairs"), "counts")
        parts = -(-parts // FAN_IN)
        level = level.withColumn("part", F.col("part") % parts)


def pair_counts(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE, text: str = "text") -> DataFrame:
    """a, b, n and best (whether n is the highest count of b) of every pair that is linked somewhere."""
    base = docs.select(F.lit(0).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    runs = _runs(base, path_a, path_b, True)
    n_chunks = runs.where("radix = -1").select("chunk").distinct().count()
    counts = _counts(runs.where("radix >= 0"), max(1, -(-n_chunks // FAN_IN)))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column("pairs"):
                found = whole(stream.as_py(), ENTRY)
                key, n = found["key"].astype(np.int64), found["n"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key & ((1 << BITS) - 1)), pa.array(key >> BITS), pa.array(n >> 1), pa.array((n & 1) == 1)], ["a", "b", "n", "best"])

    return counts.mapInArrow(unpack, "a long, b long, n long, best boolean")


def align(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE, id_col: str = "doc_id", text: str = "text", digest: bool = True) -> DataFrame:
    """The id column, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups of every text.

    The groups are ``groups_sha256``, or with ``digest`` off the group text itself, ``groups``.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = _runs(base, path_a, path_b, digest)
    runs, documents = found.where("radix >= 0").select("chunk", "radix", "pairs", "records"), found.where("radix = -1").select("chunk", "id", *[f.name for f in DOCUMENT])
    sets = max(1, -(-documents.select("chunk").distinct().count() // FAN_IN))
    counts = _counts(runs, sets)
    dealt = runs.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(sets)).cast("int"))
    spread = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))

    def contribute(left: pa.Table, right: pa.Table) -> pa.Table:
        table = whole(right.column("pairs")[0].as_py(), ENTRY)
        keys, rates = table["key"], table["n"].astype(np.int64)
        back = [contributions(p.as_py(), r.as_py(), keys, rates) for p, r in zip(left.column("pairs"), left.column("records"))]
        return pa.table({"chunk": left.column("chunk"), "back": pa.array(back, pa.binary())}) if len(left) else pa.table({"chunk": pa.array([], pa.int64()), "back": pa.array([], pa.binary())})

    back = dealt.groupBy("radix", "part").cogroup(spread.groupBy("radix", "part")).applyInArrow(contribute, "chunk long, back binary")
    schema = StructType([StructField("id", base.schema["id"].dataType), *[StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], StructField("groups", StringType())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        best, total = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for stream in right.column("back"):
            place, n, s = whole(stream.as_py(), np.int64).reshape(3, -1)  # a document once in each
            best[place] += n
            total[place] += s
        place = left.column("place").to_numpy()
        columns = [left.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_groups")]
        return pa.table([*columns, pa.array(best[place]), pa.array(total[place]), left.column("groups")], names=schema.names)

    out = documents.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(finish, schema)
    return out.withColumnsRenamed({"id": id_col, "groups": "groups_sha256" if digest else "groups"})
