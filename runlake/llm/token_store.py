"""Token ids in binary files: one zstandard frame a document, a shared dictionary, an offset index.

A store is a folder of four Parquet tables, written and read by Spark only:

* ``dictionary``: one row; sha256 of the dictionary, its bytes, bytes per id (2 or 4, little-endian);
* ``blocks``: shard, block, dictionary hash, payload (frames one after the other, about a megabyte) and
  the block's own index: id, at, bytes, n_tokens and before (ids of the shard before the document);
* ``shards``: one row a shard; documents, ids, and start (ids of all earlier shards);
* ``index``: one row a document: id, start, n_tokens, shard, block, at, bytes.

Shards are ranges of the document id in ascending order, sorted within. Each frame is compressed on its
own with a dictionary trained on serialized id arrays, so that a short document needs its block's bytes
from ``at`` on and the dictionary alone; readers compare the dictionary's hash first.

Rows: null or empty text is its end id alone. Null ids come first; rows with equal ids follow by checksum
and length, each a document of its own. An empty table gives an empty store. Further columns are not
looked at. The dictionary is trained on at most SAMPLES documents (those of smallest hash, SAMPLE_BYTES
of each); everything else covers all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlake.llm.shared import bounded_sample, small, stash
from runlake.llm.tokens import TOKENIZER, crc32, encoded

#: Bounds of the dictionary and its training sample.
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 64 << 10, 2000, 16 << 10
#: A block is closed when its frames reach this size.
BLOCK_BYTES = 1 << 20
LEVEL = 3
_DOC = "struct<doc_id:bigint,at:bigint,bytes:bigint,n_tokens:bigint,before:bigint>"


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, width: int = 2) -> DataFrame:
    """doc_id, n_tokens, crc, ids (binary, ``width`` bytes each) of every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, bounds, ids in encoded(batch.column(1), path):
                n = len(bounds) - 1
                if width == 2 and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("ids above 65535 need 4 bytes")
                parts = [ids[bounds[i] : bounds[i + 1]] for i in range(n)]
                crcs = pa.array([crc32(x) for x in parts], pa.int64())
                raw = pa.array([x.astype(f"<u{width}").tobytes() for x in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(np.diff(bounds), pa.int64()), crcs, raw], ["doc_id", "n_tokens", "crc", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, n_tokens long, crc long, ids binary")


def trained(samples: list[bytes]) -> bytes:
    """A zstandard dictionary for such arrays; where they are too few to train one, their bytes, else none."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, width: int = 2) -> None:
    """Encodes every text of ``docs`` and writes a store at ``path``, a folder that all executors share."""
    spark = docs.sparkSession
    tokens = stash(tokenized(docs, id_col, text_col, tokenizer, width), "tokens")
    sample = bounded_sample(tokens, ["doc_id", "crc"], SAMPLES).select(F.substring("ids", 1, SAMPLE_BYTES).alias("ids")).collect()
    dictionary = trained([bytes(r["ids"]) for r in sample])
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary), width)], "dict_hash string, dictionary binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        shard, block, before, payload, index = 0, 0, 0, bytearray(), []

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "dict_hash": digest, "payload": bytes(payload), "docs": index}], schema)

        for batch in batches:
            for shard, doc_id, n, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = frame.compress(ids)
                index.append({"doc_id": doc_id, "at": len(payload), "bytes": len(data), "n_tokens": n, "before": before})
                payload += data
                before += n
                if len(payload) >= BLOCK_BYTES:
                    yield closed()
                    block, payload, index = block + 1, bytearray(), []
        if index:
            yield closed()

    doc = pa.struct([(k, pa.int64()) for k in ("doc_id", "at", "bytes", "n_tokens", "before")])
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dict_hash", pa.string()), ("payload", pa.binary()), ("docs", pa.list_(doc))])
    order = ["doc_id", "crc", "n_tokens"]
    dealt = tokens.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("shard"), "doc_id", "n_tokens", "ids")
    dealt.mapInArrow(pack, f"shard int, block int, dict_hash string, payload binary, docs array<{_DOC}>").write.option("compression", "none").parquet(f"{path}/blocks")
    index = spark.read.parquet(f"{path}/blocks").select("shard", "block", F.explode("docs").alias("d")).select("shard", "block", "d.*")
    sums = index.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("n_tokens"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    sums.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).write.parquet(f"{path}/shards")
    starts = F.broadcast(spark.read.parquet(f"{path}/shards").select("shard", "start"))
    index.join(starts, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "shard", "block", "at", "bytes").write.parquet(f"{path}/index")


def _decoder(spark: SparkSession, path: str):
    """A mapInArrow function from (payload, dict_hash, docs) to documents; docs lists what to take from the payload."""
    head = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, digest, width = bytes(head["dictionary"]), head["dict_hash"], head["width"]
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the dictionary is not the one that its hash names")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
        for batch in batches:
            for payload, own, docs in zip(*(batch.column(k) for k in range(3))):
                if own.as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                data = memoryview(payload.as_buffer())
                rows = docs.as_py()
                ids = [np.frombuffer(frame.decompress(data[d["at"] : d["at"] + d["bytes"]]), f"<u{width}").astype("<u4") for d in rows]
                yield pa.RecordBatch.from_arrays([pa.array([d["doc_id"] for d in rows], pa.int64()), pa.array([d["start"] for d in rows], pa.int64()), pa.array(list(map(len, ids)), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return decode


_DECODED = "doc_id long, start long, n_tokens long, ids binary"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    starts = F.broadcast(spark.read.parquet(f"{path}/shards").select("shard", "start"))  # one row a shard
    docs = F.transform("docs", lambda d: F.struct(d["doc_id"].alias("doc_id"), d["at"].alias("at"), d["bytes"].alias("bytes"), (d["before"] + F.col("start")).alias("start")))
    return spark.read.parquet(f"{path}/blocks").join(starts, "shard").select("payload", "dict_hash", docs.alias("docs")).mapInArrow(_decoder(spark, path), _DECODED)


def read_some(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The documents whose id is in ``wanted`` (doc_id): their index rows name blocks, and only their frames are unpacked."""
    keys = wanted.select("doc_id").distinct()
    some = spark.read.parquet(f"{path}/index").join(small(stash(keys, "wanted")), "doc_id", "left_semi")
    frames = some.groupBy("shard", "block").agg(F.collect_list(F.struct("doc_id", "at", "bytes", "start")).alias("docs"))  # at most a block's documents
    return spark.read.parquet(f"{path}/blocks").drop("docs").join(frames, ["shard", "block"]).select("payload", "dict_hash", "docs").mapInArrow(_decoder(spark, path), _DECODED)
