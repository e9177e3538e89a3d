"""Token counts of whole texts by the whole-token shortcut.

The driver proves once which vocabulary strings encode alone as one token (``byte_bpe.prove``) and
broadcasts them; their number is bounded by the vocabulary. A task cuts each text into pre-tokens, counts
those strings as 1 each, and lets the tokenizer merge only the others, each distinct one once. Special
strings within a text are special tokens, which is the library's default. The scan is the whole job:
nothing is shuffled, and a task holds one batch and a bounded memory of merged pre-tokens.

Rows: a null text counts as empty, and an empty text has no tokens; repeated rows and ids, and null ids,
are rows of their own; ties cannot occur. Very long texts are counted whole. An empty table gives an
empty result. Columns named n_bytes, n_tokens or over_limit are replaced, other columns are kept only if
they are among ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from runlake.llm.byte_bpe import BYTE_BPE, ByLookup, prove


@lru_cache(2)
def counter(path: str, whole: frozenset[str]) -> ByLookup:
    return ByLookup(path, False, dict.fromkeys(whole, 1), len)


def count(texts: Sequence[str | None], lookup: ByLookup) -> list[int]:
    """The number of tokens of each text."""
    out = []
    for text in texts:
        if not text:
            out.append(0)
            continue
        found = lookup.pre_tokens(text)
        if found is None:
            out.append(len(lookup.tokenizer.encode(text, add_special_tokens=False).ids))
            continue
        lookup.learn(found)
        out.append(sum(map(lookup.table.__getitem__, found)))
    lookup.forget()
    return out


def token_counts(docs: DataFrame, limit: int = 1024, path: str = BYTE_BPE, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every text."""
    keep = [c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")]
    whole = docs.sparkSession.sparkContext.broadcast(frozenset(prove(path)))
    quoted = [F.col(f"`{c}`") for c in keep]
    base = docs.select(F.struct(*quoted).alias("kept") if keep else F.struct(F.lit(0).alias("none")).alias("kept"), F.col(f"`{text}`").cast("string").alias("text"))
    base = base.select("kept", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = counter(path, whole.value)
        for batch in batches:
            n = pa.array(count(batch.column("text").to_pylist(), lookup), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("kept"), batch.column("n_bytes"), n], ["kept", "n_bytes", "n_tokens"])

    schema = StructType([base.schema["kept"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    found = base.mapInArrow(counted, schema)
    return found.select(*([f"kept.{f'`{c}`'}" for c in keep]), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).cast(BooleanType()).alias("over_limit"))
