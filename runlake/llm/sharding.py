"""Contiguous shards of equal bytes, cut from global prefix sums of sizes; equal texts stay together.

Only DataFrame functions. The order is that of a hash of the texts, so that equal texts are neighbours. The
groups are range-partitioned by it, each partition sums its sizes, the totals of the partitions (one row
each) give every partition's start, and a group goes to the shard in whose part of all bytes its middle
byte lies. The few groups of more than 1 / PARTS of a share (at most PARTS * shards of them) are placed
first, the largest into the emptiest shard, and the cuts leave room for them. Only a group that fits into no
shard is split, row by row like groups of their own. So shards differ from an equal share by less than two
groups of 1 / PARTS of it.

Rows: null text has no bytes; each row also counts one byte, so that empty rows spread too. Null and empty
texts are one group. Within a shard rows are in the order of hash, then id, null first; wholly equal rows are
interchangeable. An empty table gives an empty result. Further columns are not looked at.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.shared import stash, with_prefix

#: A group of more than this part of a share is placed by itself.
PARTS = 32
#: What equal texts share.
KEY = ["hash", "crc", "size"]


def place(sizes: list[int], shards: int, share: float) -> tuple[list[int | None], list[float]]:
    """The shard of each group, largest first, or None if it fits into none; and the room that is left in each shard."""
    room, out = [share] * shards, []
    for size in sizes:
        k = max(range(shards), key=lambda i: (room[i], -i))
        if size <= room[k] + share / PARTS:
            room[k] -= size
            out.append(k)
        else:
            out.append(None)
    return out, [max(0.0, x) for x in room]


def byte_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard (0 to shards - 1), slot (place in the shard), start (bytes before it)."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = stash(docs.select(F.col(id_col).alias("id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("crc"), F.xxhash64(data).alias("hash")), "sized")
    groups = stash(rows.groupBy(*KEY).agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 1
    share = total / shards
    large = groups.where(F.col("bytes") > share / PARTS).orderBy(F.desc("bytes"), *KEY).collect()  # at most PARTS * shards
    homes, room = place([r["bytes"] for r in large], shards, share)
    rest = total - sum(r["bytes"] for r, home in zip(large, homes) if home is not None)
    wide = sum(room) or 1.0
    ends = [sum(room[: k + 1]) * rest / wide for k in range(shards - 1)]
    listed = json.dumps([{**{c: r[c] for c in KEY}, "home": home, "split": home is None} for r, home in zip(large, homes)])
    schema = "array<struct<hash: long, crc: long, size: long, home: int, split: boolean>>"
    known = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(listed), schema)))
    marked = rows.join(F.broadcast(known), KEY, "left")
    units = groups.join(F.broadcast(known), KEY, "left_anti").select(*KEY, F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "bytes", F.lit(False).alias("split"))
    units = units.unionByName(marked.where("split").select(*KEY, "id", F.col("size").alias("bytes"), "split"))
    cut = with_prefix(units, ["hash", "crc", "size", "id"], {"before": F.col("bytes")})
    middle = F.col("before") + F.col("bytes") / 2
    passed = [(middle >= F.lit(float(end))).cast("int") for end in ends]
    cut = stash(cut.withColumn("shard", reduce(lambda a, b: a + b, passed, F.lit(0))), "cut")
    own = ["id", *KEY, "shard"]
    placed = marked.where("home is not null").withColumn("shard", F.col("home")).select(own)
    placed = placed.unionByName(cut.where("split").select(own))
    placed = placed.unionByName(marked.where("split is null").join(cut.where("not split").select(*KEY, "shard"), KEY).select(own))
    dealt = stash(with_prefix(placed, ["shard", "hash", "crc", "size", "id"], {"start": F.col("size"), "place": F.lit(1)}), "placed")
    firsts = dealt.groupBy("shard").agg(F.min("place").alias("first"))  # at most ``shards`` rows
    return dealt.join(F.broadcast(firsts), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).alias("slot"), "start")
