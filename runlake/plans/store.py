"""A knowledge store that grows by merges: a log of versions, bucketed by id, published by a manifest.

A merge writes its rows, and nothing else, as one more version of the buckets that they hash to. A bucket
with more than COMPACT versions is rewritten as one; so the rows written are in proportion to the rows merged,
and a reader opens at most COMPACT + 1 files' worth of a bucket. A manifest lists the folders that make a
version of the whole; it is one small file, written last, and readers take the newest. So a reader sees one
version, whatever is being merged, and a merge that failed, or is repeated, leaves nothing behind that counts.

One merge runs at a time; it is named by a number, greater than any before.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.plans.knowledge import upsert

BUCKETS, COMPACT = 32, 8


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, pattern: str) -> list[str]:
    """The last part of each path that a pattern finds."""
    p, fs = _fs(spark, pattern)
    return [f.getPath().getName() for f in fs.globStatus(p) or []]


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, compact: int = COMPACT):
        self.spark, self.path, self.buckets, self.compact = spark, path.rstrip("/"), buckets, compact

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names(self.spark, f"{self.path}/manifest/*.json"))

    def manifest(self, version: int) -> dict[int, list[str]]:
        """The folders of each bucket, oldest first."""
        p, fs = _fs(self.spark, f"{self.path}/manifest/{version}.json")
        stream = fs.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text).items()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The documents of a version, the newest if none is named: the last of each id. None of an empty store."""
        if version is None:
            found = self.versions()
            if not found:
                return None
            version = found[-1]
        folders = [f for own in self.manifest(version).values() for f in own]
        return upsert(self._rows(folders), "version") if folders else None

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])

    def merge(self, docs: DataFrame, number: int) -> dict[int, list[str]]:
        """Merges documents (id, further columns, version: greater wins) as version ``number``; gives its manifest.

        Of equal ids and versions any one stays. Repeating a number replaces what it wrote before.
        """
        before = [v for v in self.versions() if v < number]
        now = dict(self.manifest(before[-1])) if before else {}
        new = f"data/{number}"
        newest = upsert(docs, "version").withColumn("_bucket", self.bucket())
        newest.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{new}")
        for name in names(self.spark, f"{self.path}/{new}/_bucket=*"):
            b = int(name.split("=")[1])
            now[b] = [*now.get(b, []), f"{new}/{name}"]
        full = {b: own for b, own in now.items() if len(own) > self.compact}
        if full:
            whole = f"compact/{number}"
            rows = upsert(self._rows([f for own in full.values() for f in own]), "version").withColumn("_bucket", self.bucket())
            rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{whole}")
            now |= {b: [f"{whole}/_bucket={b}"] for b in full}
        self._publish(number, now)
        return now

    def _publish(self, number: int, folders: dict[int, list[str]]) -> None:
        """Writes a manifest under another name and moves it into place: it is there in full or not at all."""
        draft, fs = _fs(self.spark, f"{self.path}/manifest/{number}.draft")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps({str(b): own for b, own in sorted(folders.items())}).encode()))
        finally:
            stream.close()
        final, _ = _fs(self.spark, f"{self.path}/manifest/{number}.json")
        if fs.exists(final):
            fs.delete(final, False)
        if not fs.rename(draft, final):
            raise OSError(f"could not publish version {number} of {self.path}")
