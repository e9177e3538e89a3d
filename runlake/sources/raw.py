"""Dated raw snapshots: <base>/<table>/yyyy=…/MM=…/dd=…, one folder a day."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from runlake.sources.lattice import converted, merged

#: The folders' names.
DAY = StructType([StructField(c, IntegerType()) for c in ("yyyy", "MM", "dd")])


def source_tables(listing: DataFrame, schema: str | None = None) -> DataFrame:
    """Base tables of a listing (table_schema, table_name, table_type), of one schema if given."""
    found = listing.where(F.col("table_type") == "BASE TABLE")
    return (found.where(F.col("table_schema") == schema) if schema else found).select("table_schema", "table_name")


def copy_table(df: DataFrame, base: str, table: str, day: date) -> str:
    """Writes a whole table as the day's snapshot and gives its folder; a second copy of the day replaces the first."""
    path = f"{base}/{table}/yyyy={day:%Y}/MM={day:%m}/dd={day:%d}"
    df.write.mode("overwrite").parquet(path)
    return path


def copy_tables(tables: dict[str, Callable[[], DataFrame]], base: str, day: date, at_once: int = 4, tries: int = 3) -> dict[str, str]:
    """Copies several tables, some at a time; each is read and written anew up to ``tries`` times. Gives OK or the error by table."""

    def one(name: str) -> str:
        for left in range(tries - 1, -1, -1):
            try:
                copy_table(tables[name](), base, name, day)
                return "OK"
            except PySparkException as e:
                if not left:
                    return str(e.getCondition() or type(e).__name__)
        return "OK"

    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(tables, pool.map(one, tables)))


def days_of(spark: SparkSession, base: str, table: str) -> dict[date, str]:
    """The folder of each day of a table, by names alone; nothing is opened."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{table}/yyyy=*/MM=*/dd=*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    folders = [f.getPath().toString() for f in found if f.isDirectory()]
    return {date(*[int(part.split("=")[1]) for part in f.split("/")[-3:]]): f for f in sorted(folders)}


def scan_snapshots(spark: SparkSession, base: str, table: str, since: date | None = None, provenance: bool = False) -> DataFrame:
    """All snapshots of a table, or those of ``since`` and later, with _ingest_date; other days' files are not opened.

    Days may have different columns and types: the result has the columns of all days, in the order in
    which they appear, each of the narrowest type that holds the days' types (``lattice``); a day without a
    column has null there. Days of one schema share a reader, which does its own pruning. A day with two
    schemas is read by that of one of its files. ``provenance`` adds _ingested_at and _source_file.
    """
    days = {d: f for d, f in days_of(spark, base, table).items() if since is None or d >= since}
    if not days and since is not None:
        return scan_snapshots(spark, base, table, None, provenance).where(F.lit(False))
    if not days:
        return spark.read.parquet(f"{base}/{table}")  # an error that names the path
    groups: dict[str, tuple[StructType, list[date]]] = {}
    for day, folder in sorted(days.items()):
        schema = spark.read.parquet(folder).schema  # one footer
        groups.setdefault(schema.json(), (schema, []))[1].append(day)
    wanted = reduce(merged, [schema for schema, _ in groups.values()])
    parts = []
    for schema, own in groups.values():
        whole = len(groups) == 1 and since is None
        paths = [f"{base}/{table}"] if whole else [days[d] for d in own]
        found = spark.read.schema(StructType([*schema.fields, *DAY.fields])).option("basePath", f"{base}/{table}").parquet(*paths)
        found = with_provenance(found) if provenance else found
        extra = ["_ingested_at", "_source_file"] * provenance
        have = {f.name.lower(): f for f in schema.fields}
        columns = [converted(F.col(f"`{have[f.name.lower()].name}`"), have[f.name.lower()].dataType, f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType) for f in wanted.fields]
        parts.append(found.select(*[c.alias(f.name) for c, f in zip(columns, wanted.fields)], *extra, F.make_date("yyyy", "MM", "dd").alias("_ingest_date")))
    return reduce(DataFrame.unionAll, parts)


def with_provenance(df: DataFrame) -> DataFrame:
    """Adds _ingested_at and _source_file, the file that a row came from."""
    return df.select("*", F.current_timestamp().alias("_ingested_at"), F.col("_metadata.file_path").alias("_source_file"))
