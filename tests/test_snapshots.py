"""Snapshots whose columns change between days, and the lattice of types."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as t

from runlake.plans import medallion as med
from runlake.sources import lattice, raw
from runlake.storage import new_path

DAY = lambda d: dt.date(2024, 1, d)


def copy(spark, base, day, rows, schema):
    raw.copy_table(spark.createDataFrame(rows, schema), base, "t", DAY(day))


def test_columns_added_dropped_and_widened_survive(spark):
    base = new_path(spark, "raw")
    copy(spark, base, 1, [(1, "a", dt.date(2024, 5, 1))], "id int, name string, at date")
    copy(spark, base, 2, [(2, 7, dt.datetime(2024, 5, 2, 3))], "id int, extra int, at timestamp_ntz")
    copy(spark, base, 3, [(2**40, "c", 2**41, Decimal("1.5"))], "ID long, name string, extra long, price decimal(5,2)")
    copy(spark, base, 4, [(4, 9.5, Decimal("123456.789"))], "id int, name double, price decimal(10,4)")
    found = raw.scan_snapshots(spark, base, "t")
    assert found.dtypes == [("id", "bigint"), ("name", "string"), ("at", "timestamp_ntz"), ("extra", "bigint"), ("price", "decimal(10,4)"), ("_ingest_date", "date")]
    rows = {r["_ingest_date"].day: r for r in found.collect()}
    assert (rows[1]["id"], rows[1]["name"], rows[1]["at"], rows[1]["extra"]) == (1, "a", dt.datetime(2024, 5, 1), None)
    assert (rows[2]["id"], rows[2]["extra"], rows[2]["name"]) == (2, 7, None)
    assert (rows[3]["id"], rows[3]["extra"], rows[3]["price"]) == (2**40, 2**41, Decimal("1.5"))
    assert (rows[4]["name"], rows[4]["price"]) == ("9.5", Decimal("123456.789"))


def test_bronze_of_changed_days_names_their_files(spark):
    base = new_path(spark, "raw")
    copy(spark, base, 1, [(1,)], "id int")
    copy(spark, base, 2, [(2, "x")], "id long, more string")
    rows = {r["id"]: r for r in med.bronze(spark, base, "t").collect()}
    assert rows[1]["more"] is None and rows[2]["more"] == "x" and rows[1]["_ingested_at"] is not None
    assert "dd=01" in rows[1]["_source_file"] and "dd=02" in rows[2]["_source_file"] and rows[2]["_ingest_date"] == DAY(2)


def test_records_and_lists_are_merged_by_their_parts(spark):
    base = new_path(spark, "raw")
    copy(spark, base, 1, [((1, "x"), [1], {"k": 1}), (None, None, None)], "r struct<a: int, b: string>, l array<int>, m map<string, int>")
    copy(spark, base, 2, [((2**40, 0.5), [2**40, None], {"k": 2**40})], "r struct<A: long, c: double>, l array<long>, m map<string, long>")
    found = raw.scan_snapshots(spark, base, "t")
    assert dict(found.dtypes)["r"] == "struct<a:bigint,b:string,c:double>"
    rows = sorted(found.collect(), key=repr)
    assert [r["r"] and r["r"].asDict() for r in rows if r["r"] is None or r["r"]["a"] == 1] in ([None, {"a": 1, "b": "x", "c": None}], [{"a": 1, "b": "x", "c": None}, None])
    late = next(r for r in rows if r["_ingest_date"] == DAY(2))
    assert late["l"] == [2**40, None] and late["m"] == {"k": 2**40} and late["r"]["c"] == 0.5


def test_days_of_one_schema_share_a_reader_and_other_days_are_not_opened(spark):
    base = new_path(spark, "raw")
    for day in range(1, 8):
        raw.copy_table(spark.range(day).withColumn("x", F.lit(day).cast("int" if day < 5 else "long")), base, "t", DAY(day))
    found = raw.scan_snapshots(spark, base, "t")
    assert found.count() == 28 and found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    late = raw.scan_snapshots(spark, base, "t", DAY(6))
    assert late.count() == 13 and {f.split("dd=")[1][:2] for f in late.inputFiles()} == {"06", "07"}


KINDS = [t.ByteType(), t.IntegerType(), t.LongType(), t.FloatType(), t.DoubleType(), t.StringType(), t.BooleanType(), t.DateType(), t.TimestampNTZType(), t.TimestampType(), t.DecimalType(10, 2), t.DecimalType(38, 10), t.ArrayType(t.IntegerType()), t.ArrayType(t.StringType()), t.NullType(), t.StructType([t.StructField("a", t.IntegerType())]), t.StructType([t.StructField("b", t.LongType())])]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(KINDS), st.sampled_from(KINDS))
def test_the_join_of_types_is_symmetric_and_holds_both(a, b):
    names = lambda x: {f.name for f in x.fields} if isinstance(x, t.StructType) else x
    assert names(lattice.common(a, b)) == names(lattice.common(b, a))
    both = lattice.common(a, b)
    assert names(lattice.common(both, b)) == names(both) == names(lattice.common(a, both))


@pytest.mark.parametrize(
    "a, b, join",
    [("int", "bigint", "bigint"), ("bigint", "double", "string"), ("int", "float", "double"), ("bigint", "decimal(4,2)", "decimal(21,2)"), ("decimal(38,0)", "decimal(38,10)", "string"), ("date", "timestamp", "timestamp"), ("boolean", "int", "string")],
)
def test_joins(spark, a, b, join):
    kind = lambda x: spark.createDataFrame([], f"c {x}").schema["c"].dataType
    assert lattice.common(kind(a), kind(b)) == kind(join)
