"""Raw snapshots to bronze, silver and gold tables below a base path.

A table is a Parquet folder. A load writes the next version of it and reports its rows from the write
itself (observe). Layers are DataFrame transforms of their own, so that a job can chain them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runlake.sources.raw import copy_table, scan_snapshots

TECHNICAL = ("_ingested_at", "_source_file")
#: Columns of the gold tables, in their order.
CUSTOMER = ("CustomerID", "Title", "FirstName", "MiddleName", "LastName", "CompanyName", "SalesPerson", "EmailAddress", "Phone")
PRODUCT = ("ProductID", "Name", "ProductNumber", "Color", "StandardCost", "ListPrice", "Size", "Weight", "CategoryName")
ORDER_HEADER = ("SalesOrderID", "OrderDate", "DueDate", "ShipDate", "CustomerID", "SubTotal", "TaxAmt", "Freight", "TotalDue")
ORDER_DETAIL = ("SalesOrderID", "SalesOrderDetailID", "ProductID", "OrderQty", "UnitPrice", "UnitPriceDiscount", "LineTotal")


def existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that there are, in the wanted order."""
    return df.select([c for c in wanted if c in df.columns])


def trimmed(df: DataFrame) -> DataFrame:
    """Spaces off both ends of every text column, in one projection."""
    return df.select([F.trim(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def silver_clean(df: DataFrame) -> DataFrame:
    """Without technical columns, trimmed, without repeated rows and rows that are null throughout."""
    return trimmed(df.drop(*TECHNICAL)).dropDuplicates().na.drop(how="all")


def newest_by_key(df: DataFrame, keys: Sequence[str], newest: Column | None = None) -> DataFrame:
    """One row for each key: the newest, among equally new ones the one of least row hash, then least row.

    A partial aggregate, not a window: a key of any size is reduced before the shuffle.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    order = [F.lit(0) if newest is None else newest, -F.xxhash64(*columns).cast("decimal(20,0)")]
    row = F.struct(*columns)
    kept = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return kept.select("_row.*")


def bronze(spark: SparkSession, raw: str, table: str, since: date | None = None) -> DataFrame:
    """All snapshots of a table with their day, time of load and file."""
    return scan_snapshots(spark, raw, table, since, provenance=True)


def dim_customer(customer: DataFrame) -> DataFrame:
    newest = F.col("_ingest_date") if "_ingest_date" in customer.columns else None
    return existing(newest_by_key(customer, ["CustomerID"], newest), CUSTOMER)


def dim_product(product: DataFrame, category: DataFrame | None) -> DataFrame:
    """Products with their category's name where both tables have the key; products without a category stay."""
    key, out = "ProductCategoryID", product
    newest = F.col("_ingest_date") if "_ingest_date" in product.columns else None
    out = newest_by_key(out, ["ProductID"], newest)
    if category is not None and key in product.columns and key in category.columns:
        day = F.col("_ingest_date") if "_ingest_date" in category.columns else None
        names = newest_by_key(category, [key], day).select(key, F.col("Name").alias("CategoryName"))
        out = out.join(names, key, "left")
    return existing(out, PRODUCT)


def fact_sales(detail: DataFrame, header: DataFrame) -> DataFrame:
    return existing(detail, ORDER_DETAIL).join(existing(header, ORDER_HEADER), "SalesOrderID", "inner")


def save(df: DataFrame, path: str) -> int:
    """Writes a table and gives its number of rows, counted while writing."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"]


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """An optional input: none where the table is missing."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def load_report(spark: SparkSession, jobs: dict[str, Callable[[], int]]) -> DataFrame:
    """Runs one load a table and reports table_name, status (OK or SKIP), n_rows and error; a failed load does not stop the rest."""
    rows = []
    for name, job in jobs.items():
        try:
            rows.append((name, "OK", job(), None))
        except PySparkException as e:
            rows.append((name, "SKIP", None, str(e.getCondition() or type(e).__name__)))
    return spark.createDataFrame(rows, "table_name string, status string, n_rows long, error string")  # one row a table


def bronze_tables(names: Sequence[str]) -> dict[str, str]:
    """Silver name by bronze name, of the names that start with ``bronze_``."""
    return {n: "silver_" + n.removeprefix("bronze_") for n in names if n.startswith("bronze_")}


def chain(spark: SparkSession, tables: dict[str, DataFrame], base: str, day: date) -> dict[str, DataFrame]:
    """Copy, bronze, silver and gold of the given tables, each step from the written result of the one before."""
    silver = {}
    for name, df in tables.items():
        copy_table(df, f"{base}/raw", name, day)
        save(bronze(spark, f"{base}/raw", name), f"{base}/bronze_{name.lower()}")
        save(silver_clean(spark.read.parquet(f"{base}/bronze_{name.lower()}")), f"{base}/silver_{name.lower()}")
        silver[name] = spark.read.parquet(f"{base}/silver_{name.lower()}")
    gold: dict[str, DataFrame] = {}
    if "Customer" in silver:
        gold["gold_dim_customer"] = dim_customer(silver["Customer"])
    if "Product" in silver:
        gold["gold_dim_product"] = dim_product(silver["Product"], silver.get("ProductCategory"))
    if "SalesOrderHeader" in silver and "SalesOrderDetail" in silver:
        gold["gold_fact_salesorder"] = fact_sales(silver["SalesOrderDetail"], silver["SalesOrderHeader"])
    for name, df in gold.items():
        save(df, f"{base}/{name}")
        gold[name] = spark.read.parquet(f"{base}/{name}")
    return gold


__all__ = ["bronze", "bronze_tables", "chain", "dim_customer", "dim_product", "existing", "fact_sales", "load_report", "newest_by_key", "save", "scan_snapshots", "silver_clean", "table_or_none", "trimmed"]
