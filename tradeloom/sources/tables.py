"""Tables of a folder, and the trade-document entities as views over the order tables.

Money and quantities are decimals; ids are kept; ``seq`` is an explicit ordinal with a full tie-break wherever order counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
QUANTITY = "decimal(18,4)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tariff_code(part_key: str):
    """A synthetic eight-digit code, one of forty, of a part."""
    return F.lpad(((F.col(part_key) % 40) * 2300017 + 1010000).cast("string"), 8, "0")


def part_sku(part_key: str):
    return F.concat(F.when(F.col(part_key) % 10 == 0, "ST-").otherwise(""), F.lit("SKU-"), F.col(part_key))


def unit_cost():
    """An item's cost by its total and quantity."""
    return (F.col("total_cost") / F.col("quantity")).cast(QUANTITY)


def invoice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id, line, part_id, supplier_id, description, sku, tariff_code, quantity, unit_cost, total_cost, billable."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat_ws(" ", "p_name", F.lower("p_type"), F.concat(F.lit("size "), F.col("p_size"))).alias("description"),
        part_sku("p_partkey").alias("sku"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        tariff_code("l_partkey").alias("tariff_code"),
        F.col("l_quantity").cast(QUANTITY).alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("total_cost"),
        (F.col("l_returnflag") != "R").alias("billable"),
    )
    joined = lines.join(parts, lines["part_id"] == parts["p_partkey"]).drop("p_partkey")
    return joined.withColumn("unit_cost", unit_cost())


def with_seq(items: DataFrame, *within: str) -> DataFrame:
    """``items`` with their ordinal in the invoice; equal lines are interchangeable. ``within``: columns that all items of an invoice have in common, by which
    they may have been dealt before."""
    order = Window.partitionBy(*within, "invoice_id").orderBy("line", "part_id", "supplier_id", "quantity", "total_cost", "billable")
    return items.withColumn("seq", F.row_number().over(order))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id, client_id, invoice_total and the amounts besides the items, made from the key."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("invoice_id"),
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderdate").alias("invoice_date"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").cast(MONEY).alias("invoice_total"),
        (key % 50).cast(MONEY).alias("freight"),
        (key % 7).cast(MONEY).alias("insurance"),
        (key % 11).cast(MONEY).alias("tax"),
        (key % 5).cast(MONEY).alias("other_cost"),
        (key % 13).cast(MONEY).alias("discount"),
        (key % 3).cast(MONEY).alias("free_shipping"),
    )


#: The same views in SQL, for queries in ANSI SQL over the same tables.
ITEMS_SQL = """
items AS (
  SELECT l_orderkey AS invoice_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supplier_id,
         lpad(CAST((l_partkey % 40) * 2300017 + 1010000 AS VARCHAR), 8, '0') AS tariff_code,
         CAST(l_quantity AS DECIMAL(18,4)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS total_cost,
         l_returnflag <> 'R' AS billable, p_name || ' ' || lower(p_type) || ' size ' || p_size AS description,
         CASE WHEN p_partkey % 10 = 0 THEN 'ST-' ELSE '' END || 'SKU-' || p_partkey AS sku,
         CAST(((2000000 * CAST(100 * CAST(l_extendedprice AS DECIMAL(18,2)) AS HUGEINT) + CAST(10000 * l_quantity AS HUGEINT)) // (2 * CAST(10000 * l_quantity AS HUGEINT))) / 10000 AS DECIMAL(18,4)) AS unit_cost
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""
SEQ_SQL = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY line, part_id, supplier_id, quantity, total_cost, billable) AS seq FROM items
)"""
INVOICES_SQL = """
invoices AS (
  SELECT o_orderkey AS invoice_id, o_custkey AS client_id, o_orderdate AS invoice_date, o_orderpriority AS priority,
         CAST(o_totalprice AS DECIMAL(18,2)) AS invoice_total, CAST(o_orderkey % 50 AS DECIMAL(18,2)) AS freight,
         CAST(o_orderkey % 7 AS DECIMAL(18,2)) AS insurance, CAST(o_orderkey % 11 AS DECIMAL(18,2)) AS tax,
         CAST(o_orderkey % 5 AS DECIMAL(18,2)) AS other_cost, CAST(o_orderkey % 13 AS DECIMAL(18,2)) AS discount,
         CAST(o_orderkey % 3 AS DECIMAL(18,2)) AS free_shipping
  FROM orders
)"""
