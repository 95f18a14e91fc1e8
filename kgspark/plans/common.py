"""Shared inputs of the registered queries: tables, the line table, and a property graph out of the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.lexical import segments
from kgspark.session import spread


#: Tables whose rows are texts, so that work per row is large.
TEXTS = ("documents", "conversations")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def lines(spark: SparkSession, d: str) -> DataFrame:
    return segments(table(spark, d, "documents").select("doc_id", "text"))


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customer -> supplier, weighted by line items."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    rows = li.join(o, li.l_orderkey == o.o_orderkey)
    return rows.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst")).agg(F.count("*").cast("double").alias("weight"))


def trade_nodes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.lit("CUSTOMER").alias("node_type"), F.col("c_nationkey").alias("community"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("node_type"), F.col("s_nationkey").alias("community"))
    return c.unionByName(s)


#: The same inputs in DuckDB, as common table expressions.
SQL_LINES = r"""
raw AS (SELECT doc_id, regexp_replace(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]', chr(10), 'g') AS t FROM documents),
split AS (SELECT doc_id AS doc, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS line_number FROM raw),
kept AS (SELECT doc, line_number, regexp_replace(x, '^[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') AS content FROM split),
lines AS (SELECT doc, line_number, content, row_number() OVER (PARTITION BY doc ORDER BY line_number) - 1 AS segment_idx FROM kept WHERE content <> '')"""
SQL_TRADE = """
edges AS (SELECT 'C' || o_custkey AS src, 'S' || l_suppkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
nodes AS (SELECT 'C' || c_custkey AS id, c_name AS name, 'CUSTOMER' AS node_type, c_nationkey AS community FROM customer
   UNION ALL SELECT 'S' || s_suppkey, s_name, 'SUPPLIER', s_nationkey FROM supplier)"""
