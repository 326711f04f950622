"""Graphs over the test tables, as views, and the SQL that spells them out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.graph import Graph, View
from skein.sources.project import from_tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, key: str, label: str, kind: int, kinds: int, *properties: str) -> DataFrame:
    return df.select((F.col(key) * kinds + kind).cast("long").alias("nodeId"), F.array(F.lit(label)).alias("labels"), *properties)


def purchases(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts (2 * key) and orders (2 * key + 1); part -> order for each line, with its quantity."""
    parts, orders, lines = (table(spark, sf_dir, t) for t in ("part", "orders", "lineitem"))
    nodes = _nodes(parts, "p_partkey", "Part", 0, 2).unionByName(_nodes(orders, "o_orderkey", "Order", 1, 2))
    rels = lines.select((F.col("l_partkey") * 2).alias("sourceNodeId"), (F.col("l_orderkey") * 2 + 1).alias("targetNodeId"), F.col("l_quantity").alias("quantity"))
    return from_tables(nodes, rels, type_="PART_IN_ORDER")


PURCHASES_SQL = "purchases AS (SELECT l_partkey * 2 AS src, l_orderkey * 2 + 1 AS dst, l_quantity AS w FROM lineitem)"


def chain(spark: SparkSession, sf_dir: str, undirected: bool = False) -> Graph:
    """Parts; from each line of an order to the next, with the next one's quantity."""
    parts, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    nodes = parts.select(F.col("p_partkey").alias("nodeId"), F.array(F.lit("Part")).alias("labels"), "p_size", "p_retailprice")
    a = lines.select("l_orderkey", F.col("l_partkey").alias("sourceNodeId"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    b = lines.select("l_orderkey", F.col("l_partkey").alias("targetNodeId"), "l_linenumber", F.col("l_quantity").alias("quantity"))
    rels = a.join(b, ["l_orderkey", "l_linenumber"]).select("sourceNodeId", "targetNodeId", "quantity")
    return from_tables(nodes, rels, type_="NEXT", undirected=("NEXT",) if undirected else ())


CHAIN_SQL = """nodes AS (SELECT p_partkey AS id, p_size, p_retailprice FROM part),
chain AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, b.l_quantity AS w FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
both_ways AS (SELECT src, dst, w FROM chain UNION ALL SELECT dst, src, w FROM chain),
near AS (SELECT DISTINCT src, dst FROM both_ways WHERE src <> dst)"""


def places(spark: SparkSession, sf_dir: str, undirected: bool = False) -> Graph:
    """Regions (4 * key), nations (+ 1), suppliers (+ 2) and customers (+ 3), each below its place."""
    region, nation, supplier, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    nodes = _nodes(region, "r_regionkey", "Region", 0, 4)
    for df, key, label, kind in ((nation, "n_nationkey", "Nation", 1), (supplier, "s_suppkey", "Supplier", 2), (customer, "c_custkey", "Customer", 3)):
        nodes = nodes.unionByName(_nodes(df, key, label, kind, 4))

    def below(df: DataFrame, up: str, up_kind: int, down: str, kind: int) -> DataFrame:
        return df.select((F.col(up) * 4 + up_kind).cast("long").alias("sourceNodeId"), (F.col(down) * 4 + kind).cast("long").alias("targetNodeId"), F.lit(float(kind)).alias("cost"))

    rels = below(nation, "n_regionkey", 0, "n_nationkey", 1).unionByName(below(supplier, "s_nationkey", 1, "s_suppkey", 2)).unionByName(below(customer, "c_nationkey", 1, "c_custkey", 3))
    return from_tables(nodes, rels, type_="HAS", undirected=("HAS",) if undirected else ())


PLACES_SQL = """nodes AS (SELECT CAST(r_regionkey AS BIGINT) * 4 AS id FROM region UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 4 + 1 FROM nation UNION ALL SELECT s_suppkey * 4 + 2 FROM supplier UNION ALL SELECT c_custkey * 4 + 3 FROM customer),
has AS (SELECT CAST(n_regionkey AS BIGINT) * 4 AS src, CAST(n_nationkey AS BIGINT) * 4 + 1 AS dst, 1.0::DOUBLE AS w FROM nation
  UNION ALL SELECT CAST(s_nationkey AS BIGINT) * 4 + 1, s_suppkey * 4 + 2, 2.0::DOUBLE FROM supplier UNION ALL SELECT CAST(c_nationkey AS BIGINT) * 4 + 1, c_custkey * 4 + 3, 3.0::DOUBLE FROM customer),
both_ways AS (SELECT src, dst, w FROM has UNION ALL SELECT dst, src, w FROM has)"""


def vectors(spark: SparkSession, sf_dir: str) -> View:
    """Embeddings as nodes without relationships."""
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(F.lit("Vector")).alias("labels"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    edges = spark.createDataFrame([], "src long, dst long, weight double")
    return View(nodes, edges)
