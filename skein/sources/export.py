"""Sinks, streams of graph elements, and file exports that can be read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.graph import Graph

_ARRAYS = ("array<bigint>", "array<double>", "array<float>", "array<int>")


def stream_node_property(graph: Graph, name: str, labels=("*",)) -> DataFrame:
    nodes, _ = graph.filtered(labels)
    return nodes.select("nodeId", F.col(name).alias("propertyValue"), F.col("labels").alias("nodeLabels"))


def stream_node_properties(graph: Graph, names: list[str], labels=("*",)) -> DataFrame:
    """(nodeId, nodeProperty, propertyValue, nodeLabels); values of different types as strings."""
    nodes, _ = graph.filtered(labels)
    types = {dict(nodes.dtypes)[n] for n in names}
    value = (lambda n: F.col(n)) if len(types) == 1 else (lambda n: F.col(n).cast("string"))
    pairs = F.array(*(F.struct(F.lit(n).alias("nodeProperty"), value(n).alias("propertyValue")) for n in names))
    return nodes.select("nodeId", F.explode(pairs).alias("p"), F.col("labels").alias("nodeLabels")).select("nodeId", "p.*", "nodeLabels")


def stream_relationships(graph: Graph, types=("*",)) -> DataFrame:
    _, rels = graph.filtered(relationship_types=types)
    return rels.select("sourceNodeId", "targetNodeId", "relationshipType")


def stream_relationship_property(graph: Graph, name: str, types=("*",)) -> DataFrame:
    _, rels = graph.filtered(relationship_types=types)
    return rels.select("sourceNodeId", "targetNodeId", "relationshipType", F.col(name).alias("propertyValue"))


def stream_relationship_properties(graph: Graph, names: list[str], types=("*",)) -> DataFrame:
    _, rels = graph.filtered(relationship_types=types)
    pairs = F.array(*(F.struct(F.lit(n).alias("relationshipProperty"), F.col(n).alias("propertyValue")) for n in names))
    return rels.select("sourceNodeId", "targetNodeId", "relationshipType", F.explode(pairs).alias("p")).select("sourceNodeId", "targetNodeId", "relationshipType", "p.*")


def write_node_properties(graph: Graph, names: list[str], path: str, labels=("*",), mode: str = "overwrite") -> None:
    graph.filtered(labels)[0].select("nodeId", *names).write.mode(mode).parquet(path)


def write_node_label(graph: Graph, label: str, condition, path: str, mode: str = "overwrite") -> None:
    graph.nodes.filter(condition).select("nodeId", F.lit(label).alias("label")).write.mode(mode).parquet(path)


def write_relationships(graph: Graph, type_: str, path: str, properties: list[str] | None = None, mode: str = "overwrite") -> None:
    rels = graph.rels.filter(F.col("relationshipType") == type_)
    rels.select("sourceNodeId", "targetNodeId", *(graph.relationship_properties if properties is None else properties)).write.mode(mode).parquet(path)


def export_parquet(graph: Graph, path: str, mode: str = "overwrite") -> None:
    """Two tables; relationships are partitioned by type, so one type is read without the others."""
    graph.nodes.write.mode(mode).parquet(f"{path}/nodes")
    graph.rels.write.mode(mode).partitionBy("relationshipType").parquet(f"{path}/relationships")
    _info(graph).write.mode(mode).text(f"{path}/graph_info")


def _info(graph: Graph) -> DataFrame:
    spark = graph.nodes.sparkSession
    text = json.dumps({"undirected": sorted(graph.undirected), "nodes": dict(graph.nodes.dtypes), "relationships": dict(graph.rels.dtypes), "properties": graph.properties})
    return spark.createDataFrame([(text,)], "value string").coalesce(1)


def import_parquet(spark: SparkSession, path: str) -> Graph:
    info = json.loads(spark.read.text(f"{path}/graph_info").first()[0])
    rels = spark.read.parquet(f"{path}/relationships")
    first = ["sourceNodeId", "targetNodeId", "relationshipType"]
    return Graph(spark.read.parquet(f"{path}/nodes"), rels.select(*first, *(c for c in rels.columns if c not in first)), frozenset(info["undirected"]), info["properties"])


def export_csv(graph: Graph, path: str, mode: str = "overwrite") -> None:
    """Text files with headers: nodes with :ID and :LABELS, relationships with :START_ID, :END_ID
    and :TYPE; arrays and labels are joined by semicolons. Types are kept in graph_info."""
    nodes = graph.nodes.select(F.col("nodeId").alias(":ID"), F.array_join("labels", ";").alias(":LABELS"), *(_flat(c, t).alias(c) for c, t in graph.nodes.dtypes if c not in ("nodeId", "labels")))
    rels = graph.rels.select(F.col("sourceNodeId").alias(":START_ID"), F.col("targetNodeId").alias(":END_ID"), F.col("relationshipType").alias(":TYPE"), *graph.relationship_properties)
    nodes.write.mode(mode).csv(f"{path}/nodes", header=True)
    rels.write.mode(mode).csv(f"{path}/relationships", header=True)
    _info(graph).write.mode(mode).text(f"{path}/graph_info")


def _flat(name: str, kind: str):
    return F.array_join(F.col(name).cast("array<string>"), ";") if kind.startswith("array") else F.col(name)


def import_csv(spark: SparkSession, path: str) -> Graph:
    info = json.loads(spark.read.text(f"{path}/graph_info").first()[0])
    types = info["nodes"]

    def back(name: str):
        kind = types[name]
        return F.split(name, ";").cast(kind) if kind.startswith("array") else F.col(name).cast(kind)

    schema = ", ".join(f"`{c}` string" for c in [":ID", ":LABELS", *(c for c in types if c not in ("nodeId", "labels"))])
    nodes = spark.read.csv(f"{path}/nodes", header=True, schema=schema)
    nodes = nodes.select(F.col(":ID").cast("long").alias("nodeId"), F.split(":LABELS", ";").alias("labels"), *(back(c).alias(c) for c in types if c not in ("nodeId", "labels")))
    props = [c for c in info["relationships"] if c not in ("sourceNodeId", "targetNodeId", "relationshipType")]
    schema = "`:START_ID` long, `:END_ID` long, `:TYPE` string" + "".join(f", `{p}` double" for p in props)
    rels = spark.read.csv(f"{path}/relationships", header=True, schema=schema)
    rels = rels.select(F.col(":START_ID").alias("sourceNodeId"), F.col(":END_ID").alias("targetNodeId"), F.col(":TYPE").alias("relationshipType"), *props)
    return Graph(nodes, rels, frozenset(info["undirected"]), info["properties"])
