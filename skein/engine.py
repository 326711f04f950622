"""The engine: named graphs, and operators in the modes stream, stats, mutate, write and estimate.

    engine = Engine(spark)
    engine.project("g", nodes, relationships)
    engine.call("pageRank.stream", "g", {"maxIterations": 20, "dampingFactor": 0.85})
"""

from __future__ import annotations

import inspect
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.functions import vectors
from skein.graph import ALL, Catalog, Graph, View
from skein.operators import centrality, community, embeddings, ml, paths, sampling, similarity
from skein.plans.iterate import cut, noted
from skein.sources import export, project

VERSION = "0.1.0"


@dataclass(frozen=True)
class Operator:
    """result: `node` adds a node property from column `value`, `pairs` adds relationships from
    (node1, node2, value), `paths` adds relationships with totalCost, `rows` can only stream."""

    run: Callable
    result: str
    value: str = ""


OPERATORS: dict[str, Operator] = {
    "pageRank": Operator(centrality.page_rank, "node", "score"),
    "articleRank": Operator(centrality.article_rank, "node", "score"),
    "eigenvector": Operator(centrality.eigenvector, "node", "score"),
    "degree": Operator(centrality.degree, "node", "score"),
    "betweenness": Operator(centrality.betweenness, "node", "score"),
    "closeness": Operator(centrality.closeness, "node", "score"),
    "closeness.harmonic": Operator(centrality.harmonic, "node", "score"),
    "hits": Operator(centrality.hits, "node", "auth"),
    "articulationPoints": Operator(centrality.articulation_points, "rows"),
    "bridges": Operator(centrality.bridges, "rows"),
    "influenceMaximization.celf": Operator(centrality.celf, "node", "spread"),
    "wcc": Operator(community.wcc, "node", "componentId"),
    "scc": Operator(community.scc, "node", "componentId"),
    "labelPropagation": Operator(community.label_propagation, "node", "communityId"),
    "louvain": Operator(community.louvain, "node", "communityId"),
    "leiden": Operator(community.leiden, "node", "communityId"),
    "modularityOptimization": Operator(community.modularity_optimization, "node", "communityId"),
    "k1coloring": Operator(community.k1_coloring, "node", "color"),
    "kcore": Operator(community.k_core, "node", "coreValue"),
    "kmeans": Operator(community.kmeans, "node", "communityId"),
    "triangleCount": Operator(community.triangle_count, "node", "triangleCount"),
    "triangles": Operator(community.triangles, "rows"),
    "localClusteringCoefficient": Operator(community.local_clustering_coefficient, "node", "localClusteringCoefficient"),
    "maxkcut": Operator(community.approx_max_k_cut, "node", "communityId"),
    "sllpa": Operator(community.sllpa, "node", "values"),
    "nodeSimilarity": Operator(similarity.node_similarity, "pairs", "similarity"),
    "nodeSimilarity.filtered": Operator(similarity.filtered_node_similarity, "pairs", "similarity"),
    "knn": Operator(similarity.knn, "pairs", "similarity"),
    "knn.filtered": Operator(similarity.filtered_knn, "pairs", "similarity"),
    "ml.kge.predict": Operator(similarity.kge_predict, "pairs", "score"),
    "shortestPath.dijkstra": Operator(paths.dijkstra, "paths"),
    "allShortestPaths.dijkstra": Operator(paths.dijkstra, "paths"),
    "allShortestPaths.delta": Operator(paths.delta_stepping, "paths"),
    "shortestPath.astar": Operator(paths.a_star, "paths"),
    "shortestPath.yens": Operator(paths.yens, "paths"),
    "bellmanFord": Operator(paths.bellman_ford_paths, "paths"),
    "allShortestPaths": Operator(paths.all_pairs, "rows"),
    "bfs": Operator(paths.bfs, "rows"),
    "dfs": Operator(paths.dfs, "rows"),
    "randomWalk": Operator(paths.random_walk, "rows"),
    "dag.topologicalSort": Operator(paths.topological_sort, "rows"),
    "dag.longestPath": Operator(paths.dag_longest_path, "paths"),
    "spanningTree": Operator(paths.spanning_tree, "tree"),
    "kSpanningTree": Operator(paths.k_spanning_tree, "tree"),
    "steinerTree": Operator(paths.steiner_tree, "tree"),
    "prizeSteinerTree": Operator(paths.prize_steiner_tree, "tree"),
    "fastRP": Operator(embeddings.fast_rp, "node", "embedding"),
    "node2vec": Operator(embeddings.node2vec, "node", "embedding"),
    "hashgnn": Operator(embeddings.hash_gnn, "node", "embedding"),
    "scaleProperties": Operator(vectors.scale_properties, "node", "scaledProperty"),
    "modularity": Operator(community.property_modularity, "rows"),
    "conductance": Operator(community.property_conductance, "rows"),
    "indirectExposure": Operator(centrality.exposure_to, "node", "exposure"),
}


def _count(out: DataFrame) -> int:
    return out.count()


def _forest(view: View, out: DataFrame) -> dict:
    r = out.agg(F.count("*"), F.sum("weight")).first()
    return {"effectiveNodeCount": r[0], "totalWeight": float(r[1] or 0.0)}


def _of_communities(view: View, out: DataFrame) -> dict:
    return {"nodeCount": _count(out)}


#: What the stats of an operator hold besides what all have: from its view and its result.
STATS: dict[str, Callable[[View, DataFrame], dict]] = {
    "triangleCount": lambda view, out: {"globalTriangleCount": (out.filter("triangleCount > 0").agg(F.sum("triangleCount")).first()[0] or 0) // 3, "nodeCount": _count(out)},
    "localClusteringCoefficient": lambda view, out: {"averageClusteringCoefficient": float(out.agg(F.avg(F.nanvl("localClusteringCoefficient", F.lit(0.0)))).first()[0] or 0.0), "nodeCount": _count(out)},
    "kcore": lambda view, out: {"degeneracy": int(out.agg(F.max("coreValue")).first()[0] or 0)},
    "k1coloring": lambda view, out: {"nodeCount": _count(out), "colorCount": out.select("color").distinct().count()},
    "nodeSimilarity": lambda view, out: {"nodesCompared": view.edges.select("src").distinct().count(), "similarityPairs": _count(out)},
    "nodeSimilarity.filtered": lambda view, out: {"nodesCompared": view.edges.select("src").distinct().count(), "similarityPairs": _count(out)},
    "knn": lambda view, out: {"nodesCompared": view.nodes.count(), "similarityPairs": _count(out)},
    "knn.filtered": lambda view, out: {"nodesCompared": view.nodes.count(), "similarityPairs": _count(out)},
    "spanningTree": _forest,
    "kSpanningTree": lambda view, out: {"effectiveNodeCount": _count(out)},
    "steinerTree": _forest,
    "prizeSteinerTree": _forest,
    "louvain": _of_communities,
    "leiden": _of_communities,
    "modularityOptimization": lambda view, out: {"nodes": _count(out)},
    "modularity": lambda view, out: {"nodeCount": view.nodes.count(), "relationshipCount": view.edges.count(), "communityCount": _count(out), "modularity": float(out.agg(F.sum("modularity")).first()[0] or 0.0)},
    "conductance": lambda view, out: {"averageConductance": float(out.agg(F.avg("conductance")).first()[0] or 0.0)},
    "articulationPoints": lambda view, out: {"articulationPointCount": _count(out)},
    "influenceMaximization.celf": lambda view, out: {"nodeCount": view.nodes.count(), "totalSpread": float(out.agg(F.max("spread")).first()[0] or 0.0)},
    "kmeans": lambda view, out: dict(zip(("averageDistanceToCentroid", "averageSilhouette"), map(float, out.agg(F.coalesce(F.avg("distanceFromCentroid"), F.lit(0.0)), F.coalesce(F.avg("silhouette"), F.lit(-1.0))).first()))),
    "fastRP": lambda view, out: {"nodeCount": _count(out)},
    "node2vec": lambda view, out: {"nodeCount": _count(out)},
    "hashgnn": lambda view, out: {"nodeCount": _count(out)},
}
#: The name of a result column's distribution, and of how many different values it has.
_DISTRIBUTIONS = {"score": "centralityDistribution", "similarity": "similarityDistribution", "auth": "centralityDistribution"}
_GROUPS = {"componentId": "component", "communityId": "community", "color": "color"}
MODES = ("stream", "stats", "mutate", "write")
#: Endpoints of the catalog, and the methods that answer them.
PROCEDURES = {
    "graph.list": "list",
    "graph.exists": "exists",
    "graph.drop": "drop",
    "graph.generate": "generate",
    "graph.filter": "filter",
    "graph.sample.rwr": "sample_rwr",
    "graph.sample.cnarw": "sample_cnarw",
    "graph.nodeLabel.mutate": "mutate_label",
    "graph.nodeProperties.drop": "drop_node_properties",
    "graph.relationships.drop": "drop_relationships",
    "graph.relationships.toUndirected": "to_undirected",
    "graph.relationships.indexInverse": "index_inverse",
    "graph.graphProperty.stream": "graph_property_stream",
    "graph.graphProperty.drop": "graph_property_drop",
    "graph.export": "export",
    "graph.sizeOf": "size_of",
    "collapsePath.mutate": "collapse_path",
    "splitRelationships.mutate": "split_relationships",
    "graphSage.train": "train_graph_sage_of",
    "graphSage.stream": "graph_sage_of",
    "memory.list": "memory_list",
    "memory.summary": "memory_summary",
    "util.asNode": "as_node",
    "util.nodeProperty": "node_property",
    "list": "list_operators",
}
#: Configuration that operators do not read: they leave parallelism and logging to Spark.
_IGNORED = {"concurrency", "job_id", "log_progress", "sudo", "write_concurrency", "read_concurrency", "min_batch_size", "partitioning", "batch_size"}


def snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def _distribution(rows: DataFrame, column: str) -> dict:
    shares = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]
    r = rows.agg(F.min(column).cast("double"), F.avg(column), F.max(column).cast("double"), F.percentile_approx(F.col(column).cast("double"), shares)).first()
    names = ("p1", "p5", "p10", "p25", "p50", "p75", "p90", "p95", "p99", "p999")
    return {"min": r[0], "mean": r[1], "max": r[2]} | dict(zip(names, r[3] or []))


def numbered(names: DataFrame, column: str) -> DataFrame:
    """names with __d: their numbers in order from 0. Names are dealt by ranges, and a range's
    numbers begin after all before it; the driver reads one count a range."""
    ranged = cut(names.repartitionByRange(column).withColumn("__part", F.spark_partition_id()))
    before, rows = 0, []
    for r in ranged.groupBy("__part").count().orderBy("__part").collect():
        rows.append((r["__part"], before))
        before += r["count"]
    first = F.broadcast(names.sparkSession.createDataFrame(rows, "__part int, __first long"))  # a row a partition
    place = F.row_number().over(W.partitionBy("__part").orderBy(column)) - 1
    return ranged.join(first, "__part").select(column, (place + F.col("__first")).alias("__d"))


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.graphs, self.models, self.pipelines = Catalog("graph"), Catalog("model"), Catalog("pipeline")

    # ---- projections -------------------------------------------------------------------------

    def project(self, name: str, nodes: DataFrame, rels: DataFrame, **options) -> Graph:
        return self.graphs.put(name, project.from_tables(nodes, rels, **options))

    def project_store(self, name: str, store: Graph, node_projection, relationship_projection, **options) -> Graph:
        return self.graphs.put(name, project.from_store(store, node_projection, relationship_projection, **options))

    def project_edges(self, name: str, edges: DataFrame, **options) -> Graph:
        return self.graphs.put(name, project.from_edges(edges, **options))

    def project_sql(self, name: str, node_sql: str, rel_sql: str, **options) -> Graph:
        return self.graphs.put(name, project.from_sql(self.spark, node_sql, rel_sql, **options))

    def generate(self, name: str, node_count: int, average_degree: int, **options) -> Graph:
        return self.graphs.put(name, project.generate(self.spark, node_count, average_degree, **options))

    def filter(self, name: str, source: str, node_filter: str = ALL, relationship_filter: str = ALL, parameters: dict | None = None) -> Graph:
        return self.graphs.put(name, project.filter_graph(self.graphs.get(source), node_filter, relationship_filter, parameters))

    def sample(self, name: str, source: str, method: str = "rwr", **config) -> Graph:
        return self.graphs.put(name, getattr(sampling, method)(self.graphs.get(source), **config))

    def sample_rwr(self, name: str, source: str, **config) -> Graph:
        return self.sample(name, source, "rwr", **config)

    def sample_cnarw(self, name: str, source: str, **config) -> Graph:
        return self.sample(name, source, "cnarw", **config)

    def split_relationships(self, name: str, **config) -> Graph:
        return self.graphs.put(name, ml.split_relationships(self.graphs.get(name), **config), True)

    def collapse_path(self, name: str, path_templates: list[list[str]], mutate_relationship_type: str, allow_self_loops: bool = False) -> Graph:
        graph = self.graphs.get(name)
        return self.graphs.put(name, graph.with_relationships(mutate_relationship_type, cut(paths.collapse_path(graph, path_templates, allow_self_loops))), True)

    def to_undirected(self, name: str, relationship_type: str, mutate_relationship_type: str, aggregation="NONE") -> Graph:
        return self.graphs.put(name, self.graphs.get(name).to_undirected(relationship_type, mutate_relationship_type, aggregation), True)

    def index_inverse(self, name: str, relationship_type: str) -> Graph:
        """A join on targets needs no index; the graph stays as it is."""
        del relationship_type
        return self.graphs.get(name)

    def mutate_label(self, name: str, label: str, node_filter: str) -> Graph:
        graph = self.graphs.get(name)
        from skein.functions.filter_language import parse_filter

        hit = parse_filter(node_filter, "n", dict(graph.nodes.dtypes)).apply_to_nodes(graph.nodes, graph.rels).select("nodeId").withColumn("__hit", F.lit(True))
        nodes = graph.nodes.join(hit, "nodeId", "left")
        labels = F.when(F.col("__hit"), F.array_union("labels", F.array(F.lit(label)))).otherwise(F.col("labels"))
        return self.graphs.put(name, Graph(nodes.withColumn("labels", labels).drop("__hit"), graph.rels, graph.undirected, graph.properties), True)

    # ---- properties of nodes and graphs ------------------------------------------------------

    def as_node(self, name: str, node_id: int) -> dict | None:
        """The node as a map of its id, labels and properties; None if it is not there."""
        row = self.graphs.get(name).nodes.filter(F.col("nodeId") == node_id).first()
        return row.asDict() if row else None

    def as_nodes(self, name: str, ids: DataFrame, column: str = "nodeId") -> DataFrame:
        """ids with the labels and properties of the nodes that a column names."""
        nodes = self.graphs.get(name).nodes
        return ids.join(nodes.withColumnRenamed("nodeId", column), column, "left")

    def node_property(self, name: str, node_id: int, property_key: str, node_label: str = ALL):
        """The value of one node's property; None if node, label or value are not there."""
        nodes, _ = self.graphs.get(name).filtered((node_label,))
        row = nodes.filter(F.col("nodeId") == node_id).select(property_key).first()
        return row[0] if row else None

    def graph_property_stream(self, name: str, graph_property: str) -> DataFrame:
        """(propertyValue): a row for each of the values of a property of the whole graph."""
        found = self.graphs.get(name).properties[graph_property]
        if isinstance(found, DataFrame):
            return found.toDF("propertyValue")
        values = found if isinstance(found, (list, tuple)) else [found]
        return self.spark.createDataFrame([(v,) for v in values], f"propertyValue {'long' if all(isinstance(v, int) for v in values) else 'double' if all(isinstance(v, (int, float)) for v in values) else 'string'}")

    def graph_property_drop(self, name: str, graph_property: str) -> Graph:
        graph = self.graphs.get(name)
        if graph_property not in graph.properties:
            raise KeyError(f"graph property {graph_property!r} does not exist")
        return self.graphs.put(name, replace(graph, properties={k: v for k, v in graph.properties.items() if k != graph_property}), True)

    def graph_property_mutate(self, name: str, graph_property: str, value) -> Graph:
        graph = self.graphs.get(name)
        return self.graphs.put(name, replace(graph, properties=graph.properties | {graph_property: value}), True)

    def drop_node_properties(self, name: str, node_properties: list[str]) -> Graph:
        return self.graphs.put(name, self.graphs.get(name).without_node_properties(*node_properties), True)

    def drop_relationships(self, name: str, relationship_type: str) -> Graph:
        return self.graphs.put(name, self.graphs.get(name).without_relationships(relationship_type), True)

    def exists(self, name: str) -> bool:
        return self.graphs.exists(name)

    def size_of(self, name: str) -> dict:
        """Bytes of the graph's tables as the optimizer estimates them, nothing is read."""
        graph = self.graphs.get(name)
        nodes, rels = (int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in (graph.nodes, graph.rels))
        most = 2**63 - 1  # of a join of unknown size there may be no better guess
        return {"graphName": name, "nodes": min(nodes, most), "relationships": min(rels, most), "bytes": min(nodes + rels, most)}

    def memory_list(self) -> DataFrame:
        """(name, entity, memoryInBytes) of the graphs in the catalog."""
        rows = [(n, "graph", self.size_of(n)["bytes"]) for n in self.graphs.names()]
        return self.spark.createDataFrame(rows, "name string, entity string, memoryInBytes long")

    def memory_summary(self) -> dict:
        """The graphs' bytes, and what executors can use for execution and storage."""
        held = self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().toSeq()
        free = [held.apply(i) for i in range(held.size())]
        return {"totalGraphsMemory": sum(self.size_of(n)["bytes"] for n in self.graphs.names()), "executorMemory": sum(int(m._1()) for m in free), "executorMemoryLeft": sum(int(m._2()) for m in free)}

    def list(self) -> DataFrame:
        """A row for each graph: counts, density, degrees, schema and bytes."""
        out = None
        for name in self.graphs.names():
            graph = self.graphs.get(name)
            schema = F.create_map(*(F.lit(x) for k, v in (("nodes", graph.nodes), ("relationships", graph.rels)) for x in (k, v.schema.simpleString())))
            row = graph.summary().withColumns({"graphName": F.lit(name), "schema": schema, "memoryInBytes": F.lit(self.size_of(name)["bytes"]).cast("long")})
            out = row if out is None else out.unionByName(row)
        return out

    def drop(self, name: str, fail_if_missing: bool = True) -> None:
        self.graphs.drop(name, fail_if_missing)

    # ---- operators ---------------------------------------------------------------------------

    def call(self, endpoint: str, graph_name: str | None = None, config: dict | None = None, **more):
        """endpoint: an operator's name and a mode; `.estimate` after the mode gives sizes. Or one of
        PROCEDURES, which work on the catalog."""
        if endpoint in PROCEDURES:
            given = {snake(k): v for k, v in (config or {}).items()} | more
            return getattr(self, PROCEDURES[endpoint])(*([] if graph_name is None else [graph_name]), **given)
        name, _, mode = endpoint.rpartition(".")
        estimate = mode == "estimate"
        if estimate:
            name, _, mode = name.rpartition(".")
        if name not in OPERATORS or mode not in MODES:
            raise ValueError(f"no endpoint {endpoint}; see list_operators()")
        config = {snake(k): v for k, v in (config or {}).items()} | more
        if estimate:
            return self.estimate(name, graph_name, config)
        op, graph = OPERATORS[name], self.graphs.get(graph_name)
        own = {k: config.pop(k) for k in ("mutate_property", "write_property", "mutate_relationship_type", "write_relationship_type", "write_path", "min_community_size", "consecutive_ids", "min_component_size") if k in config}
        view = self._view(graph, dict(config))
        began = time.time()
        if mode == "stream":
            return self._communities(self.run(name, graph, config), op, own)
        with noted() as facts:
            out = cut(self._communities(self.run(name, graph, config), op, own))
        stats = {"preProcessingMillis": 0, "computeMillis": int(1000 * (time.time() - began)), "configuration": config, "rows": out.count()}
        stats |= facts | (STATS[name](view, out) if name in STATS else {})
        if op.value and dict(out.dtypes)[op.value] in ("double", "float", "bigint", "int"):
            stats["distribution"] = _distribution(out, op.value)
            if op.value in _DISTRIBUTIONS:
                stats[_DISTRIBUTIONS[op.value]] = stats["distribution"]
            if op.value in _GROUPS:
                kind, sizes = _GROUPS[op.value], out.groupBy(op.value).count()
                stats |= {f"{kind}Count": sizes.count(), f"{kind}Distribution": _distribution(sizes, "count")}
        stats["postProcessingMillis"] = int(1000 * (time.time() - began)) - stats["computeMillis"]
        written = "relationshipsWritten" if op.result in ("pairs", "paths", "tree") else "nodePropertiesWritten"
        if mode in ("mutate", "write"):
            stats[written] = stats["rows"]
        if mode == "mutate":
            self.graphs.put(graph_name, self._mutated(graph, op, out, own), True)
        if mode == "write":
            if "write_path" not in own:
                raise ValueError("write needs write_path")
            self._named(op, out, own).write.mode("overwrite").parquet(own["write_path"])
        return stats

    def _view(self, graph: Graph, config: dict) -> View:
        """The view that a configuration asks for; what says so is taken out of it."""
        return graph.view(config.pop("node_labels", (ALL,)), config.pop("relationship_types", (ALL,)), config.pop("relationship_weight_property", None))

    def run(self, name: str, graph: Graph, config: dict) -> DataFrame:
        config = dict(config)
        view = self._view(graph, config)
        run = OPERATORS[name].run
        known = inspect.signature(run).parameters
        takes_all = any(p.kind is p.VAR_KEYWORD for p in known.values())
        given = {k: v for k, v in config.items() if k not in _IGNORED}
        wrong = [k for k in given if k not in known] if not takes_all else []
        if wrong:
            raise ValueError(f"{name} has no configuration {wrong}; it has {sorted(set(known) - {'view'})}")
        return run(view, **given)

    def _communities(self, out: DataFrame, op: Operator, own: dict) -> DataFrame:
        least = own.get("min_community_size") or own.get("min_component_size")
        if op.result == "node" and least and op.value in out.columns:
            large = out.groupBy(op.value).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
            out = out.join(large.drop("__n"), op.value, "left_semi")
        if op.result == "node" and own.get("consecutive_ids"):
            columns = out.columns
            out = out.join(numbered(out.select(op.value).distinct(), op.value), op.value).withColumn(op.value, F.col("__d")).select(*columns)
        return out

    def _named(self, op: Operator, out: DataFrame, own: dict) -> DataFrame:
        name = own.get("write_property") or own.get("mutate_property")
        if op.result == "node":
            return out.select("nodeId", F.col(op.value).alias(name or op.value))
        if op.result == "pairs":
            return out.select(F.col("node1").alias("sourceNodeId"), F.col("node2").alias("targetNodeId"), F.col(op.value).alias(name or op.value))
        if op.result == "paths":
            return out.select(F.col("sourceNode").alias("sourceNodeId"), F.col("targetNode").alias("targetNodeId"), "totalCost", "nodeIds", "costs")
        if op.result == "tree":
            return out.filter("nodeId <> parentId").select(F.col("parentId").alias("sourceNodeId"), F.col("nodeId").alias("targetNodeId"), F.col("weight").alias(name or "weight"))
        return out

    def _mutated(self, graph: Graph, op: Operator, out: DataFrame, own: dict) -> Graph:
        rows = self._named(op, out, own)
        if op.result == "node":
            name = own["mutate_property"]
            if name in graph.node_properties:
                raise ValueError(f"node property {name!r} exists already")
            return graph.with_node_property(name, rows, name)
        if op.result == "rows":
            raise ValueError("this operator can only stream, count and write")
        keep = [c for c in rows.columns if c not in ("nodeIds", "costs")]
        return graph.with_relationships(own["mutate_relationship_type"], rows.select(*keep))

    def estimate(self, name: str, graph_name: str | None, config: dict) -> dict:
        """Bytes of the tables a run holds at once, from counts; Spark spills what does not fit."""
        if "node_count" in config:
            n, m = config["node_count"], config.get("relationship_count", 0)
        else:
            graph = self.graphs.get(graph_name)
            n, m = graph.nodes.count(), graph.rels.count()
        width = 8 * int(config.get("embedding_dimension", 1))
        return {"operator": name, "nodeCount": n, "relationshipCount": m, "bytesMin": n * (16 + width) + m * 24, "bytesMax": 3 * n * (16 + width) + 3 * m * 40}

    def list_operators(self) -> list[str]:
        return [f"{n}.{m}" for n, op in sorted(OPERATORS.items()) for m in MODES if m != "mutate" or op.result != "rows"] + sorted(PROCEDURES)

    # ---- models ------------------------------------------------------------------------------

    def pipeline(self, name: str, task: str) -> ml.Pipeline:
        return self.pipelines.put(name, ml.Pipeline(task))

    def with_steps(self, pipeline: ml.Pipeline, view) -> DataFrame:
        """The view's nodes with the properties that a pipeline's steps add."""
        nodes = view.nodes.withColumnRenamed("id", "nodeId")
        if "labels" not in nodes.columns:
            nodes = nodes.withColumn("labels", F.array(F.lit("__ALL__")))
        rels = view.edges.select(F.col("src").alias("sourceNodeId"), F.col("dst").alias("targetNodeId"), F.lit("__ALL__").alias("relationshipType"), "weight")
        graph = Graph(nodes, rels, frozenset({"__ALL__"}) if view.undirected else frozenset())
        for operator, config in pipeline.node_property_steps:
            config = {snake(k): v for k, v in config.items()}
            name = config.pop("mutate_property")
            value = OPERATORS[operator].value
            graph = graph.with_node_property(name, cut(self.run(operator, graph, config)), value)
        return graph.nodes.withColumnRenamed("nodeId", "id")

    def train(self, pipeline_name: str, graph_name: str, model_name: str, target_property: str | None = None, relationship_types=(ALL,), node_labels=(ALL,), metrics=None, random_seed: int = 0) -> ml.Model:
        pipeline, graph = self.pipelines.get(pipeline_name), self.graphs.get(graph_name)
        view = graph.view(node_labels, relationship_types)
        if pipeline.task == "link":
            model = ml.train_link_pipeline(pipeline, graph, view, lambda v: self.with_steps(pipeline, v), random_seed)
        else:
            view = type(view)(self.with_steps(pipeline, view), view.edges, view.undirected)
            default = ("MEAN_SQUARED_ERROR",) if pipeline.task == "regression" else ("F1_WEIGHTED", "ACCURACY")
            model = ml.train_node_pipeline(pipeline, view, target_property, metrics or default, random_seed)
        return self.models.put(model_name, model)

    def predict(self, model_name: str, graph_name: str, relationship_types=(ALL,), node_labels=(ALL,), **config) -> DataFrame:
        model, graph = self.models.get(model_name), self.graphs.get(graph_name)
        view = graph.view(node_labels, relationship_types)
        nodes = self.with_steps(model.pipeline, view)
        if model.task == "link":
            return ml.predict_links(model, view, nodes, **config)
        return ml.predict_nodes(model, type(view)(nodes, view.edges, view.undirected))

    def train_graph_sage(self, model_name: str, graph_name: str, relationship_types=(ALL,), node_labels=(ALL,), **config):
        view = self.graphs.get(graph_name).view(node_labels, relationship_types)
        return self.models.put(model_name, embeddings.train_graph_sage(view, **config))

    def train_graph_sage_of(self, name: str, model_name: str, **config):
        return self.train_graph_sage(model_name, name, **config)

    def graph_sage_of(self, name: str, model_name: str, **config) -> DataFrame:
        return self.graph_sage(model_name, name, **config)

    def graph_sage(self, model_name: str, graph_name: str, relationship_types=(ALL,), node_labels=(ALL,)) -> DataFrame:
        return self.models.get(model_name).embed(self.graphs.get(graph_name).view(node_labels, relationship_types))

    def export(self, name: str, path: str, kind: str = "parquet") -> None:
        (export.export_csv if kind == "csv" else export.export_parquet)(self.graphs.get(name), path)

    def load(self, name: str, path: str, kind: str = "parquet") -> Graph:
        return self.graphs.put(name, (export.import_csv if kind == "csv" else export.import_parquet)(self.spark, path))
