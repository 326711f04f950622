"""Graphs from tables, SQL, edge rows, a store of labelled tables, or a random generator."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.filter_language import parse_filter
from skein.graph import ALL, Graph, aggregated, swapped, within

_ENDS = ("sourceNodeId", "targetNodeId")


def _checked(nodes: DataFrame, rels: DataFrame, validate: bool) -> DataFrame:
    """Without relationships whose ends are not among the nodes; an error if that is asked for."""
    inside = within(rels, nodes)
    if validate and rels.count() != inside.count():
        raise ValueError("some relationships have an end that is not among the nodes")
    return inside


def from_tables(nodes: DataFrame, rels: DataFrame, label: str = "__ALL__", type_: str = "__ALL__", undirected=(), aggregation: str | dict = "NONE", validate: bool = False) -> Graph:
    """nodes has nodeId, and may have labels (or label); rels has sourceNodeId and targetNodeId,
    and may have relationshipType; all other columns are properties."""
    if "label" in nodes.columns:
        nodes = nodes.withColumn("labels", F.array("label")).drop("label")
    if "labels" not in nodes.columns:
        nodes = nodes.withColumn("labels", F.array(F.lit(label)))
    if "relationshipType" not in rels.columns:
        rels = rels.withColumn("relationshipType", F.lit(type_))
    for c, frame, keys in (("nodeId", nodes, ("nodeId",)), ("sourceNodeId, targetNodeId", rels, _ENDS)):
        if any(k not in frame.columns for k in keys):
            raise ValueError(f"a table has no {c}; it has {frame.columns}")
    properties = [c for c in rels.columns if c not in (*_ENDS, "relationshipType")]
    rels = rels.select(*(F.col(c).cast("long").alias(c) for c in _ENDS), "relationshipType", *(F.col(p).cast("double").alias(p) for p in properties))
    rels = _checked(nodes, rels, validate)
    undirected = frozenset(undirected)
    if ALL in undirected:
        undirected = frozenset(r[0] for r in rels.select("relationshipType").distinct().collect())
    if undirected:
        rels = rels.unionByName(swapped(rels.filter(F.col("relationshipType").isin(*undirected))))
    rels = aggregated(rels, properties, aggregation)
    first = ["nodeId", "labels"]
    return Graph(nodes.select(F.col("nodeId").cast("long").alias("nodeId"), "labels", *(c for c in nodes.columns if c not in first)), rels, undirected)


def from_edges(edges: DataFrame, source: str = "source", target: str = "target", type_column: str | None = None, properties=(), source_labels: str | None = None, target_labels: str | None = None, source_properties=(), target_properties=(), undirected=(), aggregation: str | dict = "NONE") -> Graph:
    """The graph that rows of (source, target, ...) describe: nodes are the ends. A null target
    is a node without that relationship. Node properties come from columns given as
    (column, property); of different values of one node the smallest counts."""
    ends = []
    for end, labels, props in ((source, source_labels, source_properties), (target, target_labels, target_properties)):
        label = F.array(F.lit("__ALL__")) if labels is None else F.col(labels)
        label = label if labels is None or dict(edges.dtypes)[labels].startswith("array") else F.array(label)
        ends.append(edges.filter(F.col(end).isNotNull()).select(F.col(end).cast("long").alias("nodeId"), label.alias("labels"), *(F.col(c).alias(p) for c, p in props)))
    rows = ends[0].unionByName(ends[1], allowMissingColumns=True)
    names = [c for c in rows.columns if c not in ("nodeId", "labels")]
    nodes = rows.groupBy("nodeId").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"), *(F.min(c).alias(c) for c in names))
    kind = F.lit("__ALL__") if type_column is None else F.col(type_column)
    rels = edges.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("sourceNodeId"), F.col(target).alias("targetNodeId"), kind.alias("relationshipType"), *properties)
    return from_tables(nodes, rels, undirected=undirected, aggregation=aggregation)


def from_sql(spark: SparkSession, node_sql: str, rel_sql: str, args: dict | None = None, **options) -> Graph:
    """One query for nodes (id or nodeId, labels, properties), one for relationships (source,
    target or sourceNodeId, targetNodeId, type or relationshipType, properties)."""
    names = {"id": "nodeId", "source": "sourceNodeId", "target": "targetNodeId", "type": "relationshipType"}
    nodes, rels = (spark.sql(q, args=args or {}) for q in (node_sql, rel_sql))
    nodes, rels = (d.withColumnsRenamed({k: v for k, v in names.items() if k in d.columns}) for d in (nodes, rels))
    return from_tables(nodes, rels, **options)


def from_store(store: Graph, node_projection, relationship_projection, node_properties=(), relationship_properties=(), validate: bool = False) -> Graph:
    """A projection of a store by labels and types.

    node_projection: "*", a label, a list, or {name: {"label", "properties"}}; the relationship
    one likewise with {"type", "orientation", "aggregation", "properties"}. Properties: a list
    of names, or {name: {"property", "defaultValue", "aggregation"}}."""
    nodes = None
    for name, spec in _entries(node_projection, "label").items():
        label = spec.get("label", name)
        mine = store.nodes if label == ALL else store.nodes.filter(F.array_contains("labels", label))
        wanted = _mapping(node_properties) | _mapping(spec.get("properties", ()))
        mine = mine.select("nodeId", F.array(F.lit("__ALL__" if name == ALL else name)).alias("labels"), *(_mapped(mine, p, m).alias(p) for p, m in wanted.items()))
        nodes = mine if nodes is None else nodes.unionByName(mine, allowMissingColumns=True)
    names = [c for c in nodes.columns if c not in ("nodeId", "labels")]
    nodes = nodes.groupBy("nodeId").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"), *(F.first(c, ignorenulls=True).alias(c) for c in names))
    rels, undirected = None, set()
    for name, spec in _entries(relationship_projection, "type").items():
        type_ = spec.get("type", name)
        mine = store.rels if type_ == ALL else store.rels.filter(F.col("relationshipType") == type_)
        wanted = _mapping(relationship_properties) | _mapping(spec.get("properties", ()))
        kind = "__ALL__" if name == ALL else name
        orientation = spec.get("orientation", "NATURAL").upper()
        if orientation not in ("NATURAL", "REVERSE", "UNDIRECTED"):
            raise ValueError(f"no orientation {orientation}")
        mine = mine.select(*_ENDS, F.lit(kind).alias("relationshipType"), *(_mapped(mine, p, m).cast("double").alias(p) for p, m in wanted.items()))
        mine = swapped(mine) if orientation == "REVERSE" else mine.unionByName(swapped(mine)) if orientation == "UNDIRECTED" else mine
        by = {p: m.get("aggregation", spec.get("aggregation", "NONE")).upper() for p, m in wanted.items()}
        mine = aggregated(mine, list(wanted), by or spec.get("aggregation", "NONE").upper())
        undirected |= {kind} if orientation == "UNDIRECTED" else set()
        rels = mine if rels is None else rels.unionByName(mine, allowMissingColumns=True)
    return Graph(nodes, _checked(nodes, rels, validate), frozenset(undirected))


def _entries(projection, key: str) -> dict:
    if isinstance(projection, str):
        return {projection: {key: projection}}
    if isinstance(projection, dict):
        return {k: {key: v} if isinstance(v, str) else v for k, v in projection.items()}
    return {k: v for p in projection for k, v in _entries(p, key).items()}


def _mapping(properties) -> dict:
    if isinstance(properties, str):
        return {properties: {}}
    if isinstance(properties, dict):
        return {k: {"property": v} if isinstance(v, str) else v for k, v in properties.items()}
    return {p: {} for p in properties}


def _mapped(frame: DataFrame, name: str, spec: dict):
    column, default = spec.get("property", name), spec.get("defaultValue")
    if column == ALL:
        return F.lit(1.0)
    found = F.col(column) if column in frame.columns else F.lit(None)
    return found if default is None else F.coalesce(found, F.lit(default))


def filter_graph(graph: Graph, node_filter: str = ALL, relationship_filter: str = ALL, parameters: dict | None = None) -> Graph:
    """The subgraph of nodes and relationships that satisfy the two predicates."""
    nodes, rels = graph.nodes, graph.rels
    if node_filter != ALL:
        parsed = parse_filter(node_filter, "n", dict(nodes.dtypes), parameters)
        nodes = parsed.apply_to_nodes(nodes, rels)
    if relationship_filter != ALL:
        rels = parse_filter(relationship_filter, "r", dict(rels.dtypes), parameters).apply(rels)
    return replace(graph, nodes=nodes, rels=within(rels, nodes) if node_filter != ALL else rels)


def generate(spark: SparkSession, node_count: int, average_degree: int, distribution: str = "UNIFORM", seed: int = 42, property_name: str | None = None, property_range=(0.0, 1.0), property_value: float | None = None, self_loops: bool = False, undirected: bool = False) -> Graph:
    """A random graph. UNIFORM: each node has average_degree relationships; RANDOM: a gaussian
    number of them; POWER_LAW: few nodes have very many, and few are very often targets."""
    nodes = spark.range(node_count).select(F.col("id").alias("nodeId"), F.array(F.lit("__ALL__")).alias("labels"))
    unit = lambda *k: (F.pmod(F.xxhash64("nodeId", F.lit(seed), *k), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    gauss = F.sqrt(-2 * F.log(unit(F.lit(1)))) * F.cos(2 * F.pi() * unit(F.lit(2)))
    heavy = lambda u, most: F.least(F.pow(u, F.lit(-0.5)), F.lit(float(most)))
    degree = {
        "UNIFORM": F.lit(average_degree),
        "RANDOM": F.greatest(F.lit(0), F.round(average_degree + gauss * average_degree / 4)),
        "POWER_LAW": F.round(heavy(unit(F.lit(3)), node_count) * average_degree / 2),
    }[distribution.upper()].cast("int")
    rows = nodes.select("nodeId", degree.alias("d")).filter("d > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("d"))))
    share = unit(F.col("k"), F.lit(4))
    if distribution.upper() == "POWER_LAW":
        share = F.pow(share, F.lit(3.0))
    spread = node_count if self_loops else max(1, node_count - 1)
    place = F.least(F.floor(share * spread), F.lit(spread - 1))
    target = place if self_loops else F.when(place >= F.col("nodeId"), place + 1).otherwise(place)
    rels = rows.select(F.col("nodeId").alias("sourceNodeId"), target.cast("long").alias("targetNodeId"), "k")
    if property_name:
        low, high = property_range
        value = F.lit(float(property_value)) if property_value is not None else low + (high - low) * (F.pmod(F.xxhash64("sourceNodeId", "k", F.lit(seed + 1)), F.lit(1 << 53)) / float(1 << 53))
        rels = rels.withColumn(property_name, value)
    return from_tables(nodes, rels.drop("k"), undirected=(ALL,) if undirected else ())
