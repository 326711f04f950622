"""The property graph: node and relationship DataFrames, views of them, and catalogs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "*"
_NODE_KEYS = ("nodeId", "labels")
_REL_KEYS = ("sourceNodeId", "targetNodeId", "relationshipType")


@dataclass(frozen=True)
class View:
    """What operators see: nodes (id and their properties) and edges (src, dst, weight).
    An undirected view has every edge in both directions. typed, where a graph has types, is
    (src, dst, type) of the same edges."""

    nodes: DataFrame
    edges: DataFrame
    undirected: bool = False
    weighted: bool = False
    typed: DataFrame | None = None

    @property
    def ids(self) -> DataFrame:
        return self.nodes.select("id")

    def reversed(self) -> View:
        turned = lambda df, c: df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), c)
        return replace(self, edges=turned(self.edges, "weight"), typed=None if self.typed is None else turned(self.typed, "type"))

    def both_ways(self) -> View:
        """The edges and their opposites, unless the view is undirected already."""
        if self.undirected:
            return self
        back = self.reversed()
        typed = None if self.typed is None else self.typed.unionByName(back.typed)
        return replace(self, edges=self.edges.unionByName(back.edges), undirected=True, typed=typed)

    def neighbours(self) -> DataFrame:
        """Distinct (src, dst) without self-loops."""
        return self.edges.select("src", "dst").filter("src <> dst").distinct()


@dataclass(frozen=True)
class Graph:
    """nodes: nodeId, labels and node properties. rels: sourceNodeId, targetNodeId,
    relationshipType and relationship properties, which are doubles; undirected types have each
    relationship in both directions. Immutable: whatever changes it returns another."""

    nodes: DataFrame
    rels: DataFrame
    undirected: frozenset[str] = frozenset()
    properties: dict = field(default_factory=dict)
    config: dict = field(default_factory=dict)

    @property
    def node_properties(self) -> list[str]:
        return [c for c in self.nodes.columns if c not in _NODE_KEYS]

    @property
    def relationship_properties(self) -> list[str]:
        return [c for c in self.rels.columns if c not in _REL_KEYS]

    def labels(self) -> list[str]:
        return [r[0] for r in self.nodes.select(F.explode("labels").alias("l")).distinct().orderBy("l").collect()]

    def types(self) -> list[str]:
        return [r[0] for r in self.rels.select("relationshipType").distinct().orderBy("relationshipType").collect()]

    def filtered(self, node_labels=(ALL,), relationship_types=(ALL,)) -> tuple[DataFrame, DataFrame]:
        nodes, rels = self.nodes, self.rels
        if ALL not in node_labels:
            nodes = nodes.filter(F.arrays_overlap("labels", F.array(*map(F.lit, node_labels))))
            rels = within(rels, nodes)
        if ALL not in relationship_types:
            rels = rels.filter(F.col("relationshipType").isin(*relationship_types))
        return nodes, rels

    def view(self, node_labels=(ALL,), relationship_types=(ALL,), weight: str | None = None) -> View:
        if weight is not None and weight not in self.relationship_properties:
            raise ValueError(f"relationship property {weight!r} is not there; there are {self.relationship_properties}")
        nodes, rels = self.filtered(node_labels, relationship_types)
        w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(float("nan")))
        edges = rels.select(F.col("sourceNodeId").alias("src"), F.col("targetNodeId").alias("dst"), w.alias("weight"))
        named = self.types() if self.undirected and ALL in relationship_types else relationship_types
        undirected = bool(self.undirected) and all(t in self.undirected for t in named)
        typed = rels.select(F.col("sourceNodeId").alias("src"), F.col("targetNodeId").alias("dst"), F.col("relationshipType").alias("type"))
        return View(nodes.withColumnRenamed("nodeId", "id"), edges, undirected, weight is not None, typed)

    def with_node_property(self, name: str, values: DataFrame, column: str, default=None) -> Graph:
        """values has nodeId and column; nodes without a value get the default."""
        values = values.select(F.col("nodeId"), F.col(column).alias(name))
        nodes = self.nodes.drop(name).join(values, "nodeId", "left")
        return replace(self, nodes=nodes if default is None else nodes.withColumn(name, F.coalesce(name, F.lit(default))))

    def with_relationships(self, type_: str, rels: DataFrame, undirected: bool = False) -> Graph:
        """rels has sourceNodeId, targetNodeId and properties; it becomes a new type."""
        new = rels.withColumn("relationshipType", F.lit(type_))
        if undirected:
            new = new.unionByName(swapped(new))
        return replace(self, rels=self.rels.unionByName(new, allowMissingColumns=True), undirected=self.undirected | ({type_} if undirected else set()))

    def without_relationships(self, type_: str) -> Graph:
        return replace(self, rels=self.rels.filter(F.col("relationshipType") != type_), undirected=self.undirected - {type_})

    def without_node_properties(self, *names: str) -> Graph:
        return replace(self, nodes=self.nodes.drop(*names))

    def with_label(self, label: str, condition) -> Graph:
        labels = F.when(condition, F.array_union("labels", F.array(F.lit(label)))).otherwise(F.col("labels"))
        return replace(self, nodes=self.nodes.withColumn("labels", labels))

    def to_undirected(self, type_: str, new_type: str, aggregation: str | dict = "NONE") -> Graph:
        """A new type with every relationship of type_ in both directions, parallel ones combined."""
        rels = self.rels.filter(F.col("relationshipType") == type_)
        both = rels.unionByName(swapped(rels)).withColumn("relationshipType", F.lit(new_type))
        both = aggregated(both, self.relationship_properties, aggregation)
        return replace(self, rels=self.rels.unionByName(both.select(*self.rels.columns)), undirected=self.undirected | {new_type})

    def summary(self) -> DataFrame:
        """One row: counts, density, and the distribution of out-degrees."""
        spark = self.nodes.sparkSession
        n, m = self.nodes.count(), self.rels.count()
        degree = self.nodes.select("nodeId").join(self.rels.groupBy(F.col("sourceNodeId").alias("nodeId")).count(), "nodeId", "left").select(F.coalesce("count", F.lit(0)).alias("d"))
        shares = [0.5, 0.75, 0.9, 0.95, 0.99, 0.999]
        row = degree.agg(F.min("d"), F.avg("d"), F.max("d"), F.percentile_approx("d", shares)).first()
        spread = {"min": float(row[0] or 0), "mean": float(row[1] or 0), "max": float(row[2] or 0)} | {f"p{str(100 * s).rstrip('0').rstrip('.').replace('.', '')}": float(v) for s, v in zip(shares, row[3] or [0] * 6)}
        density = m / (n * (n - 1)) if n > 1 else 0.0
        return spark.createDataFrame([(n, m, density, spread)], "nodeCount long, relationshipCount long, density double, degreeDistribution map<string, double>")


def swapped(rels: DataFrame) -> DataFrame:
    return rels.withColumns({"sourceNodeId": F.col("targetNodeId"), "targetNodeId": F.col("sourceNodeId")})


def within(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """The relationships whose two ends are among the nodes."""
    columns = rels.columns
    for end in ("sourceNodeId", "targetNodeId"):
        rels = rels.join(nodes.select(F.col("nodeId").alias(end)), end, "left_semi")
    return rels.select(*columns)


_FOLDS = {
    "SUM": lambda c: F.sum(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))),
    "MIN": lambda c: F.min(F.coalesce(F.nanvl(c, F.lit(float("inf"))), F.lit(float("inf")))),
    "MAX": lambda c: F.max(F.coalesce(F.nanvl(c, F.lit(float("-inf"))), F.lit(float("-inf")))),
    "COUNT": lambda c: F.sum(F.when(c.isNull() | F.isnan(c), 0.0).otherwise(1.0)),
    "SINGLE": lambda c: F.min(c),  # the smallest, so that the one kept does not depend on order
}


def aggregated(rels: DataFrame, properties: list[str], aggregation: str | dict) -> DataFrame:
    """Parallel relationships of a type combined; aggregation: one name, or one a property."""
    by = aggregation if isinstance(aggregation, dict) else {p: aggregation for p in properties}
    kinds = {k: "NONE" if v == "DEFAULT" else v for k, v in by.items()}
    if not isinstance(aggregation, dict) and aggregation in ("NONE", "DEFAULT") or kinds and all(v == "NONE" for v in kinds.values()):
        return rels
    if "NONE" in kinds.values():
        raise ValueError("some properties are aggregated and others are not")
    folds = [_FOLDS[kinds.get(p, "SINGLE")](F.col(p).cast("double")).alias(p) for p in properties]
    if not folds:
        return rels.dropDuplicates(list(_REL_KEYS))
    return rels.groupBy(*_REL_KEYS).agg(*folds)


class Catalog:
    """Named objects of a session: graphs, models or pipelines."""

    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def put(self, name: str, item, replace_: bool = False):
        if name in self._items and not replace_:
            raise ValueError(f"{self.kind} {name!r} exists already")
        self._items[name] = item
        return item

    def get(self, name: str):
        if name not in self._items:
            raise KeyError(f"{self.kind} {name!r} does not exist; there are {sorted(self._items)}")
        return self._items[name]

    def exists(self, name: str) -> bool:
        return name in self._items

    def names(self) -> list[str]:
        return sorted(self._items)

    def drop(self, name: str, fail_if_missing: bool = True):
        if fail_if_missing:
            self.get(name)
        return self._items.pop(name, None)
