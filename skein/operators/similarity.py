"""Similarity operators and link-prediction functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.functions.vectors import property_metric
from skein.graph import ALL, View
from skein.operators.nearest import Score, nearest
from skein.plans.iterate import cut

#: Common targets with more neighbours than this are dealt with in blocks of sources.
BLOCK = 512


def _among(nodes: DataFrame, spec, column: str) -> DataFrame | None:
    """The ids that a filter names: None for all, a list of ids, or a label."""
    if spec in (None, ALL, [ALL], (ALL,)):
        return None
    if isinstance(spec, str):
        return nodes.filter(F.array_contains("labels", spec)).select(F.col("id").alias(column))
    ids = spec if isinstance(spec, (list, tuple, set)) else [spec]
    return nodes.sparkSession.createDataFrame([(int(i),) for i in ids], f"{column} long")


def top(pairs: DataFrame, by: str | None, k: int, bottom: bool = False) -> DataFrame:
    """The k most (least) similar a node, or of all; ties by ids."""
    order = [F.asc("similarity") if bottom else F.desc("similarity")]
    if by is None:
        return pairs.orderBy(*order, "node1", "node2").limit(k)
    rank = F.row_number().over(W.partitionBy(by).orderBy(*order, "node2"))
    return pairs.withColumn("__k", rank).filter(F.col("__k") <= k).drop("__k")


def node_similarity(
    view: View, similarity_metric: str = "JACCARD", similarity_cutoff: float = 1e-42, degree_cutoff: int = 1, upper_degree_cutoff: int = 2147483647,
    top_k: int | None = 10, bottom_k: int | None = None, top_n: int = 0, bottom_n: int = 0, source_node_filter=None, target_node_filter=None, use_components: bool = False,
) -> DataFrame:
    """(node1, node2, similarity) of nodes with common targets.

    Pairs come from a self-join on the target, each unordered pair once; counts of common
    targets are summed before they move. A target that very many nodes share would make one
    task join all its nodes with each other; its nodes are dealt into blocks, and the join is by
    (target, pair of blocks), so the work of one target spreads over tasks. Components need no
    care: nodes of different components have no common target."""
    metric = similarity_metric.upper()
    if metric not in ("JACCARD", "OVERLAP", "COSINE"):
        raise ValueError(f"no metric {metric}")
    links = view.edges.filter("src <> dst")
    if view.weighted:
        links = links.groupBy("src", "dst").agg(F.min("weight").alias("w"))
    else:
        links = links.select("src", "dst").distinct()
    size = [F.count("*").alias("n")] + ([F.sum("w").alias("s"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l")] if view.weighted else [])
    vectors = links.groupBy("src").agg(*size).filter(F.col("n").between(degree_cutoff, upper_degree_cutoff))
    # sizes travel with the links, so that pairs need no further join
    sized = cut(links.join(vectors, "src"))
    blocks = sized.groupBy("dst").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("deg")).filter("deg > 1").drop("deg")
    dealt = sized.join(blocks, "dst").withColumn("b", F.pmod(F.xxhash64("src"), F.col("blocks")).cast("int"))
    # a pair of blocks (i, j), i <= j, meets once: a row is on the left of (b, j) and on the right of (i, b)
    left = dealt.withColumn("j", F.explode(F.sequence("b", F.col("blocks") - 1))).select("dst", F.col("b").alias("bi"), F.col("j").alias("bj"), *(F.col(c).alias(f"{c}1") for c in sized.columns if c != "dst"))
    right = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b")))).select("dst", F.col("i").alias("bi"), F.col("b").alias("bj"), *(F.col(c).alias(f"{c}2") for c in sized.columns if c != "dst"))
    met = left.join(right, ["dst", "bi", "bj"]).filter("(bi <> bj AND src1 <> src2) OR (bi = bj AND src1 < src2)")
    keys = ["src1", "src2", "n1", "n2"] + (["s1", "s2", "l1", "l2"] if view.weighted else [])
    flip = F.col("src1") > F.col("src2")
    met = met.select(*(F.when(flip, F.col(c[0] + ("2" if c[-1] == "1" else "1") if c[:3] != "src" else "src" + ("2" if c[-1] == "1" else "1"))).otherwise(F.col(c)).alias(c) for c in keys), *([F.least("w1", "w2").alias("lw"), (F.col("w1") * F.col("w2")).alias("pw")] if view.weighted else []))
    common = [F.count("*").alias("common")] + ([F.sum("lw").alias("lw"), F.sum("pw").alias("pw")] if view.weighted else [])
    pairs = met.groupBy(*keys).agg(*common)
    if view.weighted:
        value = {"JACCARD": F.col("lw") / (F.col("s1") + F.col("s2") - F.col("lw")), "OVERLAP": F.col("lw") / F.least("s1", "s2"), "COSINE": F.col("pw") / (F.col("l1") * F.col("l2"))}[metric]
    else:
        value = {"JACCARD": F.col("common") / (F.col("n1") + F.col("n2") - F.col("common")), "OVERLAP": F.col("common") / F.least("n1", "n2"), "COSINE": F.col("common") / F.sqrt(F.col("n1") * F.col("n2"))}[metric]
    pairs = pairs.select(F.col("src1").alias("a"), F.col("src2").alias("b"), value.alias("similarity")).filter((F.col("similarity") >= similarity_cutoff) & (F.col("similarity") > 0))
    both = F.explode(F.array(F.struct(F.col("a").alias("node1"), F.col("b").alias("node2")), F.struct(F.col("b").alias("node1"), F.col("a").alias("node2"))))
    out = pairs.select(both.alias("p"), "similarity").select("p.*", "similarity")
    for spec, column in ((source_node_filter, "node1"), (target_node_filter, "node2")):
        ids = _among(view.nodes, spec, column)
        out = out if ids is None else out.join(ids, column, "left_semi")
    if bottom_k or top_k:
        out = top(out, "node1", bottom_k or top_k, bool(bottom_k))
    if top_n or bottom_n:
        out = top(out, None, top_n or bottom_n, bool(bottom_n))
    return out.select("node1", "node2", "similarity")


def filtered_node_similarity(view: View, **config) -> DataFrame:
    return node_similarity(view, **config)


def _properties(node_properties) -> dict[str, str]:
    if isinstance(node_properties, str):
        return {node_properties: "DEFAULT"}
    if isinstance(node_properties, dict):
        return {k: (v or "DEFAULT") for k, v in node_properties.items()}
    return {k: m for p in node_properties for k, m in _properties(p).items()}


def _scored(pairs: DataFrame, nodes: DataFrame, props: dict[str, str], types: dict[str, str]) -> DataFrame:
    """(node1, node2, similarity): the mean of the properties' metrics."""
    a = nodes.select(F.col("id").alias("node1"), *(F.col(p).alias(f"a_{p}") for p in props))
    b = nodes.select(F.col("id").alias("node2"), *(F.col(p).alias(f"b_{p}") for p in props))
    value = sum((property_metric(types[p], m, F.col(f"a_{p}"), F.col(f"b_{p}")) for p, m in props.items()), F.lit(0.0)) / len(props)
    return pairs.join(a, "node1").join(b, "node2").select("node1", "node2", value.alias("similarity"))


def knn(
    view: View, node_properties, top_k: int = 10, similarity_cutoff: float = 0.0, sample_rate: float = 0.5, delta_threshold: float = 0.001, max_iterations: int = 100, random_joins: int = 10,
    random_seed: int = 0, initial_sampler: str = "UNIFORM", source_node_filter=None, target_node_filter=None, seed_target_nodes: bool = False, exact_up_to: int | None = None,
) -> DataFrame:
    """(node1, node2, similarity): each node's most similar others by its properties.

    Every node is compared with all others, in blocks, vectors by matrix products: see nearest(). Only if
    exact_up_to is given and there are more nodes, the result is approximate: neighbour lists
    start random and are improved, new and sampled old and reverse neighbours of a node are compared with each other, with
    random_joins random nodes more, until no more than a share delta_threshold changes."""
    props, types = _properties(node_properties), dict(view.nodes.dtypes)
    missing = [p for p in props if p not in types]
    if missing:
        raise ValueError(f"node properties {missing} are not there")
    nodes = cut(view.nodes.select("id", *(["labels"] if "labels" in types else []), *props))
    n = nodes.count()
    sources, targets = _among(nodes, source_node_filter, "node1"), _among(nodes, target_node_filter, "node2")
    if exact_up_to is None or n <= exact_up_to:
        best = _exact(nodes, props, types, top_k, sources, targets)
    else:
        best = _descent(nodes, props, types, top_k, sample_rate, delta_threshold, max_iterations, random_joins, random_seed, sources, targets, n)
    return best.filter(F.col("similarity") >= similarity_cutoff)


def _blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """left joined with all of right, in blocks."""
    a, b = (max(1, -(-df.count() // 1024)) for df in (left, right))
    deal = lambda df, own, count, other, others: df.withColumns({own: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(others - 1)))})
    left, right = deal(left, "i", a, "j", b).withColumnRenamed("id", "node1"), deal(right, "j", b, "i", a).withColumnRenamed("id", "node2")
    # exploded, a side is much larger than Spark takes it for, so it may not be broadcast
    return left.join(right.hint("merge"), ["i", "j"]).drop("i", "j").filter("node1 <> node2")


def _pairwise(sources: DataFrame, targets: DataFrame, columns: list[str], score: Column, without: DataFrame | None = None) -> DataFrame:
    """(node1, node2, similarity) of all pairs, by an expression over a_ and b_ columns."""
    pairs = _blocks(sources.select("id", *(F.col(c).alias(f"a_{c}") for c in columns)), targets.select("id", *(F.col(c).alias(f"b_{c}") for c in columns))).select("node1", "node2", score.alias("similarity"))
    return pairs if without is None else pairs.join(without, ["node1", "node2"], "left_anti")


def _by_vectors(sources: DataFrame, targets: DataFrame, column: str, kind: Score, score: Column, k: int, bottom: bool = False, without: DataFrame | None = None) -> DataFrame:
    """The k best a source of _pairwise(). Pairs of vectors of the usual length whose numbers are all there
    and in range are scored by nearest(), all others by the expression."""
    size = targets.filter(F.size(column) > 0).groupBy(F.size(column).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    dim = size["n"] if size else 0
    if kind.shift is not None and (len(kind.shift) != dim or not (np.abs(kind.shift) < 1e70).all()):
        dim = 0
    length = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, v: s + v * v))
    # in range: squares and products neither overflow nor vanish
    good = F.coalesce((F.size(column) == dim) & F.forall(column, lambda v: v.isNotNull() & ((v == 0) | F.abs(v).between(1e-70, 1e70))) & ((length == 0) | length.between(1e-70, 1e70)), F.lit(False)) if dim else F.lit(False)
    mark = lambda df: df.withColumn("__good", good)
    sources, targets = mark(sources), mark(targets)
    split = lambda df, yes: df.filter(F.col("__good") if yes else ~F.col("__good"))
    found = nearest(split(sources, True).select("id", F.col(column).alias("x")), split(targets, True).select("id", F.col(column).alias("x")), dim, kind, k, without) if dim else None
    if found is not None:
        found = found.select("node1", "node2", (-F.col("score") if bottom else F.col("score")).alias("similarity"))
    rest = None
    for a, b in ((split(sources, False), targets), (split(sources, True), split(targets, False))):
        if not a.isEmpty() and not b.isEmpty():
            more = _pairwise(a, b, [column], score, without)
            rest = more if rest is None else rest.unionByName(more)
    both = [x for x in (found, rest) if x is not None]
    if not both:
        return sources.limit(0).select(F.col("id").alias("node1"), F.col("id").alias("node2"), F.lit(0.0).alias("similarity"))
    return top(both[0] if len(both) == 1 else both[0].unionByName(both[1]), "node1", k, bottom)


def _exact(nodes: DataFrame, props: dict[str, str], types: dict[str, str], k: int, sources: DataFrame | None, targets: DataFrame | None) -> DataFrame:
    among = lambda ids, name: nodes if ids is None else cut(nodes.join(ids.withColumnRenamed(name, "id"), "id", "left_semi"))
    a, b = among(sources, "node1"), among(targets, "node2")
    value = sum((property_metric(types[p], m, F.col(f"a_{p}"), F.col(f"b_{p}")) for p, m in props.items()), F.lit(0.0)) / len(props)
    [(name, metric), *others] = props.items()
    metric = "COSINE" if metric.upper() == "DEFAULT" and types[name] in ("array<double>", "array<float>") else metric.upper()
    if others or not types[name].startswith("array") or metric not in ("COSINE", "EUCLIDEAN", "PEARSON"):
        return top(_pairwise(a, b, list(props), value), "node1", k)
    double = lambda df: df.withColumn(name, F.col(name).cast("array<double>"))
    return _by_vectors(double(a), double(b), name, Score(metric), value, k)


def _descent(nodes, props, types, k, rate, delta, rounds, random_joins, seed, sources, targets, n) -> DataFrame:
    # random picks are the ids of a hash bucket; only targets are dealt into buckets, about four to each
    pool = nodes.select("id") if targets is None else cut(nodes.select("id").join(targets.withColumnRenamed("node2", "id"), "id", "left_semi"))
    buckets = max(1, (n if targets is None else pool.count()) // 4)
    pool = cut(pool.select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(buckets)).alias("bk")))

    def random_pairs(count: int, r: int) -> DataFrame:
        draw = F.pmod(F.xxhash64("id", "t", F.lit(seed + r)), F.lit(buckets))
        picks = nodes.select("id", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("t")).select(F.col("id").alias("node1"), draw.alias("bk"))
        return picks.join(pool.withColumnRenamed("id", "node2"), "bk").filter("node1 <> node2").select("node1", "node2").distinct()

    best = cut(top(_scored(random_pairs(k, 0), nodes, props, types), "node1", k).withColumn("new", F.lit(True)))
    for r in range(1, rounds + 1):
        sampled = lambda c: F.pmod(F.xxhash64("node1", "node2", F.lit(seed + r), F.lit(c)), F.lit(1000)) < int(1000 * rate)  # noqa: E731, B023
        near = best.filter(sampled(1)).select(F.col("node1").alias("mid"), F.col("node2").alias("x"), "new")
        # a node's reverse neighbours can be very many; as many as its own are sampled
        back = best.filter(sampled(2)).select(F.col("node2").alias("mid"), F.col("node1").alias("x"), "new")
        order = W.partitionBy("mid").orderBy(F.xxhash64("x", F.lit(seed + r)))
        back = back.withColumn("q", F.row_number().over(order)).filter(F.col("q") <= k).drop("q")
        around = near.unionByName(back).groupBy("mid", "x").agg(F.max("new").alias("new"))
        met = around.toDF("mid", "node1", "n1").join(around.toDF("mid", "node2", "n2"), "mid").filter("node1 <> node2 AND (n1 OR n2)").select("node1", "node2")
        tried = met.unionByName(random_pairs(random_joins, r)).distinct()
        if targets is not None:
            tried = tried.join(targets, "node2", "left_semi")
        tried = _scored(tried.join(best.select("node1", "node2"), ["node1", "node2"], "left_anti"), nodes, props, types).withColumn("new", F.lit(True))
        best = cut(top(best.withColumn("new", F.lit(False)).unionByName(tried), "node1", k))
        if best.filter("new").count() <= delta * k * n:
            break
    best = best.drop("new")
    return best if sources is None else best.join(sources, "node1", "left_semi")


def filtered_knn(view: View, node_properties, **config) -> DataFrame:
    return knn(view, node_properties, **config)


# ---- link prediction functions: a score for each row of pairs (node1, node2) ----------------


def _neighbourhoods(view: View, direction: str) -> DataFrame:
    v = {"OUTGOING": view, "INCOMING": view.reversed(), "BOTH": view.both_ways()}[direction.upper()]
    return v.edges.select("src", "dst").distinct()


def _common(view: View, pairs: DataFrame, direction: str, score: Column, name: str) -> DataFrame:
    links = _neighbourhoods(view, direction)
    degree = view.both_ways().edges.groupBy(F.col("src").alias("m")).agg(F.count("*").alias("deg"))
    asked = pairs.select("node1", "node2").distinct()
    met = asked.filter("node1 <> node2").join(links.toDF("node1", "m"), "node1").join(links.toDF("node2", "m"), ["node2", "m"])
    found = met.join(degree, "m").groupBy("node1", "node2").agg(score.alias(name))
    return pairs.join(found, ["node1", "node2"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def common_neighbors(view: View, pairs: DataFrame, direction: str = "BOTH") -> DataFrame:
    return _common(view, pairs, direction, F.count("*").cast("double"), "score")


def adamic_adar(view: View, pairs: DataFrame, direction: str = "BOTH") -> DataFrame:
    return _common(view, pairs, direction, F.sum(1 / F.log("deg")), "score")


def resource_allocation(view: View, pairs: DataFrame, direction: str = "BOTH") -> DataFrame:
    return _common(view, pairs, direction, F.sum(1 / F.col("deg")), "score")


def _sizes(view: View, pairs: DataFrame, direction: str, distinct: bool) -> DataFrame:
    links = {"OUTGOING": view, "INCOMING": view.reversed(), "BOTH": view.both_ways()}[direction.upper()].edges.select("src", "dst")
    degree = (links.distinct() if distinct else links).groupBy("src").agg(F.count("*").cast("double").alias("d"))
    out = pairs.join(degree.toDF("node1", "d1"), "node1", "left").join(degree.toDF("node2", "d2"), "node2", "left")
    return out.fillna(0.0, ["d1", "d2"])


def preferential_attachment(view: View, pairs: DataFrame, direction: str = "BOTH") -> DataFrame:
    return _sizes(view, pairs, direction, False).withColumn("score", F.col("d1") * F.col("d2")).drop("d1", "d2")


def total_neighbors(view: View, pairs: DataFrame, direction: str = "BOTH") -> DataFrame:
    links = _neighbourhoods(view, direction)
    asked = pairs.select("node1", "node2").distinct()
    met = asked.join(links.toDF("node1", "m"), "node1").join(links.toDF("node2", "m"), ["node2", "m"]).groupBy("node1", "node2").agg(F.count("*").alias("c"))
    out = _sizes(view, pairs, direction, True).join(met, ["node1", "node2"], "left")
    return out.withColumn("score", F.col("d1") + F.col("d2") - F.coalesce("c", F.lit(0))).drop("d1", "d2", "c")


def same_community(view: View, pairs: DataFrame, community_property: str = "community") -> DataFrame:
    of = view.nodes.select("id", F.col(community_property).alias("c"))
    out = pairs.join(of.toDF("node1", "c1"), "node1", "left").join(of.toDF("node2", "c2"), "node2", "left")
    return out.withColumn("score", F.coalesce((F.col("c1") == F.col("c2")).cast("double"), F.lit(0.0))).drop("c1", "c2")


def kge_predict(view: View, node_embedding_property: str, relationship_type_embedding: list[float], scoring_function: str, top_k: int, source_node_filter=None, target_node_filter=None) -> DataFrame:
    """(node1, node2, score): for each source the targets with the best score of the triple under
    TransE (distance, smaller is better) or DistMult; pairs linked already are left out."""
    e = F.col(node_embedding_property).cast("array<double>")
    nodes = cut(view.nodes.filter(F.col(node_embedding_property).isNotNull()).select("id", e.alias("x"), *(["labels"] if "labels" in view.nodes.columns else [])))
    rel = F.array(*(F.lit(float(v)) for v in relationship_type_embedding))
    a, b = (nodes if ids is None else cut(nodes.join(ids.toDF("id"), "id", "left_semi")) for ids in (_among(nodes, source_node_filter, "node1"), _among(nodes, target_node_filter, "node2")))
    if scoring_function.lower() == "transe":
        terms = F.zip_with(F.zip_with("a_x", rel, lambda x, y: x + y), "b_x", lambda x, y: (x - y) * (x - y))
        score = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))
    elif scoring_function.lower() == "distmult":
        terms = F.zip_with(F.zip_with("a_x", rel, lambda x, y: x * y), "b_x", lambda x, y: x * y)
        score = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    else:
        raise ValueError(f"no scoring function {scoring_function}")
    linked = cut(view.edges.select(F.col("src").alias("node1"), F.col("dst").alias("node2")).distinct())
    kind = Score(scoring_function.upper(), np.array([float(v) for v in relationship_type_embedding]))
    found = _by_vectors(a, b, "x", kind, score, top_k, kind.kind == "TRANSE", None if linked.isEmpty() else linked)
    return found.withColumnRenamed("similarity", "score")
