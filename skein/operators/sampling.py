"""Graph samples: random walks with restarts, and walks aware of common neighbours."""

from __future__ import annotations

import itertools
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.graph import Graph, View, within
from skein.operators.draws import drawn, guide, unit
from skein.plans.iterate import cut, is_empty, smallest


def _shared(links: DataFrame) -> DataFrame:
    """(src, dst, c): how many nodes both ends of a link have links to, itself being one. Common ends are
    found in triangles of the links without their direction, each once from its node of least
    degree, so that a node that very many share is not paired with itself for all of these."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    sides = links.filter("src <> dst").groupBy(a.alias("a"), b.alias("b")).agg(F.max(F.col("src") == a).alias("ab"), F.max(F.col("src") == b).alias("ba"))
    sides = cut(sides)
    degree = sides.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    ranked = sides.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    turn = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") > F.col("b")))
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    # from the end of less degree: out tells whether a link goes that way, back whether one comes
    up = cut(ranked.select(pick("a", "b").alias("p"), pick("b", "a").alias("q"), pick("ab", "ba").alias("out"), pick("ba", "ab").alias("back")))
    x, y, z = up.toDF("p", "q", "pq", "qp"), up.toDF("p", "r", "pr", "rp"), up.toDF("q", "r", "qr", "rq")
    met = x.join(y, "p").join(z, ["q", "r"])
    pairs = []
    for s, t, m in itertools.permutations("pqr"):
        pairs.append(F.when(F.col(s + t) & F.col(s + m) & F.col(t + m), F.struct(F.col(s).alias("src"), F.col(t).alias("dst"))))
    third = met.select(F.explode(F.filter(F.array(*pairs), lambda v: v.isNotNull())).alias("v")).select("v.src", "v.dst")
    # loops: of the far end, of the near one if a link leads back to it, and from a node to itself
    loops = links.filter("src = dst").select(F.col("src").alias("at"))
    others = links.filter("src <> dst").select("src", "dst")
    far = others.join(loops.withColumnRenamed("at", "dst"), "dst", "left_semi").select("src", "dst")
    near = others.select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(others, ["src", "dst"], "left_semi").join(loops.withColumnRenamed("at", "src"), "src", "left_semi").select("src", "dst")
    own = links.join(loops.withColumnRenamed("at", "src"), "src", "left_semi").select("src", F.col("src").alias("dst"))
    return third.unionByName(far).unionByName(near).unionByName(own).groupBy("src", "dst").agg(F.count("*").alias("c"))


def _walk(view: View, ratio: float, restart: float, start_nodes, seed: int, walkers: int, common_aware: bool) -> DataFrame:
    """(id) of the nodes seen. walkers walks step together; each goes back to its start with
    probability restart. When three rounds see nothing new, the walks start at nodes not seen yet,
    until the goal is reached or all nodes are seen. A large goal has more walkers."""
    links = cut(view.edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).filter("w > 0 AND NOT isnan(w)"))
    if common_aware:
        # a step to a node of few common neighbours and high degree is likelier
        degree = links.groupBy("src").agg(F.count("*").alias("d"))
        both = links.join(_shared(links), ["src", "dst"], "left").join(degree, "src").join(degree.toDF("dst", "dd"), "dst", "left")
        keep = 1 - F.coalesce("c", F.lit(0)) / F.least("d", F.coalesce("dd", F.lit(1)))
        links = cut(both.select("src", "dst", (F.col("w") * F.greatest(keep, F.lit(0.05))).alias("w")))
    cells, totals = guide(links.withColumnRenamed("w", "weight"))
    goal = max(1, int(view.nodes.count() * ratio + 0.5))
    spark = view.nodes.sparkSession
    seen, attempt, walkers = None, -1, max(walkers, goal // 8)
    while True:
        attempt += 1
        if attempt == 0 and start_nodes:
            start = spark.createDataFrame([(int(i),) for i in start_nodes], "id long")
        else:
            fresh = view.ids if seen is None else view.ids.join(seen, "id", "left_anti")
            start = smallest(fresh, walkers, F.xxhash64("id", F.lit(seed + attempt)), "id")
        walks = start.join(totals, "id", "left").select(F.col("id").alias("start"), F.col("n").alias("start_n"), F.col("total").alias("start_total"), F.col("id").alias("at"), "n", "total")
        walks = cut(walks)
        if is_empty(walks):
            break
        seen = cut(walks.select(F.col("at").alias("id")) if seen is None else seen.unionByName(walks.select(F.col("at").alias("id"))).distinct())
        if seen.count() >= goal:
            return smallest(seen, goal, F.xxhash64("id", F.lit(seed)), "id")
        idle, k = 0, 0
        while idle < 3:
            k += 1
            stepped = drawn(walks, cells, unit("start", F.lit(k), F.lit(seed + attempt)))
            stuck = walks.filter("n IS NULL").withColumns({"dst": F.lit(None).cast("long"), "next_n": F.lit(None).cast("long"), "next_total": F.lit(None).cast("double")})
            back = (unit("start", F.lit(k), F.lit(seed + attempt), F.lit("back")) < restart) | F.col("dst").isNull()
            to = lambda home, on: F.when(back, F.col(home)).otherwise(F.col(on))  # noqa: E731, B023
            walks = cut(stepped.select(*stuck.columns).unionByName(stuck).select("start", "start_n", "start_total", to("start", "dst").alias("at"), to("start_n", "next_n").alias("n"), to("start_total", "next_total").alias("total")), walks)
            before = seen.count()
            seen = cut(seen.unionByName(walks.select(F.col("at").alias("id"))).distinct())
            now = seen.count()
            if now >= goal:
                return smallest(seen, goal, F.xxhash64("id", F.lit(seed)), "id")
            idle = idle + 1 if now == before else 0
    return seen if seen is not None else view.ids.limit(0)


def _stratified(nodes: DataFrame, seen: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Of each combination of labels its share of nodes. Counts by hash bucket tell which buckets
    are taken; only the one in which the share ends is ordered."""
    kind = F.array_join(F.array_sort("labels"), "\n").alias("kind")
    known = nodes.select("nodeId", kind).join(seen.select(F.col("id").alias("nodeId"), F.lit(0).alias("walked")), "nodeId", "left")
    bucket = F.coalesce("walked", F.lit(1)) * 65536 + F.pmod(F.xxhash64("nodeId", F.lit(seed)), F.lit(65536))
    known = cut(known.select("nodeId", "kind", bucket.alias("bucket")))
    counts = known.groupBy("kind", "bucket").agg(F.count("*").alias("n"))
    share = known.groupBy("kind").agg(F.round(F.count("*") * ratio).cast("long").alias("share"))
    before = F.sum("n").over(W.partitionBy("kind").orderBy("bucket")) - F.col("n")
    taken = cut(counts.withColumn("before", before).join(share, "kind").filter("before < share").select("kind", "bucket", (F.col("share") - F.col("before")).alias("left"), "n"))
    kept = known.join(taken, ["kind", "bucket"])
    part = kept.filter("n > left").withColumn("k", F.row_number().over(W.partitionBy("kind", "bucket").orderBy("nodeId"))).filter("k <= left")
    ids = kept.filter("n <= left").select("nodeId").unionByName(part.select("nodeId"))
    return nodes.join(ids, "nodeId", "left_semi")


def sample(graph: Graph, sampling_ratio: float = 0.15, restart_probability: float = 0.1, node_label_stratification: bool = False, start_nodes=(), random_seed: int = 0, weight: str | None = None, walkers: int = 256, common_aware: bool = False) -> Graph:
    """The subgraph of sampling_ratio of the nodes, found by walks. With stratification each
    combination of labels has its own share: of its nodes that were walked on first, then of others,
    each in the order of a seeded hash."""
    view = graph.view(weight=weight)
    seen = _walk(view, sampling_ratio, restart_probability, start_nodes, random_seed, walkers, common_aware)
    nodes = graph.nodes.join(seen.withColumnRenamed("id", "nodeId"), "nodeId", "left_semi")
    if node_label_stratification:
        nodes = _stratified(graph.nodes, seen, sampling_ratio, random_seed)
    nodes = cut(nodes)
    return replace(graph, nodes=nodes, rels=within(graph.rels, nodes))


def rwr(graph: Graph, **config) -> Graph:
    return sample(graph, **config)


def cnarw(graph: Graph, **config) -> Graph:
    return sample(graph, common_aware=True, **config)
