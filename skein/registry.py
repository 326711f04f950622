"""All registered queries over the graphs of plans/example_graphs.py, and SQL to hold them against.

Doubles are rounded to six places on both sides. Iterative operators have their rounds unrolled in
SQL. Operators whose results are drawn, learned or one of several right ones have no SQL; tests
hold them against definitions and invariants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.engine import Engine
from skein.functions import vectors as vec
from skein.operators import centrality, community, embeddings, ml, paths, sampling, similarity
from skein.plans.example_graphs import CHAIN_SQL, PLACES_SQL, PURCHASES_SQL, chain, places, purchases, table, vectors
from skein.plans.iterate import cut, pregel
from skein.sources.export import stream_node_properties, stream_relationship_properties
from skein.sources.project import filter_graph, from_edges, from_store, generate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- similarity --------------------------------------------------------------------------------


def _similar(value: str, weighted: bool = False) -> str:
    size = "count(*) AS n" + (", sum(w) AS s, sqrt(sum(w * w)) AS l" if weighted else "")
    links = "SELECT src, dst, min(w) AS w FROM purchases GROUP BY src, dst" if weighted else "SELECT DISTINCT src, dst FROM purchases"
    more = ", sum(least(a.w, b.w)) AS lw, sum(a.w * b.w) AS pw" if weighted else ""
    return f"""
WITH {PURCHASES_SQL}, e AS ({links}), d AS (SELECT src, {size} FROM e GROUP BY src),
c AS (SELECT a.src AS node1, b.src AS node2, count(*) AS common{more} FROM e AS a JOIN e AS b ON a.dst = b.dst AND a.src <> b.src GROUP BY a.src, b.src),
s AS (SELECT node1, node2, {value} AS similarity FROM c JOIN d AS x ON x.src = node1 JOIN d AS y ON y.src = node2),
r AS (SELECT *, row_number() OVER (PARTITION BY node1 ORDER BY similarity DESC, node2) AS k FROM s WHERE similarity > 0)
SELECT node1, node2, round(similarity, 6) AS similarity FROM r WHERE k <= 10"""


@query(_similar("CAST(common AS DOUBLE) / (x.n + y.n - common)"))
def node_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: parts that are bought together."""
    return rounded(similarity.node_similarity(purchases(spark, sf_dir).view()), "similarity")


@query(_similar("CAST(common AS DOUBLE) / least(x.n, y.n)"))
def node_similarity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.node_similarity(purchases(spark, sf_dir).view(), "OVERLAP"), "similarity")


@query(_similar("CAST(common AS DOUBLE) / sqrt(x.n * y.n)"))
def node_similarity_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.node_similarity(purchases(spark, sf_dir).view(), "COSINE"), "similarity")


@query(_similar("lw / (x.s + y.s - lw)", True))
def node_similarity_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.node_similarity(purchases(spark, sf_dir).view(weight="quantity")), "similarity")


@query(_similar("CAST(common AS DOUBLE) / (x.n + y.n - common)").replace("FROM r WHERE k <= 10", "FROM (SELECT *, row_number() OVER (PARTITION BY node1 ORDER BY similarity DESC, node2) AS q FROM r WHERE node2 % 4 = 0) WHERE q <= 10").replace("SELECT node1, node2, round", "SELECT node1, node2, round"))
def node_similarity_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets only among parts with an even key, given as a label."""
    graph = purchases(spark, sf_dir).with_label("Even", F.col("nodeId") % 4 == 0)
    return rounded(similarity.filtered_node_similarity(graph.view(), target_node_filter="Even"), "similarity")


@query("""
WITH p AS (SELECT a.vec_id AS node1, b.vec_id AS node2, (list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) + 1) / 2 AS similarity FROM embeddings AS a JOIN embeddings AS b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY node1 ORDER BY similarity DESC, node2) AS k FROM p)
SELECT node1, node2, round(similarity, 6) AS similarity FROM r WHERE k <= 10""")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.knn(vectors(spark, sf_dir), "embedding"), "similarity")


@query("""
WITH p AS (SELECT a.vec_id AS node1, b.vec_id AS node2, 1 / (1 + list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS similarity FROM embeddings AS a JOIN embeddings AS b ON a.vec_id <> b.vec_id WHERE a.label = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY node1 ORDER BY similarity DESC, node2) AS k FROM p)
SELECT node1, node2, round(similarity, 6) AS similarity FROM r WHERE k <= 5""")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = vectors(spark, sf_dir)
    zero = F.when(F.col("label") == 0, F.array(F.lit("Vector"), F.lit("Zero"))).otherwise(F.col("labels"))
    view = type(view)(view.nodes.withColumn("labels", zero), view.edges)
    return rounded(similarity.filtered_knn(view, {"embedding": "EUCLIDEAN"}, top_k=5, source_node_filter="Zero"), "similarity")


@query("""
WITH p AS (SELECT a.vec_id AS node1, b.vec_id AS node2, list_distance(list_transform(CAST(a.embedding AS DOUBLE[]), lambda x: x + 0.1::DOUBLE), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings AS a JOIN embeddings AS b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY node1 ORDER BY score, node2) AS k FROM p)
SELECT node1, node2, round(score, 6) AS score FROM r WHERE k <= 3""")
def kge_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.kge_predict(vectors(spark, sf_dir), "embedding", [0.1] * 64, "TransE", 3), "score")


@query("""
WITH p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_cosine_similarity(x, y), 6) AS cosine, round(list_distance(x, y), 6) AS distance, round(1 / (1 + list_distance(x, y)), 6) AS euclidean,
  round(list_cosine_similarity(list_transform(x, lambda v: v - list_avg(x)), list_transform(y, lambda v: v - list_avg(y))), 6) AS pearson FROM p""")
def similarity_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    p = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return p.select("vec_id", F.round(vec.cosine("x", "y"), 6).alias("cosine"), F.round(vec.euclidean_distance("x", "y"), 6).alias("distance"), F.round(vec.euclidean("x", "y"), 6).alias("euclidean"), F.round(vec.pearson("x", "y"), 6).alias("pearson"))


_PAIRS = "pairs AS (SELECT id AS node1, id + 1 AS node2 FROM nodes WHERE id + 1 IN (SELECT id FROM nodes))"


@query(f"""
WITH {CHAIN_SQL}, {_PAIRS}, l AS (SELECT DISTINCT src, dst FROM both_ways), deg AS (SELECT src, count(*) AS d FROM both_ways GROUP BY src), sz AS (SELECT src, count(*) AS d FROM l GROUP BY src),
m AS (SELECT node1, node2, count(*) AS cn, sum(1 / ln(d)) AS aa, sum(1.0::DOUBLE / d) AS ra FROM pairs JOIN l AS x ON x.src = node1 JOIN l AS y ON y.src = node2 AND y.dst = x.dst JOIN deg ON deg.src = x.dst GROUP BY node1, node2)
SELECT node1, node2, CAST(coalesce(cn, 0) AS DOUBLE) AS common, round(coalesce(aa, 0), 6) AS adamic, round(coalesce(ra, 0), 6) AS resource,
  CAST(coalesce(a.d, 0) * coalesce(b.d, 0) AS DOUBLE) AS preferential, CAST(coalesce(s.d, 0) + coalesce(t.d, 0) - coalesce(cn, 0) AS DOUBLE) AS total, CAST(p.p_size = q.p_size AS INTEGER)::DOUBLE AS same
FROM pairs LEFT JOIN m USING (node1, node2) LEFT JOIN deg AS a ON a.src = node1 LEFT JOIN deg AS b ON b.src = node2 LEFT JOIN sz AS s ON s.src = node1 LEFT JOIN sz AS t ON t.src = node2
JOIN nodes AS p ON p.id = node1 JOIN nodes AS q ON q.id = node2""")
def link_prediction_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = chain(spark, sf_dir).view()
    pairs = view.ids.select(F.col("id").alias("node1"), (F.col("id") + 1).alias("node2")).join(view.ids.withColumnRenamed("id", "node2"), "node2", "left_semi")
    out = similarity.common_neighbors(view, pairs).withColumnRenamed("score", "common")
    for f, name in ((similarity.adamic_adar, "adamic"), (similarity.resource_allocation, "resource"), (similarity.preferential_attachment, "preferential"), (similarity.total_neighbors, "total")):
        out = out.join(f(view, pairs).withColumnRenamed("score", name), ["node1", "node2"])
    out = out.join(similarity.same_community(view, pairs, "p_size").withColumnRenamed("score", "same"), ["node1", "node2"])
    return rounded(out, "adamic", "resource")


# ---- centrality --------------------------------------------------------------------------------


def _rank(divisor: str, rounds: int = 19) -> str:
    steps = [f"WITH {CHAIN_SQL}, g AS (SELECT src, dst, sum(w) AS w, count(*) AS c FROM chain GROUP BY src, dst), deg AS (SELECT src, CAST(count(*) AS DOUBLE) AS d FROM chain GROUP BY src), av AS (SELECT (SELECT count(*) FROM chain) / CAST((SELECT count(*) FROM nodes) AS DOUBLE) AS a), p AS MATERIALIZED (SELECT g.src, g.dst, g.c / {divisor} AS p FROM g JOIN deg USING (src), av)"]
    steps.append("r0 AS (SELECT id, 0.15::DOUBLE AS rank, 0.15::DOUBLE AS delta FROM nodes)")
    for k in range(1, rounds + 1):
        first = "" if k == 1 else " WHERE delta > 1e-7"
        steps.append(f"r{k} AS MATERIALIZED (SELECT r.id, r.rank + 0.85 * coalesce(m.s, 0) AS rank, 0.85 * coalesce(m.s, 0) AS delta FROM r{k - 1} AS r LEFT JOIN (SELECT p.dst AS id, sum(p.p * q.delta) AS s FROM p JOIN (SELECT * FROM r{k - 1}{first}) AS q ON q.id = p.src GROUP BY p.dst) AS m USING (id))")
    return ",\n".join(steps) + f"\nSELECT id AS \"nodeId\", round(rank, 6) AS score FROM r{rounds}"


@query(_rank("d"))
def page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.page_rank(chain(spark, sf_dir).view()), "score")


@query(_rank("(d + a)"))
def article_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.article_rank(chain(spark, sf_dir).view()), "score")


def _eigen(rounds: int = 20) -> str:
    steps = [f"WITH {CHAIN_SQL}, g AS MATERIALIZED (SELECT src, dst, CAST(count(*) AS DOUBLE) AS c FROM chain GROUP BY src, dst), n0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank, CAST(NULL AS DOUBLE) AS nxt FROM nodes)"]
    for k in range(1, rounds + 1):
        m = f"LEFT JOIN (SELECT g.dst AS id, sum(g.c * q.nxt) AS s FROM g JOIN n{k - 1} AS q ON q.id = g.src GROUP BY g.dst) AS m USING (id)"
        steps.append(f"x{k} AS MATERIALIZED (SELECT n.id, n.rank + coalesce(m.s, 0) AS nxt FROM n{k - 1} AS n {m}), n{k} AS MATERIALIZED (SELECT id, nxt / (SELECT sqrt(sum(nxt * nxt)) FROM x{k}) AS rank, nxt FROM x{k})")
    return ",\n".join(steps) + f"\nSELECT id AS \"nodeId\", round(rank, 6) AS score FROM n{rounds}"


@query(_eigen())
def eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.eigenvector(chain(spark, sf_dir).view(), tolerance=0.0), "score")


def _hits(rounds: int = 20) -> str:
    steps = [f"WITH {CHAIN_SQL}, g AS MATERIALIZED (SELECT src, dst, CAST(count(*) AS DOUBLE) AS c FROM chain GROUP BY src, dst), h0 AS (SELECT id, 1.0::DOUBLE AS v FROM nodes)"]
    for k in range(1, rounds + 1):
        for new, old, frm, to in ((f"a{k}", f"h{k - 1}", "src", "dst"), (f"h{k}", f"a{k}", "dst", "src")):
            steps.append(f"u_{new} AS MATERIALIZED (SELECT n.id, coalesce(m.v, 0) AS v FROM nodes AS n LEFT JOIN (SELECT g.{to} AS id, sum(g.c * q.v) AS v FROM g JOIN {old} AS q ON q.id = g.{frm} GROUP BY g.{to}) AS m USING (id)), {new} AS MATERIALIZED (SELECT id, v / (SELECT sqrt(sum(v * v)) FROM u_{new}) AS v FROM u_{new})")
    return ",\n".join(steps) + f"\nSELECT a.id AS \"nodeId\", round(a.v, 6) AS auth, round(h.v, 6) AS hub FROM a{rounds} AS a JOIN h{rounds} AS h USING (id)"


@query(_hits())
def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.hits(chain(spark, sf_dir).view()), "auth", "hub")


@query(f"""WITH {CHAIN_SQL}, d AS (SELECT src AS id, CAST(count(*) AS DOUBLE) AS o FROM chain GROUP BY src), i AS (SELECT dst AS id, CAST(count(*) AS DOUBLE) AS o FROM chain GROUP BY dst), w AS (SELECT src AS id, sum(w) AS o FROM chain WHERE w > 0 GROUP BY src)
SELECT id AS "nodeId", coalesce(d.o, 0) AS score, coalesce(i.o, 0) AS reverse, coalesce(w.o, 0) AS weighted, coalesce(d.o, 0) + coalesce(i.o, 0) AS undirected FROM nodes LEFT JOIN d USING (id) LEFT JOIN i USING (id) LEFT JOIN w USING (id)""")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = chain(spark, sf_dir)
    out = centrality.degree(graph.view())
    for name, found in (("reverse", centrality.degree(graph.view(), "REVERSE")), ("weighted", centrality.degree(graph.view(weight="quantity"))), ("undirected", centrality.degree(graph.view(), "UNDIRECTED"))):
        out = out.join(found.withColumnRenamed("score", name), "nodeId")
    return out


_DEPTHS = f"""WITH RECURSIVE {PLACES_SQL}, walk AS (SELECT id AS s, id AS node, CAST(-1 AS BIGINT) AS prev, 0 AS depth FROM nodes UNION ALL SELECT w.s, e.dst, w.node, w.depth + 1 FROM walk AS w JOIN both_ways AS e ON e.src = w.node AND e.dst <> w.prev)"""


@query(f"""{_DEPTHS}, f AS (SELECT node, count(*) AS n, sum(depth) AS far, sum(1.0::DOUBLE / depth) AS inv FROM walk WHERE depth > 0 GROUP BY node)
SELECT id AS "nodeId", round(coalesce(n / CAST(far AS DOUBLE), 0), 6) AS score, round(coalesce(n / CAST(far AS DOUBLE) * n / ((SELECT count(*) FROM nodes) - 1), 0), 6) AS faust, round(coalesce(inv / ((SELECT count(*) FROM nodes) - 1), 0), 6) AS harmonic FROM nodes LEFT JOIN f ON f.node = id""")
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = places(spark, sf_dir, True).view()
    out = centrality.closeness(view).join(centrality.closeness(view, True).withColumnRenamed("score", "faust"), "nodeId")
    return rounded(out.join(centrality.harmonic(view).withColumnRenamed("score", "harmonic"), "nodeId"), "score", "faust", "harmonic")


@query(f"""WITH {PLACES_SQL}, leaf AS (SELECT src, count(*) AS n FROM has WHERE src % 4 = 1 GROUP BY src), nat AS (SELECT h.src AS reg, h.dst AS id, coalesce(l.n, 0) AS leaves FROM has AS h LEFT JOIN leaf AS l ON l.src = h.dst WHERE h.src % 4 = 0),
reg AS (SELECT reg, sum(leaves + 1) AS t, sum((leaves + 1) * (leaves + 1)) AS sq FROM nat GROUP BY reg),
b AS (SELECT reg AS id, (t * t - sq) / 2.0 AS s FROM reg UNION ALL SELECT id, (t * t - leaves - (t - leaves) * (t - leaves)) / 2.0 FROM nat JOIN reg USING (reg))
SELECT id AS "nodeId", CAST(coalesce(s, 0) AS DOUBLE) AS score FROM nodes LEFT JOIN b USING (id)""")
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On trees: the pairs of nodes that a node separates."""
    return rounded(centrality.betweenness(places(spark, sf_dir, True).view()), "score")


@query(f"""WITH {PLACES_SQL} SELECT id AS "nodeId" FROM nodes WHERE (SELECT count(*) FROM both_ways WHERE src = id) > 1""")
def articulation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.articulation_points(places(spark, sf_dir, True).view())


@query(f"""WITH {PLACES_SQL} SELECT least(src, dst) AS "from", greatest(src, dst) AS "to" FROM has""")
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.bridges(places(spark, sf_dir, True).view())


@query()
def influence_maximization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.celf(places(spark, sf_dir).view(), 3, 0.3, 5)


@query(f"""WITH {PLACES_SQL}, o AS (SELECT src, sum(w) AS t FROM has GROUP BY src), a AS (SELECT dst AS id, 1.0::DOUBLE / t AS e, src FROM has JOIN o USING (src) WHERE src % 4 = 0)
SELECT id AS "nodeId", 1.0::DOUBLE AS exposure, 0 AS hop, CAST(NULL AS BIGINT) AS parent, id AS root FROM nodes WHERE id % 4 = 0
UNION ALL SELECT id, round(e, 6), 1, src, src FROM a UNION ALL SELECT has.dst, round(a.e / o.t, 6), 2, has.src, a.src FROM has JOIN a ON a.id = has.src JOIN o ON o.src = has.src""")
def indirect_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = places(spark, sf_dir).view(weight="cost")
    return rounded(centrality.indirect_exposure(view, view.ids.filter("id % 4 = 0")), "exposure")


# ---- stats --------------------------------------------------------------------------------------


def _stats(spark: SparkSession, graph, endpoint: str, config: dict, *names: str) -> DataFrame:
    """One row of an endpoint's stats."""
    engine = Engine(spark)
    engine.graphs.put("g", graph)
    found = engine.call(f"{endpoint}.stats", "g", config)
    kinds = {bool: "boolean", int: "long", float: "double"}
    values = [round(found[n], 6) if isinstance(found[n], float) else found[n] for n in names]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{n} {kinds[type(v)]}" for n, v in zip(names, values)))


@query(f"""WITH {PLACES_SQL} SELECT count(*) AS "componentCount" FROM nodes WHERE id % 4 = 0""")
def wcc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, places(spark, sf_dir), "wcc", {}, "componentCount")


@query(f"""WITH {CHAIN_SQL}, e AS (SELECT * FROM near WHERE src < dst) SELECT count(*) AS "globalTriangleCount", (SELECT count(*) FROM nodes) AS "nodeCount" FROM e AS x JOIN e AS y ON y.src = x.dst JOIN e AS z ON z.src = x.src AND z.dst = y.dst""")
def triangle_count_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, chain(spark, sf_dir, True), "triangleCount", {}, "globalTriangleCount", "nodeCount")


@query("""SELECT FALSE AS "containsNegativeCycle" """)
def bellman_ford_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, chain(spark, sf_dir), "bellmanFord", {"sourceNode": _least_part(spark, sf_dir), "relationshipWeightProperty": "quantity"}, "containsNegativeCycle")


@query(f"""WITH {CHAIN_SQL}, t AS (SELECT sum(w) AS t FROM both_ways), k AS (SELECT p_size AS c, sum(w) AS k FROM both_ways JOIN nodes ON id = src GROUP BY p_size),
i AS (SELECT a.p_size AS c, sum(w) AS e FROM both_ways JOIN nodes AS a ON a.id = src JOIN nodes AS b ON b.id = dst WHERE a.p_size = b.p_size GROUP BY a.p_size)
SELECT round(sum((coalesce(e, 0) - k * k / t) / t), 6) AS modularity, (SELECT count(DISTINCT p_size) FROM nodes) AS "communityCount", (SELECT count(*) FROM both_ways) AS "relationshipCount" FROM k LEFT JOIN i USING (c), t""")
def modularity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, chain(spark, sf_dir, True), "modularity", {"communityProperty": "p_size", "relationshipWeightProperty": "quantity"}, "modularity", "communityCount", "relationshipCount")


# ---- community ---------------------------------------------------------------------------------


@query(f"""WITH {PLACES_SQL} SELECT id AS "nodeId", CASE WHEN src IS NULL THEN id WHEN src % 4 = 0 THEN src ELSE (SELECT h.src FROM has AS h WHERE h.dst = x.src) END AS "componentId" FROM nodes LEFT JOIN has AS x ON x.dst = id""")
def wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places under one region; its id is the smallest that leads there."""
    found = community.wcc(places(spark, sf_dir).view())
    region = found.filter("nodeId % 4 = 0").select("componentId", F.col("nodeId").alias("region"))
    return found.join(region, "componentId").select("nodeId", F.col("region").alias("componentId"))


@query(f"""WITH {PLACES_SQL} SELECT id AS "nodeId", id AS "componentId" FROM nodes""")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.scc(places(spark, sf_dir).view())


@query(f"""WITH RECURSIVE {CHAIN_SQL}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM chain WHERE src <> dst), hub AS (SELECT src AS id FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
f AS (SELECT id FROM hub UNION SELECT e.dst FROM f JOIN e ON e.src = f.id), b AS (SELECT id FROM hub UNION SELECT e.src FROM b JOIN e ON e.dst = b.id),
core AS (SELECT id FROM f INTERSECT SELECT id FROM b), rest AS MATERIALIZED (SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM core) AND dst NOT IN (SELECT id FROM core)),
r AS (SELECT src AS id, dst AS other FROM rest UNION SELECT r.id, rest.dst FROM r JOIN rest ON rest.src = r.other)
SELECT id AS "nodeId", CASE WHEN id IN (SELECT id FROM core) THEN (SELECT min(id) FROM core) ELSE least(id, coalesce((SELECT min(x.other) FROM r AS x JOIN r AS y ON y.id = x.other AND y.other = x.id WHERE x.id = nodes.id), id)) END AS "componentId" FROM nodes""")
def scc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.scc(chain(spark, sf_dir).view())


def _labels(rounds: int = 9) -> str:
    steps = [f"WITH {CHAIN_SQL}, g AS MATERIALIZED (SELECT src, dst, CAST(count(*) AS DOUBLE) AS c FROM chain GROUP BY src, dst), l0 AS (SELECT id, id AS label FROM nodes)"]
    for k in range(1, rounds + 1):
        steps.append(f"l{k} AS MATERIALIZED (SELECT n.id, coalesce(b.label, n.label) AS label FROM l{k - 1} AS n LEFT JOIN (SELECT src AS id, label FROM (SELECT g.src, q.label, row_number() OVER (PARTITION BY g.src ORDER BY sum(g.c) DESC, q.label) AS k FROM g JOIN l{k - 1} AS q ON q.id = g.dst GROUP BY g.src, q.label) WHERE k = 1) AS b USING (id))")
    return ",\n".join(steps) + f"\nSELECT id AS \"nodeId\", label AS \"communityId\" FROM l{rounds}"


@query(_labels())
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.label_propagation(chain(spark, sf_dir).view())


@query(f"""WITH {CHAIN_SQL}, t AS (SELECT sum(w) AS t FROM both_ways), k AS (SELECT p_size AS c, sum(w) AS k FROM both_ways JOIN nodes ON id = src GROUP BY p_size),
i AS (SELECT a.p_size AS c, sum(w) AS e FROM both_ways JOIN nodes AS a ON a.id = src JOIN nodes AS b ON b.id = dst WHERE a.p_size = b.p_size GROUP BY a.p_size), c AS (SELECT DISTINCT p_size AS c FROM nodes)
SELECT CAST(c AS BIGINT) AS "communityId", round((coalesce(e, 0) - coalesce(k, 0) * coalesce(k, 0) / t) / t, 6) AS modularity FROM c LEFT JOIN k USING (c) LEFT JOIN i USING (c), t""")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = chain(spark, sf_dir, True).view(weight="quantity")
    return rounded(community.modularity(view, view.nodes.select(F.col("id").alias("nodeId"), F.col("p_size").cast("long").alias("communityId"))), "modularity")


@query(f"""WITH {CHAIN_SQL} SELECT CAST(a.p_size AS BIGINT) AS community, round(sum(CASE WHEN a.p_size <> b.p_size THEN w ELSE 0 END) / sum(w), 6) AS conductance FROM chain JOIN nodes AS a ON a.id = src JOIN nodes AS b ON b.id = dst GROUP BY a.p_size""")
def conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = chain(spark, sf_dir).view(weight="quantity")
    return rounded(community.conductance(view, view.nodes.select(F.col("id").alias("nodeId"), F.col("p_size").cast("long").alias("communityId"))), "conductance")


_TRIANGLES = f"""WITH {CHAIN_SQL}, e AS (SELECT * FROM near WHERE src < dst), t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e AS x JOIN e AS y ON y.src = x.dst JOIN e AS z ON z.src = x.src AND z.dst = y.dst),
n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id)"""


@query(f"""{_TRIANGLES} SELECT id AS "nodeId", coalesce(n, 0) AS "triangleCount" FROM nodes LEFT JOIN n USING (id)""")
def triangle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.triangle_count(chain(spark, sf_dir, True).view())


@query(f"""{_TRIANGLES} SELECT a AS "nodeA", b AS "nodeB", c AS "nodeC" FROM t""")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.triangles(chain(spark, sf_dir, True).view())


@query(f"""{_TRIANGLES}, d AS (SELECT src AS id, count(*) AS d FROM near GROUP BY src)
SELECT id AS "nodeId", round(CASE WHEN coalesce(n, 0) = 0 OR d < 2 THEN 0 ELSE 2.0::DOUBLE * n / (d * (d - 1)) END, 6) AS "localClusteringCoefficient" FROM nodes LEFT JOIN n USING (id) LEFT JOIN d USING (id)""")
def local_clustering_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(community.local_clustering_coefficient(chain(spark, sf_dir, True).view()), "localClusteringCoefficient")


def _cores(rounds: int = 45) -> str:
    steps = [f"WITH {CHAIN_SQL}, l AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM both_ways WHERE src <> dst GROUP BY src, dst), s0 AS MATERIALIZED (SELECT id, coalesce((SELECT sum(n) FROM l WHERE src = id), 0) AS v FROM nodes)"]
    for k in range(1, rounds + 1):
        near = f"SELECT l.src, s.v, sum(l.n) AS n FROM l JOIN s{k - 1} AS s ON s.id = l.dst GROUP BY l.src, s.v"
        steps.append(f"s{k} AS MATERIALIZED (SELECT s.id, least(s.v, coalesce(h.h, 0)) AS v FROM s{k - 1} AS s LEFT JOIN (SELECT src, max(least(v, above)) AS h FROM (SELECT src, v, sum(n) OVER (PARTITION BY src ORDER BY v DESC) AS above FROM ({near})) GROUP BY src) AS h ON h.src = s.id)")
    return ",\n".join(steps) + f"\nSELECT id AS \"nodeId\", CAST(v AS BIGINT) AS \"coreValue\" FROM s{rounds}"


@query(_cores())
def k_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.k_core(chain(spark, sf_dir, True).view())


@query(f"""WITH {CHAIN_SQL} SELECT id AS "nodeId", TRUE AS coloured, CAST(0 AS BIGINT) AS clashes, TRUE AS few FROM nodes""")
def k1_coloring_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each node whether it has a colour, how many neighbours have the same one, and whether
    the colour is at most the number of neighbours."""
    view = chain(spark, sf_dir, True).view()
    found = community.k1_coloring(view).select(F.col("nodeId").alias("id"), "color")
    links = view.neighbours().join(found.toDF("src", "a"), "src").join(found.toDF("dst", "b"), "dst")
    near = links.groupBy("src").agg(F.count("*").alias("degree"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("clashes"))
    out = found.join(near, F.col("id") == F.col("src"), "left")
    return out.select(F.col("id").alias("nodeId"), F.col("color").isNotNull().alias("coloured"), F.coalesce("clashes", F.lit(0)).cast("long").alias("clashes"), (F.col("color") <= F.coalesce("degree", F.lit(0))).alias("few"))


@query()
def k1_coloring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.k1_coloring(chain(spark, sf_dir, True).view())


#: Facts that a good partition of the places has: its modularity is at least that of one community
#: a nation, and all of a community hangs together.
_PARTITION_SQL = f"""WITH {PLACES_SQL} SELECT count(*) AS nodes, TRUE AS good, CAST(0 AS BIGINT) AS apart FROM nodes"""


def _partition_facts(spark: SparkSession, sf_dir: str, find: Callable) -> DataFrame:
    view = places(spark, sf_dir, True).view()
    found = cut(find(view).select("nodeId", "communityId"))
    # regions are with one of their nations, all others with their nation or themselves
    nation = view.edges.filter("dst % 4 = 1 AND src % 4 > 1").select(F.col("src").alias("nodeId"), F.col("dst").alias("communityId"))
    base = view.ids.select(F.col("id").alias("nodeId")).join(nation, "nodeId", "left").select("nodeId", F.coalesce("communityId", "nodeId").alias("communityId"))
    q, least = (community.modularity(view, c).agg(F.sum("modularity")).first()[0] for c in (found, base))
    of = found.select(F.col("nodeId").alias("id"), F.col("communityId").alias("c"))
    inside = view.edges.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst").filter("a = b")
    parts = view.ids.join(community.contracted_labels(inside.select("src", "dst")), "id", "left").select("id", F.coalesce("component", "id").alias("part"))
    apart = of.join(parts, "id").groupBy("c").agg(F.countDistinct("part").alias("n")).filter("n > 1").count()
    return spark.createDataFrame([(found.count(), q >= least - 1e-9, apart)], "nodes long, good boolean, apart long")


@query(_PARTITION_SQL)
def louvain_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partition_facts(spark, sf_dir, community.louvain)


@query(_PARTITION_SQL)
def leiden_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partition_facts(spark, sf_dir, community.leiden)


@query()
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.louvain(places(spark, sf_dir, True).view())


@query()
def leiden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.leiden(places(spark, sf_dir, True).view())


@query()
def modularity_optimization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.modularity_optimization(places(spark, sf_dir, True).view())


def _lloyd(rounds: int = 9) -> str:
    near = "SELECT p.vec_id, p.x, arg_min(c.k, (list_distance(p.x, c.m), c.k)) AS k, min(list_distance(p.x, c.m)) AS d FROM p, c{} AS c GROUP BY p.vec_id, p.x"
    steps = ["WITH p AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL), c0 AS (SELECT k, list_transform(range(64), lambda i: v) AS m FROM (VALUES (0, -0.1::DOUBLE), (1, 0.0::DOUBLE), (2, 0.1::DOUBLE)) AS t(k, v))"]
    for r in range(1, rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r - 1)}), m{r} AS (SELECT k, i, avg(v) AS v FROM (SELECT k, unnest(x) AS v, unnest(range(64)) AS i FROM a{r}) GROUP BY k, i), c{r} AS MATERIALIZED (SELECT k, list(v ORDER BY i) AS m FROM m{r} GROUP BY k UNION ALL SELECT k, m FROM c{r - 1} WHERE k NOT IN (SELECT k FROM a{r}))")
    return ",\n".join(steps) + f"\nSELECT vec_id AS \"nodeId\", CAST(k AS BIGINT) AS \"communityId\", round(d, 6) AS \"distanceFromCentroid\" FROM ({near.format(rounds)})"


@query(_lloyd())
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = vectors(spark, sf_dir)
    found = community.kmeans(view, "embedding", 3, delta_threshold=0.0, seed_centroids=[[x] * 64 for x in (-0.1, 0.0, 0.1)])
    return rounded(found.drop("silhouette"), "distanceFromCentroid")


@query(f"""WITH {PLACES_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, CAST(2 AS BIGINT) AS parts, TRUE AS more_than_half""")
def max_k_cut_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a tree's relationships, all of which can be cut, more than half are."""
    view = places(spark, sf_dir, True).view()
    found = community.approx_max_k_cut(view, iterations=3).select(F.col("nodeId").alias("id"), F.col("communityId").alias("c"))
    apart = view.edges.join(found.toDF("src", "a"), "src").join(found.toDF("dst", "b"), "dst").agg(F.avg((F.col("a") != F.col("b")).cast("int")).alias("share"))
    return found.agg(F.count("*").alias("nodes"), F.countDistinct("c").alias("parts")).join(F.broadcast(apart)).select("nodes", "parts", (F.col("share") > 0.5).alias("more_than_half"))


@query()
def max_k_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.approx_max_k_cut(places(spark, sf_dir, True).view(), iterations=3)


@query()
def sllpa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.sllpa(places(spark, sf_dir, True).view(), 5)


# ---- paths -------------------------------------------------------------------------------------


def _distances(rounds: int = 40) -> str:
    steps = [f"WITH {CHAIN_SQL}, g AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM chain GROUP BY src, dst), d0 AS (SELECT min(id) AS id, 0.0::DOUBLE AS d FROM nodes)"]
    for k in range(1, rounds + 1):
        steps.append(f"d{k} AS MATERIALIZED (SELECT id, min(d) AS d FROM (SELECT id, d FROM d{k - 1} UNION ALL SELECT g.dst, q.d + g.w FROM d{k - 1} AS q JOIN g ON g.src = q.id) GROUP BY id)")
    return ",\n".join(steps) + f"\nSELECT id AS \"targetNode\", d AS \"totalCost\" FROM d{rounds}"


def _least_part(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "part").agg(F.min("p_partkey")).first()[0]


def _along(view, found: DataFrame) -> DataFrame:
    """(targetNode, totalCost, pathCost, ends): what the steps of a path cost in the graph, which is
    null for a step that is no relationship, and whether it goes from source to target."""
    found = cut(found)
    steps = found.select("targetNode", F.explode(F.arrays_zip(F.slice("nodeIds", F.lit(1), F.greatest(F.size("nodeIds") - 1, F.lit(0))).alias("src"), F.slice("nodeIds", 2, F.size("nodeIds")).alias("dst"))).alias("s"))
    links = view.edges.groupBy("src", "dst").agg(F.min("weight").alias("w"))
    costs = steps.select("targetNode", "s.src", "s.dst").join(links, ["src", "dst"], "left").groupBy("targetNode").agg(F.sum("w").alias("pathCost"))
    ends = (F.get("nodeIds", F.lit(0)) == F.col("sourceNode")) & (F.element_at("nodeIds", -1) == F.col("targetNode"))
    return found.join(costs, "targetNode", "left").select("targetNode", "totalCost", F.coalesce("pathCost", F.lit(0.0)).alias("pathCost"), ends.alias("ends"))


_PATHS_SQL = _distances().replace('d AS "totalCost"', 'd AS "totalCost", d AS "pathCost", TRUE AS ends')


@query(_PATHS_SQL)
def dijkstra(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = chain(spark, sf_dir).view(weight="quantity")
    return _along(view, paths.dijkstra(view, _least_part(spark, sf_dir)))


@query(_PATHS_SQL)
def delta_stepping(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = chain(spark, sf_dir).view(weight="quantity")
    return _along(view, paths.delta_stepping(view, _least_part(spark, sf_dir), 25.0))


@query(_PATHS_SQL)
def bellman_ford(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = chain(spark, sf_dir).view(weight="quantity")
    return _along(view, paths.bellman_ford_paths(view, _least_part(spark, sf_dir)))


def _hops(rounds: int = 12) -> str:
    return _distances(rounds).replace("min(w) AS w FROM chain", "1 AS w FROM chain").replace('AS "targetNode", d AS "totalCost"', 'AS "nodeId", CAST(d AS BIGINT) AS depth')


@query(_hops())
def bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.bfs(chain(spark, sf_dir).view(), _least_part(spark, sf_dir)).select("nodeId", "depth")


@query()
def dfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.dfs(chain(spark, sf_dir).view(), _least_part(spark, sf_dir))


@query(f"""{_DEPTHS} SELECT s AS "sourceNodeId", node AS "targetNodeId", CAST(depth AS DOUBLE) AS distance FROM walk WHERE depth > 0""")
def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.all_pairs(places(spark, sf_dir, True).view())


@query(f"""WITH {PLACES_SQL} SELECT id AS "nodeId", CASE id % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS "maxDistanceFromSource" FROM nodes""")
def topological_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.topological_sort(places(spark, sf_dir).view(weight="cost"))


@query(f"""WITH {PLACES_SQL}, p AS (SELECT dst AS id, src FROM has)
SELECT CASE WHEN id % 4 = 0 THEN id WHEN id % 4 = 1 THEN p.src ELSE (SELECT q.src FROM p AS q WHERE q.id = p.src) END AS "sourceNode", id AS "targetNode", CASE id % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN 3.0 ELSE 4.0 END AS "totalCost" FROM nodes LEFT JOIN p USING (id)""")
def dag_longest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.dag_longest_path(places(spark, sf_dir).view(weight="cost")).select("sourceNode", "targetNode", "totalCost")


@query(f"""WITH {PLACES_SQL}, n AS (SELECT dst AS id FROM has WHERE src = 0) SELECT CAST(0 AS BIGINT) AS "nodeId", CAST(0 AS BIGINT) AS "parentId", 0.0::DOUBLE AS weight UNION ALL SELECT dst, src, w FROM has WHERE src = 0 OR src IN (SELECT id FROM n)""")
def spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.spanning_tree(places(spark, sf_dir, True).view(weight="cost"), 0)


def _forest_weights(rounds: int = 30) -> str:
    """Of the relationships up to a weight, any spanning forest of least weight has as many as nodes
    lack to the components: told from smallest labels, without a forest."""
    steps = [f"WITH {CHAIN_SQL}, e AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM both_ways WHERE src <> dst GROUP BY src, dst), t AS (SELECT DISTINCT w AS t FROM e), l0 AS MATERIALIZED (SELECT t, id, id AS l FROM t, nodes)"]
    for k in range(1, rounds + 1):
        steps.append(f"n{k} AS MATERIALIZED (SELECT q.t, e.src AS id, min(q.l) AS l FROM l{k - 1} AS q JOIN e ON e.dst = q.id AND e.w <= q.t GROUP BY q.t, e.src), h{k} AS MATERIALIZED (SELECT q.t, q.id, least(q.l, coalesce(n.l, q.l)) AS l FROM l{k - 1} AS q LEFT JOIN n{k} AS n USING (t, id)), l{k} AS MATERIALIZED (SELECT a.t, a.id, least(a.l, b.l) AS l FROM h{k} AS a JOIN h{k} AS b ON b.t = a.t AND b.id = a.l)")
    last = f"c AS (SELECT t, (SELECT count(*) FROM nodes) - count(DISTINCT l) AS n FROM l{rounds} GROUP BY t), d AS (SELECT t, n - coalesce(lag(n) OVER (ORDER BY t), 0) AS n FROM c)"
    return ",\n".join([*steps, last]) + "\nSELECT t AS weight, CAST(n AS BIGINT) AS n FROM d WHERE n > 0"


@query(_forest_weights())
def spanning_forest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many relationships of each weight the forest has."""
    return paths.spanning_forest(chain(spark, sf_dir, True).view(weight="quantity")).groupBy("weight").agg(F.count("*").alias("n"))


@query(_forest_weights())
def spanning_tree_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the tree of the least part, which reaches all parts that have relationships."""
    found = paths.spanning_tree(chain(spark, sf_dir, True).view(weight="quantity"), _least_part(spark, sf_dir))
    return found.filter("nodeId <> parentId").groupBy("weight").agg(F.count("*").alias("n"))


@query()
def k_spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.k_spanning_tree(places(spark, sf_dir, True).view(weight="cost"), 0, 20)


@query()
def yens(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _least_part(spark, sf_dir)
    return paths.yens(chain(spark, sf_dir).view(weight="quantity"), source, source + 1, 3)


@query()
def steiner_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _least_part(spark, sf_dir)
    return paths.steiner_tree(chain(spark, sf_dir).view(weight="quantity"), source, [source + 1, source + 2, source + 3])


@query()
def prize_steiner_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = places(spark, sf_dir, True)
    view = graph.view(weight="cost")
    return paths.prize_steiner_tree(type(view)(view.nodes.withColumn("prize", (F.col("id") % 7).cast("double")), view.edges, True, True), "prize")


@query(f"""WITH {PLACES_SQL} SELECT id AS "nodeId", CAST(2 AS BIGINT) AS walks, CAST(0 AS BIGINT) AS wrong FROM nodes""")
def random_walk_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each node how many walks begin there, and how many steps are along no relationship."""
    view = places(spark, sf_dir, True).view()
    walks = cut(paths.random_walk(view, 5, 2, 0.5, 2.0).select("nodeIds").withColumn("w", F.monotonically_increasing_id()))
    steps = walks.select("w", F.explode(F.arrays_zip(F.slice("nodeIds", F.lit(1), F.size("nodeIds") - 1).alias("src"), F.slice("nodeIds", 2, F.size("nodeIds")).alias("dst"))).alias("s")).select("w", "s.src", "s.dst")
    wrong = steps.join(view.edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").groupBy("w").agg(F.count("*").alias("wrong"))
    first = walks.select("w", F.get("nodeIds", F.lit(0)).alias("nodeId"))
    return first.join(wrong, "w", "left").groupBy("nodeId").agg(F.count("*").alias("walks"), F.coalesce(F.sum("wrong"), F.lit(0)).cast("long").alias("wrong"))


@query()
def random_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.random_walk(places(spark, sf_dir, True).view(), 5, 2, 0.5, 2.0)


@query(f"""WITH {PLACES_SQL} SELECT DISTINCT a.src AS "sourceNodeId", b.dst AS "targetNodeId" FROM has AS a JOIN has AS b ON b.src = a.dst""")
def collapse_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.collapse_path(places(spark, sf_dir), [["HAS", "HAS"]])


# ---- graphs, properties, scalers ----------------------------------------------------------------


@query("""SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS "nodeCount", (SELECT count(*) FROM lineitem) AS "relationshipCount",
round((SELECT count(*) FROM lineitem)::DOUBLE / (((SELECT count(*) FROM part) + (SELECT count(*) FROM orders)) * ((SELECT count(*) FROM part) + (SELECT count(*) FROM orders) - 1)::DOUBLE), 12) AS density""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchases(spark, sf_dir).summary().select("nodeCount", "relationshipCount", F.round("density", 12).alias("density"))


@query(f"""WITH {CHAIN_SQL} SELECT src AS "sourceNodeId", dst AS "targetNodeId", w AS quantity FROM chain WHERE w > 25 AND src IN (SELECT id FROM nodes WHERE p_size >= 20 AND NOT p_size = 30) AND dst IN (SELECT id FROM nodes WHERE p_size >= 20 AND NOT p_size = 30)""")
def filter_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_graph(chain(spark, sf_dir), "n:Part AND n.p_size >= $least AND NOT n.p_size = 30", "r:NEXT AND r.quantity > 25.0", {"least": 20})
    return found.rels.select("sourceNodeId", "targetNodeId", "quantity")


@query(f"""WITH {CHAIN_SQL} SELECT id AS "nodeId" FROM nodes WHERE (SELECT count(*) FROM chain WHERE src = id) > 20""")
def filter_by_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_graph(chain(spark, sf_dir), "degree() > 20").nodes.select("nodeId")


@query(f"""WITH {CHAIN_SQL} SELECT src AS "sourceNodeId", dst AS "targetNodeId", sum(w) AS quantity FROM both_ways GROUP BY src, dst""")
def to_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = chain(spark, sf_dir).to_undirected("NEXT", "BESIDE", "SUM")
    return graph.rels.filter("relationshipType = 'BESIDE'").select("sourceNodeId", "targetNodeId", "quantity")


@query(f"""WITH {CHAIN_SQL} SELECT dst AS "sourceNodeId", src AS "targetNodeId", max(w) AS quantity, count(*)::DOUBLE AS n FROM chain GROUP BY src, dst""")
def project_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"BEFORE": {"type": "NEXT", "orientation": "REVERSE", "properties": {"quantity": {"aggregation": "MAX"}, "n": {"property": "quantity", "aggregation": "COUNT"}}}}
    return from_store(chain(spark, sf_dir), {"Part": {"label": "Part", "properties": ["p_size"]}}, spec).rels.drop("relationshipType")


@query("""SELECT id AS "nodeId", count(*) AS degree FROM (SELECT user_id AS id FROM events UNION ALL SELECT CASE event_type WHEN 'click' THEN -1 WHEN 'view' THEN -2 WHEN 'purchase' THEN -3 ELSE -4 END FROM events) GROUP BY id""")
def project_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and kinds of events as a graph of edge rows; degrees both ways."""
    kind = F.when(F.col("event_type") == "click", -1).when(F.col("event_type") == "view", -2).when(F.col("event_type") == "purchase", -3).otherwise(-4)
    edges = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), kind.cast("long").alias("target"))
    found = centrality.degree(from_edges(edges).view(), "UNDIRECTED")
    return found.select("nodeId", F.col("score").cast("long").alias("degree"))


@query("""SELECT p_partkey AS "nodeId", 'p_size' AS "nodeProperty", CAST(p_size AS VARCHAR) AS "propertyValue" FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part""")
def stream_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("nodeId"), F.array(F.lit("Part")).alias("labels"), "p_size", "p_type")
    from skein.graph import Graph

    graph = Graph(part, chain(spark, sf_dir).rels)
    return stream_node_properties(graph, ["p_size", "p_type"]).drop("nodeLabels")


@query(f"""WITH {CHAIN_SQL} SELECT src AS "sourceNodeId", dst AS "targetNodeId", 'NEXT' AS "relationshipType", 'quantity' AS "relationshipProperty", w AS "propertyValue" FROM chain""")
def stream_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_relationship_properties(chain(spark, sf_dir), ["quantity"])


@query("""WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, avg(p_retailprice) AS mean, stddev_pop(p_retailprice) AS dev, max(abs(p_retailprice)) AS most, sum(abs(p_retailprice)) AS l1, sqrt(sum(p_retailprice * p_retailprice)) AS l2 FROM part)
SELECT p_partkey AS id, round((p_retailprice - lo) / (hi - lo), 6) AS minmax, round(p_retailprice / most, 6) AS max, round((p_retailprice - mean) / (hi - lo), 6) AS mean, round((p_retailprice - mean) / dev, 6) AS stdscore,
round(p_retailprice - mean, 6) AS center, round(ln(p_retailprice + 1), 6) AS log, round(p_retailprice / l1, 9) AS l1norm, round(p_retailprice / l2, 9) AS l2norm FROM part, s""")
def scale_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"))
    out = part
    for s in ("MINMAX", "MAX", "MEAN", "STDSCORE", "CENTER", "LOG", "L1NORM", "L2NORM"):
        out = vec.scale(out.withColumn(s.lower(), F.col("x")), s.lower(), s, 1.0)
    return out.select("id", *(F.round(s, 9 if "norm" in s else 6).alias(s) for s in ("minmax", "max", "mean", "stdscore", "center", "log", "l1norm", "l2norm")))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS DOUBLE) AS l FROM embeddings), u AS (SELECT unnest(range(64)) AS i, unnest(e) AS x FROM v), s AS (SELECT i, min(x) AS lo, max(x) AS hi FROM u GROUP BY i),
a AS (SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM s), b AS (SELECT min(l) AS lo, max(l) AS hi FROM v)
SELECT vec_id AS "nodeId", round((e[1] - a.lo[1]) / (a.hi[1] - a.lo[1]), 6) AS first, round((e[64] - a.lo[64]) / (a.hi[64] - a.lo[64]), 6) AS last, round((l - b.lo) / (b.hi - b.lo), 6) AS label, 65 AS n FROM v, a, b""")
def scale_array_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array and a number, scaled place by place and put one after another."""
    found = vec.scale_properties(vectors(spark, sf_dir), ["embedding", "label"], "MINMAX")
    at = lambda k: F.get("scaledProperty", F.lit(k))
    return rounded(found.select("nodeId", at(0).alias("first"), at(63).alias("last"), at(64).alias("label"), F.size("scaledProperty").alias("n")), "first", "last", "label")


@query("""SELECT p_partkey AS id, CAST(p_size = 1 AS BIGINT) AS a, CAST(p_size = 2 AS BIGINT) AS b, CAST(p_size > 2 AND p_size = 3 AS BIGINT) AS c FROM part""")
def one_hot_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = vec.one_hot(F.array(*map(F.lit, (1, 2, 3))), F.array("p_size"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hot.alias("h")).select("id", *(F.get("h", F.lit(k)).alias(n) for k, n in enumerate("abc")))


@query("""SELECT p_partkey AS id, isfinite(p_retailprice / CASE WHEN p_size = 1 THEN 'Infinity'::DOUBLE ELSE 1 END) AND p_size <> 2 AS finite FROM part""")
def utility_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("p_size") == 2, vec.nan()).otherwise(F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), vec.is_finite(x).alias("finite"))


@query("""SELECT CAST(500 AS BIGINT) AS nodes, CAST(2000 AS BIGINT) AS relationships, CAST(4 AS BIGINT) AS least, CAST(4 AS BIGINT) AS most""")
def generate_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = generate(spark, 500, 4)
    degrees = graph.rels.groupBy("sourceNodeId").count()
    return degrees.agg(F.count("*").alias("nodes"), F.sum("count").alias("relationships"), F.min("count").alias("least"), F.max("count").alias("most"))


_SAMPLE_SQL = f"""WITH {PLACES_SQL} SELECT CAST(round(count(*) * 0.15) AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS strangers, CAST(0 AS BIGINT) AS dangling FROM nodes"""


def _sample_facts(spark: SparkSession, sf_dir: str, draw: Callable) -> DataFrame:
    """How many nodes a sample has, how many of them the graph lacks, and how many of its
    relationships lack an end."""
    graph = places(spark, sf_dir, True)
    found = draw(graph)
    ends = found.rels.select(F.explode(F.array("sourceNodeId", "targetNodeId")).alias("nodeId"))
    counts = (found.nodes.count(), found.nodes.join(graph.nodes, "nodeId", "left_anti").count(), ends.join(found.nodes, "nodeId", "left_anti").count())
    return spark.createDataFrame([counts], "nodes long, strangers long, dangling long")


@query(_SAMPLE_SQL)
def sample_rwr_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample_facts(spark, sf_dir, sampling.rwr)


@query(_SAMPLE_SQL)
def sample_cnarw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample_facts(spark, sf_dir, sampling.cnarw)


@query(f"""WITH {PLACES_SQL} SELECT CASE id % 4 WHEN 0 THEN 'Region' WHEN 1 THEN 'Nation' WHEN 2 THEN 'Supplier' ELSE 'Customer' END AS label, CAST(round(count(*) * 0.15) AS BIGINT) AS nodes FROM nodes GROUP BY id % 4 HAVING round(count(*) * 0.15) > 0""")
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's share of a stratified sample."""
    found = sampling.rwr(places(spark, sf_dir, True), node_label_stratification=True).nodes
    return found.select(F.get("labels", F.lit(0)).alias("label")).groupBy("label").agg(F.count("*").alias("nodes"))


@query()
def sample_rwr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rwr(places(spark, sf_dir, True)).nodes.select("nodeId")


@query()
def sample_cnarw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cnarw(places(spark, sf_dir, True)).nodes.select("nodeId")


@query(f"""WITH RECURSIVE {PLACES_SQL}, d AS (SELECT id, 0 AS d FROM nodes WHERE id % 4 = 0 UNION ALL SELECT has.dst, d.d + 1 FROM d JOIN has ON has.src = d.id) SELECT id, CAST(min(d) AS DOUBLE) AS distance FROM d GROUP BY id""")
def pregel_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vertex program: hops from the regions."""
    view = places(spark, sf_dir).view()
    start = F.when(F.col("id") % 4 == 0, 0.0).otherwise(float("inf"))
    less = F.coalesce(F.col("message") < F.col("distance"), F.lit(False))
    out = pregel(view.ids, view.edges, {"distance": start, "active": F.col("id") % 4 == 0}, F.col("distance") + F.col("weight"), F.min, {"distance": F.when(less, F.col("message")).otherwise(F.col("distance")), "active": less}, 10, F.col("active"))
    return out.select("id", "distance")


# ---- embeddings and learning ---------------------------------------------------------------------


@query()
def fast_rp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.fast_rp(places(spark, sf_dir, True).view(), 16)


@query()
def node2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.node2vec(places(spark, sf_dir, True).view(), 8, 4, 2)


@query()
def hash_gnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.hash_gnn(places(spark, sf_dir, True).view(), 2, 4, generate_features={"dimension": 16, "densityLevel": 2})


@query()
def graph_sage(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = chain(spark, sf_dir, True).view()
    return embeddings.train_graph_sage(view, ["p_size", "p_retailprice"], 8, sample_sizes=(5, 5)).embed(view)


@query("""WITH m AS (SELECT count(DISTINCT least(a.l_partkey, b.l_partkey) * 10000000 + greatest(a.l_partkey, b.l_partkey)) AS m FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
SELECT 'TEST' AS "relationshipType", CAST(2 * round(m * 0.2) AS BIGINT) AS n FROM m UNION ALL SELECT 'REMAINING', CAST(2 * (m - round(m * 0.2)) AS BIGINT) FROM m""")
def split_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ml.split_relationships(chain(spark, sf_dir, True), 0.2, 1.0, "NEXT")
    return found.rels.filter("relationshipType <> 'NEXT'").groupBy("relationshipType").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT a.vec_id AS node1, b.vec_id AS node2, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y, a.label AS k, b.label AS l FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1)
SELECT node1, node2, round(x[1] * y[1], 6) AS hadamard, round((x[1] - y[1]) * (x[1] - y[1]), 6) AS l2, round(list_cosine_similarity(x, y), 6) AS cosine, CAST(k = l AS INTEGER)::DOUBLE AS same FROM p""")
def link_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = vectors(spark, sf_dir).nodes
    pairs = nodes.select(F.col("id").alias("node1"), (F.col("id") + 1).alias("node2"))
    out = ml.link_features(pairs, nodes, [("HADAMARD", ["embedding"]), ("L2", ["embedding"]), ("COSINE", ["embedding"]), ("SAME_CATEGORY", ["label"])])
    at = lambda k: F.get("features", F.lit(k))
    return rounded(out.select("node1", "node2", at(0).alias("hadamard"), at(64).alias("l2"), at(128).alias("cosine"), at(129).alias("same")), "hadamard", "l2", "cosine")


@query("""WITH c AS (SELECT k, sum(CAST(quality = k AND toxic = k AS INTEGER))::DOUBLE AS hit, sum(CAST(quality = k AS INTEGER))::DOUBLE AS truth, sum(CAST(toxic = k AS INTEGER))::DOUBLE AS said FROM labels, (VALUES (0), (1)) AS v(k) GROUP BY k),
f AS (SELECT k, hit, truth, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN truth > 0 THEN hit / truth ELSE 0 END AS r FROM c), g AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM f)
SELECT round(sum(hit) / sum(truth), 6) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * truth) / sum(truth), 6) AS f1_weighted, round(max(CASE WHEN k = 1 THEN p END), 6) AS precision_1, round(max(CASE WHEN k = 1 THEN r END), 6) AS recall_1 FROM g""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("predicted"))
    found = ml.classification_metrics(rows)
    names = {"ACCURACY": "accuracy", "F1_MACRO": "f1_macro", "F1_WEIGHTED": "f1_weighted", "PRECISION(class=1)": "precision_1", "RECALL(class=1)": "recall_1"}
    return spark.createDataFrame([tuple(round(float(found[k]), 6) for k in names)], ", ".join(f"{v} double" for v in names.values()))


@query("""WITH r AS (SELECT l.quality AS y, round(d.n_chars::DOUBLE / (d.n_chars + 1000), 9) AS p FROM labels AS l JOIN documents AS d USING (doc_id) WHERE d.n_chars IS NOT NULL),
g AS (SELECT p, sum(y)::DOUBLE AS tp, sum(1 - y)::DOUBLE AS fp FROM r GROUP BY p), c AS (SELECT p, tp, sum(tp) OVER w AS t, sum(fp) OVER w AS f FROM g WINDOW w AS (ORDER BY p DESC)),
x AS (SELECT tp, t / (t + f) AS now, coalesce(lag(t / (t + f)) OVER (ORDER BY p DESC), 1) AS before FROM c)
SELECT round(sum(tp * (now + before) / 2) / (SELECT sum(y) FROM r), 6) AS aucpr FROM x""")
def auc_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of a text as a score of its quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = F.col("n_chars").cast("double")
    rows = labels.join(docs, "doc_id").filter("n_chars IS NOT NULL").select(F.col("quality").alias("label"), (n / (n + 1000)).alias("probability"))
    return spark.createDataFrame([(round(ml.auc_pr(rows), 6),)], "aucpr double")


@query()
def node_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = vectors(spark, sf_dir)
    pipeline = ml.Pipeline("classification").select_features("embedding").configure_split(validationFolds=2).add("LogisticRegression", maxEpochs=10)
    return ml.predict_nodes(ml.train_node_pipeline(pipeline, view, "label"), view)


@query()
def node_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = chain(spark, sf_dir).view()
    pipeline = ml.Pipeline("regression").select_features("p_size").configure_split(validationFolds=2).add("LinearRegression")
    return ml.predict_nodes(ml.train_node_pipeline(pipeline, view, "p_retailprice", ("MEAN_SQUARED_ERROR",)), view)


@query()
def link_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = places(spark, sf_dir, True).view()
    nodes = view.nodes.withColumn("x", (F.col("id") % 4).cast("double"))
    view = type(view)(nodes, view.edges, True)
    pipeline = ml.Pipeline("link").add_feature("HADAMARD", ["x"]).configure_split(validationFolds=2).add("LogisticRegression", maxEpochs=10)
    model = ml.train_link_pipeline(pipeline, None, view, lambda v: v.nodes)
    return ml.predict_links(model, view, nodes, top_n=50)
