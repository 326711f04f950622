"""Steps whose cost may not grow faster than their input, against plain definitions."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions.vectors import property_metric
from skein.graph import View
from skein.operators import centrality, draws, ml, nearest, paths, sampling, similarity
from skein.plans import iterate
from skein.sources.project import from_tables


def frame(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double")


def star(spark, leaves):
    """Node 0 and its leaves, linked both ways."""
    out = spark.range(1, leaves + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    return View(spark.range(leaves + 1).select("id"), out, False, False).both_ways()


def test_draws_by_weight(spark):
    links = [(0, k, w) for k, w in enumerate((5, 0.25, 0.25, 3, 1e-9, 1.5), 1)] + [(1, 0, 2)]
    cells, totals = draws.guide(frame(spark, links))
    assert cells.count() <= 2 * len(links)
    assert {r["id"]: (r["n"], r["total"]) for r in totals.collect()} == {0: (6, 10 + 1e-9), 1: (1, 2.0)}
    at = totals.filter("id = 0").select(F.col("id").alias("at"), "n", "total").join(spark.range(20000))
    got = Counter(r["dst"] for r in draws.drawn(at, cells, F.col("id") / 20000.0).collect())
    assert sum(got.values()) == 20000  # one link for each u, even at the borders
    assert all(abs(got[k] / 20000 - w / 10) < 1e-3 for _, k, w in links[:-1])


def test_second_order_walks(spark):
    edges = [(0, 1, 1), (1, 0, 2), (1, 2, 1), (0, 2, 1), (1, 3, 1)] + [e for k in range(4, 16) for e in ((1, k, 0.5), (k, 1, 1))]
    v = View(spark.range(16).select("id"), frame(spark, edges), False, True)
    walks = [tuple(r["nodeIds"]) for r in paths.random_walk(v, 3, 20000, 0.5, 2.0, source_nodes=[0]).collect()]
    got = Counter(w[2] for w in walks if w[1] == 1)
    want = {0: 2 / 0.5, 2: 1.0, 3: 0.5} | {k: 0.25 for k in range(4, 16)}
    assert len(walks) == 20000 and all(len(w) == 2 for w in walks if w[1] == 2)  # node 2 has no way out
    assert all(abs(got[k] / got.total() - w / sum(want.values())) < 0.015 for k, w in want.items())


def test_walks_past_a_hub(spark):
    """A step that read all relationships of the hub would read 400 million rows."""
    walks = paths.random_walk(star(spark, 20000), 4, 1, 0.5, 2.0).select(F.get("nodeIds", F.lit(0)).alias("a"), F.size("nodeIds").alias("n"), (F.expr("filter(nodeIds, (x, i) -> i > 0 AND (x = 0) = (nodeIds[i - 1] = 0))")).alias("wrong"))
    assert walks.filter("n = 4 AND size(wrong) = 0").count() == walks.select("a").distinct().count() == 20001


def test_common_ends(spark):
    rng = random.Random(1)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(90)})  # with loops
    got = {(r["src"], r["dst"]): r["c"] for r in sampling._shared(frame(spark, [(*p, 1) for p in pairs])).collect()}
    out = {a: {y for x, y in pairs if x == a} for a in range(14)}
    assert {p: got.get(p, 0) for p in pairs} == {(a, b): len(out[a] & out[b]) for a, b in pairs}


def test_samples_past_a_hub(spark):
    """Leaves of one node, paired with each other, would be 400 million pairs."""
    v = star(spark, 20000)
    graph = from_tables(v.nodes.select(F.col("id").alias("nodeId"), F.array(F.lit("N")).alias("labels")), v.edges.select(F.col("src").alias("sourceNodeId"), F.col("dst").alias("targetNodeId")))
    for f in (sampling.rwr, sampling.cnarw):
        assert f(graph, sampling_ratio=0.1).nodes.count() == 2000


def odd_vectors(spark, n, dim, seed):
    """Vectors with copies, zeros, and some of nulls, NaN, infinities, other lengths, or none at all."""
    rng = random.Random(seed)
    rows = [(i, [float(rng.randint(-3, 3)) if i % 2 else rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(15)] + [(n + 20 + i, [0.0] * dim) for i in range(3)]
    rows += [(n + 30, [1.0, None] + [0.5] * (dim - 2)), (n + 31, [float("nan")] * dim), (n + 32, [1.0] * (dim - 1)), (n + 33, None), (n + 34, [float("inf")] + [0.0] * (dim - 1)), (n + 35, [1e-200] * dim), (n + 36, [])]
    nodes = spark.createDataFrame([(i, x, ["N"]) for i, x in rows], "id long, x array<double>, labels array<string>")
    return View(nodes, frame(spark, [(0, i, 1) for i in range(1, 60)] + [(n, 5, 1)]))


@pytest.mark.parametrize("metric", ["COSINE", "EUCLIDEAN", "PEARSON"])
def test_knn_by_products(spark, metric, monkeypatch):
    """The same to the last bit, and with the same ties, as the expression over all pairs."""
    monkeypatch.setattr(nearest, "TILE", 64)
    v = odd_vectors(spark, 300, 6, 1)
    if metric == "PEARSON":
        v = View(v.nodes.filter("id <> 336"), v.edges)  # an empty array has no mean
    got = similarity.knn(v, {"x": metric}, 7).collect()
    a, b = (v.nodes.select(F.col("id").alias(n), F.col("x").alias(c)) for n, c in (("node1", "a"), ("node2", "b")))
    pairs = a.crossJoin(b).filter("node1 <> node2").select("node1", "node2", property_metric("array<double>", metric, F.col("a"), F.col("b")).alias("similarity"))
    assert sorted(got) == sorted(similarity.top(pairs, "node1", 7).collect())


@pytest.mark.parametrize("kind", ["TransE", "DistMult"])
def test_links_by_products(spark, kind):
    v = odd_vectors(spark, 200, 4, 2)
    v = View(v.nodes.filter("id < 223 OR id = 235"), v.edges)  # scores of others are null or not a number
    rel = [0.5, -1.0, 0.25, 2.0]
    rows, linked = {r["id"]: r["x"] for r in v.nodes.collect()}, {(r["src"], r["dst"]) for r in v.edges.collect()}

    def score(h, t):
        parts = [(a + r - b) * (a + r - b) if kind == "TransE" else a * r * b for a, r, b in zip(h, rel, t)]
        total = 0.0
        for x in parts:
            total += x
        return math.sqrt(total) if kind == "TransE" else -total

    want = set()
    for i, h in rows.items():
        best = sorted((score(h, t), j) for j, t in rows.items() if j != i and (i, j) not in linked)[:5]
        want |= {(i, j, s if kind == "TransE" else -s) for s, j in best}
    assert {tuple(r) for r in similarity.kge_predict(v, "x", rel, kind, 5).collect()} == want


def test_vectors_do_not_move_for_each_other(spark):
    """Each of 12,000 vectors is sent some times, not once for a thousand others."""
    v = View(spark.range(12000).select("id", F.array(*(F.rand(k) for k in range(4))).alias("x")), frame(spark, [(0, 1, 1)]))
    plan = similarity.knn(v, "x", 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and "MapInArrow" in plan


def leafy(spark, seed):
    """A random graph whose nodes have many leaves, a star, a pair, and a node alone."""
    rng = random.Random(seed)
    pairs = {(a, b) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(16)) if a < b} | {(rng.randrange(12), k) for k in range(12, 40)}
    pairs |= {(40, k) for k in range(41, 46)} | {(46, 47)}
    both = View(spark.range(49).select("id"), frame(spark, [(a, b, 1) for a, b in sorted(pairs)])).both_ways()
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(49)}
    far = {}
    for i in near:
        dist, queue = {i: 0}, [i]
        for x in queue:
            for y in sorted(near[x] - set(dist)):
                dist[y] = dist[x] + 1
                queue.append(y)
        far[i] = dist
    return both, near, far


@pytest.mark.parametrize("seed", [1, 2])
def test_leaves_are_told_from_one(spark, seed):
    v, near, far = leafy(spark, seed)
    assert paths.fold_leaves(v)[0].nodes.count() < 30
    got = sorted(tuple(r) for r in paths.all_pairs(v).collect())
    assert got == sorted((i, j, float(d)) for i in far for j, d in far[i].items() if i != j)
    for f, want in ((centrality.closeness, lambda d: len(d) / sum(d) if d else 0), (centrality.harmonic, lambda d: sum(1 / x for x in d) / 48)):
        found = {r["nodeId"]: r["score"] for r in f(v).collect()}
        assert len(found) == 49 and all(abs(found[i] - want([d for d in far[i].values() if d])) < 1e-9 for i in far)

    def count(i, j):
        return 1 if i == j else sum(count(i, k) for k in near[j] if far[i].get(k, 99) == far[i][j] - 1)

    paths_ = {(i, j): count(i, j) for i in far for j in far[i]}
    want = {v_: sum(paths_[i, v_] * paths_[v_, j] / paths_[i, j] for i in far[v_] for j in far[v_] if i < j and v_ not in (i, j) and far[i][v_] + far[v_][j] == far[i][j]) for v_ in far}
    found = {r["nodeId"]: r["score"] for r in centrality.betweenness(v).collect()}
    assert len(found) == 49 and all(abs(found[i] - want[i]) < 1e-9 for i in want)


def test_links_of_few_kinds(spark):
    """The same pairs as from scoring all, without scoring all."""
    v = star(spark, 60)
    nodes = v.nodes.withColumn("x", (F.col("id") % 3).cast("double"))
    rng = random.Random(3)
    more = frame(spark, [(a, b, 1) for a, b in {tuple(sorted(rng.sample(range(1, 61), 2))) for _ in range(400)}])
    v = View(nodes, v.edges.unionByName(View(v.nodes, more).both_ways().edges), True)
    pipeline = ml.Pipeline("link").add_feature("HADAMARD", ["x"]).configure_split(validationFolds=2).add("LogisticRegression", maxEpochs=5)
    model = ml.train_link_pipeline(pipeline, None, v, lambda w: v.nodes)
    everything = ml.predict_links(model, v, nodes).orderBy(F.desc("probability"), "node1", "node2").collect()
    links = v.edges.toDF("node1", "node2", "w").drop("w").distinct()
    for n in (5, 300, len(everything) + 10):
        assert ml._best_of_kinds(model, links, nodes, n, 0.0).collect() == everything[:n]
    assert ml._best_of_kinds(model, links, nodes.withColumn("x", F.rand(1)).unionByName(spark.range(100, 400).select("id", F.rand(2).alias("x"))), 5, 0.0) is None


def one_event_at_a_time(edges, prizes):
    """What _grown() does, an edge or a prize at a time, all edges looked at for each."""
    part, left, grown, members, forest = list(range(len(prizes))), list(prizes), [0.0] * len(prizes), {n: [n] for n in range(len(prizes))}, []
    while active := [c for c in members if left[c] > 1e-12]:
        step, event = min((left[c], (c,)) for c in active)
        for a, b, w in edges:
            speed = (left[part[a]] > 1e-12) + (left[part[b]] > 1e-12)
            if part[a] != part[b] and speed and (w - grown[a] - grown[b]) / speed < step - 1e-12:
                step, event = (w - grown[a] - grown[b]) / speed, (a, b)
        for c in active:
            left[c] -= max(step, 0.0)
            for n in members[c]:
                grown[n] += max(step, 0.0)
        if len(event) == 1:
            left[event[0]] = 0.0
            continue
        forest.append(event)
        x, y = part[event[0]], part[event[1]]
        for n in members[y]:
            part[n] = x
        members[x] += members.pop(y)
        left[x] += left[y]
        left[y] = 0.0
    return forest


@pytest.mark.parametrize("seed", range(8))
def test_growth_by_prizes(seed):
    rng = random.Random(seed)
    n = 60
    draw = (lambda: rng.uniform(0, 6)) if seed % 2 else (lambda: float(rng.randint(0, 6)))
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(120)}) if seed % 2 else [(rng.randrange(k), k) for k in range(1, n)]  # ties in trees only
    edges, prizes = [(a, b, draw() + 1) for a, b in pairs], [draw() for _ in range(n)]
    a, b, w = (np.array(c) for c in zip(*edges))
    assert sorted(paths._grown(a, b, w.astype(float), np.array(prizes))) == sorted(one_event_at_a_time(edges, prizes))


def test_growth_of_a_star():
    """Some rounds, not one for each of 50,000 leaves."""
    n = 50_000
    begun = time.process_time()
    forest = paths._grown(np.zeros(n, int), np.arange(1, n + 1), np.full(n, 2.0), np.arange(n + 1) % 7.0)
    assert len(forest) > n // 2 and time.process_time() - begun < 60


@pytest.mark.parametrize("n", [0, 1, 700, 2999, 3000, 5000])
def test_smallest(spark, n, monkeypatch):
    monkeypatch.setattr(iterate, "LISTED", 0)
    rows = spark.range(1500).select("id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("s"))
    got = iterate.smallest(rows, n, F.xxhash64("id"), "id", "s")
    assert sorted(got.collect()) == sorted(rows.orderBy(F.xxhash64("id"), "id", "s").limit(n).collect())


def test_holdouts_are_not_gathered(spark):
    """Half of 60,000 relationships are held out without a task that lists them."""
    v = spark.range(60000)
    rels = v.select(F.col("id").alias("sourceNodeId"), (F.col("id") + 1).alias("targetNodeId"))
    graph = from_tables(spark.range(60001).select(F.col("id").alias("nodeId"), F.array(F.lit("N")).alias("labels")), rels)
    plan = ml._first(graph.rels, 30000, "sourceNodeId", "targetNodeId")._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 30000" not in plan
    found = ml.split_relationships(graph, 0.5, 0.0).rels.groupBy("relationshipType").count().collect()
    assert {r[0]: r[1] for r in found if r[0] in ("TEST", "REMAINING")} == {"TEST": 30000, "REMAINING": 30000}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_yens_on_few_edges(spark, seed):
    """The cheapest of all loopless paths, found on a part of the edges."""
    rng = random.Random(seed)
    edges = [(*rng.sample(range(9), 2), rng.uniform(0, 5) if seed < 3 else float(rng.randint(0, 3))) for _ in range(30)] + [(20, 21, 1)]
    cost = {}
    for a, b, w in edges:
        cost[a, b] = min(w, cost.get((a, b), w))
    every, stack = [], [([0], [0.0])]
    while stack:
        path, sums = stack.pop()
        if path[-1] == 8:
            every.append((sums[-1], path))
            continue
        stack += [([*path, b], [*sums, sums[-1] + w]) for (a, b), w in cost.items() if a == path[-1] and b not in path]
    v = View(spark.range(22).select("id"), frame(spark, edges), False, True)
    for k in (1, 4, len(every) + 5):
        got = [(r["totalCost"], r["nodeIds"]) for r in paths.yens(v, 0, 8, k).orderBy("index").collect()]
        assert len(got) == min(k, len(every)) and all(abs(c - d) < 1e-9 for (c, _), (d, _) in zip(got, sorted(every)))
        assert len({tuple(p) for _, p in got}) == len(got) and all((c, p) in [(x, y) for x, y in every] or seed < 3 for c, p in got)
    assert paths.yens(v, 0, 21, 2).count() == 0 and [r["nodeIds"] for r in paths.yens(v, 20, 20, 2).collect()] == [[20]]


def test_few_edges_lie_between(spark):
    rng = random.Random(5)
    edges = [(*rng.sample(range(300), 2), rng.randint(1, 50)) for _ in range(3000)]
    v = View(spark.range(300).select("id"), frame(spark, edges), False, True)
    far = paths.shortest_distances(v, v.ids.filter("id = 0")).select(F.col("node").alias("src"), F.col("cost").alias("before"))
    least = far.filter("src = 7").first()["before"]
    assert 0 < paths._between(v.edges.join(far, "src"), 7, least * 1.2).count() < 300
