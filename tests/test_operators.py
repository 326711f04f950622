"""Operators against documented examples, definitions and invariants."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.graph import View
from skein.operators import centrality, community, embeddings, ml, paths, sampling, similarity
from skein.plans.iterate import pregel
from skein.sources.project import from_tables


def view_of(spark, edges, n=None, undirected=False, **columns):
    edges = [(*e, 1.0)[:3] for e in edges]
    ids = range(n) if n else sorted({x for e in edges for x in e[:2]})
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    for name, values in columns.items():
        nodes = nodes.join(spark.createDataFrame(list(enumerate(values)), f"id long, {name} {'array<double>' if isinstance(values[0], list) else 'double'}"), "id", "left")
    v = View(nodes, spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double"), False, True)
    return v.both_ways() if undirected else v


def values(df, key="nodeId", value=None):
    return {r[key]: (r[value] if value else tuple(r)[1]) for r in df.collect()}


PAGES = [(0, 1, 0.2), (0, 3, 0.2), (0, 2, 0.6), (1, 0, 1), (2, 0, 1), (4, 0, 1), (5, 0, 1), (6, 0, 1), (7, 0, 1), (3, 0, 0.8), (3, 4, 0.05), (3, 5, 0.05), (3, 6, 0.05), (3, 7, 0.05)]


def unweighted(v):
    return View(v.nodes, v.edges.withColumn("weight", F.lit(1.0)), v.undirected, False)


def test_page_rank(spark):
    got = values(centrality.page_rank(unweighted(view_of(spark, PAGES))))
    want = {0: 3.215681999884452, 1: 1.0542700552146722, 2: 1.0542700552146722, 3: 1.0542700552146722, 4: 0.3278578964488539}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    personal = values(centrality.page_rank(unweighted(view_of(spark, PAGES)), source_nodes=[4]))
    assert max(personal, key=personal.get) == 0 and personal[5] < personal[4]
    assert max(values(centrality.page_rank(view_of(spark, PAGES), scaler="MAX")).values()) == 1.0


def test_betweenness(spark):
    follows = [(0, 2, 1), (1, 2, 1), (2, 3, 1), (2, 4, 1.3), (3, 5, 1), (4, 5, 0.5), (5, 6, 1)]
    v = view_of(spark, follows)
    assert values(centrality.betweenness(unweighted(v))) == {0: 0, 1: 0, 2: 8, 3: 3, 4: 3, 5: 5, 6: 0}
    assert values(centrality.betweenness(v)) == {0: 0, 1: 0, 2: 8, 3: 0, 4: 6, 5: 5, 6: 0}


def test_hits(spark):
    links = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (4, 1), (4, 3), (4, 5), (4, 7), (5, 6), (5, 8), (5, 7), (6, 7), (6, 8), (7, 8)]
    got = {r["nodeId"]: (r["auth"], r["hub"]) for r in centrality.hits(view_of(spark, links)).collect()}
    want = {1: (0.42644630743935796, 0.3573686670593437), 3: (0.6463862608483191, 0.0), 4: (0.0, 0.640681017095129)}
    assert all(abs(got[k][i] - v[i]) < 1e-6 for k, v in want.items() for i in (0, 1))


def test_closeness_and_harmonic(spark):
    v = view_of(spark, [(0, 1), (1, 2)], 4, True)
    assert values(centrality.closeness(v)) == {0: 2 / 3, 1: 1.0, 2: 2 / 3, 3: 0.0}
    assert values(centrality.harmonic(v)) == {0: 0.5, 1: 2 / 3, 2: 0.5, 3: 0.0}


def random_edges(n, m, seed, weights=False):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randint(1, 9) if weights else 1) for _ in range(m)]


def reach(edges, n):
    links = defaultdict(set)
    for a, b, *_ in edges:
        links[a].add(b)
    out = {}
    for s in range(n):
        seen, stack = {s}, [s]
        while stack:
            for b in links[stack.pop()] - seen:
                seen.add(b)
                stack.append(b)
        out[s] = seen
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    n, edges = 30, random_edges(30, 30, seed)
    v = view_of(spark, edges, n)
    r, u = reach(edges, n), reach(edges + [(b, a) for a, b, _ in edges], n)
    assert values(community.scc(v)) == {i: min(j for j in r[i] if i in r[j]) for i in range(n)}
    assert values(community.wcc(v)) == {i: min(u[i]) for i in range(n)}
    heavy = view_of(spark, [(0, 1, 5), (1, 2, 1)])
    assert values(community.wcc(heavy, threshold=2)) == {0: 0, 1: 0, 2: 2}


@pytest.mark.parametrize("seed", [3, 4])
def test_cut_structure(spark, seed):
    n, edges = 16, random_edges(16, 17, seed)
    v = view_of(spark, edges, n)

    def parts(es, nodes):
        u = reach([e for a, b, _ in es for e in ((a, b), (b, a))], n)
        return len({min(u[i] & nodes) for i in nodes})

    all_ = set(range(n))
    points = {i for i in all_ if parts([e for e in edges if i not in e[:2]], all_ - {i}) > parts(edges, all_)}
    assert {r[0] for r in centrality.articulation_points(v).collect()} == points
    cuts = {tuple(sorted(e[:2])) for k, e in enumerate(edges) if parts(edges[:k] + edges[k + 1 :], all_) > parts(edges, all_)}
    assert {tuple(r) for r in centrality.bridges(v).collect()} == cuts


def test_k_core(spark):
    friends = [(0, 1), (1, 2), (2, 3), (2, 7), (3, 4), (3, 5), (3, 6), (4, 5), (4, 6), (5, 6), (6, 7), (8, 9)]
    assert values(community.k_core(view_of(spark, friends, 10, True))) == {8: 1, 9: 1, 0: 1, 1: 1, 2: 2, 7: 2, 3: 3, 4: 3, 5: 3, 6: 3}


def test_triangles(spark):
    knows = [(1, 2), (1, 3), (4, 1), (5, 1), (5, 4), (0, 1), (4, 3), (3, 2)]
    v = view_of(spark, knows, 6, True)
    assert {k: round(x, 6) for k, x in values(community.local_clustering_coefficient(v)).items()} == {2: 1.0, 5: 1.0, 3: 0.666667, 4: 0.666667, 1: 0.3, 0: 0.0}
    assert community.triangles(v).count() == 3
    assert values(community.triangle_count(v, max_degree=4))[1] == -1


@pytest.mark.parametrize("seed", [5, 6])
def test_colouring(spark, seed):
    edges = random_edges(40, 120, seed)
    color = values(community.k1_coloring(view_of(spark, edges, 40, True)))
    assert all(color[a] != color[b] for a, b, _ in edges if a != b) and None not in color.values()


SOCIAL = [(0, 1, 1), (0, 2, 1), (2, 1, 1), (0, 3, 5), (4, 3, 1), (4, 5, 1), (5, 4, 1)]


def quality(edges, part):
    w = sum(e[2] for e in edges)
    inside = sum(e[2] for e in edges if part[e[0]] == part[e[1]])
    k = Counter()
    for a, b, x in edges:
        k[part[a]] += x / 2
        k[part[b]] += x / 2
    return inside / w - sum(v * v for v in k.values()) / w**2


def test_communities(spark):
    unit = [(a, b, 1) for a, b, _ in SOCIAL]
    v = view_of(spark, unit, undirected=True)
    best = max(quality(unit, dict(enumerate(p))) for p in itertools.product(range(3), repeat=6))
    for f in (community.louvain, community.leiden):
        assert quality(unit, values(f(v))) >= best - 0.05
    got = values(community.modularity(v, v.ids.select(F.col("id").alias("nodeId"), F.when(F.col("id") < 3, 0).otherwise(1).alias("communityId"))), "communityId")
    part = {i: 0 if i < 3 else 1 for i in range(6)}
    assert abs(sum(got.values()) - quality(unit, part)) < 1e-9
    cut = community.conductance(v, v.ids.select(F.col("id").alias("nodeId"), F.when(F.col("id") < 3, 0).otherwise(1).alias("communityId")))
    assert values(cut, "community") == {0: 1 / 7, 1: 1 / 7}
    labels = values(community.label_propagation(v))
    assert set(labels) == set(range(6))
    halves = values(community.approx_max_k_cut(view_of(spark, [(0, 2), (0, 3), (1, 2), (1, 3)], undirected=True)))
    assert halves[0] == halves[1] != halves[2] == halves[3]
    assert all(community.sllpa(v, 4).select(F.size("values")).collect())


def test_kmeans(spark):
    points = [[0.0, 0.0], [0.1, 0.0], [5.0, 5.0], [5.1, 5.0]]
    v = view_of(spark, [(0, 1), (2, 3)], x=points)
    out = community.kmeans(v, "x", 2, seed_centroids=[[0.0, 1.0], [4.0, 4.0]], compute_silhouette=True)
    assert values(out) == {0: 0, 1: 0, 2: 1, 3: 1} and min(r["silhouette"] for r in out.collect()) > 0.9
    free = values(community.kmeans(v, "x", 2, random_seed=1))
    assert free[0] == free[1] != free[2] == free[3]


ROADS = [(0, 1, 50), (0, 2, 50), (0, 3, 100), (1, 3, 40), (2, 3, 40), (2, 4, 80), (3, 4, 30), (3, 5, 80), (4, 5, 40)]


def test_shortest_paths(spark):
    v = view_of(spark, ROADS)
    got = {r["targetNode"]: r for r in paths.dijkstra(v, 0).collect()}
    assert {k: r["totalCost"] for k, r in got.items()} == {0: 0, 1: 50, 2: 50, 3: 90, 4: 120, 5: 160}
    assert got[5]["nodeIds"] == [0, 1, 3, 4, 5] and got[5]["costs"] == [0, 50, 90, 120, 160]
    assert paths.dijkstra(v, 0, [4]).count() == 1
    three = paths.yens(v, 0, 5, 3).orderBy("index").collect()
    assert [(r["totalCost"], r["nodeIds"]) for r in three] == [(160, [0, 1, 3, 4, 5]), (160, [0, 2, 3, 4, 5]), (170, [0, 1, 3, 5])]
    pairs = {(r[0], r[1]): r[2] for r in paths.all_pairs(v).collect()}
    assert pairs[(0, 5)] == 160 and (5, 0) not in pairs
    with pytest.raises(ValueError):
        paths.dijkstra(view_of(spark, [(0, 1, -1)]), 0)
    found, negative = paths.bellman_ford(view_of(spark, [(0, 1, 4), (0, 2, 1), (2, 1, -3), (1, 3, 1)]), 0)
    assert not negative and values(found, "targetNode", "totalCost") == {0: 0, 1: -2, 2: 1, 3: -1}
    found, negative = paths.bellman_ford(view_of(spark, [(0, 1, 1), (1, 2, -3), (2, 1, 1)]), 0)
    assert negative and found.count() == 0
    geo = view_of(spark, [(0, 1, 100), (1, 2, 100), (0, 2, 500)], latitude=[0.0, 1.0, 2.0], longitude=[0.0, 0.0, 0.0])
    assert paths.a_star(geo, 0, 2).first()["nodeIds"] == [0, 1, 2]


def test_traversal(spark):
    v = view_of(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)])
    assert [r[0] for r in paths.bfs(v, 0).orderBy("position").collect()] == [0, 1, 2, 3, 4]
    assert [r[0] for r in paths.bfs(v, 0, [2]).orderBy("position").collect()] == [0, 1, 2]
    assert {r[0] for r in paths.bfs(v, 0, max_depth=1).collect()} == {0, 1, 2}
    assert [r[0] for r in paths.dfs(v, 0).orderBy("position").collect()] == [0, 2, 3, 4, 1]
    assert values(paths.topological_sort(v)) == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}
    cyclic = view_of(spark, [(0, 1), (1, 2), (2, 1), (2, 3)])
    assert set(values(paths.topological_sort(cyclic))) == {0}
    far = {r["targetNode"]: (r["totalCost"], r["nodeIds"]) for r in paths.dag_longest_path(view_of(spark, [(0, 1, 3), (0, 2, 1), (1, 2, 5)])).collect()}
    assert far == {0: (0, [0]), 1: (3, [0, 1]), 2: (8, [0, 1, 2])}
    walks = paths.random_walk(v, 4, 3).collect()
    step = {(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)}
    assert len(walks) == 12 and all((a, b) in step for w in walks for a, b in zip(w["nodeIds"], w["nodeIds"][1:]))


PLACES = [(3, 1, 4), (3, 4, 6), (1, 0, 1), (1, 2, 3), (0, 2, 2), (2, 4, 5), (5, 6, 1)]


def test_trees(spark):
    v = view_of(spark, PLACES, undirected=True)
    tree = {r[0]: (r[1], r[2]) for r in paths.spanning_tree(v, 3).collect()}
    assert tree == {0: (1, 1), 1: (3, 4), 2: (0, 2), 3: (3, 0), 4: (2, 5)}
    heavy = paths.spanning_tree(v, 3, "maximum").agg(F.sum("weight")).first()[0]
    assert heavy == 4 + 6 + 5 + 2
    assert {r[0] for r in paths.k_spanning_tree(v, 3, 3).collect()} == {3, 1, 0}
    steiner = {r[0]: r[1] for r in paths.steiner_tree(view_of(spark, [(0, 1, 10), (0, 5, 1), (1, 2, 1), (2, 3, 1), (2, 4, 1), (5, 2, 1)]), 0, [3, 4]).collect()}
    assert steiner == {0: 0, 5: 0, 2: 5, 3: 2, 4: 2}
    links = [(0, 5, 10), (0, 1, 3), (0, 4, 7), (1, 2, 1), (2, 3, 4), (2, 4, 6), (5, 3, 3)]
    prize = paths.prize_steiner_tree(view_of(spark, links, undirected=True, prize=[5.0, 20.0, 11.0, 10.0, 8.0, 1.0]), "prize")
    assert {frozenset(r[:2]) for r in prize.collect() if r[0] != r[1]} == {frozenset(p) for p in ((0, 1), (1, 2), (3, 2), (4, 2))}


def test_node_similarity(spark):
    likes = [(0, 10), (0, 11), (0, 12), (1, 10), (1, 11), (2, 11), (3, 12), (3, 12)]
    v = unweighted(view_of(spark, likes))
    got = {(r[0], r[1]): r[2] for r in similarity.node_similarity(v).collect()}
    assert got == {(0, 1): 2 / 3, (1, 0): 2 / 3, (0, 2): 1 / 3, (2, 0): 1 / 3, (0, 3): 1 / 3, (3, 0): 1 / 3, (1, 2): 1 / 2, (2, 1): 1 / 2}
    assert similarity.node_similarity(v, top_k=1).count() == 4
    assert similarity.node_similarity(v, top_n=1).first()[:2] == (0, 1)
    assert [tuple(r[:2]) for r in similarity.node_similarity(v, bottom_k=1, source_node_filter=[0]).collect()] == [(0, 2)]
    assert similarity.node_similarity(v, degree_cutoff=2).count() == 2
    many = [(i, 5000) for i in range(1200)]  # one target in several blocks
    big = similarity.node_similarity(unweighted(view_of(spark, many)), top_k=1)
    assert big.count() == 1200 and big.filter("similarity <> 1").count() == 0


def test_knn(spark):
    rng = random.Random(1)
    points = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(120)]
    v = view_of(spark, [(i, (i + 1) % 120) for i in range(120)], x=points)
    exact = {(r[0], r[1]) for r in similarity.knn(v, "x", 5).collect()}
    rough = {(r[0], r[1]) for r in similarity.knn(v, "x", 5, exact_up_to=0, max_iterations=8, sample_rate=1.0).collect()}
    assert len(exact) == 600 and len(exact & rough) / 600 > 0.9


def test_knn_exact_at_any_size_and_rare_targets(spark):
    rng = random.Random(2)
    points = [[rng.gauss(0, 1)] for _ in range(20_100)]
    v = view_of(spark, [(0, 1)], 20_100, x=points)
    got = {(r[0], r[1]) for r in similarity.knn(v, {"x": "EUCLIDEAN"}, 3, source_node_filter=[5, 6]).collect()}
    near = lambda i: sorted((j for j in range(20_100) if j != i), key=lambda j: abs(points[i][0] - points[j][0]))[:3]
    assert got == {(i, j) for i in (5, 6) for j in near(i)}
    few = view_of(spark, [(i, (i + 1) % 400) for i in range(400)], x=points[:400])
    rough = similarity.knn(few, {"x": "EUCLIDEAN"}, 3, exact_up_to=0, max_iterations=2, target_node_filter=[7, 8, 9, 10])
    assert rough.count() == 1200 and {r[0] for r in rough.select("node2").distinct().collect()} <= {7, 8, 9, 10}


def test_embeddings(spark):
    v = view_of(spark, [(i, (i + 1) % 12) for i in range(12)], undirected=True, f=[float(i) for i in range(12)])
    a = values(embeddings.fast_rp(v, 8, feature_properties=["f"], property_ratio=0.5, normalization_strength=-0.5))
    assert a == values(embeddings.fast_rp(v, 8, feature_properties=["f"], property_ratio=0.5, normalization_strength=-0.5)) and {len(x) for x in a.values()} == {8}
    for kind in ({"generate_features": {"dimension": 6, "densityLevel": 2}}, {"feature_properties": ["f"], "binarize_features": {"dimension": 6}}):
        h = values(embeddings.hash_gnn(v, 1, 3, **kind))
        assert {len(x) for x in h.values()} == {6} and {y for x in h.values() for y in x} <= {0.0, 1.0}
    assert {len(x) for x in values(embeddings.hash_gnn(v, 1, 3, generate_features={"dimension": 6, "densityLevel": 2}, output_dimension=4)).values()} == {4}
    assert len(values(embeddings.node2vec(v, 4, 5, 2))) == 12
    for kind in ("MEAN", "POOL"):
        s = values(embeddings.train_graph_sage(v, ["f"], 4, kind, sample_sizes=(3, 3), max_iterations=3).embed(v))
        assert {len(x) for x in s.values()} == {4}


def test_hash_gnn_by_types(spark):
    from skein.graph import Graph

    nodes = spark.createDataFrame([(i, ["N"]) for i in range(30)], "nodeId long, labels array<string>")
    pairs = [(i, (i + 1) % 30) for i in range(30)]
    rels = lambda kinds: spark.createDataFrame([(a, b, k) for (a, b), k in zip(pairs, kinds)], "sourceNodeId long, targetNodeId long, relationshipType string")
    config = {"iterations": 2, "embedding_density": 4, "generate_features": {"dimension": 32, "densityLevel": 3}}
    one, two = Graph(nodes, rels(["A"] * 30)).view(), Graph(nodes, rels(["A", "B"] * 15)).view()
    plain = values(embeddings.hash_gnn(one, **config))
    assert values(embeddings.hash_gnn(two, **config)) == plain  # types say nothing
    assert values(embeddings.hash_gnn(one, heterogeneous=True, **config)) == plain  # one type is as none
    assert values(embeddings.hash_gnn(two, heterogeneous=True, **config)) != plain
    assert values(embeddings.hash_gnn(two.both_ways(), heterogeneous=True, **config)).keys() == plain.keys()


@pytest.mark.parametrize("kind", ["MEAN", "POOL"])
@pytest.mark.parametrize("activation", ["SIGMOID", "RELU"])
def test_graph_sage_gradients(kind, activation):
    """Every weight's gradient against differences of the loss."""
    rng = np.random.default_rng(3)
    labels = {"a": rng.normal(size=(4, 3)), "b": rng.normal(size=(4, 3))}
    pool = lambda a, b: rng.normal(size=(a, b)) if kind == "POOL" else None
    wide = 5 if kind == "POOL" else 3
    layers = [{"own": rng.normal(size=(3, 5)), "near": rng.normal(size=(wide, 5)), "pool": pool(3, 5)}, {"own": rng.normal(size=(5, 5)), "near": rng.normal(size=(5, 5)), "pool": pool(5, 5)}]
    model = embeddings.GraphSageModel(["f"], kind, activation, layers, (3, 2), labels)
    x, label = rng.normal(size=(9, 4)), np.array(list("abababbaa"), object)
    near = [rng.integers(-1, 9, (9, 3)), rng.integers(-1, 9, (9, 2))]
    near[1][0] = near[0][1] = -1
    pairs, other = np.array([(0, 1), (2, 3), (0, 4)]), np.array([5, 6, 0])
    loss = lambda: embeddings.sage_loss(model, x, label, near, pairs, other, 2.0)
    _, grads = loss()
    assert set(grads) == set(model.weights())
    for k, w in model.weights().items():
        for at in [(0, 0), (1, 2), (2, 1)]:
            held = w[at]
            w[at] = held + 1e-6
            above = loss()[0]
            w[at] = held - 1e-6
            below = loss()[0]
            w[at] = held
            assert abs((above - below) / 2e-6 - grads[k][at]) < 1e-5, (k, at)


def test_graph_sage_learns(spark):
    from skein.graph import Graph

    rng = random.Random(1)
    nodes = spark.createDataFrame([(i, ["A" if i % 2 else "B"], rng.gauss(1.0 if i < 20 else -1.0, 0.5)) for i in range(40)], "nodeId long, labels array<string>, f double")
    pairs = [(a, b) for side in (0, 20) for a in range(side, side + 20) for b in rng.sample(range(side, side + 20), 4) if a != b]
    rels = spark.createDataFrame([(a, b, "T") for a, b in pairs], "sourceNodeId long, targetNodeId long, relationshipType string")
    view = Graph(nodes, rels).view().both_ways()
    for more in ({}, {"projected_feature_dimension": 3}):
        m = embeddings.train_graph_sage(view, ["f"], 4, sample_sizes=(3, 3), epochs=8, batch_size=50, learning_rate=0.05, negative_sample_weight=1, **more)
        assert m.metrics["ranEpochs"] == len(m.metrics["epochLosses"]) and m.metrics["epochLosses"][-1] < m.metrics["epochLosses"][0]
        assert {len(x) for x in values(m.embed(view)).values()} == {4}


def test_given_negatives(spark):
    from skein.graph import Graph

    nodes = spark.createDataFrame([(i, ["N"], [float(i % 2), 1.0]) for i in range(60)], "nodeId long, labels array<string>, x array<double>")
    rows = [(i, i + 2, "LINK") for i in range(58)] + [(i, i + 1, "NOT") for i in range(59)]
    graph = Graph(nodes, spark.createDataFrame(rows, "sourceNodeId long, targetNodeId long, relationshipType string"))
    p = ml.Pipeline("link").add_feature("L2", ["x"]).configure_split(validationFolds=2, trainFraction=0.5, testFraction=0.3, negativeRelationshipType="NOT").add("LogisticRegression", maxEpochs=30)
    m = ml.train_link_pipeline(p, graph, graph.view(), lambda w: w.nodes)
    assert m.metrics["test"]["AUCPR"] > 0.99


def test_learning(spark):
    rng = random.Random(2)
    x = [[rng.gauss(2 * (i % 2), 0.3), rng.gauss(0, 1)] for i in range(120)]
    v = view_of(spark, [(i, i + 2) for i in range(118)], 120, True, x=x, y=[float(i % 2) for i in range(120)])
    for trainer, params in (("LogisticRegression", {"maxEpochs": 20}), ("RandomForestClassification", {"numberOfDecisionTrees": {"range": [3, 5]}}), ("MultilayerPerceptron", {"hiddenLayerSizes": [4], "maxEpochs": 30})):
        p = ml.Pipeline("classification").select_features("x").configure_split(validationFolds=2).configure_auto_tuning(2).add(trainer, **params)
        m = ml.train_node_pipeline(p, v, "y", ("F1_WEIGHTED", "ACCURACY"))
        assert m.metrics["test"]["ACCURACY"] > 0.9
    assert ml.predict_nodes(m, v).count() == 120
    p = ml.Pipeline("regression").select_features("x").configure_split(validationFolds=2).add("LinearRegression")
    assert ml.train_node_pipeline(p, v, "y", ("MEAN_SQUARED_ERROR",)).metrics["test"]["MEAN_SQUARED_ERROR"] < 0.1
    p = ml.Pipeline("link").add_feature("L2", ["x"]).configure_split(validationFolds=2, trainFraction=0.5).add("LogisticRegression", maxEpochs=20)
    m = ml.train_link_pipeline(p, None, v, lambda w: w.nodes)
    assert 0 < m.metrics["test"]["AUCPR"] <= 1 and ml.predict_links(m, v, v.nodes, top_n=7).count() == 7
    assert ml.predict_links(m, v, v.nodes, sample_rate=0.5, top_k=2).count() > 0


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, predicted int")
    m = ml.classification_metrics(rows)
    assert m["ACCURACY"] == 0.75 and m["RECALL(class=1)"] == 0.5 and abs(m["F1(class=0)"] - 0.8) < 1e-9
    auc = ml.auc_pr(spark.createDataFrame([(1.0, 0.9), (0.0, 0.8), (1.0, 0.7)], "label double, probability double"))
    assert abs(auc - (0.5 + 0.5 * (0.5 + 2 / 3) / 2)) < 1e-9
    assert ml.auc_pr(spark.createDataFrame([(0.0, 0.9)], "label double, probability double")) == 0.0


@pytest.mark.parametrize("maximum", [False, True])
def test_spanning_forest_with_cycles(spark, maximum):
    """Against a greedy choice of edges in the order of weight and ends, ties and all."""
    rng = random.Random(5)
    edges = list({(min(e), max(e)): (*e, rng.randint(1, 6)) for e in (rng.sample(range(60), 2) for _ in range(170))}.values()) + [(70, 71, 2), (71, 72, 2), (70, 72, 2)]
    up = {x: x for e in edges for x in e[:2]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    want = set()
    for w, a, b in sorted(((-w if maximum else w), min(a, b), max(a, b)) for a, b, w in edges):
        if root(a) != root(b):
            up[root(a)] = root(b)
            want.add((a, b, abs(w)))
    got = paths.spanning_forest(view_of(spark, edges, undirected=True), maximum)
    assert {tuple(r) for r in got.collect()} == want


def test_k_core_random(spark):
    rng = random.Random(9)
    edges = [tuple(rng.sample(range(50), 2)) for _ in range(190)]
    near = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    want, left, k = {}, dict(near), 0
    while left:
        low = [n for n in left if sum(m in left for m in near[n]) <= k]
        if low:
            for n in low:
                want[n] = k
                del left[n]
        else:
            k += 1
    assert values(community.k_core(view_of(spark, edges, 50, True))) == want | {n: 0 for n in range(50) if n not in near}


def test_pregel_targets_and_master(spark):
    v = view_of(spark, [(0, 1), (1, 2), (2, 3)])
    # everyone tells node 3 directly; the master stops after the second superstep
    ends = []
    out = pregel(v.ids, v.edges, {"n": F.lit(0).cast("long")}, F.lit(1).cast("long"), F.count, {"n": F.col("n") + F.coalesce("message", F.lit(0))}, 10, targets=F.array(F.lit(3).cast("long")), master=lambda state, k: bool(ends.append(state.count()) or k == 1))
    assert values(out.select("id", "n"), "id") == {0: 0, 1: 0, 2: 0, 3: 8} and ends == [4, 4]


def test_negatives_when_few_are_left(spark):
    v = view_of(spark, [(a, b) for a in range(6) for b in range(a + 1, 6) if (a, b) not in ((0, 1), (2, 3))], 6)
    assert {tuple(r) for r in ml.negative_pairs(v, 100, 0).collect()} == {(0, 1), (1, 0), (2, 3), (3, 2)}
    assert ml.negative_pairs(v, 3, 0).count() == 3


def test_samples_of_many_small_components(spark):
    nodes = spark.createDataFrame([(i, ["A" if i < 300 else "B"]) for i in range(1200)], "nodeId long, labels array<string>")
    rels = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(600)], "sourceNodeId long, targetNodeId long")
    g = from_tables(nodes, rels, undirected=("*",))
    assert sampling.rwr(g, sampling_ratio=0.8, walkers=2).nodes.count() == 960
    found = sampling.rwr(g, sampling_ratio=0.1, node_label_stratification=True).nodes
    assert {r[0]: r[1] for r in found.groupBy(F.get("labels", F.lit(0))).count().collect()} == {"A": 30, "B": 90}


def test_split_and_samples(spark):
    nodes = spark.createDataFrame([(i,) for i in range(60)], "nodeId long")
    rels = spark.createDataFrame([(i, (i * 7 + 1) % 60) for i in range(60)], "sourceNodeId long, targetNodeId long")
    g = from_tables(nodes, rels, undirected=("*",))
    out = ml.split_relationships(g, 0.2, 1.0)
    n = g.rels.count() // 2
    labels = Counter(r["label"] for r in out.rels.filter("relationshipType = 'TEST'").collect())
    assert labels[1.0] == labels[0.0] and abs(labels[1.0] - 0.2 * n) <= 2
    for f in (sampling.rwr, sampling.cnarw):
        s = f(g, sampling_ratio=0.5, walkers=4)
        assert s.nodes.count() == 30 and s.rels.join(s.nodes, F.col("sourceNodeId") == F.col("nodeId"), "left_anti").count() == 0


def test_celf_and_exposure(spark):
    v = view_of(spark, [(0, i) for i in range(1, 6)] + [(6, i) for i in (7, 8)])
    chosen = centrality.celf(v, 2, 1.0, 3).collect()
    assert [(r[0], r[1]) for r in chosen] == [(0, 6.0), (6, 9.0)]
    e = values(centrality.indirect_exposure(v, v.ids.filter("id = 6")))
    assert e == {6: 1.0, 7: 0.5, 8: 0.5}


def test_pregel(spark):
    v = view_of(spark, [(0, 1, 2), (1, 2, 2), (0, 2, 5)])
    less = F.coalesce(F.col("message") < F.col("d"), F.lit(False))
    out = pregel(v.ids, v.edges, {"d": F.when(F.col("id") == 0, 0.0).otherwise(float("inf")), "on": F.col("id") == 0}, F.col("d") + F.col("weight"), F.min, {"d": F.when(less, F.col("message")).otherwise(F.col("d")), "on": less}, 5, F.col("on"))
    assert values(out.select("id", "d"), "id") == {0: 0, 1: 2, 2: 4}


def test_link_functions(spark):
    v = view_of(spark, [(0, 1), (0, 2), (3, 1), (3, 2), (3, 4)])
    pairs = spark.createDataFrame([(0, 3), (0, 0), (1, 9)], "node1 long, node2 long")
    got = {(r["node1"], r["node2"]): r["score"] for r in similarity.common_neighbors(v, pairs).collect()}
    assert got == {(0, 3): 2.0, (0, 0): 0.0, (1, 9): 0.0}
    assert {r["score"] for r in similarity.resource_allocation(v, pairs).collect()} == {1.0, 0.0}
    assert {(r["node1"], r["node2"]): r["score"] for r in similarity.total_neighbors(v, pairs).collect()}[(0, 3)] == 3
