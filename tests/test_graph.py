"""Graphs, projections, the filter language, exports, catalogs and modes."""

import pytest
from pyspark.sql import functions as F

from skein.engine import OPERATORS, Engine
from skein.functions import vectors as vec
from skein.graph import Graph
from skein.sources import export
from skein.sources.project import filter_graph, from_edges, from_sql, from_store, from_tables, generate


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def people(spark):
    nodes = spark.createDataFrame([(0, ["Person"], 30, 1.5), (1, ["Person", "Boss"], 50, 2.5), (2, ["Item"], None, float("nan"))], "nodeId long, labels array<string>, age int, score double")
    rels = spark.createDataFrame([(0, 1, "KNOWS", 1.0), (0, 1, "KNOWS", 3.0), (1, 2, "OWNS", 5.0), (0, 9, "OWNS", 1.0), (2, 2, "OWNS", None)], "sourceNodeId long, targetNodeId long, relationshipType string, w double")
    return from_tables(nodes, rels)


def test_dangling_and_validation(spark, people):
    assert people.rels.count() == 4
    nodes = spark.createDataFrame([(0,)], "nodeId long")
    rels = spark.createDataFrame([(0, 1)], "sourceNodeId long, targetNodeId long")
    with pytest.raises(ValueError):
        from_tables(nodes, rels, validate=True)
    with pytest.raises(ValueError):
        from_tables(nodes.withColumnRenamed("nodeId", "x"), rels)


def test_aggregations(spark, people):
    base = people.nodes, people.rels.drop("labels")
    for kind, want in (("SUM", 4.0), ("MIN", 1.0), ("MAX", 3.0), ("COUNT", 2.0), ("SINGLE", 1.0)):
        g = from_tables(*base, aggregation=kind)
        assert g.rels.filter("relationshipType = 'KNOWS'").select("w").first()[0] == want
    assert from_tables(*base).rels.count() == 4


def test_orientations(people):
    spec = {"K": {"type": "KNOWS", "orientation": "UNDIRECTED"}, "O": {"type": "OWNS", "orientation": "REVERSE", "properties": {"w": {"defaultValue": 7.0}}}}
    g = from_store(people, ["Person", "Item"], spec)
    assert rows(g.rels.filter("relationshipType = 'O'").select("sourceNodeId", "targetNodeId", "w")) == [(2, 1, 5.0), (2, 2, 7.0)]
    assert g.rels.filter("relationshipType = 'K'").count() == 4 and g.undirected == {"K"}
    assert from_store(people, "Person", "*").rels.count() == 2  # OWNS ends at an item
    assert g.view(relationship_types=("K",)).undirected and not g.view().undirected


def test_from_edges_and_sql(spark):
    df = spark.createDataFrame([(1, 2, "A"), (2, 3, "B"), (4, None, "A"), (1, 2, "A")], "source long, target long, kind string")
    g = from_edges(df, type_column="kind", undirected=("B",))
    assert rows(g.nodes.select("nodeId")) == [(1,), (2,), (3,), (4,)] and g.rels.count() == 4
    g = from_sql(spark, "SELECT id FROM range(3)", "SELECT id AS source, id + 1 AS target FROM range(:n)", {"n": 2})
    assert rows(g.rels.select("sourceNodeId", "targetNodeId")) == [(0, 1), (1, 2)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("n:Person", [0, 1]),
        ("n:Person:Boss", [1]),
        ("n.age > 30", [1]),
        ("n.age = 30 OR n.age = 50 AND n:Boss", [0, 1]),
        ("NOT n.age = 30", [1, 2]),
        ("n:Person XOR n:Boss", [0]),
        ("n.score = 1.50000000001", [0]),
        ("n.score <> 1.5", [1, 2]),
        ("n.score >= 0.0", [0, 1]),
        ("n.age < $limit", [0]),
        ("(n.age + 0 = 1)", None),
        ("n.nope = 1", None),
        ("degree() = 1", [1, 2]),
        ("degree('OWNS') >= 1", [1, 2]),
        ("-n.age < -40", [1]),
        ("TRUE AND NOT FALSE", [0, 1, 2]),
    ],
)
def test_filter_language(people, text, want):
    if want is None:
        with pytest.raises(ValueError):
            filter_graph(people, text)
    else:
        assert rows(filter_graph(people, text, "*", {"limit": 40}).nodes.select("nodeId")) == [(i,) for i in want]


def test_filter_relationships(people):
    assert filter_graph(people, "*", "r:KNOWS|OWNS AND r.w >= 3.0").rels.count() == 2
    g = filter_graph(people, "n:Person", "r.w < 2")
    assert rows(g.rels.select("sourceNodeId", "targetNodeId")) == [(0, 1)]


def test_export_round_trip(spark, people, tmp_path):
    g = people.with_node_property("vec", people.nodes.select("nodeId", F.array(F.lit(1.5), F.lit(2.0)).alias("v")), "v")
    for kind in ("csv", "parquet"):
        engine = Engine(spark)
        engine.graphs.put("g", g)
        engine.export("g", f"file://{tmp_path}/{kind}", kind)
        back = engine.load("h", f"file://{tmp_path}/{kind}", kind)
        assert rows(back.nodes.select("nodeId", "labels", "age", "vec")) == rows(g.nodes.select("nodeId", "labels", "age", "vec"))
        assert rows(back.rels.fillna(-1.0)) == rows(g.rels.fillna(-1.0))


def test_streams(people):
    assert export.stream_node_property(people, "age", ("Person",)).count() == 2
    assert export.stream_node_properties(people, ["age", "score"]).count() == 6
    assert export.stream_relationship_property(people, "w", ("KNOWS",)).count() == 2
    assert export.stream_relationships(people).count() == 4


def test_generate(spark):
    for kind in ("UNIFORM", "RANDOM", "POWER_LAW"):
        g = generate(spark, 200, 3, kind, property_name="w", property_range=(2.0, 4.0))
        lo, hi = g.rels.agg(F.min("w"), F.max("w")).first()
        assert g.nodes.count() == 200 and g.rels.filter("sourceNodeId = targetNodeId").count() == 0 and 2 <= lo <= hi <= 4
        assert rows(g.rels) == rows(generate(spark, 200, 3, kind, property_name="w", property_range=(2.0, 4.0)).rels)


def test_modes(spark, people, tmp_path):
    engine = Engine(spark)
    engine.graphs.put("g", people)
    assert engine.call("degree.stream", "g", {"relationshipWeightProperty": "w"}).count() == 3
    stats = engine.call("wcc.stats", "g")
    assert stats["componentCount"] == 1 and stats["componentDistribution"]["max"] == 3
    engine.call("degree.mutate", "g", {"mutateProperty": "deg", "concurrency": 4})
    assert "deg" in engine.graphs.get("g").node_properties
    with pytest.raises(ValueError):
        engine.call("degree.mutate", "g", {"mutateProperty": "deg"})
    engine.call("nodeSimilarity.mutate", "g", {"mutateRelationshipType": "SIM", "mutateProperty": "score"})
    path = f"file://{tmp_path}/out"
    engine.call("wcc.write", "g", {"writePath": path, "writeProperty": "part"})
    assert spark.read.parquet(path).columns == ["nodeId", "part"]
    assert engine.call("pageRank.stats.estimate", "g")["nodeCount"] == 3
    assert engine.call("wcc.stream", "g", {"minComponentSize": 4}).count() == 0
    assert {r["componentId"] for r in engine.call("scc.stream", "g", {"consecutiveIds": True}).collect()} == {0, 1, 2}
    for bad in ("nope.stream", "wcc.nope"):
        with pytest.raises(ValueError):
            engine.call(bad, "g")
    with pytest.raises(ValueError):
        engine.call("wcc.stream", "g", {"unknownKey": 1})
    with pytest.raises(KeyError):
        engine.call("wcc.stream", "missing")
    with pytest.raises(ValueError):
        engine.project("g", people.nodes, people.rels)
    engine.mutate_label("g", "Old", "n.age > 40")
    assert engine.graphs.get("g").labels() == ["Boss", "Item", "Old", "Person"]
    engine.to_undirected("g", "KNOWS", "BOTH", "SUM")
    assert rows(engine.graphs.get("g").rels.filter("relationshipType = 'BOTH'").select("sourceNodeId", "targetNodeId", "w")) == [(0, 1, 4.0), (1, 0, 4.0)]
    engine.collapse_path("g", [["KNOWS", "OWNS"]], "FAR")
    assert rows(engine.graphs.get("g").rels.filter("relationshipType = 'FAR'").select("sourceNodeId", "targetNodeId")) == [(0, 2)]
    assert engine.list().count() == 1 and len(engine.list_operators()) > 150 and len(OPERATORS) > 45
    engine.drop("g")
    engine.drop("g", False)


def test_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 2.0, 3.0], [0.0, 0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(vec.jaccard("a", "b").alias("j"), vec.overlap("a", "b").alias("o"), vec.cosine("a", "z").alias("c"), vec.euclidean("a", "a").alias("e"), vec.pearson("a", "a").alias("p")).first()
    assert (r["j"], r["o"], r["c"], r["e"]) == (0.5, 0.5, 0.0, 1.0) and abs(r["p"] - 1) < 1e-9
    x = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "x double")
    assert sorted(v[0] for v in vec.scale(x, "x", "MINMAX").collect())[:2] == [0.0, 1.0]
    assert {v[0] for v in vec.scale(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", "STDSCORE").collect()} == {0.0}
    with pytest.raises(ValueError):
        vec.scale(x, "x", "NOPE")


def test_streaming_components(spark, tmp_path):
    from skein.streaming.incremental import StreamedComponents

    for k, pairs in enumerate([[(1, 2), (3, 4)], [(2, 3), (7, 8)]]):
        spark.createDataFrame(pairs, "sourceNodeId long, targetNodeId long").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        stream = spark.readStream.schema("sourceNodeId long, targetNodeId long").parquet(f"file://{tmp_path}/in/*")
        if k == 0:
            parts = StreamedComponents(spark, f"file://{tmp_path}/labels")
        parts.start(stream, f"file://{tmp_path}/check").awaitTermination()
    assert rows(parts.labels) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)]


def test_streaming_components_restart(spark, tmp_path):
    """Another object over the same folders goes on, a batch that runs again changes nothing, and
    old versions go."""
    from skein.streaming.incremental import StreamedComponents

    batches = [[(1, 2), (3, 4)], [(2, 3)], [(7, 8)], [(8, 1)]]
    for k, pairs in enumerate(batches):
        batch = spark.createDataFrame(pairs, "sourceNodeId long, targetNodeId long")
        for _ in range(2):
            StreamedComponents(spark, f"file://{tmp_path}/labels").update(batch, k)
    assert rows(StreamedComponents(spark, f"file://{tmp_path}/labels").labels) == [(i, 1) for i in (1, 2, 3, 4, 7, 8)]
    assert sorted(p.name for p in (tmp_path / "labels").iterdir()) == ["2", "3"]


def test_stats(spark, people):
    engine = Engine(spark)
    engine.graphs.put("g", people)
    for endpoint, names in {
        "pageRank": "ranIterations didConverge centralityDistribution",
        "labelPropagation": "ranIterations didConverge communityCount communityDistribution",
        "louvain": "modularity modularities ranLevels communityCount",
        "kcore": "degeneracy",
        "k1coloring": "colorCount nodeCount ranIterations didConverge",
        "localClusteringCoefficient": "averageClusteringCoefficient nodeCount",
        "nodeSimilarity": "nodesCompared similarityPairs similarityDistribution",
    }.items():
        found = engine.call(f"{endpoint}.stats", "g")
        assert not set(names.split()) - set(found), (endpoint, found)
        assert {"computeMillis", "postProcessingMillis", "configuration"} <= set(found)
    tree = engine.call("spanningTree.stats", "g", {"sourceNode": 0, "relationshipWeightProperty": "w"})
    assert (tree["effectiveNodeCount"], tree["totalWeight"]) == (3, 6.0)
    engine.call("wcc.mutate", "g", {"mutateProperty": "part"})
    found = engine.call("modularity.stats", "g", {"communityProperty": "part"})
    assert found["communityCount"] == 1 and found["modularity"] == 0.0 and found["relationshipCount"] == 4
    assert rows(engine.call("conductance.stream", "g", {"communityProperty": "part"})) == [(0, 0.0)]


def test_negative_cycle_flag(spark):
    engine = Engine(spark)
    nodes = spark.createDataFrame([(i,) for i in range(3)], "nodeId long")
    engine.project("n", nodes, spark.createDataFrame([(0, 1, 1.0), (1, 2, -3.0), (2, 1, 1.0)], "sourceNodeId long, targetNodeId long, w double"))
    config = {"sourceNode": 0, "relationshipWeightProperty": "w"}
    assert engine.call("bellmanFord.stats", "n", config)["containsNegativeCycle"] is True
    assert [r["isNegativeCycle"] for r in engine.call("bellmanFord.stream", "n", config).collect()] == [True]


def test_procedures(spark, people):
    engine = Engine(spark)
    engine.graphs.put("g", people)
    assert engine.call("graph.exists", "g") and not engine.call("graph.exists", "h")
    assert engine.call("util.nodeProperty", "g", {"nodeId": 1, "propertyKey": "age"}) == 50
    assert engine.call("util.nodeProperty", "g", {"nodeId": 1, "propertyKey": "age", "nodeLabel": "Item"}) is None
    assert engine.call("util.asNode", "g", {"nodeId": 0})["labels"] == ["Person"] and engine.call("util.asNode", "g", {"nodeId": 77}) is None
    assert engine.as_nodes("g", spark.createDataFrame([(1,), (5,)], "nodeId long")).filter("age IS NULL").count() == 1
    engine.graph_property_mutate("g", "sizes", [3, 4])
    assert rows(engine.call("graph.graphProperty.stream", "g", {"graphProperty": "sizes"})) == [(3,), (4,)]
    engine.call("graph.graphProperty.drop", "g", {"graphProperty": "sizes"})
    with pytest.raises(KeyError):
        engine.call("graph.graphProperty.stream", "g", {"graphProperty": "sizes"})
    engine.call("graph.nodeProperties.drop", "g", {"nodeProperties": ["score"]})
    assert engine.graphs.get("g").node_properties == ["age"]
    engine.call("graph.relationships.drop", "g", {"relationshipType": "OWNS"})
    assert engine.graphs.get("g").types() == ["KNOWS"]
    assert engine.call("graph.sizeOf", "g")["bytes"] > 0 and engine.call("memory.list").count() == 1
    assert engine.call("memory.summary")["executorMemory"] > 0
    assert set(engine.call("graph.list").columns) >= {"graphName", "schema", "memoryInBytes", "degreeDistribution"}
    engine.call("graph.drop", "g")
    assert not engine.call("graph.exists", "g")


def test_scaled_arrays(spark):
    from skein.graph import View

    nodes = spark.createDataFrame([(0, [0.0, 5.0], 1), (1, [2.0, 5.0], 3), (2, [4.0, 5.0], None)], "id long, x array<double>, y int")
    view = View(nodes, spark.createDataFrame([], "src long, dst long, weight double"))
    got = {r[0]: r[1] for r in vec.scale_properties(view, ["x", "y"], "MINMAX").collect()}
    assert got == {0: [0.0, 0.0, 0.0], 1: [0.5, 0.0, 1.0], 2: [1.0, 0.0, None]}
    with pytest.raises(ValueError):
        vec.scale_properties(View(nodes.withColumn("x", F.slice("x", F.lit(1), (F.col("id") + 1).cast("int"))), view.edges), "x")


def test_numbered(spark):
    from skein.engine import numbered

    got = rows(numbered(spark.range(0, 3000, 3).select((F.col("id") * 7).alias("c")), "c").select("c", "__d"))
    assert got == [(21 * i, i) for i in range(1000)]


def test_graph_type(people):
    assert isinstance(people.without_node_properties("age").without_relationships("OWNS"), Graph)
    assert people.summary().first()["relationshipCount"] == 4
