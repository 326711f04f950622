"""Centrality operators. Each takes a View and returns (nodeId, score) unless it says otherwise."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.vectors import scale
from skein.graph import View
from skein.operators.paths import bfs_levels, fold_leaves, shortest_distances
from skein.plans.iterate import EVERY, cut, is_empty, note


def _sources(view: View, source_nodes) -> DataFrame | None:
    if not source_nodes:
        return None
    ids = source_nodes if isinstance(source_nodes, (list, tuple, set)) else [source_nodes]
    return view.nodes.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")


def _propagate(view: View, divisor, damping: float, tolerance: float, max_iterations: int, source_nodes, scaler: str) -> DataFrame:
    """Delta propagation: a node whose last change exceeds tolerance sends it, times the edge's
    weight over its divisor, to its neighbours. The changes that came in are damped and added."""
    edges = view.edges.filter("weight > 0") if view.weighted else view.edges
    # parallel edges are one with their summed weight; the division is done once
    out = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    degree = edges.groupBy("src").agg(F.sum("weight").alias("deg"))
    links = cut(out.join(degree, "src").select("src", "dst", (F.col("w") / divisor(F.col("deg"))).alias("p")))
    start = _sources(view, source_nodes)
    base = 1.0 - damping
    state = view.ids.withColumn("rank", F.lit(base))
    if start is not None:
        state = view.ids.join(start.withColumn("s", F.lit(base)), "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("rank"))
    state = stored = cut(state.withColumn("delta", F.col("rank")))
    note(ranIterations=1, didConverge=False)
    for k in range(1, max_iterations):
        note(ranIterations=k + 1)
        senders = state.filter(F.col("delta") > tolerance) if k > 1 else state
        sent = links.join(senders.select(F.col("id").alias("src"), "delta"), "src")
        inbox = sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("delta")).alias("m"))
        change = damping * F.coalesce(F.col("m"), F.lit(0.0))
        state = state.join(inbox, "id", "left").select("id", (F.col("rank") + change).alias("rank"), change.alias("delta"))
        if k % EVERY == 0 and k + 1 < max_iterations:
            state = stored = cut(state, stored)
            if is_empty(state.filter(F.col("delta") > tolerance)):
                note(didConverge=True)
                break
    return scale(state.select(F.col("id").alias("nodeId"), F.col("rank").alias("score")), "score", scaler)


def page_rank(view: View, damping_factor: float = 0.85, tolerance: float = 1e-7, max_iterations: int = 20, source_nodes=(), scaler: str = "NONE") -> DataFrame:
    """Unnormalised PageRank; rank that reaches nodes without relationships is lost."""
    return _propagate(view, lambda deg: deg, damping_factor, tolerance, max_iterations, source_nodes, scaler)


def article_rank(view: View, damping_factor: float = 0.85, tolerance: float = 1e-7, max_iterations: int = 20, source_nodes=(), scaler: str = "NONE") -> DataFrame:
    """PageRank whose divisor is the degree plus the average degree."""
    counts = view.edges.agg(F.sum("weight").alias("m")).first()["m"] or 0.0
    average = counts / max(1, view.nodes.count())
    return _propagate(view, lambda deg: deg + F.lit(average), damping_factor, tolerance, max_iterations, source_nodes, scaler)


def eigenvector(view: View, tolerance: float = 1e-7, max_iterations: int = 20, source_nodes=(), scaler: str = "NONE") -> DataFrame:
    """Power iteration: what came in and the last rank are added and normalised to length 1.
    Messages carry the sum before it is normalised."""
    edges = view.edges
    if view.weighted:
        degree = edges.groupBy("src").agg(F.sum("weight").alias("deg"))
        edges = edges.join(degree, "src").withColumn("weight", F.col("weight") / F.col("deg"))
    links = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("p")))
    start = _sources(view, source_nodes)
    if start is None:
        state = view.ids.withColumn("rank", F.lit(1.0 / max(1, view.nodes.count())))
    else:
        state = view.ids.join(start.withColumn("s", F.lit(1.0 / start.count())), "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("rank"))
    state = state.withColumn("next", F.lit(None).cast("double"))
    for k in range(max_iterations):
        if k == 0:
            joined = state.withColumn("m", F.lit(0.0))
        else:
            sent = links.join(state.select(F.col("id").alias("src"), "next"), "src")
            joined = state.join(sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("next")).alias("m")), "id", "left")
        new = cut(joined.select("id", "rank", (F.col("rank") + F.coalesce("m", F.lit(0.0))).alias("next")))
        length = math.sqrt(new.agg(F.sum(F.col("next") * F.col("next"))).first()[0] or 1.0)
        change = new.agg(F.max(F.abs(F.col("next") / length - F.col("rank")))).first()[0] or 0.0
        state = new.select("id", (F.col("next") / length).alias("rank"), "next")
        note(ranIterations=k + 1, didConverge=bool(k and change <= tolerance))
        if k and change <= tolerance:
            break
    return scale(state.select(F.col("id").alias("nodeId"), F.col("rank").alias("score")), "score", scaler)


def degree(view: View, orientation: str = "NATURAL", scaler: str = "NONE") -> DataFrame:
    """Number of relationships, or the sum of positive weights."""
    orientation = orientation.upper()
    edges = {"NATURAL": view, "REVERSE": view.reversed(), "UNDIRECTED": view.both_ways()}[orientation].edges
    weight = F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)) if view.weighted else F.count("*").cast("double")
    found = edges.groupBy(F.col("src").alias("id")).agg(weight.alias("score"))
    out = view.ids.join(found, "id", "left").select(F.col("id").alias("nodeId"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return scale(out, "score", scaler)


def _reach(view: View) -> DataFrame:
    """(node, n, far, near): of the nodes that reach a node their number, and the sums of their distances
    and of the inverses. Leaves of one node are told from one of them: see fold_leaves()."""
    sums = lambda size: (F.sum(size).alias("n"), F.sum(size * F.col("depth")).alias("far"), F.sum(size / F.col("depth")).alias("near"))
    folded = fold_leaves(view)
    if folded is None:
        return bfs_levels(view, view.ids).filter("depth > 0").groupBy("node").agg(*sums(F.lit(1)))
    small, members = folded
    sizes = members.filter("id = rep").select(F.col("id").alias("source"), "size")
    found = bfs_levels(small, small.ids).filter("depth > 0").join(sizes, "source").groupBy("node").agg(*sums(F.col("size")))
    others = F.col("size") - 1
    out = members.select(F.col("id").alias("member"), F.col("rep").alias("node"), "size").join(found, "node")
    return out.select(F.col("member").alias("node"), (F.col("n") + others).alias("n"), (F.col("far") + 2 * others).alias("far"), (F.col("near") + others / 2).alias("near"))


def closeness(view: View, use_wasserman_faust: bool = False) -> DataFrame:
    """Of the nodes that reach a node: their number over the sum of their distances."""
    score = F.col("n") / F.col("far")
    if use_wasserman_faust:
        score = score * F.col("n") / F.lit(max(1, view.nodes.count() - 1))
    out = view.ids.join(_reach(view), F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias("nodeId"), F.coalesce(score, F.lit(0.0)).alias("score"))


def harmonic(view: View) -> DataFrame:
    """The sum of inverse distances from all other nodes, over their number."""
    n = max(1, view.nodes.count() - 1)
    out = view.ids.join(_reach(view), F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias("nodeId"), F.coalesce(F.col("near") / n, F.lit(0.0)).alias("score"))


def betweenness(view: View, sampling_size: int | None = None, sampling_seed: int = 0) -> DataFrame:
    """Shortest paths through a node, by accumulation from the far ends of every source's
    shortest-path graph, all sources and a level at a time. With sampling_size that many
    sources, chosen by degree and a seeded hash. Undirected scores are halved. Without weights
    one of a node's leaves stands for all of them, as source and as far end: see fold_leaves()."""
    folded = fold_leaves(view) if sampling_size is None and not view.weighted else None
    whole, sizes, view = view, None, view if folded is None else folded[0]
    if folded is not None:
        sizes = folded[1].filter("id = rep").select("id", "size", "hub")
    sources = view.ids
    if sampling_size is not None:
        chance = -F.log((F.pmod(F.xxhash64("id", F.lit(sampling_seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53))
        by_degree = degree(view).select(F.col("nodeId").alias("id"), F.col("score").alias("d"))
        sources = by_degree.orderBy(chance / F.greatest("d", F.lit(1e-9)), "id").limit(sampling_size).select("id")
    # parallel edges are no more paths; of weights the least counts
    edges = cut(view.edges.filter("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    if view.weighted:
        dist = cut(shortest_distances(View(view.nodes, edges, view.undirected, True), sources).select("source", "node", "cost"))
        near = dist.select("source", F.col("node").alias("src"), F.col("cost").alias("c"))
        far = dist.select("source", F.col("node").alias("dst"), F.col("cost").alias("d"))
        steps = cut(near.join(edges, "src").join(far, ["source", "dst"]).filter(F.abs(F.col("c") + F.col("weight") - F.col("d")) < 1e-9).select("source", "src", "dst"))
        levels = cut(_longest_levels(dist.select("source", "node"), steps))
    else:
        levels = cut(bfs_levels(View(view.nodes, edges), sources))
        near = levels.select("source", F.col("node").alias("src"), F.col("depth").alias("a"))
        far = levels.select("source", F.col("node").alias("dst"), F.col("depth").alias("b"))
        steps = cut(near.join(edges.select("src", "dst"), "src").join(far, ["source", "dst"]).filter("b = a + 1").select("source", "src", "dst"))
    depth = levels.agg(F.max("depth")).first()[0] or 0
    at = levels.select("source", F.col("node").alias("dst"), "depth")
    steps = cut(steps.join(at, ["source", "dst"]))
    paths = levels.filter("depth = 0").select("source", "node", F.lit(1.0).alias("paths"))
    counted = paths
    for d in range(1, depth + 1):
        into = steps.filter(F.col("depth") == d).join(counted.withColumnRenamed("node", "src"), ["source", "src"])
        counted = cut(counted.unionByName(into.groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))))
    ratio = steps.join(counted.select("source", F.col("node").alias("src"), F.col("paths").alias("ps")), ["source", "src"])
    ratio = cut(ratio.join(counted.select("source", F.col("node").alias("dst"), F.col("paths").alias("pd")), ["source", "dst"]).select("source", "src", "dst", "depth", (F.col("ps") / F.col("pd")).alias("r")))
    share = None  # (source, node, x): the part of paths that passes on through node, of nodes done
    for d in range(depth, 0, -1):
        level = ratio.filter(F.col("depth") == d)
        if share is None:
            passed = level.withColumn("x", F.lit(0.0))
        else:
            passed = level.join(share.withColumnRenamed("node", "dst"), ["source", "dst"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
        if sizes is not None:
            passed = passed.join(sizes.select(F.col("id").alias("dst"), "size"), "dst")
        ends = F.lit(1) if sizes is None else F.col("size")
        new = passed.groupBy("source", F.col("src").alias("node")).agg(F.sum(F.col("r") * (ends + F.col("x"))).alias("x"))
        share = cut(new if share is None else share.unionByName(new).groupBy("source", "node").agg(F.sum("x").alias("x")))
    half = 2.0 if view.undirected else 1.0
    if share is None:
        return whole.ids.select(F.col("id").alias("nodeId"), F.lit(0.0).alias("score"))
    share = share.filter("source <> node").select("source", F.col("node").alias("id"), "x")
    if sizes is not None:
        share = share.join(sizes.select(F.col("id").alias("source"), "size"), "source").select("id", (F.col("x") * F.col("size")).alias("x"))
        # from leaf to leaf of one node, all paths pass it
        share = share.unionByName(sizes.filter("size > 1").select(F.col("hub").alias("id"), (F.col("size") * (F.col("size") - 1)).cast("double").alias("x")))
    total = share.groupBy("id").agg((F.sum("x") / half).alias("score"))
    return whole.ids.join(total, "id", "left").select(F.col("id").alias("nodeId"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _longest_levels(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(source, node, depth): the most steps from the source in each acyclic graph of steps."""
    level = nodes.withColumn("depth", F.lit(0))
    while True:
        into = steps.join(level.select("source", F.col("node").alias("src"), "depth"), ["source", "src"]).groupBy("source", F.col("dst").alias("node")).agg((F.max("depth") + 1).alias("d"))
        new = cut(level.join(into, ["source", "node"], "left").select("source", "node", F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth"), (F.coalesce("d", F.lit(0)) > F.col("depth")).alias("moved")))
        level = new.drop("moved")
        if is_empty(new.filter("moved")):
            return level


def hits(view: View, hits_iterations: int = 20) -> DataFrame:
    """(nodeId, auth, hub): rounds of both, each normalised to length 1."""
    links = cut(view.edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")))

    def gather(state: DataFrame, column: str, frm: str, to: str) -> DataFrame:
        sent = links.join(state.select(F.col("id").alias(frm), F.col(column).alias("v")), frm)
        inbox = sent.groupBy(F.col(to).alias("id")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
        return view.ids.join(inbox, "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v"))

    def unit(values: DataFrame, name: str) -> DataFrame:
        values = cut(values)
        length = math.sqrt(values.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0) or 1.0
        return values.select("id", (F.col("v") / length).alias(name))

    hub = view.ids.withColumn("hub", F.lit(1.0))
    auth = None
    for _ in range(hits_iterations):
        auth = unit(gather(hub, "hub", "src", "dst"), "auth")
        hub = unit(gather(auth, "auth", "dst", "src"), "hub")
    if auth is None:
        auth = view.ids.withColumn("auth", F.lit(1.0))
    return auth.join(hub, "id").select(F.col("id").alias("nodeId"), "auth", "hub")


def _low_links(edges: pa.Table) -> tuple[np.ndarray, set, list]:
    """Depth-first search of one component: its articulation points and bridges."""
    links: dict[int, list[int]] = {}
    for a, b in zip(edges.column("src").to_pylist(), edges.column("dst").to_pylist()):
        if a != b:
            links.setdefault(a, []).append(b)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    points, bridges = set(), []
    for root in sorted(links):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, children = [(root, None, iter(sorted(links[root])), [False])], 0
        while stack:
            node, parent, rest, skipped = stack[-1]
            for other in rest:
                if other == parent and not skipped[0]:
                    skipped[0] = True  # the edge it came by; a parallel one counts
                elif other in order:
                    low[node] = min(low[node], order[other])
                else:
                    order[other] = low[other] = len(order)
                    stack.append((other, node, iter(sorted(links[other])), [False]))
                    break
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[node])
                    if low[node] > order[up]:
                        bridges.append((min(up, node), max(up, node)))
                    if up == root:
                        children += 1
                    elif low[node] >= order[up]:
                        points.add(up)
        if children > 1:
            points.add(root)
    return np.array(sorted(links)), points, bridges


def _by_component(view: View, run, schema: str) -> DataFrame:
    """run on the edges of one component at a time; leaves are peeled before in SQL terms by
    nothing, so the largest component must fit one task's memory as two columns of ids."""
    from skein.operators.community import wcc

    both = view.both_ways().edges.select("src", "dst")
    part = wcc(view).select(F.col("nodeId").alias("src"), F.col("componentId").alias("__c"))
    return both.join(part, "src").groupBy("__c").applyInArrow(run, schema)


def articulation_points(view: View) -> DataFrame:
    """(nodeId): the nodes without which their component falls apart."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"nodeId": pa.array(sorted(_low_links(table)[1]), pa.int64())})

    return _by_component(view, run, "nodeId long")


def bridges(view: View) -> DataFrame:
    """(from, to), from < to: the relationships without which their component falls apart."""

    def run(table: pa.Table) -> pa.Table:
        found = sorted(set(_low_links(table)[2]))
        return pa.table({"from": pa.array([a for a, _ in found], pa.int64()), "to": pa.array([b for _, b in found], pa.int64())})

    return _by_component(view, run, "`from` long, `to` long")


def celf(view: View, seed_set_size: int, propagation_probability: float = 0.1, monte_carlo_simulations: int = 100, random_seed: int = 0) -> DataFrame:
    """(nodeId, spread): greedily the seeds that add most to the spread of independent cascades;
    ties to the smaller id.

    A simulation keeps each edge by a seeded hash; what a seed reaches in it is found by one
    frontier for all nodes and simulations together. Marginal gains are then counts of reached
    (simulation, node) pairs not yet covered, so each choice is one aggregate."""
    sims = view.nodes.sparkSession.range(monte_carlo_simulations).select(F.col("id").alias("sim"))
    coin = (F.pmod(F.xxhash64("src", "dst", "sim", F.lit(random_seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    kept = view.neighbours().withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(monte_carlo_simulations - 1)))).filter(coin < propagation_probability)
    kept = cut(kept.select(F.col("sim").cast("long").alias("sim"), "src", "dst"))
    seen = view.ids.join(F.broadcast(sims)).select("sim", F.col("id").alias("seed"), F.col("id").alias("node"))  # simulations are few and given
    frontier = seen
    while True:
        new = frontier.join(kept, (frontier["sim"] == kept["sim"]) & (frontier["node"] == kept["src"])).select(frontier["sim"], "seed", F.col("dst").alias("node")).distinct()
        new = cut(new.join(seen, ["sim", "seed", "node"], "left_anti"))
        if is_empty(new):
            break
        seen, frontier = cut(seen.unionByName(new)), new
    chosen: list[tuple[int, float]] = []
    total = 0.0
    for _ in range(min(seed_set_size, view.nodes.count())):
        gain = seen.groupBy("seed").agg((F.count("*") / monte_carlo_simulations).alias("gain"))
        if chosen:
            gain = view.ids.withColumnRenamed("id", "seed").filter(~F.col("seed").isin([c for c, _ in chosen])).join(gain, "seed", "left").fillna(0.0, ["gain"])
        best = gain.orderBy(F.desc("gain"), "seed").first()
        total += best["gain"]
        chosen.append((best["seed"], float(total)))
        covered = seen.filter(F.col("seed") == best["seed"]).select("sim", "node")
        seen = cut(seen.join(covered, ["sim", "node"], "left_anti"))
    return view.nodes.sparkSession.createDataFrame(chosen, "nodeId long, spread double")


def indirect_exposure(view: View, sanctioned: DataFrame, transfers: DataFrame | None = None, max_iterations: int = 20) -> DataFrame:
    """(nodeId, exposure, hop, parent, root): sanctioned nodes (column id) have exposure 1 at hop
    0; a node first reached gets the largest of its senders' exposures over their number of
    transfers, of equal ones that of the smaller sender."""
    out = transfers if transfers is not None else view.edges.groupBy("src").agg(F.sum("weight").alias("total"))
    links = cut(view.neighbours().join(out.withColumnRenamed("id", "src"), "src"))
    done = sanctioned.select(F.col("id").alias("nodeId"), F.lit(1.0).alias("exposure"), F.lit(0).alias("hop"), F.lit(None).cast("long").alias("parent"), F.col("id").alias("root"))
    frontier = done
    for k in range(1, max_iterations + 1):
        sent = frontier.join(links, frontier["nodeId"] == links["src"]).select(F.col("dst").alias("nodeId"), (F.col("exposure") / F.col("total")).alias("e"), F.col("src").alias("p"), "root")
        best = sent.groupBy("nodeId").agg(F.max(F.struct("e", (-F.col("p")).alias("np"), "root")).alias("b"))
        new = cut(best.join(done, "nodeId", "left_anti").select("nodeId", F.col("b.e").alias("exposure"), F.lit(k).alias("hop"), (-F.col("b.np")).alias("parent"), F.col("b.root").alias("root")))
        if is_empty(new):
            break
        done, frontier = cut(done.unionByName(new)), new
    return done


def exposure_to(view: View, sanctioned_property: str, total_transfers_property: str | None = None, max_iterations: int = 20) -> DataFrame:
    """indirect_exposure() to the nodes whose property is above 0."""
    sanctioned = view.nodes.filter(F.col(sanctioned_property).cast("double") > 0).select("id")
    totals = None if total_transfers_property is None else view.nodes.select("id", F.col(total_transfers_property).cast("double").alias("total"))
    return indirect_exposure(view, sanctioned, totals, max_iterations)
