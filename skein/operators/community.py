"""Community operators. A community's name is the smallest id among its members, unless seeds
or the operator's own definition say otherwise."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.graph import View
from skein.plans.iterate import cut, is_empty, note


def contracted_labels(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of edges (src, dst): every round nodes point at their smallest
    neighbour, pointers are followed once more and edges contracted, so rounds are about
    the logarithm of the longest chain, and edges shrink from round to round."""
    edges = cut(edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    while not is_empty(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to"))
        to = cut(to)
        to = cut(to.join(to.select(F.col("a").alias("to"), F.col("to").alias("up")), "to", "left").select("a", F.coalesce("up", "to").alias("to")))
        moved = edges.join(to.withColumnRenamed("to", "na"), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("nb")), "b")
        edges = cut(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).filter("a <> b").distinct())
        labels = cut(labels.join(to.select(F.col("a").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
    return labels


def wcc(view: View, threshold: float | None = None, seed_property: str | None = None) -> DataFrame:
    """(nodeId, componentId): connected whatever the direction. With a threshold only over edges
    of larger weight. With seeds nodes of one seed are connected, and a component's name is its
    smallest seed; components without one are named after the largest seed onwards."""
    edges = view.edges.select("src", "dst", "weight")
    if threshold is not None:
        edges = edges.filter(F.col("weight") > threshold)
    links = edges.select("src", "dst")
    if seed_property:
        seeds = view.nodes.filter(F.col(seed_property).isNotNull()).select("id", F.col(seed_property).cast("long").alias("seed"))
        first = seeds.groupBy("seed").agg(F.min("id").alias("src"))
        links = links.unionByName(seeds.join(first, "seed").select("src", F.col("id").alias("dst")))
    found = contracted_labels(links)
    out = view.ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    if not seed_property:
        return out.select(F.col("id").alias("nodeId"), F.col("component").alias("componentId"))
    named = out.join(seeds, "id", "left").groupBy("component").agg(F.min("seed").alias("seed"))
    highest = seeds.agg(F.max("seed")).first()[0] or 0
    return out.join(named, "component").select(F.col("id").alias("nodeId"), F.coalesce(F.col("seed"), F.col("component") + highest + 1).alias("componentId"))


def scc(view: View) -> DataFrame:
    """(nodeId, componentId). Colouring: the smallest id that reaches a node is its colour; of a
    colour's nodes those that reach its name backwards are a component. Nodes without open
    edges in or out are components of their own and go first."""
    left, edges = cut(view.ids), cut(view.neighbours())
    done = None

    def finish(found: DataFrame) -> None:
        nonlocal done, left, edges
        found = cut(found)
        done = found if done is None else cut(done.unionByName(found))
        left = cut(left.join(found, "id", "left_anti"))
        edges = cut(edges.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti"))

    while not is_empty(left):
        while True:  # trim
            single = left.join(edges.select(F.col("src").alias("id")).distinct().intersect(edges.select(F.col("dst").alias("id")).distinct()), "id", "left_anti")
            single = cut(single.withColumn("component", F.col("id")))
            if is_empty(single):
                break
            finish(single)
        if is_empty(left):
            break
        colour = cut(left.withColumn("colour", F.col("id")))
        while True:
            low = edges.join(colour.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("c"))
            new = cut(colour.join(low, "id", "left").select("id", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") < F.col("colour")).alias("moved")))
            colour = new.drop("moved")
            if is_empty(new.filter("moved")):
                break
        inside = edges.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst").filter("cs = cd")
        inside = cut(inside.select("src", "dst"))
        reach = cut(colour.filter("id = colour").select("id", "colour"))
        frontier = reach
        while True:
            back = frontier.join(inside, frontier["id"] == inside["dst"]).select(F.col("src").alias("id"), "colour").distinct()
            new = cut(back.join(reach, "id", "left_anti"))
            if is_empty(new):
                break
            reach, frontier = cut(reach.unionByName(new)), new
        finish(reach.select("id", F.col("colour").alias("component")))
    if done is None:
        done = view.ids.withColumn("component", F.col("id"))
    named = done.join(done.groupBy("component").agg(F.min("id").alias("low")), "component")
    return named.select(F.col("id").alias("nodeId"), F.col("low").alias("componentId"))


def label_propagation(view: View, max_iterations: int = 10, node_weight_property: str | None = None, seed_property: str | None = None) -> DataFrame:
    """(nodeId, communityId). All nodes at once take the label with the largest vote of their
    out-neighbours, ties to the smallest; the first iteration only sets labels: seeds, and
    for others ids from the largest seed onwards. Rounds are synchronous, so bipartite parts can
    swap labels for ever; max_iterations ends that."""
    labels = view.ids.withColumn("label", F.col("id"))
    if seed_property:
        highest = view.nodes.agg(F.max(F.col(seed_property).cast("long"))).first()[0]
        labels = view.nodes.select("id", F.coalesce(F.col(seed_property).cast("long"), F.col("id") + F.lit((highest if highest is not None else -1) + 1)).alias("label"))
    links = view.edges
    if node_weight_property:
        links = links.join(view.nodes.select(F.col("id").alias("dst"), F.col(node_weight_property).cast("double").alias("nw")), "dst").withColumn("weight", F.col("weight") * F.col("nw"))
    links = cut(links.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    labels = cut(labels)
    note(ranIterations=1, didConverge=False)
    for k in range(1, max_iterations):
        votes = links.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("vote"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.max(F.struct("vote", (-F.col("label")).alias("n"))).alias("b")).select("id", (-F.col("b.n")).alias("new"))
        joined = cut(labels.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"), (F.col("new") != F.col("label")).alias("moved")))
        labels = joined.drop("moved")
        still = is_empty(joined.filter("moved"))
        note(ranIterations=k + 1, didConverge=still)
        if still:
            break
    return labels.select(F.col("id").alias("nodeId"), F.col("label").alias("communityId"))


def modularity(view: View, communities: DataFrame) -> DataFrame:
    """(communityId, modularity) of communities (nodeId, communityId): the share of weight inside
    less the square of the share of weight at its nodes. Stored, so doubled, edges count."""
    of = communities.select(F.col("nodeId").alias("id"), F.col("communityId").alias("c"))
    total = view.edges.agg(F.sum("weight")).first()[0] or 1.0
    both = view.edges.join(of.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(of.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
    # each stored edge weighs half at each end, so directed edges count at both
    ends = both.select(F.col("cs").alias("c"), (F.col("weight") / 2).alias("k"), F.when(F.col("cs") == F.col("cd"), F.col("weight") / 2).otherwise(0.0).alias("e")).unionByName(both.select(F.col("cd").alias("c"), (F.col("weight") / 2).alias("k"), F.when(F.col("cs") == F.col("cd"), F.col("weight") / 2).otherwise(0.0).alias("e")))
    sums = ends.groupBy("c").agg(F.sum("k").alias("k"), F.sum("e").alias("e"))
    found = of.select("c").distinct().join(sums, "c", "left")
    k, e = F.coalesce("k", F.lit(0.0)), F.coalesce("e", F.lit(0.0))
    return found.select(F.col("c").alias("communityId"), ((e - k * k / total) / total).alias("modularity"))


def conductance(view: View, communities: DataFrame) -> DataFrame:
    """(community, conductance): of the weight going out of a community's nodes the share that
    leaves it; negative communities are none."""
    of = communities.select(F.col("nodeId").alias("id"), F.col("communityId").alias("c")).filter("c >= 0")
    both = view.edges.join(of.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(of.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
    out = F.sum(F.when(F.col("cs") != F.col("cd"), F.col("weight")).otherwise(0.0))
    return both.groupBy(F.col("cs").alias("community")).agg((out / F.sum("weight")).alias("conductance"))


def _property_communities(view: View, community_property: str) -> DataFrame:
    found = view.nodes.filter(F.col(community_property).isNotNull())
    return found.select(F.col("id").alias("nodeId"), F.col(community_property).cast("long").alias("communityId"))


def property_modularity(view: View, community_property: str) -> DataFrame:
    """modularity() of the communities that a node property names."""
    return modularity(view, _property_communities(view, community_property))


def property_conductance(view: View, community_property: str) -> DataFrame:
    """conductance() of the communities that a node property names."""
    return conductance(view, _property_communities(view, community_property))


def _weighted_links(view: View) -> DataFrame:
    """(src, dst, w) in both directions, parallel edges summed."""
    return cut(view.both_ways().edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")))


def _local_moves(links: DataFrame, start: DataFrame, max_iterations: int, tolerance: float, gamma: float = 1.0) -> tuple[DataFrame, float]:
    """(id, c) after rounds of moves to the neighbour community with the largest gain, and the
    modularity. First the nodes of one, then of the other of two hash classes move, which
    keeps neighbours from swapping; classes are dealt anew each round, and the best round is kept.
    Ties go to the smaller community."""
    total = links.agg(F.sum("w")).first()[0] or 1.0
    degree = cut(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    state = cut(start.join(degree, "id", "left").select("id", "c", F.coalesce("k", F.lit(0.0)).alias("k")))

    def quality(s: DataFrame) -> float:
        inside = links.join(s.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").filter("a = b").agg(F.sum("w")).first()[0] or 0.0
        spread = s.groupBy("c").agg(F.sum("k").alias("v")).agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
        return inside / total - gamma * spread / (total * total)

    best, best_q = state, quality(state)
    idle = 0
    for r in range(max_iterations):
        for side in (0, 1):
            volume = state.groupBy("c").agg(F.sum("k").alias("v"))
            near = links.filter("src <> dst").join(state.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("e"))
            mine = state.withColumnRenamed("c", "own")
            option = near.join(mine, "id").join(volume, "c")
            # gains are compared without the node's own volume where it already is
            value = F.col("e") - gamma * F.col("k") * (F.col("v") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / total
            ranked = option.groupBy("id").agg(F.max(F.struct(value.alias("g"), (-F.col("c")).alias("n"))).alias("b"), F.max(F.when(F.col("c") == F.col("own"), value)).alias("stay"))
            alone = F.lit(0.0)  # staying where no neighbour is
            joined = state.join(ranked, "id", "left").join(volume, "c")
            stay = F.coalesce("stay", alone - gamma * F.col("k") * (F.col("v") - F.col("k")) / total)
            go = (F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == side) & (F.col("b.g") > stay + 1e-12)
            state = cut(joined.select("id", F.when(go, -F.col("b.n")).otherwise(F.col("c")).alias("c"), "k"))
        q = quality(state)
        idle = 0 if q > best_q + tolerance else idle + 1
        if q > best_q:
            best, best_q = state, q
        note(ranIterations=r + 1, didConverge=idle == 2)
        if idle == 2:
            break
    return best.select("id", "c"), best_q


def _named(ids: DataFrame, state: DataFrame) -> DataFrame:
    low = state.groupBy("c").agg(F.min("id").alias("low"))
    return ids.join(state.join(low, "c").select("id", "low"), "id", "left").select(F.col("id").alias("nodeId"), F.coalesce("low", "id").alias("communityId"))


def _start(view: View, seed_property: str | None) -> DataFrame:
    if not seed_property:
        return view.ids.withColumn("c", F.col("id"))
    # communities get names that ids do not have: seeds are numbered below 0
    return view.nodes.select("id", F.when(F.col(seed_property).isNotNull(), -1 - F.col(seed_property).cast("long")).otherwise(F.col("id")).alias("c"))


def modularity_optimization(view: View, max_iterations: int = 10, tolerance: float = 1e-4, seed_property: str | None = None) -> DataFrame:
    """(nodeId, communityId) of one level of local moves."""
    state, quality = _local_moves(_weighted_links(view), _start(view, seed_property), max_iterations, tolerance)
    note(modularity=quality)
    return _named(view.ids, state)


def _contract(links: DataFrame, state: DataFrame) -> DataFrame:
    a, b = state.select(F.col("id").alias("src"), F.col("c").alias("cs")), state.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
    return cut(links.join(a, "src").join(b, "dst").groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("w").alias("w")))


def louvain(view: View, max_levels: int = 10, max_iterations: int = 10, tolerance: float = 1e-4, seed_property: str | None = None, include_intermediate_communities: bool = False, refine: bool = False, gamma: float = 1.0, theta: float = 0.01, random_seed: int = 0) -> DataFrame:
    """(nodeId, communityId[, intermediateCommunityIds]): local moves, then communities become
    nodes with summed weights, until nothing is gained."""
    links = _weighted_links(view)
    state, quality = _local_moves(links, _start(view, seed_property), max_iterations, tolerance, gamma)
    place = cut(view.ids.join(state, "id", "left").select("id", F.coalesce("c", "id").alias("c")))
    levels, qualities = [place], [quality]
    done = False
    for _ in range(1, max_levels):
        if refine:
            parts = _refined(links, state, gamma, theta, random_seed)
            links = _contract(links, parts)
            start = cut(parts.join(state.withColumnRenamed("c", "start"), "id").groupBy(F.col("c").alias("id")).agg(F.min("start").alias("c")))
            node_of = place.join(parts.select(F.col("id").alias("u"), F.col("c").alias("part")), F.col("u") == (F.col("node") if "node" in place.columns else F.col("id")), "left").select("id", F.coalesce("part", "id").alias("node"))
            nodes = cut(node_of)
        else:
            links = _contract(links, state)
            start = state.select(F.col("c").alias("id")).distinct().withColumn("c", F.col("id"))
            nodes = place.select("id", F.col("c").alias("node"))
        new, q = _local_moves(links, start, max_iterations, tolerance, gamma)
        if q <= quality + tolerance:
            done = True
            break
        state, quality = new, q
        qualities.append(q)
        place = cut(nodes.join(new.withColumnRenamed("id", "node"), "node", "left").select("id", "node", F.coalesce("c", "node").alias("c")))
        levels.append(place)
    note(ranLevels=len(levels), didConverge=done, modularity=quality, modularities=qualities)
    out = _named(view.ids, place.select("id", "c"))
    if include_intermediate_communities:
        for k, level in enumerate(levels):
            out = out.join(_named(view.ids, level.select("id", "c")).withColumnRenamed("communityId", f"__l{k}"), "nodeId")
        out = out.select("nodeId", "communityId", F.array(*(F.col(f"__l{k}") for k in range(len(levels)))).alias("intermediateCommunityIds"))
    return out


def _refined(links: DataFrame, state: DataFrame, gamma: float, theta: float, seed: int) -> DataFrame:
    """(id, c): within each community, single nodes join a neighbour part that gains, drawn in
    proportion to exp(gain / theta); a node that another joins stays."""
    total = links.agg(F.sum("w")).first()[0] or 1.0
    degree = links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    s = cut(state.join(degree, "id", "left").fillna(0.0, ["k"]))
    a, b = s.select(F.col("id").alias("src"), F.col("c").alias("cs"), F.col("k").alias("ks")), s.select(F.col("id").alias("dst"), F.col("c").alias("cd"), F.col("k").alias("kd"))
    inside = links.filter("src <> dst").join(a, "src").join(b, "dst").filter("cs = cd")
    gain = (F.col("w") - gamma * F.col("ks") * F.col("kd") / total) / total
    u = (F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    offer = inside.withColumn("g", gain).filter("g > 0").groupBy("src").agg(F.max(F.struct((F.col("g") / theta - F.log(-F.log(u))).alias("x"), "dst")).alias("o")).select("src", F.col("o.dst").alias("to"))
    # by a hash nodes are hosts or guests, so that no chain forms
    host = lambda c: F.pmod(F.xxhash64(c, F.lit(seed + 1)), F.lit(2)) == 0
    moves = offer.filter(~host("src") & host("to"))
    return cut(state.select("id").join(moves.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("to", "id").alias("c")))


def leiden(view: View, max_levels: int = 10, gamma: float = 1.0, theta: float = 0.01, tolerance: float = 1e-4, random_seed: int = 0, seed_property: str | None = None, include_intermediate_communities: bool = False) -> DataFrame:
    """As louvain(), but communities are refined into well-connected parts before they become
    nodes, and the next level starts from the communities. Undirected views only. At last,
    communities that fell apart are split into their connected parts."""
    if not view.undirected:
        raise ValueError("leiden works on undirected relationships only")
    found = louvain(view, max_levels, 10, tolerance, seed_property, include_intermediate_communities, True, gamma, theta, random_seed)
    of = found.select(F.col("nodeId").alias("id"), "communityId")
    same = view.edges.join(of.select(F.col("id").alias("src"), F.col("communityId").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("communityId").alias("b")), "dst").filter("a = b")
    parts = contracted_labels(same.select("src", "dst"))
    return found.join(parts.withColumnRenamed("id", "nodeId"), "nodeId", "left").withColumn("communityId", F.coalesce("component", "nodeId")).drop("component")


def k1_coloring(view: View, max_iterations: int = 10, palette: int = 8) -> DataFrame:
    """(nodeId, color). Every round an uncoloured node picks, by a hash, one of the smallest colours
    that no neighbour has, of as many as it has uncoloured neighbours before it in a hashed
    order, `palette` at most; of equal picks of neighbours the first in the order stands. Rounds go
    on until all have a colour, about the logarithm of the nodes, so no relationship joins equal
    colours; max_iterations is accepted, but needs no bound here."""
    links = cut(view.both_ways().neighbours())
    state = cut(view.ids.select("id", F.xxhash64("id").alias("h"), F.lit(None).cast("long").alias("color")))
    k = 0
    while not is_empty(state.filter("color IS NULL")):
        k += 1
        other = state.select(F.col("id").alias("dst"), F.col("h").alias("oh"), F.col("color").alias("oc"))
        near = state.filter("color IS NULL").select(F.col("id").alias("src"), "h").join(links, "src").join(other, "dst")
        before = F.col("oc").isNull() & (F.struct("oh", "dst") > F.struct(F.col("h").alias("oh"), F.col("src").alias("dst")))
        seen = near.groupBy(F.col("src").alias("id")).agg(F.sum(before.cast("int")).alias("ahead"), F.collect_set("oc").alias("taken"))
        taken = F.coalesce("taken", F.array().cast("array<bigint>"))
        most = F.least(F.coalesce("ahead", F.lit(0)) + 1, F.lit(palette))
        free = F.array_except(F.sequence(F.lit(0).cast("long"), (F.size(taken) + palette).cast("long")), taken)
        picked = state.filter("color IS NULL").join(seen, "id", "left").select("id", "h", F.get(free, F.pmod(F.xxhash64("id", F.lit(k)), most).cast("int")).alias("pick"))
        picked = cut(picked)
        rival = picked.select(F.col("id").alias("dst"), F.col("h").alias("oh"), F.col("pick").alias("op"))
        lost = picked.select(F.col("id").alias("src"), "h", "pick").join(links, "src").join(rival, "dst").filter("pick = op AND struct(oh, dst) > struct(h, src)").select(F.col("src").alias("id")).distinct()
        won = picked.join(lost, "id", "left_anti").select("id", F.col("pick").alias("new"))
        state = cut(state.join(won, "id", "left").select("id", "h", F.coalesce("color", "new").alias("color")), state)
    note(ranIterations=k, didConverge=True)
    return state.select(F.col("id").alias("nodeId"), "color")


def k_core(view: View) -> DataFrame:
    """(nodeId, coreValue): each node's value is lowered to the largest h such that h neighbours
    have h or more, until nothing changes. Parallel relationships count each.

    Each node keeps how many neighbours have its value or more. A node that falls takes one from
    those whose values it passes, and only nodes left with too few are counted anew, so a round
    reads the relationships of nodes that fell or have to, not all."""
    links = cut(view.both_ways().edges.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")))

    def counted(who: DataFrame, values: DataFrame) -> DataFrame:
        """(id, h, support) of nodes (id, v): h, and how many neighbours have h or more. Neighbours
        above a node's own value count as that value, so a histogram is enough."""
        near = links.join(who.select(F.col("id").alias("src"), F.col("v").alias("own")), "src").join(values.select(F.col("id").alias("dst"), "v"), "dst")
        held = near.groupBy("src", F.least("v", "own").alias("v")).agg(F.sum("n").alias("n"))
        above = held.withColumn("above", F.sum("n").over(W.partitionBy("src").orderBy(F.desc("v"))))
        # with values falling, min(v, above) rises and then falls; the support of h is the count at the last value of h or more
        h = above.withColumn("h", F.max(F.least("v", "above")).over(W.partitionBy("src")))
        return h.groupBy(F.col("src").alias("id")).agg(F.max("h").alias("h"), F.max(F.when(F.col("v") >= F.col("h"), F.col("above"))).alias("support"))

    start = view.ids.join(links.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("v")), "id", "left").select("id", F.coalesce("v", F.lit(0)).cast("long").alias("v"))
    start = cut(start)
    first = counted(start, start)
    state = cut(start.join(first, "id", "left").select("id", F.coalesce("h", F.lit(0)).alias("v"), F.coalesce("support", F.lit(0)).alias("support"), F.col("v").alias("old")))
    while True:
        fell = state.filter("v < old").select(F.col("id").alias("src"), F.col("old").alias("o"), F.col("v").alias("to"))
        if is_empty(fell):
            return state.select(F.col("id").alias("nodeId"), F.col("v").alias("coreValue"))
        lost = links.join(fell, "src").join(state.select(F.col("id").alias("dst"), "v"), "dst").filter("v > to AND v <= o").groupBy(F.col("dst").alias("id")).agg(F.sum("n").alias("n"))
        state = cut(state.join(lost, "id", "left").select("id", "v", (F.col("support") - F.coalesce("n", F.lit(0))).alias("support")), state)
        anew = counted(state.filter("support < v"), state)
        # a node none of whose neighbours is left has 0
        few = F.col("support") < F.col("v")
        state = cut(state.join(anew.withColumnRenamed("support", "s"), "id", "left").select("id", F.when(few, F.coalesce("h", F.lit(0))).otherwise(F.col("v")).alias("v"), F.when(few, F.coalesce("s", F.lit(0))).otherwise(F.col("support")).alias("support"), F.col("v").alias("old")), state)


def _oriented(view: View, max_degree: int | None = None) -> DataFrame:
    """Each undirected relationship once, from the end of smaller (degree, id): so no node has
    more than about the square root of all relationships, and wedges stay few."""
    links = view.both_ways().neighbours()
    degree = links.groupBy("src").agg(F.count("*").alias("d"))
    if max_degree is not None:
        degree = degree.filter(F.col("d") <= max_degree)
    links = links.join(degree.withColumnRenamed("d", "ds"), "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    return cut(links.filter(F.struct("ds", "src") < F.struct("dd", "dst")).select("src", "dst", "ds", "dd"))


def triangles(view: View, max_degree: int | None = None) -> DataFrame:
    """(nodeA, nodeB, nodeC) with nodeA < nodeB < nodeC; parallel relationships count once."""
    e = _oriented(view, max_degree)
    wedge = e.select("src", F.col("dst").alias("b"), F.col("dd").alias("db")).join(e.select("src", F.col("dst").alias("c"), F.col("dd").alias("dc")), "src").filter(F.struct("db", "b") < F.struct("dc", "c"))
    closed = wedge.join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    three = F.array_sort(F.array("src", "b", "c"))
    return closed.select(three[0].alias("nodeA"), three[1].alias("nodeB"), three[2].alias("nodeC"))


def triangle_count(view: View, max_degree: int | None = None) -> DataFrame:
    """(nodeId, triangleCount); -1 for nodes of more than max_degree neighbours, which are left out."""
    found = triangles(view, max_degree).select(F.explode(F.array("nodeA", "nodeB", "nodeC")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    out = view.ids.join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    if max_degree is not None:
        big = view.both_ways().neighbours().groupBy(F.col("src").alias("id")).count().filter(F.col("count") > max_degree)
        out = out.join(big, "id", "left").select("id", F.when(F.col("count").isNotNull(), -1).otherwise(F.col("n")).alias("n"))
    return out.select(F.col("id").alias("nodeId"), F.col("n").cast("long").alias("triangleCount"))


def local_clustering_coefficient(view: View, triangle_count_property: str | None = None) -> DataFrame:
    """(nodeId, localClusteringCoefficient): triangles over pairs of distinct neighbours."""
    if triangle_count_property:
        t = view.nodes.select(F.col("id").alias("nodeId"), F.col(triangle_count_property).alias("triangleCount"))
    else:
        t = triangle_count(view)
    degree = view.both_ways().neighbours().groupBy(F.col("src").alias("nodeId")).agg(F.count("*").alias("d"))
    d = F.coalesce("d", F.lit(0))
    value = F.when(F.col("triangleCount") < 0, float("nan")).when((F.col("triangleCount") == 0) | (d < 2), 0.0).otherwise(2 * F.col("triangleCount") / (d * (d - 1)))
    return t.join(degree, "nodeId", "left").select("nodeId", value.alias("localClusteringCoefficient"))


def kmeans(view: View, node_property: str, k: int = 10, max_iterations: int = 10, delta_threshold: float = 0.05, number_of_restarts: int = 1, initial_sampler: str = "UNIFORM", seed_centroids: list[list[float]] | None = None, random_seed: int = 0, compute_silhouette: bool = False) -> DataFrame:
    """(nodeId, communityId, distanceFromCentroid, silhouette) of vectors. With seed_centroids
    rounds start there and stop when no more than a share delta_threshold of nodes move; otherwise
    parallel k-means++ starts, the best of restarts by the sum of squared distances."""
    points = view.nodes.select("id", F.col(node_property).cast("array<double>").alias("x"))
    points = cut(points.filter(F.col("x").isNotNull()))
    n = points.count()
    if seed_centroids is None:
        features = points.withColumn("features", array_to_vector("x"))
        best = None
        for r in range(number_of_restarts):
            model = KMeans(k=max(2, min(k, n)), maxIter=max_iterations, seed=random_seed + r, initMode="k-means||" if initial_sampler.upper() == "KMEANSPP" else "random").fit(features)
            if best is None or model.summary.trainingCost < best.summary.trainingCost:
                best = model
        centres = [list(map(float, c)) for c in best.clusterCenters()]
        rounds = 0
    else:
        centres, rounds = [list(map(float, c)) for c in seed_centroids], max_iterations

    def assigned(centres: list) -> DataFrame:
        # k centres are a parameter's worth of data
        dists = [F.sqrt(F.aggregate(F.zip_with("x", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)) for c in centres]
        least = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(dists))))
        return points.withColumn("m", least).select("id", "x", F.col("m.i").alias("c"), F.col("m.d").alias("d"))

    state = cut(assigned(centres))
    for r in range(1, rounds):
        dims = range(len(centres[0]))
        sums = {row["c"]: row for row in state.groupBy("c").agg(*(F.avg(F.get("x", F.lit(j))).alias(f"m{j}") for j in dims)).collect()}
        centres = [[sums[i][f"m{j}"] for j in dims] if i in sums else c for i, c in enumerate(centres)]
        new = cut(assigned(centres))
        swaps = new.join(state.select("id", F.col("c").alias("old")), "id").filter("c <> old").count()
        state = new
        if swaps <= math.floor(n * delta_threshold):
            break
    note(centroids=centres)
    silhouette = F.lit(-1.0)
    if compute_silhouette and n:
        dims = range(len(centres[0]))
        stats = {row["c"]: row for row in state.groupBy("c").agg(F.count("*").alias("n"), F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("q"), *(F.sum(F.get("x", F.lit(j))).alias(f"s{j}") for j in dims)).collect()}
        own = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
        means = {c: (own + (r["q"] - 2 * F.aggregate(F.zip_with("x", F.array(*(F.lit(float(r[f"s{j}"])) for j in dims)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)) / r["n"], r["n"]) for c, r in stats.items()}
        a = F.coalesce(*(F.when(F.col("c") == c, m * nn / max(1, nn - 1)) for c, (m, nn) in means.items()))
        b = F.array_min(F.array(*(F.when(F.col("c") != c, m) for c, (m, _) in means.items())))
        silhouette = F.coalesce((b - a) / F.greatest(a, b), F.lit(0.0))
    return state.select(F.col("id").alias("nodeId"), F.col("c").cast("long").alias("communityId"), F.col("d").alias("distanceFromCentroid"), silhouette.alias("silhouette"))


def approx_max_k_cut(view: View, k: int = 2, iterations: int = 8, random_seed: int = 0, minimum: bool = False) -> DataFrame:
    """(nodeId, communityId): nodes start in k parts by a seeded hash; in each round those of one
    of two hash classes move to the part with least (for a minimum cut most) weight to it; the
    best of all rounds is kept."""
    links = cut(view.both_ways().edges.filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("w")))
    state = cut(view.ids.withColumn("c", F.pmod(F.xxhash64("id", F.lit(random_seed)), F.lit(k))))

    def cost(s: DataFrame) -> float:
        return links.join(s.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").filter("a <> b").agg(F.sum("w")).first()[0] or 0.0

    sign = -1.0 if minimum else 1.0
    best, best_cost = state, cost(state)
    for r in range(2 * iterations):
        near = links.join(state.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("e"))
        movers = state.filter(F.pmod(F.xxhash64("id", F.lit(random_seed + r // 2 + 1)), F.lit(2)) == r % 2).select("id")
        options = movers.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))).join(near, ["id", "c"], "left")
        pick = options.groupBy("id").agg(F.min(F.struct((F.coalesce("e", F.lit(0.0)) * sign).alias("e"), "c")).alias("p"))
        state = cut(state.join(pick, "id", "left").select("id", F.coalesce("p.c", "c").alias("c")))
        now = cost(state)
        if now * sign > best_cost * sign:
            best, best_cost = state, now
    note(cutCost=best_cost / 2)
    return best.select(F.col("id").alias("nodeId"), F.col("c").alias("communityId"))


def sllpa(view: View, max_iterations: int = 10, min_association_strength: float = 0.2, random_seed: int = 0) -> DataFrame:
    """(nodeId, values): overlapping communities. Every round each neighbour speaks a label from
    its memory, drawn by a seeded hash, and a listener remembers the most frequent one, ties to
    the smallest. Labels that fill more than a share of the memory are kept."""
    links = cut(view.both_ways().neighbours())
    state = cut(view.ids.withColumn("memory", F.array("id")))
    for r in range(1, max_iterations):
        said = links.join(state.select(F.col("id").alias("dst"), "memory"), "dst").select("src", F.get("memory", F.pmod(F.xxhash64("src", "dst", F.lit(r), F.lit(random_seed)), F.size("memory")).cast("int")).alias("label"))
        heard = said.groupBy("src", "label").agg(F.count("*").alias("n")).groupBy(F.col("src").alias("id")).agg(F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("b"))
        state = cut(state.join(heard, "id", "left").select("id", F.concat("memory", F.array(F.coalesce(-F.col("b.neg"), "id"))).alias("memory")))
    note(ranIterations=max_iterations, didConverge=False)
    counts = state.select("id", F.size("memory").alias("all"), F.explode("memory").alias("label")).groupBy("id", "all", "label").agg(F.count("*").alias("n"))
    kept = counts.filter(F.col("n") > F.col("all") * min_association_strength).groupBy("id").agg(F.array_sort(F.collect_list("label")).alias("values"))
    return view.ids.join(kept, "id", "left").select(F.col("id").alias("nodeId"), F.coalesce("values", F.array().cast("array<long>")).alias("values"))

