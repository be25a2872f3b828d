"""Strong components, cycles and whole closures of edge tables, in a number of rounds that grows with the logarithm of path lengths.

A walk level by level needs as many rounds as a chain is long. Here nodes with a single edge onward are taken out all at once: their
chains are followed by pointer doubling to the node where they end, edges into a chain are led to its end, and what is left is a smaller
graph with the same components. The same is done against the direction of the edges. Nodes that nothing leads to or that lead nowhere
are on no cycle and go as well. Of the rest, nodes with few edges that are no neighbours of each other are bypassed: each path over them
becomes an edge. So a long strip of tangled chains shrinks by a fixed share each round and is not peeled from its ends. Only a graph in
which every node has many edges is coloured along its edges.

All tables are written per round; joins are left to measured sizes, and lookup sides are unique, so hubs may be split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.plans.storage import materialise


#: A node is bypassed if that makes at most this many edges, or no more than it takes away.
BYPASS = 16


@dataclass(frozen=True)
class _Bypassed:
    """Nodes taken out in one round, none next to another: the edges (a, v) into them and (v, b) out of them."""

    into: DataFrame
    out: DataFrame


@dataclass(frozen=True)
class _Chains:
    """Nodes taken out in one round: their edges before it, the end of each chain, and the nodes 2^k steps on."""

    edges: DataFrame
    ends: DataFrame
    steps: list[DataFrame]


def _named(df: DataFrame, **names: str) -> DataFrame:
    """Columns under other names, so that a table can be joined with itself."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def _double(single: DataFrame, count: int) -> tuple[list[DataFrame], DataFrame, DataFrame | None]:
    """Follows ``single`` (v, p) by doubling: the tables (v, p) of 2^k steps, the chains' ends (v, r), and one node of each ring.

    A ring of nodes with a single edge has no end; its smallest node is given instead and the ends are left out.
    """
    inside = single.select(F.col("v").alias("q"), F.lit(True).alias("hit"))
    start = single.join(inside, F.col("p") == F.col("q"), "left").select("v", "p", F.col("hit").isNotNull().alias("open"), F.col("v").alias("low"))
    now, _ = materialise(start, "chain")
    steps, reached = [], 1
    while now.where("open").limit(1).count():
        steps.append(now.where("open").select("v", "p"))
        if reached >= count:  # longer than all nodes together: only rings are left
            lows = _named(now, v="at", low="least")
            rings = now.where("open").join(lows, F.col("p") == F.col("at")).select(F.col("least").alias("v")).distinct()
            return steps, now, materialise(rings, "rings")[0]
        onward = _named(now, v="at", p="p2", open="open2", low="low2")
        doubled = now.where("open").join(onward, F.col("p") == F.col("at")).select(
            "v", F.col("p2").alias("p"), F.col("open2").alias("open"), F.least("low", "low2").alias("low"))
        now, _ = materialise(now.where("not open").unionByName(doubled), "chain")
        reached *= 2
    return steps, now.select("v", F.col("p").alias("r")), None


def _take_chains(edges: DataFrame) -> _Chains | None:
    """Takes out all nodes with one edge onward; None if there are none."""
    single, count = materialise(
        edges.groupBy("a").agg(F.min("b").alias("p"), F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("a").alias("v"), "p"), "single")
    if not count:
        return None
    steps, ends, rings = _double(single, count)
    if rings is not None:  # one node of each ring stays and is the end of the others
        steps, ends, _ = _double(single.join(rings, "v", "left_anti"), count)
    return _Chains(edges, ends, steps)


def _bypass(edges: DataFrame, turn: int) -> tuple[_Bypassed, DataFrame] | None:
    """Takes out nodes with few edges; also the edges that are left, with one for each path over such a node. None if there are none."""
    few = edges.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("o")).join(
        edges.groupBy(F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("i")), "v").where(
        F.col("i") * F.col("o") <= F.greatest(F.lit(BYPASS), F.col("i") + F.col("o")))
    # of two neighbours the one with the smaller hash goes, in another order each turn
    ranked, _ = materialise(few.select("v", F.struct(F.xxhash64("v", F.lit(turn)).alias("h"), "v").alias("rank")), "few")
    beside = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a"))
    beaten = beside.join(ranked, "v").join(_named(ranked, v="u", rank="other"), "u").where(F.col("other") < F.col("rank")).select("v")
    gone, count = materialise(ranked.select("v").join(beaten.distinct(), "v", "left_anti"), "gone")
    if not count:
        return None
    into, out = edges.join(_named(gone, v="b"), "b").select("a", F.col("b").alias("v")), edges.join(_named(gone, v="a"), "a").select(F.col("a").alias("v"), "b")
    rest = edges.join(_named(gone, v="a"), "a", "left_anti").join(_named(gone, v="b"), "b", "left_anti").select("a", "b")
    over = into.join(out, "v").where("a != b").select("a", "b")
    return _Bypassed(into, out), materialise(rest.unionByName(over).distinct(), "bypassed")[0]


def _trim(edges: DataFrame) -> DataFrame:
    """Without edges from nodes that nothing leads to and edges to nodes that lead nowhere."""
    out = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
    return out.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b")


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, component): the component of the greatest node of each colour; a node's colour is the greatest node that leads to it."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    colours, _ = materialise(ends.withColumn("c", F.col("node")).withColumn("moved", F.lit(True)), "colour")
    while colours.where("moved").limit(1).count():
        sent = edges.join(_named(colours.where("moved"), node="a", c="c"), "a").groupBy(F.col("b").alias("node")).agg(F.max("c").alias("got"))
        colours, _ = materialise(colours.join(sent, "node", "left").select(
            "node", F.greatest("c", "got").alias("c"), F.coalesce(F.col("got") > F.col("c"), F.lit(False)).alias("moved")), "colour")
    plain = colours.select("node", "c")
    inside, _ = materialise(
        edges.join(_named(plain, node="a", c="ca"), "a").join(_named(plain, node="b", c="cb"), "b").where("ca = cb").select("a", "b"), "inside")
    front, count = materialise(plain.where("node = c"), "back")
    found = front
    while count:
        met = inside.join(_named(front, node="b", c="c"), "b").select(F.col("a").alias("node"), "c").distinct()
        front, count = materialise(met.join(found.select("node"), "node", "left_anti"), "back")
        found = found.unionByName(front) if count else found
    return found.select("node", F.col("c").alias("component"))


def _put_back(chains: _Chains, known: DataFrame) -> DataFrame:
    """``known`` (node, component) with the nodes of ``chains`` that belong to the component of their end.

    A chain's node does if its end leads to it: if an edge from a node of that component enters the chain there or before.
    """
    named = known.select(F.col("node").alias("x"), "component")
    ends = chains.ends.join(named, F.col("r") == F.col("x"), "left").select("v", "r", F.coalesce("component", "r").alias("own"))
    outer = chains.edges.join(chains.ends.select(F.col("v").alias("a")), "a", "left_anti").join(named, F.col("a") == F.col("x"), "left").select(
        F.coalesce("component", "a").alias("from"), "b")
    marks = outer.join(ends, F.col("b") == F.col("v")).where(F.col("from") == F.col("own")).select("v").distinct()
    for step in reversed(chains.steps):  # a mark stands for 2^k nodes onward, then for half of them at two places
        marks, count = materialise(marks.unionByName(marks.join(step, "v").select(F.col("p").alias("v"))).distinct(), "marks")
        if not count:
            return known
    inside = marks.join(ends, "v")
    return known.unionByName(inside.select(F.col("v").alias("node"), F.col("own").alias("component"))).unionByName(
        inside.select(F.col("r").alias("node"), F.col("own").alias("component"))).distinct()


def _put_back_bypassed(step: _Bypassed, known: DataFrame) -> DataFrame:
    """``known`` (node, component) with the bypassed nodes that a component leads to and that lead back to it, and with that component's nodes."""
    named = known.select(F.col("node").alias("x"), "component")
    into = step.into.join(named, F.col("a") == F.col("x"), "left").select("v", "a", F.coalesce("component", "a").alias("own"))
    out = step.out.join(named, F.col("b") == F.col("x"), "left").select("v", "b", F.coalesce("component", "b").alias("own"))
    ways = into.select("v", "own").join(out.select("v", "own"), ["v", "own"], "left_semi").distinct()
    ends = into.join(ways, ["v", "own"], "left_semi").select("a", "own").union(out.join(ways, ["v", "own"], "left_semi").select("b", "own"))
    return known.union(ways).union(ends).distinct()


def strong_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for every node of an edge: nodes that lead to each other share the smallest of them as their component.

    Edges with a null end are left out; repeated edges and edges of a node to itself change nothing.
    """
    whole, _ = materialise(
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct(), "edges")
    nodes = whole.select(F.col("a").alias("node")).union(whole.select("b")).distinct()
    known = nodes.limit(0).withColumn("component", F.col("node"))
    rest, count = materialise(_trim(whole.where("a != b")), "rest")
    taken: list[_Chains | _Bypassed | DataFrame] = []
    turn = 0
    while count:
        turn += 1
        chains = _take_chains(rest) if turn <= 2 else None  # along the edges, then against them
        if chains is not None:
            taken.append(chains)
            led = chains.ends.select(F.col("v").alias("b"), "r")
            rest = rest.join(chains.ends.select(F.col("v").alias("a")), "a", "left_anti").join(led, "b", "left").select(
                "a", F.coalesce("r", "b").alias("b")).where("a != b").distinct()
        elif turn > 2:
            bypassed = _bypass(rest, turn)
            if bypassed is not None:
                taken.append(bypassed[0])
                rest = bypassed[1]
            else:  # many edges everywhere
                found, _ = materialise(_coloured(rest), "found")
                taken.append(found)
                gone = found.select("node")
                rest = rest.join(_named(gone, node="a"), "a", "left_anti").join(_named(gone, node="b"), "b", "left_anti").select("a", "b")
        rest, count = materialise(_trim(rest).select(F.col("b").alias("a"), F.col("a").alias("b")), "rest")  # turned around
    for step in reversed(taken):
        if isinstance(step, DataFrame):
            more = known.unionByName(step)
        else:
            more = _put_back(step, known) if isinstance(step, _Chains) else _put_back_bypassed(step, known)
        known = known if more is known else materialise(more, "known")[0]
    least = known.groupBy("component").agg(F.min("node").alias("first"))
    placed = known.join(least, "component").select("node", F.col("first").alias("component"))
    return nodes.join(_named(placed, node="node", component="c"), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def cyclic_edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst, component) of every edge that lies on a cycle, over the whole table."""
    parts, _ = materialise(strong_components(edges, src, dst), "parts")
    pairs = edges.select(src, dst).distinct()
    return pairs.join(_named(parts, node=src, component="component"), src).join(_named(parts, node=dst, component="_other"), dst).where(
        F.col("component") == F.col("_other")).select(src, dst, "component")


def closure(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(root, node): all nodes that each node leads to, itself only along a cycle.

    Paths between components double in length each round, so a graph of depth d takes about log2(d) rounds. The result is as large
    as the number of such pairs; for a few roots of a large graph ``graph.walk`` does less.
    """
    parts, _ = materialise(strong_components(edges, src, dst), "parts")
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct()
    led = pairs.join(_named(parts, node="a", component="x"), "a").join(_named(parts, node="b", component="y"), "b")
    led, _ = materialise(led.select("x", "y").distinct(), "led")
    reach, count = materialise(led.where("x != y"), "reach")
    while True:
        longer = reach.join(_named(reach, x="y", y="z"), "y").select("x", F.col("z").alias("y"))
        reach, now = materialise(reach.unionByName(longer).distinct(), "reach")
        if now == count:
            break
        count = now
    met = reach.unionByName(led.where("x = y"))
    roots, ends = _named(parts, component="x", node="root"), _named(parts, component="y", node="node")
    return met.join(roots, "x").join(ends, "y").select("root", "node")


def closure_edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(root, src, dst): for every node that edges leave, all edges behind it, also those around a cycle."""
    pairs = edges.select(src, dst).distinct()
    starts = pairs.select(F.col(src).alias("root"), F.col(src).alias("node")).distinct()
    met = closure(edges, src, dst).unionByName(starts).distinct()
    return met.join(pairs, F.col("node") == F.col(src)).select("root", src, dst)
