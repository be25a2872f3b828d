"""Walks over edge tables.

A walk keeps one row per (root, node): the level at which the node was first
reached. Each round joins the newest rows with the two-column edge table, drops
what was reached before and writes the rest. The edges stay evenly split files
and are never partitioned by node, so a hub with a third of all edges is read by
many tasks: a small frontier is broadcast by its measured size, a large one is
sort-merge joined and adaptive execution splits the hub. Chains of a large table
are followed by doubling first, so rounds do not grow with their length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe import dims
from opsframe.functions.keys import key_day, key_task
from opsframe.operators.joins import top_nodes
from opsframe.plans.ordered import chunked
from opsframe.plans.storage import materialise, write_step

BROADCAST_EDGES = 500_000
_SMALL_HOPS = 16


def _chained(links: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shortcuts, tails): the links between heads with the levels they span, and how far each other node lies behind its head.

    A node with a single link to it, that is no root, is always one level below the node before it. It gets the first node up its chain
    that isn't such a node as its head, found by doubling. Rings of such nodes have no head: no root leads to them.
    """
    links = links.where(F.col("_src") != F.col("_dst"))
    single = links.groupBy(F.col("_dst").alias("_tail")).agg(F.min("_src").alias("_head"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    single, count = materialise(single.join(roots.select(F.col("root").alias("_tail")), "_tail", "left_anti"), "single")
    inside = single.select(F.col("_tail").alias("_head"), F.lit(True).alias("_open"))
    tails, _ = materialise(single.join(inside, "_head", "left").select(
        "_tail", "_head", F.lit(1).alias("_w"), F.coalesce("_open", F.lit(False)).alias("_open")), "tails")
    reached = 1
    while reached < count and tails.where("_open").limit(1).count():
        above = tails.select(F.col("_tail").alias("_head"), F.col("_head").alias("_next"), F.col("_w").alias("_more"), F.col("_open").alias("_on"))
        longer = tails.where("_open").join(above, "_head").select(
            "_tail", F.col("_next").alias("_head"), (F.col("_w") + F.col("_more")).alias("_w"), F.col("_on").alias("_open"))
        tails, _ = materialise(tails.where("not _open").unionByName(longer), "tails")
        reached *= 2
    tails = tails.where("not _open").drop("_open")
    before = tails.select(F.col("_tail").alias("_src"), "_head", "_w")
    onward = links.join(single.select(F.col("_tail").alias("_dst")), "_dst", "left_anti").join(before, "_src", "left")
    return onward.groupBy(F.coalesce("_head", "_src").alias("_src"), "_dst").agg(
        F.min(F.coalesce("_w", F.lit(0)) + 1).alias("_w")), tails


def walk(edges: DataFrame, roots: DataFrame, src: str, dst: str, levels: int | None = None,
         broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """(root, level, node): first level at which each root reaches each node; roots are level 0.

    ``roots`` has the column ``root``. Ends when nothing new is reached, so
    cycles need no special care. One level is one written round. Only when the
    counted edges fit a broadcast are several levels expanded per round, because
    then a level costs no pass over a large table but mostly job overhead. A deep
    walk of larger tables goes from head to head of their chains (``_chained``)
    and adds the nodes between at the end.
    """
    spark = edges.sparkSession
    links, n_links = materialise(
        edges.select(F.col(src).alias("_src"), F.col(dst).alias("_dst")).where(
            F.col("_src").isNotNull() & F.col("_dst").isNotNull()).distinct(), "edges")
    hops, tails = 1, None
    if n_links > broadcast_edges and (levels is None or levels > _SMALL_HOPS):
        short, tails = _chained(links, roots)
        links, n_links = materialise(short, "short")
    else:
        links = links.withColumn("_w", F.lit(1))
    if n_links <= broadcast_edges:
        links, hops = F.broadcast(links), _SMALL_HOPS
    start = roots.select("root").where(F.col("root").isNotNull()).distinct().select(
        "root", F.lit(0).alias("level"), F.col("root").alias("node"))
    schema = start.schema
    path, count = write_step(start, "level")
    paths, done = [path], 0
    while count and (levels is None or done < levels):
        width = hops if levels is None or tails is not None else min(hops, levels - done)
        step = spark.read.schema(schema).parquet(paths[-1])
        if width > 1:
            # a root reaches no more nodes than there are edges, few here; kept together
            # by root, its hops and their duplicates need no further shuffle
            step = step.repartition("root")
        for _ in range(width):
            met = step.join(links, F.col("node") == F.col("_src"), "inner" if width == 1 else "left")
            onward = F.struct((F.col("level") + F.col("_w")).alias("level"), F.col("_dst").alias("node"))
            if width > 1:
                # nodes of earlier hops of the round travel along
                here = F.struct(F.col("level"), F.col("node"))
                met = met.select("root", F.explode(F.array(here, onward)).alias("_n"))
            else:
                met = met.select("root", onward.alias("_n"))
            # several edges to one node collapse before the shuffle
            step = met.where(F.col("_n.node").isNotNull()).groupBy("root", F.col("_n.node").alias("node")).agg(
                F.min("_n.level").alias("level")).select("root", "level", "node")
        seen = spark.read.schema(schema).parquet(*paths).select("root", "node", F.col("level").alias("_known"))
        again = ["root", "node"]
        if tails is not None:
            # links span several levels here, so a later one may still lead to a node at an earlier level
            step = step if levels is None else step.where(F.col("level") <= levels)
            seen, again = seen.groupBy(*again).agg(F.min("_known").alias("_known")).select(
                F.col("root").alias("_r"), F.col("node").alias("_n"), "_known"), [
                F.col("root") == F.col("_r"), F.col("node") == F.col("_n"), F.col("_known") <= F.col("level")]
        fresh = step.join(seen, again, "left_anti").select("root", "level", "node")
        path, count = write_step(fresh, "level")
        done += width if tails is None else 0  # a chained walk ends by its levels
        if count:
            paths.append(path)
    found = spark.read.schema(schema).parquet(*paths)
    if tails is None:
        return found
    heads = found.groupBy("root", "node").agg(F.min("level").alias("level")).select("root", "level", "node")
    behind = heads.join(tails, F.col("node") == F.col("_head")).select("root", (F.col("level") + F.col("_w")).alias("level"), F.col("_tail").alias("node"))
    return heads.unionByName(behind if levels is None else behind.where(F.col("level") <= levels))


def _walked_edges(edges: DataFrame, roots: DataFrame, src: str, dst: str, levels: int | None) -> DataFrame:
    """(root, level, src, dst) of every edge met, each once per root at its first level."""
    nodes = walk(edges, roots, src, dst, levels)
    if levels is not None:
        nodes = nodes.where(F.col("level") < levels)
    pairs = edges.select(F.col(src).alias("node"), F.col(dst).alias("_other")).distinct()
    return nodes.join(pairs, "node", "inner").select(
        "root", (F.col("level") + 1).alias("level"), F.col("node").alias(src), F.col("_other").alias(dst))


def descendants(edges: DataFrame, roots: DataFrame, levels: int | None = 1, parent: str = "parent_job_key",
                child: str = "job_key") -> DataFrame:
    """Edges below the roots up to ``levels``: 0 gives none, None the full closure."""
    return _walked_edges(edges, roots, parent, child, levels)


def ancestors(edges: DataFrame, roots: DataFrame, levels: int | None = 1, parent: str = "parent_job_key",
              child: str = "job_key") -> DataFrame:
    """Edges above the roots up to ``levels``: 0 gives none, None the full closure."""
    return _walked_edges(edges, roots, child, parent, levels)


def find_cycles(edges: DataFrame, roots: DataFrame, parent: str, child: str) -> DataFrame:
    """Edges a level-by-level walk would meet a second time, per root.

    A node is met again when an edge leads to it from its own level or a deeper
    one; what it leads to is then repeated. The walk itself ends regardless.
    """
    nodes = walk(edges, roots, parent, child)
    pairs = edges.select(F.col(parent).alias("_p"), F.col(child).alias("_c")).distinct()
    source = nodes.select("root", F.col("node").alias("_p"), F.col("level").alias("_pl"))
    target = nodes.select("root", F.col("node").alias("_c"), F.col("level").alias("_cl"))
    again = source.join(pairs, "_p", "inner").join(target, ["root", "_c"], "inner").where(
        F.col("_pl") >= F.col("_cl")).select("root", F.col("_c").alias("_p")).distinct()
    return again.join(pairs, "_p", "inner").select("root", F.col("_p").alias(parent), F.col("_c").alias(child))


def same_day_edges(edges: DataFrame, parent: str = "parent_job_key", child: str = "job_key") -> DataFrame:
    """Edges between instances of different tasks on one day, read off their keys."""
    p, c = F.col(parent), F.col(child)
    return edges.where((key_day(p) == key_day(c)) & (key_task(p) != key_task(c)))


def display_edges(edges: DataFrame, jobs: DataFrame, flow_view: bool = False) -> DataFrame:
    """Same-day edges shown to users; members of workflows only appear in the view of a flow."""
    out = same_day_edges(edges)
    if flow_view:
        return out
    outside = jobs.where(F.col("flow_job_id") == "0").select("job_key")
    return out.join(outside, "job_key", "left_semi")


def nest(levels: DataFrame, parent: str, child: str) -> DataFrame:
    """A walk as a tree: (root, node, parent, level, path). A node hangs below its smallest parent of the level above.

    The result stays flat; the path orders it and can be of any depth: paths are joined from pieces, twice as long each round.
    """
    # an edge back to the root hangs nothing
    levels = levels.where(F.col(child) != F.col("root"))
    first = levels.groupBy("root", child).agg(F.min("level").alias("level"))
    hung = levels.join(first, ["root", child, "level"], "left_semi").groupBy("root", "level", child).agg(
        F.min(parent).alias(parent))
    hung, _ = materialise(hung, "hung")
    # each row holds its path below an ancestor; a round takes the ancestor's own row in front and so doubles what it spans
    rows = hung.select("root", F.col(child).alias("node"), F.col(parent).alias("parent"), "level", F.col(parent).alias("_up"),
                       F.array(F.col(child).cast("string")).alias("path"))
    reached, depth = 1, hung.agg(F.max("level").alias("n")).first()["n"] or 0
    while reached < depth:
        above = rows.select("root", F.col("node").alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_front"))
        rows, _ = materialise(rows.join(above, ["root", "_up"], "left").select(
            "root", "node", "parent", "level", F.coalesce("_next", "_up").alias("_up"),
            F.when(F.col("_next").isNull(), F.col("path")).otherwise(F.concat("_front", "path")).alias("path")), "tree")
        reached *= 2
    return rows.withColumn("path", F.concat(F.array(F.col("root").cast("string")), "path")).drop("_up")


def child_lists(levels: DataFrame, parent: str, child: str, size: int = 1000, limit: int | None = None) -> DataFrame:
    """One nesting step as lists of at most ``size`` children: (root, parent, chunk, children)."""
    pairs = levels.select("root", parent, child).distinct()
    return chunked(pairs, ["root", parent], [child], F.col(child), size, "children", limit)


def task_graph(tasks: DataFrame, edges: DataFrame, roots: DataFrame, levels: int = 1, direction: str = "both",
               ) -> DataFrame:
    """Task edges around the roots (task_id in column ``root``), with the members of met workflows as extra edges."""
    parts = []
    if direction in ("down", "both"):
        parts.append(descendants(edges, roots, levels, "parent_task_id", "task_id").select(
            "root", "level", "parent_task_id", "task_id", F.lit("down").alias("kind")))
    if direction in ("up", "both"):
        parts.append(ancestors(edges, roots, levels, "parent_task_id", "task_id").select(
            "root", "level", "parent_task_id", "task_id", F.lit("up").alias("kind")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    met = out.select("root", "level", F.when(F.col("kind") == "down", F.col("task_id")).otherwise(
        F.col("parent_task_id")).alias("flow_id")).unionByName(
        roots.select("root", F.lit(0).alias("level"), F.col("root").alias("flow_id")))
    met = met.groupBy("root", "flow_id").agg(F.min("level").alias("level"))
    members = tasks.where((F.col("flow_id") > 0) & (F.col("is_deleted") == 0)).select("flow_id", "task_id")
    inside = met.join(members, "flow_id", "inner").select(
        "root", "level", F.col("flow_id").alias("parent_task_id"), "task_id", F.lit("member").alias("kind"))
    return out.unionByName(inside)


def workflow_graph(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of every workflow with their level from its entry nodes (entries are level 0)."""
    members = tasks.where((F.col("flow_id") > 0) & (F.col("is_deleted") == 0)).select("task_id", "flow_id")
    child = members.select("task_id", F.col("flow_id").alias("_f"))
    parent = members.select(F.col("task_id").alias("parent_task_id"), F.col("flow_id").alias("_f"))
    inside = edges.join(child, "task_id", "inner").join(parent, ["parent_task_id", "_f"], "inner").select(
        "task_id", "parent_task_id", F.lit(0).alias("is_deleted"))
    entries = top_nodes(tasks, inside).select(F.col("task_id").alias("root"))
    nodes = walk(inside, entries, "parent_task_id", "task_id")
    return nodes.groupBy(F.col("node").alias("task_id")).agg(F.min("level").alias("level")).join(
        members, "task_id", "inner").select("flow_id", "task_id", "level")


def restart_closure(edges: DataFrame, jobs: DataFrame, roots: DataFrame, only_next: bool = False) -> DataFrame:
    """Instances to restart with each root: same-day children of other tasks, next level only or all."""
    below = walk(same_day_edges(edges), roots, "parent_job_key", "job_key", 1 if only_next else None).where(
        F.col("level") > 0).withColumnRenamed("node", "job_key")
    facts = jobs.select("job_key", "id", "status", "cyc_time", "task_type", "task_id")
    return below.join(facts, "job_key", "inner").select(
        "root", "level", "job_key", "id", F.coalesce("status", F.lit(dims.STATUS["UNSUBMIT"])).alias("status"),
        "cyc_time", "task_type", "task_id")


def same_day_descendants(edges: DataFrame, jobs: DataFrame, tasks: DataFrame, roots: DataFrame,
                         levels: int | None = None, only_next: bool = False) -> DataFrame:
    """Same-day descendants, all or up to ``levels``; an instance of a deleted task is cut together with what lies below it."""
    live = jobs.join(tasks.where("is_deleted = 0").select("task_id"), "task_id", "left_semi").select("job_key")
    allowed = same_day_edges(edges).join(live, "job_key", "left_semi")
    below = walk(allowed, roots, "parent_job_key", "job_key", 1 if only_next else levels)
    return below.where(F.col("level") > 0).withColumnRenamed("node", "job_key")


def roots_of(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """Nodes that no edge leads to."""
    return edges.select(F.col(parent).alias("node")).distinct().join(
        edges.select(F.col(child).alias("node")), "node", "left_anti")


def leaves_of(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """Nodes that no edge leaves."""
    return roots_of(edges, child, parent)


def pair(*cols: Sequence[str]) -> Column:
    """Composite node key."""
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])
