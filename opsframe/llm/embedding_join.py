"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors whose cosine is at least t lie within eps = sqrt(2 - 2 t) of each other, and so do their projections on
any orthonormal directions. The vectors are sorted by the cells of a grid of side eps on their leading principal directions and
cut into sequence intervals. The join descends from pairs of long intervals to pairs of blocks and drops a pair as soon as the boxes
around both lie more than eps apart; inside a pair of blocks it goes on with smaller intervals. Only what is left is compared,
in double precision.

Equal vectors are one entry from the start. A task puts out link counts and a star per linked group, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import components, materialise, read, tasks

THRESHOLD = 0.9
#: Vectors that the principal directions are fitted on, chosen by a hash; every vector is indexed.
SAMPLE = 4096
#: Directions of the grid order and of the boxes.
GRID, BOX = 6, 12
#: Vectors of a block, of the intervals inside it, and children of an interval above it.
BLOCK, INNER, FAN = 2048, 256, 8
#: Added to eps, so that rounding never drops a pair.
SLACK = 1e-6


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, first by their largest part, so that squares neither vanish nor overflow."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def valid(embedding: str) -> str:
    """SQL: a vector with at least one part other than zero, all of them finite."""
    return (
        f"{embedding} is not null and forall({embedding}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        f" and exists({embedding}, x -> x <> 0)"
    )


def _matrix(column: pa.Array, kind: str, size: int) -> np.ndarray:
    """Binary rows as a matrix; shorter vectors are filled with zeros."""
    out = np.zeros((len(column), size), dtype=kind)
    for k, x in enumerate(column):
        v = np.frombuffer(x.as_buffer(), dtype=kind)
        out[k, : len(v)] = v
    return out


def _blocks(classes: DataFrame, kind: str, size: int, centre: np.ndarray, axes: np.ndarray, eps: float, block: int) -> DataFrame:
    """Blocks in grid order: idx parts (pid, seq), the entries, and the box of their projections."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast((centre, axes))  # size x BOX numbers
    grid = min(GRID, axes.shape[1])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mid, dirs = shared.value
        for b in batches:
            v = _list_matrix(b.column("v"), kind, size)
            y = (unit(v) - mid) @ dirs
            cells = np.floor(y[:, :grid] / eps).astype(np.int64)
            lens = [len(x) for x in b.column("v")]
            packed = [v[k, :n].tobytes() for k, n in enumerate(lens)]
            yield pa.RecordBatch.from_arrays(
                [b.column("k1"), b.column("k2"), b.column("n"), pa.array(packed, pa.binary()), pa.array(cells.tolist(), pa.list_(pa.int64())),
                 pa.array(y[:, 0])], ["k1", "k2", "n", "v", "cell", "y"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mid, dirs = shared.value
        pid, seq, held = TaskContext.get().partitionId(), 0, []

        def emit(rows: pa.Table) -> pa.RecordBatch:
            y = (unit(_matrix(rows.column("v").combine_chunks(), kind, size)) - mid) @ dirs
            one = {
                "pid": [pid], "seq": [seq], "rows": [len(rows)], "k1": [rows.column("k1").to_numpy().tobytes()], "k2": [rows.column("k2").to_numpy().tobytes()],
                "n": [rows.column("n").to_numpy().tobytes()], "v": [rows.column("v").to_pylist()],
                "lo": [y.min(axis=0).tolist()], "hi": [y.max(axis=0).tolist()],
            }
            return pa.RecordBatch.from_pydict(one, schema=_BLOCK)

        waiting = 0
        for b in batches:
            held.append(b)
            waiting += len(b)
            while waiting >= block:
                table = pa.Table.from_batches(held)
                yield emit(table.slice(0, block))
                seq, waiting = seq + 1, waiting - block
                held = table.slice(block).to_batches()
        if waiting:
            yield emit(pa.Table.from_batches(held))

    keyed = classes.mapInArrow(project, "k1 long, k2 long, n long, v binary, cell array<long>, y double")
    order = ["cell", "y", "k1", "k2"]
    parts = max(tasks(spark, classes.count(), 4 * block), 1)
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("k1", "k2", "n", "v")
    return dealt.mapInArrow(pack, "pid long, seq long, rows long, k1 binary, k2 binary, n binary, v array<binary>, lo array<double>, hi array<double>")


_BLOCK = pa.schema([
    ("pid", pa.int64()), ("seq", pa.int64()), ("rows", pa.int64()), ("k1", pa.binary()), ("k2", pa.binary()), ("n", pa.binary()),
    ("v", pa.list_(pa.binary())), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
])


def _list_matrix(column: pa.Array, kind: str, size: int) -> np.ndarray:
    out = np.zeros((len(column), size), dtype=kind)
    for k, x in enumerate(column):
        v = x.values.to_numpy(zero_copy_only=False)
        out[k, : len(v)] = v
    return out


def block_pairs(blocks: DataFrame, dims: int, eps: float, fan: int = FAN) -> DataFrame:
    """(a, b), a <= b: pairs of blocks that the descent from the whole sequence can't rule out."""
    boxes = blocks.select("idx", *[F.col("lo")[d].alias(f"lo{d}") for d in range(dims)], *[F.col("hi")[d].alias(f"hi{d}") for d in range(dims)])
    top = boxes.agg(F.max("idx")).first()[0]
    levels = 0
    while fan**levels <= top:
        levels += 1
    pairs = blocks.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(levels - 1, -1, -1):
        node = F.floor(F.col("idx") / fan**level).cast("long")
        nodes = boxes.groupBy(node.alias("node")).agg(
            *[F.min(f"lo{d}").alias(f"lo{d}") for d in range(dims)], *[F.max(f"hi{d}").alias(f"hi{d}") for d in range(dims)])
        nodes = nodes.withColumn("up", F.floor(F.col("node") / fan).cast("long"))
        left = nodes.select(F.col("up").alias("a"), F.struct("*").alias("p"))
        right = nodes.select(F.col("up").alias("b"), F.struct("*").alias("q"))
        gap = [F.greatest(F.lit(0.0), F.col(f"p.lo{d}") - F.col(f"q.hi{d}"), F.col(f"q.lo{d}") - F.col(f"p.hi{d}")) for d in range(dims)]
        apart = reduce(lambda x, y: x + y, [g * g for g in gap])
        pairs = pairs.join(left, "a").join(right, "b").where("p.node <= q.node").where(apart <= (eps + SLACK) ** 2).select(
            F.col("p.node").alias("a"), F.col("q.node").alias("b"))
    return pairs


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node of its group, given links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_pairs(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, threshold: float, eps: float, inner: int, same: bool):
    """Index pairs with cosine >= threshold, by intervals of ``inner`` rows whose boxes of px and py lie within eps.

    x and y are unit rows; ``same`` compares a block with itself, each pair once.
    """
    out_i, out_j = [], []
    cuts_x, cuts_y = range(0, len(x), inner), range(0, len(y), inner)
    box_x = [(px[a : a + inner].min(axis=0), px[a : a + inner].max(axis=0)) for a in cuts_x]
    box_y = [(py[a : a + inner].min(axis=0), py[a : a + inner].max(axis=0)) for a in cuts_y]
    for a, (lo_a, hi_a) in zip(cuts_x, box_x):
        for b, (lo_b, hi_b) in zip(cuts_y, box_y):
            if same and b < a:
                continue
            gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
            if (gap * gap).sum() > (eps + SLACK) ** 2:
                continue
            i, j = np.nonzero(x[a : a + inner] @ y[b : b + inner].T >= threshold)
            i, j = i + a, j + b
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            out_i.append(i)
            out_j.append(j)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def _compare(pairs: DataFrame, blocks: DataFrame, kind: str, size: int, centre: np.ndarray, axes: np.ndarray, threshold: float, eps: float) -> DataFrame:
    """(key, root, links) per pair of blocks: how many rows an entry links with there, and its group's smallest entry."""
    shared = pairs.sparkSession.sparkContext.broadcast((centre, axes))
    part = blocks.select("idx", F.struct("n", "v").alias("x"))
    both = pairs.join(part.withColumnRenamed("x", "p"), pairs.a == F.col("idx")).drop("idx")
    both = both.join(part.withColumnRenamed("x", "q"), both.b == F.col("idx")).select("a", "b", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mid, dirs = shared.value
        for b in batches:
            for k in range(len(b)):
                a_, b_ = b.column("a")[k].as_py(), b.column("b")[k].as_py()
                sides = []
                for name in ("p", "q")[: 1 if a_ == b_ else 2]:
                    side = b.column(name)[k]
                    raw = _matrix(side["v"].values, kind, size)
                    dim = np.array([len(v.as_buffer()) for v in side["v"].values])
                    u = unit(raw)
                    sides.append((u, (u - mid) @ dirs, np.frombuffer(side["n"].as_buffer(), "<i8"), dim))
                (ux, px, nx, dx), (uy, py, ny, dy) = sides[0], sides[-1]
                i, j = near_pairs(ux, uy, px, py, threshold, eps, INNER, a_ == b_)
                keep = dx[i] == dy[j]  # vectors of different lengths don't link
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                first_x, first_y, m = a_ << 20, b_ << 20, len(ux)
                shift = 0 if a_ == b_ else m
                keys = np.arange(m) + first_x if a_ == b_ else np.concatenate([np.arange(m) + first_x, np.arange(len(uy)) + first_y])
                links = np.zeros(len(keys), dtype=np.int64)
                np.add.at(links, i, ny[j])
                np.add.at(links, j + shift, nx[i])
                label = _stars(i, j + shift, len(keys))
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(keys[label[hit]]), pa.array(links[hit])], ["key", "root", "links"])

    return both.mapInArrow(run, "key long, root long, links long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK,
) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept.

    Two rows link if their cosine in double precision is ``threshold`` or more. Vectors that are null, empty, zero, or hold null or
    non-finite parts link with nothing and are components of their own; so do vectors of different lengths with each other. Equal vectors,
    also of equal rows, link. ``component_id`` is the smallest id reachable; null ids are never it unless there is no other, and
    kept compares null-safely. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    element = dict(vectors.select(vector_col).dtypes)[vector_col]
    kind = "<f4" if element == "array<float>" else "<f8"
    v = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    good = F.expr(valid("v"))
    keys = rows.select("vec_id", F.when(good, F.xxhash64("v")).alias("k1"), F.when(good, F.xxhash64(F.lit(1), "v")).alias("k2"))
    keys, _ = materialise(keys, "keys")
    classes = rows.where(good).select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")).groupBy("k1", "k2", "v").agg(
        F.count(F.lit(1)).alias("n"))
    classes, total = materialise(classes, "vectors")
    alone = F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    if not total:
        return keys.select("vec_id", F.lit(0).cast("long").alias("n_links"), *alone)
    size = classes.agg(F.max(F.size("v"))).first()[0]
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    drawn = classes.orderBy(F.xxhash64("k1"), "k1", "k2").limit(SAMPLE).select("v").collect()
    sample = np.zeros((len(drawn), size))
    for k, r in enumerate(drawn):
        sample[k, : len(r.v)] = r.v
    sample = unit(sample)
    centre = sample.mean(axis=0)
    axes = np.linalg.svd(sample - centre, full_matrices=False)[2][:BOX].T
    dims = axes.shape[1]
    blocks, _ = materialise(_blocks(classes, kind, size, centre, axes, max(eps, 1e-9), block), "blocks")
    width = 1
    while width <= blocks.agg(F.max("seq")).first()[0]:
        width *= FAN
    blocks = blocks.withColumn("idx", F.col("pid") * width + F.col("seq"))
    pairs, _ = materialise(block_pairs(blocks, dims, eps), "pairs")
    found, _ = materialise(_compare(pairs, blocks, kind, size, centre, axes, threshold, eps), "links")
    groups = components(found.where("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for idx, k1, k2, n in zip(*(b.column(c) for c in ("idx", "k1", "k2", "n"))):
                parts = [np.frombuffer(x.as_buffer(), "<i8") for x in (k1, k2, n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts[0])) + (idx.as_py() << 20)), *map(pa.array, parts)], ["key", "k1", "k2", "n"])

    entries = blocks.select("idx", "k1", "k2", "n").mapInArrow(unpack, "key long, k1 long, k2 long, n long")
    placed = entries.join(groups.withColumnRenamed("node", "key"), "key", "left").join(linked, "key", "left").select(
        "k1", "k2", F.coalesce("root", "key").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    firsts = keys.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("first"))
    placed, _ = materialise(placed.join(firsts, ["k1", "k2"]), "placed")
    named = placed.join(placed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("k1", "k2", "n_links", "component_id")
    inside = keys.where("k1 is not null").join(named, ["k1", "k2"]).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    outside = keys.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), *alone)
    return inside.union(outside)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked at a cosine of 0.9."""
    return near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


#: Every pair by brute force; components by reachability.
ORACLE = """
WITH RECURSIVE ok AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b, a.vec_id AS va, b.vec_id AS vb FROM ok a JOIN ok b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach(r, t) AS (SELECT a, b FROM links UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.t = links.a),
counts AS (SELECT va AS vec_id, count(*) AS n_links FROM links GROUP BY va),
roots AS (SELECT ok.vec_id, least(ok.vec_id, min(t.vec_id)) AS component_id FROM reach JOIN ok ON ok.r = reach.r JOIN ok t ON t.r = reach.t GROUP BY ok.vec_id)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) LEFT JOIN roots USING (vec_id)
"""
