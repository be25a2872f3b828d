"""Exact top-k search by inner product with a dual-tree search over cover trees.

All vectors, queries among them, are placed by the same upper tree, fitted on a bounded sample, and cut in that order into chunks of
bounded size. A task builds a cover tree over each chunk: centres are chosen farthest first, so those of a level keep apart by its
scale and cover their points within it, and every node knows its covering radius. The chunk's queries are put into groups that
are nodes of the same order, with a centre and a radius of their own, and search their own chunk first.

Then pairs of a query group and a chunk are pruned, and inside a chunk pairs of a group and a node: with centres a, b and radii r, s no query
of the group reaches more than <a, b> + |a| s + |b| r + r s anywhere in the node. If that is below the worst k-th score of the group, the
pair is left out. What is left is computed in whole numbers. A chunk is read once per slice of the groups that need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsframe.llm.common import materialise, read

#: Each part of a vector is floor(SCALE * x).
SCALE = 256
#: Vectors that the upper tree is fitted on, chosen by a hash, and its leaves; every vector is indexed.
SAMPLE, LEAVES = 2048, 128
#: Vectors of a chunk, children of a node, and vectors below which a node isn't divided.
CHUNK, FAN, LEAF = 16_384, 16, 256
#: Queries of a group, and groups that one slice of a chunk's work holds.
GROUP, SLICE = 128, 64
#: Added to a bound for rounding, as a share of the parts it is made of.
SLACK = 1e-9


def whole(vector: Column) -> Column:
    """The vector's parts as whole numbers; null if the vector is null or holds null or non-finite parts."""
    x = vector.cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(good, F.transform(x, lambda v: F.floor(v * F.lit(float(SCALE)))))


def _dense(column: pa.Array, size: int) -> np.ndarray:
    """Lists of whole numbers as rows, shorter ones continued with zeros."""
    out = np.zeros((len(column), size), dtype=np.int64)
    lens = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), lens)
    ends = np.cumsum(lens)
    out[rows, np.arange(len(flat)) - np.repeat(ends - lens, lens)] = flat
    return out


def _pack(x: np.ndarray) -> bytes:
    """Rows in the smallest type that holds them."""
    top = int(np.abs(x).max(initial=0))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind.encode()[1:] + x.astype(kind).tobytes()


def _unpack(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<" + bytes(data[:2]).decode(), offset=2).reshape(-1, size).astype(np.float64)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, exact as long; raises where they leave that type."""
    limit = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1]
    if limit < 2**53:
        return (x @ y.T).astype(np.int64)
    if limit >= 2**63:
        raise OverflowError("inner products beyond long")
    return x.astype(np.int64) @ y.astype(np.int64).T


def farthest_first(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``count`` centres, each the point farthest from those before it, and the centre of every point; equal points share one."""
    norm = (x * x).sum(axis=1)
    centres = [int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
    best = norm + norm[centres[0]] - 2 * (x @ x[centres[0]])
    owner = np.zeros(len(x), dtype=np.int64)
    while len(centres) < count:
        far = int(np.argmax(best))
        if best[far] <= 0 or (x[far] == x[centres[owner[far]]]).all():
            break
        d = norm + norm[far] - 2 * (x @ x[far])
        closer = d < best
        owner[closer], best[closer] = len(centres), d[closer]
        owner[far], best[far] = len(centres), 0
        centres.append(far)
    return np.array(centres), owner


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A cover tree over the rows of ``x``: the order of the rows, the nodes, and their covering radii.

    A node is (first row, end, centre, first child, end of children), rows counted in the new order; a leaf has no children. Nodes that
    farthest-first centres can't divide, because all rows are equal, stay leaves whatever their size.
    """
    order = np.arange(len(x))
    nodes, radii = [[0, len(x), 0, 0, 0]], [0.0]
    at = 0
    while at < len(nodes):
        lo, hi = nodes[at][:2]
        some = order[lo:hi]
        middle = int(np.argmin(((x[some] - x[some].mean(axis=0)) ** 2).sum(axis=1)))
        nodes[at][2] = int(some[middle])  # a row of x until the order is final
        radii[at] = float(np.sqrt(((x[some] - x[some[middle]]) ** 2).sum(axis=1).max()))
        if hi - lo > leaf:
            centres, owner = farthest_first(x[some], FAN)
            if len(centres) > 1:
                order[lo:hi] = some[np.argsort(owner, kind="stable")]
                ends = lo + np.cumsum(np.bincount(owner, minlength=len(centres)))
                nodes[at][3:] = [len(nodes), len(nodes) + len(centres)]
                for a, b in zip([lo, *ends[:-1].tolist()], ends.tolist()):
                    nodes.append([a, b, 0, 0, 0])
                    radii.append(0.0)
        at += 1
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.arange(len(x))
    table = np.array(nodes, dtype=np.int64)
    table[:, 2] = place[table[:, 2]]
    return order, table, np.array(radii)


class Chunk:
    """A chunk as a task holds it: its vectors in tree order, nodes, radii, and the ids and row numbers of each vector."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray, radii: np.ndarray, ends: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.x, self.nodes, self.radii, self.ends, self.ids, self.rows = x, nodes, radii, ends, ids, rows


class Best:
    """The ``k`` best rows of each query found so far, as (score, id, row), ids ascending among equal scores."""

    def __init__(self, count: int, k: int, worst: np.ndarray | None = None):
        self.k = k
        self.query = self.score = self.id = self.row = np.zeros(0, dtype=np.int64)
        #: The k-th score of each query, or what is known of it from elsewhere.
        self.floor = np.full(count, np.iinfo(np.int64).min) if worst is None else worst.copy()

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        query, score, ids, row = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.id, ids), (self.row, row)))
        order = np.lexsort((row, ids, -score, query))
        query, score, ids, row = query[order], score[order], ids[order], row[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.r_[starts, len(query)])
        rank = np.arange(len(query)) - np.repeat(starts, sizes)
        full = query[rank == self.k - 1]
        self.floor[full] = np.maximum(self.floor[full], score[rank == self.k - 1])
        keep = rank < self.k
        self.query, self.score, self.id, self.row = query[keep], score[keep], ids[keep], row[keep]


def search(queries: np.ndarray, chunk: Chunk, best: Best) -> int:
    """Adds what ``chunk`` holds for a group of queries; returns how many products were computed."""
    centre = queries.mean(axis=0)
    radius = float(np.sqrt(((queries - centre) ** 2).sum(axis=1).max()))
    size = float(np.sqrt((centre * centre).sum()))
    length = np.sqrt((queries * queries).sum(axis=1))
    done, nodes = 0, chunk.nodes
    mids = chunk.x[nodes[:, 2]]
    far = np.sqrt((mids * mids).sum(axis=1))
    reach = (mids @ centre) + size * chunk.radii + far * radius + radius * chunk.radii
    reach += SLACK * (size + radius) * (far + chunk.radii) + 1e-6
    waiting = [0]
    while waiting:
        node = waiting.pop()
        if reach[node] < best.floor.min():
            continue
        lo, hi, _, first, end = nodes[node]
        if first < end:  # the child that promises most comes next
            waiting += sorted(range(first, end), key=reach.__getitem__)
            continue
        own = queries @ mids[node] + length * chunk.radii[node] + SLACK * length * (far[node] + chunk.radii[node]) + 1e-6
        some = np.flatnonzero(own >= best.floor)
        if not len(some):
            continue
        scores = products(queries[some], chunk.x[lo:hi])
        done += scores.size
        i, j = np.nonzero(scores >= best.floor[some][:, None])
        counts = chunk.ends[lo + j + 1] - chunk.ends[lo + j]
        rows = np.repeat(chunk.ends[lo + j + 1] - np.cumsum(counts), counts) + np.arange(counts.sum())
        best.add(np.repeat(some[i], counts), np.repeat(scores[i, j], counts), chunk.ids[rows], chunk.rows[rows])
    return done


_TREE = pa.schema([
    ("key", pa.int64()), ("home", pa.int64()), ("x", pa.binary()), ("nodes", pa.binary()), ("radii", pa.binary()), ("ends", pa.binary()),
    ("ids", pa.binary()), ("rows", pa.binary()), ("cids", pa.binary()), ("floor", pa.binary()), ("centre", pa.list_(pa.float64())),
    ("radius", pa.float64()), ("worst", pa.int64()), ("found", pa.list_(pa.binary())),
])
_TREE_DDL = ("key long, home long, x binary, nodes binary, radii binary, ends binary, ids binary, rows binary, cids binary, floor binary,"
             " centre array<double>, radius double, worst long, found array<binary>")


def _found(best: Best, cids: np.ndarray) -> list[bytes]:
    return [a.astype("<i8").tobytes() for a in (cids[best.query], best.score, best.id, best.row)]


def build(classes: DataFrame, size: int, k: int, centres: np.ndarray, parts: int) -> DataFrame:
    """Chunks with their trees and, as rows with a ``home``, the query groups with what their own chunk holds for them.

    ``classes`` hold (cid, v, ids, rows, asks).
    """
    shared = classes.sparkSession.sparkContext.broadcast(centres)  # LEAVES vectors at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mid = shared.value
        for b in batches:
            x = _dense(b.column("v"), size).astype(np.float64)
            leaf = np.argmin((mid * mid).sum(axis=1)[None, :] - 2 * (x @ mid.T), axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*b.schema.names, "leaf"])

    def grow(rows: pa.Table, key: int) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        x = _dense(rows["v"].combine_chunks(), size).astype(np.float64)
        order, nodes, radii = cover_tree(x)
        rows, x = rows.take(pa.array(order)), x[order]
        members, rows_of = rows["ids"].combine_chunks(), rows["rows"].combine_chunks()
        ends = np.r_[0, np.cumsum(np.asarray(members.value_lengths()))].astype(np.int64)
        ids, numbers = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (members, rows_of))
        chunk = Chunk(x, nodes, radii, ends, ids, numbers)
        packed = {"key": key, "x": _pack(x), "nodes": nodes.tobytes(), "radii": radii.tobytes(), "ends": ends.tobytes(), "ids": ids.tobytes(),
                  "rows": numbers.tobytes(), "centre": x[nodes[0, 2]].tolist(), "radius": float(radii[0])}
        yield pa.RecordBatch.from_pylist([packed], schema=_TREE)
        asks = np.flatnonzero(rows["asks"].to_numpy())
        cids = rows["cid"].to_numpy()
        for g, a in enumerate(range(0, len(asks), GROUP)):
            some = asks[a : a + GROUP]
            best = Best(len(some), k)
            search(x[some], chunk, best)
            centre = x[some].mean(axis=0)
            group = {"key": (key << 16) + g, "home": key, "x": _pack(x[some]), "cids": cids[some].tobytes(), "floor": best.floor.tobytes(),
                     "centre": centre.tolist(), "radius": float(np.sqrt(((x[some] - centre) ** 2).sum(axis=1).max())), "worst": int(best.floor.min()),
                     "found": _found(best, cids[some])}
            yield pa.RecordBatch.from_pylist([group], schema=_TREE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, key = [], 0, TaskContext.get().partitionId() << 20
        for b in batches:
            held.append(b)
            waiting += len(b)
            while waiting >= CHUNK:
                table = pa.Table.from_batches(held)
                yield from grow(table.slice(0, CHUNK), key)
                held, waiting, key = table.slice(CHUNK).to_batches(), waiting - CHUNK, key + 1
        if waiting:
            yield from grow(pa.Table.from_batches(held), key)

    placed = classes.mapInArrow(place, "cid long, v array<long>, ids array<long>, rows array<long>, asks boolean, leaf long")
    dealt = placed.repartitionByRange(parts, "leaf", F.xxhash64("cid")).sortWithinPartitions("leaf", F.xxhash64("cid"))
    return dealt.mapInArrow(cut, _TREE_DDL)


def open_pairs(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """(grp, chunk) of all query groups and other chunks whose bound reaches the group's worst k-th score, tested in packs."""
    node = F.struct("key", "home", "centre", "radius", "worst")
    chunk_pack, group_pack = F.shiftright("key", 20 + 8), F.shiftright("key", 16 + 20 + 4)
    packed = chunks.groupBy(chunk_pack.alias("pack")).agg(F.collect_list(node).alias("b"))  # of 256 tasks' chunks
    last = chunks.agg(F.max(chunk_pack)).first()[0]
    asking = groups.groupBy(group_pack.alias("side")).agg(F.collect_list(node).alias("a"))  # of 16 tasks' groups
    both = asking.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))).join(packed, "pack").select("a", "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("a"), batch.column("b")):
                key, home, centre, radius, worst = (left.values.field(c).to_numpy(zero_copy_only=False) for c in ("key", "home", "centre", "radius", "worst"))
                other, _, middle, far, _ = (right.values.field(c).to_numpy(zero_copy_only=False) for c in ("key", "home", "centre", "radius", "worst"))
                centre, middle = np.stack(centre), np.stack(middle)
                la, lb = np.sqrt((centre * centre).sum(axis=1)), np.sqrt((middle * middle).sum(axis=1))
                reach = centre @ middle.T + np.outer(la, far) + np.outer(radius, lb) + np.outer(radius, far)
                reach += SLACK * np.outer(la + radius, lb + far) + 1e-6
                i, j = np.nonzero((reach >= worst[:, None]) & (home[:, None] != other[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(key[i].astype(np.int64)), pa.array(other[j].astype(np.int64))], ["grp", "chunk"])

    return both.mapInArrow(test, "grp long, chunk long")


def visit(pairs: DataFrame, groups: DataFrame, chunks: DataFrame, size: int, k: int) -> DataFrame:
    """Rows with ``found``: what the chunks of ``pairs`` hold for their groups. Each chunk goes out once per slice of its groups."""
    spark = pairs.sparkSession
    wanted = pairs.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("long").alias("slices"))
    wanted, _ = materialise(wanted, "slices")
    total = wanted.agg(F.sum("slices")).first()[0] or 0
    fields = ["key", "x", "nodes", "radii", "ends", "ids", "rows", "cids", "floor"]
    data = chunks.select(*fields).join(wanted, F.col("key") == F.col("chunk")).withColumn(
        "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).select("chunk", "slice", F.lit(0).alias("kind"), *fields)
    asked = pairs.join(wanted, "chunk").join(groups.select(*fields), F.col("grp") == F.col("key")).select(
        "chunk", F.pmod(F.xxhash64("grp"), F.col("slices")).alias("slice"), F.lit(1).alias("kind"), *fields)
    work = data.unionByName(asked).repartition(max(1, min(total, 100_000)), "chunk", "slice").sortWithinPartitions("chunk", "slice", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        for batch in batches:
            for r in range(len(batch)):
                raw = {c: batch.column(c)[r].as_buffer() for c in fields[1:]}
                x = _unpack(raw["x"].to_pybytes(), size)
                if batch.column("kind")[r].as_py() == 0:
                    ends, ids, rows = (np.frombuffer(raw[c], dtype=np.int64) for c in ("ends", "ids", "rows"))
                    chunk = Chunk(x, np.frombuffer(raw["nodes"], dtype=np.int64).reshape(-1, 5), np.frombuffer(raw["radii"]), ends, ids, rows)
                    continue
                best = Best(len(x), k, np.frombuffer(raw["floor"], dtype=np.int64))
                search(x, chunk, best)
                if len(best.query):
                    found = _found(best, np.frombuffer(raw["cids"], dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.binary()))], ["found"])

    return work.mapInArrow(run, "found array<binary>")


def _unfold(found: DataFrame) -> DataFrame:
    """(cid, score, id, row) of packed results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column("found"):
                parts = [np.frombuffer(p.as_buffer(), dtype="<i8") for p in one.values]
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], ["cid", "score", "id", "row"])

    return found.mapInArrow(run, "cid long, score long, id long, row long")


#: Stands for a null id while results are ordered, so that null ids come last.
_NO_ID = 2**63 - 1


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of ``vectors`` whose id is divisible by ``every``, its ``k`` other rows of highest inner product: query_id, rank, vec_id, score.

    Parts count as floor(256 x). Vectors that are null or hold null or non-finite parts take no part; an empty or shorter vector counts as
    continued with zeros. Ties go to the smaller id, null ids last; a row is left out of its own result only, so repeated rows find
    each other. Fewer other rows than ``k`` give fewer ranks, an empty table gives none. Products beyond long raise. Other columns are not read.
    """
    spark = vectors.sparkSession
    taken = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col)).alias("v")).where("v is not null")
    rows, _ = materialise(taken.withColumn("row", F.monotonically_increasing_id()), "rows")
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    # of equal vectors only the first k + 1 rows can be in a result, one of them may be the query's own
    order = F.row_number().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"), "row"))
    first = rows.withColumn("order", order).where(F.col("order") <= k + 1)
    members = F.array_sort(F.collect_list(F.struct(F.coalesce("vec_id", F.lit(_NO_ID)).alias("id"), "row")))
    asked = rows.groupBy("v").agg(F.max(asks).alias("asks"))
    classes = first.groupBy("v").agg(members.alias("m")).join(asked, "v").select(
        F.monotonically_increasing_id().alias("cid"), "v", F.col("m.id").alias("ids"), F.col("m.row").alias("rows"), "asks")
    classes, total = materialise(classes, "vectors")
    size = max(1, classes.agg(F.max(F.size("v"))).first()[0] or 0)
    sample = [r.v for r in classes.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()]
    drawn = np.zeros((max(1, len(sample)), size))
    for r, v in enumerate(sample):
        drawn[r, : len(v)] = v
    centres = drawn[farthest_first(drawn, LEAVES)[0]]
    centres = centres[cover_tree(centres, 1)[0]]
    parts = max(1, -(-total // CHUNK), min(spark.sparkContext.defaultParallelism, total // 1024))
    tree, _ = materialise(build(classes, size, k + 1, centres, parts), "tree")
    chunks, groups = tree.where("home is null"), tree.where("home is not null")
    if not groups.limit(1).count():
        pairs = spark.createDataFrame([], "grp long, chunk long")
    else:
        pairs, _ = materialise(open_pairs(groups, chunks), "pairs")
    more, _ = materialise(visit(pairs, groups, chunks, size, k + 1), "found")
    results = _unfold(groups.select("found").unionByName(more))
    rank = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"), "id", "row"))
    best = results.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("cid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "score", "id", "row"))).alias("best"))
    queries = rows.where(asks).join(classes.where("asks").select("cid", "v"), "v").select("cid", F.col("vec_id").alias("query_id"), "row")
    mine = F.slice(F.filter("best", lambda x: x["row"] != F.col("row")), 1, k)
    return queries.join(best, "cid").select("query_id", F.posexplode(mine).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.nullif(F.col("x.id"), F.lit(_NO_ID)).alias("vec_id"), F.col("x.score").alias("score"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other embeddings of each fiftieth."""
    return top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


ORACLE = """
WITH x AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM x q JOIN x c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
t AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""
