"""Repeated byte strings found by a distributed merge sort of suffixes that never re-compares known prefixes.

A byte goes when a string of ``width`` bytes that covers it also starts anywhere else. Whether the string at a start repeats
shows in the sorted order of suffixes: it does if a neighbour shares ``width`` bytes or more.

1. Each text is cut into stretches of starts that share one anchor: the smallest hash among the ``ANCHOR``-byte strings
   within the start's ``width`` bytes. The anchor depends on those bytes only, so equal strings have equal anchors, and
   starts whose anchor occurs once in the corpus are settled. So are equal stretches: they are counted, not sorted.
2. The stretches that differ but share an anchor yield the suffixes to sort. A task sorts runs of them; anchor classes that
   lie in one run are settled by it, since equal strings never have different anchors. The distinct suffixes of classes that
   span runs are cut at common splitters and exchanged front-coded: the length shared with the suffix before, and the rest.
3. The pieces of one range meet in a task, and a loser tree merges them. Every competitor carries the length it shares with the
   last winner. Different lengths decide without looking at a byte; equal lengths compare from there on.
4. Suffixes that repeat go back to their stretches, those to their texts, whose covered bytes are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import drop_step, materialise, read, write_step

WIDTH = 200
#: Bytes of an anchor; a start chooses among WIDTH - ANCHOR + 1 of them.
ANCHOR = 40
#: Bytes hashed at once; a longer text goes in overlapping stretches.
BLOCK = 1 << 18
#: Suffixes of a sorted run, and of a range on average.
RUN, RANGE = 60_000, 400_000
#: Stretches drawn for the splitters, at most.
SPLITTER_SAMPLE = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_POW, _INV = _powers(_BASE, BLOCK + 2)
_POW2, _INV2 = _powers(_BASE2, BLOCK + 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _prefix(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=out[1:])
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w successive values, from running minima forwards and backwards in blocks of w."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def stretches(data: np.ndarray, valid: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Stretches of starts with one anchor: first start, last start, anchor hash, content hash.

    ``valid`` marks the starts whose ``width`` bytes lie within one text.
    """
    n = len(data)
    sums = _prefix(data, _POW)
    h = _mix((sums[anchor:] - sums[:-anchor]) * _INV[: n - anchor + 1])
    low = np.uint64((1 << 21) - 1)  # the place decides between equal hashes: the leftmost wins
    best = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), width - anchor + 1)
    at = (best & low).astype(np.int64)
    change = np.ones(len(at), dtype=bool)
    change[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(at)) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    sums2 = _prefix(data, _POW2)
    content = _mix((sums2[last + width] - sums2[first]) * _INV2[first])
    return first, last, h[at[first]].view(np.int64), content.view(np.int64)


def _pieces(texts: list[bytes], width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, bytes) of up to BLOCK bytes; pieces of a long text overlap by width - 1."""
    group, size = [], 0
    for k, t in enumerate(texts):
        for a in range(0, max(1, len(t) - width + 1), BLOCK // 2):
            piece = t[a : a + BLOCK // 2 + width - 1]
            if size + len(piece) > BLOCK:
                yield group
                group, size = [], 0
            group.append((k, a, piece))
            size += len(piece)
    if group:
        yield group


_STRETCH = "doc_id long, digest binary, s long, e long, h long, c long"


def text_stretches(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    """The stretches of all texts of ``docs`` (doc_id, t binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, column = b.column("doc_id"), b.column("t")
            for lo in range(0, len(ids), 512):
                texts = column.slice(lo, 512).to_pylist()
                digests = pa.array([hashlib.md5(t, usedforsecurity=False).digest() for t in texts], pa.binary())
                for group in _pieces(texts, width):
                    lens = np.array([len(p) for _, _, p in group])
                    begin = np.concatenate([[0], np.cumsum(lens)])
                    data = np.frombuffer(b"".join(p for _, _, p in group), dtype=np.uint8)
                    if len(data) < width:
                        continue
                    owner = np.repeat(np.arange(len(group)), lens)[: len(data) - width + 1]
                    valid = np.arange(len(owner)) + width <= begin[1:][owner]
                    first, last, h, c = stretches(data, valid, width, anchor)
                    if not len(first):
                        continue
                    who = owner[first]
                    doc = np.array([k for k, _, _ in group])[who]
                    shift = np.array([a for _, a, _ in group])[who] - begin[:-1][who]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(doc + lo)), digests.take(pa.array(doc)), pa.array(first + shift), pa.array(last + shift),
                         pa.array(h), pa.array(c)], ["doc_id", "digest", "s", "e", "h", "c"])

    return docs.mapInArrow(run, _STRETCH)


# ---- sorted runs -----------------------------------------------------------------------------------------


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared lengths with the row before (0 for the first), and the remaining bytes, of sorted equal-width rows."""
    n, width = rows.shape
    shared = np.zeros(n, dtype=np.int64)
    differ = rows[1:] != rows[:-1]
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return shared, rows[np.arange(width)[None, :] >= shared[:, None]].tobytes()


def front_decode(shared: np.ndarray, rest: bytes, width: int) -> Iterator[bytes]:
    """The rows again, one at a time."""
    row, at = b"", 0
    for k in shared.tolist():
        row = row[:k] + rest[at : at + width - k]
        at += width - k
        yield row


def loser_tree_merge(runs: list[tuple[np.ndarray, bytes, np.ndarray]], width: int) -> Iterator[tuple[int, int, int]]:
    """Merges front-coded runs: (shared length with the suffix before, run, index in run) in sorted order.

    A run is (shared lengths, rest, ids). A node of the tree keeps the loser of its match; each competitor knows
    the length it shares with the suffix that last won, and no byte before that is compared again.
    """
    n = 1
    while n < len(runs):
        n *= 2
    rows = [front_decode(s, r, width) for s, r, _ in runs]
    shared = [s.tolist() for s, _, _ in runs]
    sizes = [len(s) for s in shared]
    # text, shared length with the last winner, position; None marks an empty run
    text: list[bytes | None] = [next(g, None) for g in rows] + [None] * (n - len(runs))
    known, place = [0] * n, [0] * n
    losers = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); a loser's length becomes that shared with its winner, the next suffix put out."""
        ta, tb = text[a], text[b]
        if ta is None or tb is None:
            return (b, a) if ta is None else (a, b)
        ka, kb = known[a], known[b]
        if ka != kb:  # the longer agreement with the last winner is the smaller; the other's length stays
            return (a, b) if ka > kb else (b, a)
        if ta[ka:] == tb[ka:]:
            known[b] = width
            return a, b
        x = int.from_bytes(ta[ka:], "big") ^ int.from_bytes(tb[ka:], "big")
        same = width - (x.bit_length() + 7) // 8
        if ta[same] < tb[same]:
            known[b] = same
            return a, b
        known[a] = same
        return b, a

    def build(node: int) -> int:
        if node >= n:
            return node - n
        w, losers[node] = play(build(2 * node), build(2 * node + 1))
        return w

    champion = build(1) if n > 1 else 0
    while text[champion] is not None:
        k = place[champion]
        yield known[champion], champion, k
        k += 1
        place[champion] = k
        if k < sizes[champion]:
            text[champion] = next(rows[champion])
            known[champion] = shared[champion][k]  # front coding tells it for the same run
        else:
            text[champion] = None
        node = (champion + n) >> 1
        while node:
            champion, losers[node] = play(champion, losers[node])
            node >>= 1


def repeated_in_range(runs: list[tuple[np.ndarray, bytes, np.ndarray]], width: int) -> list[list[int]]:
    """For each run, the ids of suffixes that another run holds too."""
    out: list[list[int]] = [[] for _ in runs]
    before: tuple[int, int] | None = None
    for shared, run, k in loser_tree_merge(runs, width):
        if shared >= width:
            if before is not None:
                out[before[0]].append(int(runs[before[0]][2][before[1]]))
            out[run].append(int(runs[run][2][k]))
            before = None  # the earlier ones of these equals are noted
        else:
            before = (run, k)
    return out


def sort_run(stretches_: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All starts of the stretches, sorted: distinct rows, the id of each, and ids of starts equal to another here.

    An id is stretch * 2^20 + offset.
    """
    flat = np.frombuffer(b"".join(stretches_), dtype=np.uint8)
    lens = np.array([len(x) for x in stretches_])
    begin = np.cumsum(lens) - lens
    counts = lens - width + 1
    which = np.repeat(np.arange(len(lens)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    raw = flat.tobytes()
    place = (begin[which] + offset).tolist()
    order = np.array(sorted(range(len(place)), key=[raw[p : p + width] for p in place].__getitem__), dtype=np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(flat, width)[np.array(place)[order]]
    ids = (which * (1 << 20) + offset)[order]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    equal = ~fresh
    equal[:-1] |= ~fresh[1:]
    return rows[fresh], ids[fresh], ids[equal]


def cut_points(rows: np.ndarray, splitters: list[bytes]) -> list[int]:
    """Where each range of the splitters begins in sorted rows."""
    out, n = [], len(rows)
    for s in splitters:
        lo, hi = 0, n
        while lo < hi:
            mid = (lo + hi) // 2
            if rows[mid].tobytes() < s:
                lo = mid + 1
            else:
                hi = mid
        out.append(lo)
    return [0, *out, n]


_OPEN = "h long, c long, kinds long, bytes binary"
_PIECE = "part int, run long, h binary, c binary, shared binary, rest binary, ids binary"


def _contested(open_: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The bytes of one copy of each open stretch."""
    wanted = open_.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("s", "e", "h", "c", "kinds")).alias("cuts"))
    wanted = wanted.withColumnsRenamed({"doc_id": "d", "digest": "k"})
    held = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("k"))).select("t", "cuts")
    cut = held.select("t", F.explode("cuts").alias("x"))
    return cut.select("x.h", "x.c", "x.kinds", F.expr(f"substring(t, cast(x.s + 1 as int), cast(x.e - x.s + {width} as int))").alias("bytes"))


def _sorted_runs(rows: DataFrame, splitters: list[bytes], width: int, run_size: int) -> DataFrame:
    """Sorted runs, as rows of ``_PIECE``.

    A task takes whole anchor classes, and a class too large for a run only in part (``salt``). Every run puts out a row
    with part -1: its stretches and the ids of starts equal to another of the run, which settles the whole classes.
    Of a class that several runs share, the distinct starts follow, cut at the splitters and front-coded, to be exchanged.
    """
    shared_splitters = rows.sparkSession.sparkContext.broadcast(splitters)  # at most one per range, width bytes each

    def emit(run: int, held: list[tuple[int, int, bytes]], split: bool) -> pa.RecordBatch:
        h, c, data = zip(*held)
        sorted_rows, ids, equal = sort_run(list(data), width)
        names = [np.array(x, dtype="<i8").tobytes() for x in (h, c)]
        out = [(-1, run, *names, b"", b"", equal.astype("<i8").tobytes())]
        cuts = cut_points(sorted_rows, shared_splitters.value) if split else []
        for part, (a, z) in enumerate(zip(cuts, cuts[1:])):
            if a < z:
                shared, rest = front_code(sorted_rows[a:z])
                out.append((part, run, None, None, shared.astype("<u4").tobytes(), rest, ids[a:z].astype("<i8").tobytes()))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["part", "run", "h", "c", "shared", "rest", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, starts, now = TaskContext.get().partitionId() << 32, [], 0, None
        for b in batches:
            for h, c, salts, salt, data in zip(*(b.column(k).to_pylist() for k in ("h", "c", "salts", "salt", "bytes"))):
                key = (salts > 1, h, salt)
                # a class of several runs stands alone; others share a run until it is full, and end with it
                if held and key != now and (starts >= run_size or key[0] or now[0]):
                    yield emit(number, held, now[0])
                    number, held, starts = number + 1, [], 0
                now = key
                held.append((h, c, data))
                starts += len(data) - width + 1
        if held:
            yield emit(number, held, now[0])

    per_run = max(1, run_size // (width // 2))
    salted = rows.withColumn("salts", F.ceil(F.col("kinds") / per_run)).withColumn("salt", F.pmod("c", F.col("salts")))
    dealt = salted.repartition("h", "salt").sortWithinPartitions("salts", "h", "salt", "c")
    return dealt.select("h", "c", "salts", "salt", "bytes").mapInArrow(run, _PIECE)


def _merge(width: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        runs = [
            (np.frombuffer(s, "<u4"), r, np.frombuffer(i, "<i8"))
            for s, r, i in zip(pieces["shared"], pieces["rest"], pieces["ids"])
        ]
        found = repeated_in_range(runs, width)
        rows = [(run_, np.array(ids, dtype="<i8").tobytes()) for run_, ids in zip(pieces["run"], found) if ids]
        return pd.DataFrame(rows, columns=["run", "ids"])

    return run


def _spans(found: DataFrame) -> DataFrame:
    """(h, c, lo, hi): offsets of a stretch that repeat, as closed intervals, from the ids of each run."""
    low = (1 << 20) - 1

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in rows["ids"]]))
        names = rows[rows["part"] == -1]
        h, c = np.frombuffer(names["h"].iloc[0], "<i8"), np.frombuffer(names["c"].iloc[0], "<i8")
        first = np.ones(len(ids), dtype=bool)
        first[1:] = np.diff(ids) != 1  # ids of two stretches are never neighbours: a stretch is shorter than 2^20 - 1
        lo = ids[first]
        hi = ids[np.append(np.flatnonzero(first)[1:], len(ids)) - 1] if len(ids) else ids
        return pd.DataFrame({"h": h[lo >> 20], "c": c[lo >> 20], "lo": lo & low, "hi": hi & low})

    return found.groupBy("run").applyInPandas(run, "h long, c long, lo long, hi long")


def repeated_starts(
    docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, run_size: int = RUN, range_size: int = RANGE,
) -> DataFrame:
    """(doc_id, digest, s, e): the starts, as closed intervals, whose ``width`` bytes also start elsewhere.

    ``docs`` has doc_id, digest (MD5 of the text, 16 bytes) and t (the text as binary, never null).
    """
    spark = docs.sparkSession
    path, _ = write_step(text_stretches(docs.select("doc_id", "t"), width, anchor), "stretches")
    all_ = spark.read.parquet(path)
    anchors = all_.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    anchors, _ = materialise(anchors, "anchors")  # joins of two exchanges can split a hot anchor
    shared, _ = materialise(all_.join(anchors, "h", "left_semi"), "shared")
    drop_step(spark, path)
    copies = shared.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "digest", "s", "e")).alias("one"))
    copies, _ = materialise(copies, "copies")
    mixed = copies.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed, _ = materialise(mixed, "mixed")
    # a stretch found twice repeats all through; it is sorted only as a partner for others
    open_ = copies.join(mixed, "h").select("h", "c", "kinds", "one.*")
    rows, n_rows = materialise(_contested(open_, docs, width), "contested")
    twice = copies.where("n > 1").select("h", "c", F.lit(0).cast("long").alias("lo"), F.lit(1 << 40).cast("long").alias("hi"))
    spans = twice
    if n_rows:
        large = rows.where(F.col("kinds") > run_size // (width // 2))
        starts, stretches_ = large.agg(F.coalesce(F.sum(F.length("bytes") - (width - 1)), F.lit(0)), F.count(F.lit(1))).first()
        ranges = max(1, -(-starts // range_size))
        share = SPLITTER_SAMPLE / max(stretches_, SPLITTER_SAMPLE)
        drawn = large.where(F.pmod(F.xxhash64("h", "c"), F.lit(1 << 20)) < int(share * (1 << 20))).select(
            F.expr(f"substring(bytes, 1 + cast(pmod(c, length(bytes) - {width - 1}) as int), {width})").alias("x")).collect()
        drawn = sorted(bytes(r.x) for r in drawn)
        splitters = [drawn[k * len(drawn) // ranges] for k in range(1, ranges)] if drawn else []
        pieces, _ = materialise(_sorted_runs(rows, splitters, width, run_size), "pieces")
        merged = pieces.where("part >= 0").groupBy("part").applyInPandas(_merge(width), "run long, ids binary")
        found = pieces.where("part < 0").select("run", "ids", "part", "h", "c").unionByName(merged, allowMissingColumns=True)
        some, _ = materialise(_spans(found), "spans")
        spans = twice.union(some.join(copies.where("n = 1").select("h", "c"), ["h", "c"], "left_semi"))
    return shared.join(spans, ["h", "c"]).select(
        "doc_id", "digest", (F.col("s") + F.col("lo")).alias("s"), F.least(F.col("s") + F.col("hi"), "e").alias("e"))


def removals(held: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, run_size: int = RUN, range_size: int = RANGE) -> DataFrame:
    """(d, k, spans): the repeated starts of each text, by doc_id and the text's MD5."""
    spans = repeated_starts(held, width, anchor, run_size, range_size).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return materialise(spans.withColumnsRenamed({"doc_id": "d", "digest": "k"}), "removals")[0]


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR,
                with_kept: bool = False, run_size: int = RUN, range_size: int = RANGE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_kept`` the bytes left.

    A byte is removed if a ``width``-byte string that covers it starts at any other place too, of any row; strings are
    judged on the input. Null texts are empty; texts shorter than ``width`` stay whole; equal rows are copies of each
    other and lose everything if they are long enough. Matches don't cross rows. A null doc_id is allowed. Rows are told apart
    by doc_id and the text's MD5, 128 bits. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).withColumn("digest", F.unhex(F.md5("t")))
    spans = removals(held, width, anchor, run_size, range_size)
    both = held.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("k")), "left").select("doc_id", "t", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [remove(t.as_py(), x.as_py(), width) for t, x in zip(b.column("t"), b.column("spans"))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip([*cols[:4], cols[4] if with_kept else [None] * len(rows)], kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = both.mapInArrow(run, _KEPT)
    return out if with_kept else out.drop("kept")


def remove(text: bytes, spans: list[dict] | None, width: int) -> tuple[int, int, int, str, bytes]:
    """(bytes, removed, removed runs, digest of what is left, what is left)."""
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for s, e in sorted((x["s"], x["e"] + width) for x in spans or ()):
        if s > end:  # touching spans are one run
            runs += 1
            kept.append(text[at:s])
        removed += max(0, e - max(s, end))
        at = end = max(end, e)
    kept.append(text[at:])
    left = b"".join(kept)
    return len(text), removed, runs, hashlib.sha256(left).hexdigest(), left


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with the texts that ``dedup_bytes`` leaves; a character cut in two is dropped. Null texts stay null.

    Every row stays, also one of which nothing is left.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    held = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).withColumn("digest", F.unhex(F.md5("t")))
    spans = removals(held.select("doc_id", "t", "digest"), width)
    both = held.drop("t").join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("k")), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series(
            [t if t is None or x is None else remove(t.encode(), list(x), width)[4].decode(errors="ignore") for t, x in zip(texts, found)], dtype=object)

    old = F.col(f"doc.`{text_col}`")
    new = F.when(F.col("spans").isNull(), old).otherwise(cut(old, "spans"))
    return both.select(*[new.alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with strings of 200 bytes that occur more than once removed."""
    return dedup_bytes(read(spark, sf_dir, "documents", "doc_id", "text"))
