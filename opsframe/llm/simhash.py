"""SimHash near-duplicates found by covering locality-sensitive hashing.

A bit position i gets a code m(i), one of the 2^(r+1) - 1 nonzero vectors of r + 1 bits, in turn. For every nonzero vector
v there is a table whose mask keeps the positions with an odd number of ones in m(i) AND v. Two fingerprints at r or fewer
bits differ in positions with r codes at most; some nonzero v is orthogonal to all of them, so that table's mask drops
every differing position and the pair collides there. No pair within the radius is missed, whatever the data.

Equal fingerprints are one entry from the start. A bucket with many entries is cut into chunks of bounded size, every two
of which are compared in one task, and what leaves it is a star per group of linked entries, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import components, materialise, read
from opsframe.llm.mixing import row_digest

BITS = 64
SEED = 42
#: Entries of a chunk of a large bucket.
CHUNK = 1000
#: Shingles whose bits are counted at once.
STEP = 1 << 15


def fingerprint(text: bytes, shingle: int) -> int:
    """Lower-cases A-Z, takes words between ASCII white space and the majority bits of their shingles' XXH64."""
    words = text.lower().split()  # bytes: lower() and split() know ASCII only
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n < 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, STEP):
        m = min(STEP, n - k)
        cuts = zip(starts[k : k + m], starts[k + shingle : k + shingle + m])
        h = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in cuts), dtype="<u8", count=m)
        counts += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    set_bits = np.packbits(counts * 2 > n, bitorder="little")
    return int.from_bytes(set_bits.tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, keyed: bool = False) -> DataFrame:
    """(doc_id, fp) per row, fp as the 64 bits of a long; if ``keyed``, also ``row``, a digest of id and text."""
    key = [row_digest(id_col, text_col).alias("row")] if keyed else []
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), *key, F.col(text_col).cast("binary").alias("t"))
    names = ["doc_id", "row"] if keyed else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py() or b"", shingle) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], [*names, "fp"])

    return wanted.mapInArrow(run, f"doc_id long, {'row binary, ' if keyed else ''}fp long")


def covering_masks(radius: int) -> list[int]:
    """The masks of the 2^(radius + 1) - 1 tables, as signed longs."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    masks = [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _stars(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(value, smallest value of its group) over the links among ``values``."""
    n = len(values)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    signed = values.view(np.int64)
    return list(zip(signed[moved].tolist(), signed[label[moved]].tolist()))


def links(fps: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints ``fp`` (distinct) linked at ``radius`` bits or fewer."""
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in enumerate(covering_masks(radius))])
    keyed = fps.select("fp", F.explode(tables).alias("t")).select("fp", F.col("t.k").alias("k"), F.col("fp").bitwiseAND(F.col("t.m")).alias("key"))
    full = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = full.select("k", "key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # chunk i meets every other chunk of its bucket once, as (smaller, larger)
    met = keyed.join(full, ["k", "key"]).withColumn("own", own).select(
        "k", "key", "fp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"), "own")
    pairs = met.groupBy("k", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for x in b.column("fps"):
                values = np.sort(x.values.to_numpy(zero_copy_only=False).view(np.uint64))
                found.update(_stars(values, radius))
            a = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], ["a", "b"])

    return pairs.select("fps").mapInArrow(run, "a long, b long").distinct()


def _placed(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, first, root) per fingerprint of ``prints``: its smallest doc_id and the fingerprint that names its group."""
    classes, _ = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    edges, _ = materialise(links(classes.select("fp"), radius), "edges")
    groups = components(edges)
    return classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """Near-duplicate groups: per row of ``docs`` doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` bits. Null and empty texts, and texts of
    white space, have fingerprint zero and link like any other. Texts shorter than a shingle hash as a whole. A null
    doc_id keeps its row and is never a group's smallest, unless the group has no other. Equal rows get equal results. An empty table gives
    no rows; other columns are not read.
    """
    prints, _ = materialise(fingerprints(docs, id_col, text_col, shingle), "prints")
    placed = _placed(prints, radius)
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: the one with the smallest doc_id, of several rows with that id the smallest digest of id and text.

    A null id comes last. Rows are told apart by id and text, so neither null nor repeated ids tie rows of different groups.
    """
    prints, _ = materialise(fingerprints(docs, id_col, text_col, shingle, keyed=True), "prints")
    rows = prints.groupBy("fp", "row").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_rows"))
    rows = rows.join(_placed(prints, radius).select("fp", "root"), "fp")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "n_rows")).alias("least")
    kept, _ = materialise(rows.groupBy("root").agg(least).select(F.col("least.row").alias("row"), F.col("least.n_rows").alias("n_rows")), "kept")
    held = docs.select(F.struct("*").alias("doc"), row_digest(id_col, text_col).alias("row"))  # so no name can clash
    once = held.join(kept.where("n_rows = 1"), "row", "left_semi")
    again = held.join(kept.where("n_rows > 1"), "row", "left_semi").dropDuplicates(["row"])
    return once.union(again).select("doc.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents by 3-word shingles at 3 or fewer differing bits."""
    return simhash_groups(read(spark, sf_dir, "documents", "doc_id", "text"))
