"""Spelling variant grouping by a dictionary of trie node pairs.

The words are sorted and the nodes of their trie numbered; the same for the reversed words. A word without its i-th character is then a
pair of integers, the node of what stands before and the node of what stands behind. Two words that share such a pair at a skipped
place differ by one replaced character; a word whose halves meet at that pair, with nothing skipped, lacks the one character. So near
words are found by equality of integer pairs alone, exactly, for words of any length.

A pair joins at most one word per character of the alphabet and one more without it, so groups are small by construction. No pairs of words are
put out: each group holds its best words, and each member reads what it needs from them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import drop_step, materialise, pieces, read, tasks, write_step

#: Code points and occurrences that a word needs.
MIN_LENGTH, MIN_COUNT = 6, 5
#: How often its form must occur for each occurrence of a word.
RATIO = 5
#: The share of (document, run) pairs that lose a code point is one in this many.
LOSS = 199
#: Counts that a task holds before it puts them out.
HELD = 1_000_000
#: Words of one task when nodes are numbered.
PER_TASK = 500_000
_RUN = re.compile("[a-zÀ-ÿ]+")
_ASCII_RUN = re.compile("[a-z]+")


def runs(doc_id: str, text: bytes) -> Counter:
    """Occurrences of each run of a UTF-8 text, A-Z lower-cased, after the losses that the document's id decides."""
    found: Counter = Counter()
    for piece in pieces(text):
        low = piece.lower()
        found.update(_ASCII_RUN.findall(low.decode()) if low.isascii() else _RUN.findall(low.decode(errors="replace")))
    seed = zlib.crc32(f"{doc_id}:".encode())
    lost = [(run, h) for run in found if (h := zlib.crc32(run.encode(), seed)) % LOSS == 0]
    out = found
    moved = [(run[: h % len(run)] + run[h % len(run) + 1 :], found[run]) for run, h in lost]
    for run, _ in lost:
        del out[run]
    for run, n in moved:
        out[run] += n
    return out


def count_words(docs: DataFrame, min_length: int) -> DataFrame:
    """(word, n): occurrences of each word of at least ``min_length`` code points, summed per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = text.as_buffer()
                if data is None:
                    continue
                get = held.get
                for word, n in runs(doc_id, bytes(data)).items():
                    if len(word) >= min_length:
                        held[word] = get(word, 0) + n
                if len(held) > HELD:
                    yield emit()
                    held = {}
        if held:
            yield emit()

    return docs.mapInArrow(run, "word string, n long")


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def number_nodes(words: DataFrame, count: int, reverse: bool) -> tuple[DataFrame, dict[int, int]]:
    """(word, n, nodes): the numbers of a word's trie nodes from the root to the whole word, and which numbers mean which others.

    Sorted words share nodes with their predecessor up to the common prefix; the rest of a word's nodes are new. Tasks
    number ranges of the sorted words independently. A range's first word may share a prefix with the range before; those few nodes have
    two numbers, and the second is mapped to the first. For that, the driver reads the first and last word of each range.
    """
    key = F.reverse("word") if reverse else F.col("word")
    parts = tasks(words.sparkSession, count, PER_TASK)
    dealt = words.withColumn("key", key).repartitionByRange(parts, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() + 1) << 40  # a task numbers fewer than 2**40 nodes; 0 is the root
        used, before, path = 0, "", [0]
        first = True
        for batch in chain(batches, [None]):
            if batch is None:
                if not first:  # the last word once more, marked as such
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([path], pa.list_(pa.int64())),
                         pa.array([before], pa.string()), pa.array([base], pa.int64())], ["word", "n", "nodes", "edge", "base"])
                continue
            nodes, edges = [], []
            for word in batch.column("key").to_pylist():
                same = _common(before, word)
                path = path[: same + 1] + list(range(base + used, base + used + len(word) - same))
                used += len(word) - same
                before = word
                nodes.append(path)
                edges.append(word if first else None)
                first = False
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(nodes, pa.list_(pa.int64())), pa.array(edges, pa.string()),
                 pa.array([base if e is not None else None for e in edges], pa.int64())], ["word", "n", "nodes", "edge", "base"])

    numbered, _ = materialise(dealt.mapInArrow(run, "word string, n long, nodes array<long>, edge string, base long"), "nodes")
    means: dict[int, int] = {}
    last, last_nodes = None, []
    for row in numbered.where("edge is not null").select("word", "edge", "nodes", "base").orderBy("base", F.col("word").isNull()).collect():
        if row.word is not None and last is not None:  # the first word of a range beside the last one before it
            same = _common(last, row.edge)
            means.update({row.nodes[d]: last_nodes[d] for d in range(1, same + 1)})
        last, last_nodes = row.edge, [means.get(x, x) for x in row.nodes]
    return numbered.where("word is not null").select("word", "n", "nodes"), means


def node_pairs(forward: DataFrame, backward: DataFrame, same_prefix: dict[int, int], same_suffix: dict[int, int]) -> DataFrame:
    """(prefix, suffix, own, n, skips, extra): each word's places by the nodes around them; ``own`` is the word's own last node.

    ``skips`` tells whether a character stands between both nodes. ``extra`` is false where the skipped character repeats the one
    before it, so that leaving out either of them counts once.
    """
    maps = forward.sparkSession.sparkContext.broadcast((same_prefix, same_suffix))  # a common prefix per range of words
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
    names = ["prefix", "suffix", "own", "n", "skips", "extra"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = maps.value
        out: list[list] = [[] for _ in kinds]
        for batch in batches:
            for word, n, ahead, behind in zip(*(batch.column(c) for c in ("word", "n", "nodes", "back"))):
                word, n = word.as_py(), n.as_py()
                ahead = [first.get(x, x) for x in ahead.as_py()]
                behind = [second.get(x, x) for x in behind.as_py()]
                length = len(word)
                out[0] += ahead[:length] + ahead
                out[1] += behind[length - 1 :: -1] + behind[::-1]
                out[2] += [ahead[-1]] * (2 * length + 1)
                out[3] += [n] * (2 * length + 1)
                out[4] += [True] * length + [False] * (length + 1)
                out[5] += [not i or word[i] != word[i - 1] for i in range(length)] + [False] * (length + 1)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)
                    out = [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    both = forward.join(backward.select("word", F.col("nodes").alias("back")), "word")
    return both.mapInArrow(run, "prefix long, suffix long, own long, n long, skips boolean, extra boolean")


def near_words(places: DataFrame) -> DataFrame:
    """(own, n_near, best): per word with near words how many there are and the one with most occurrences, as (-n, own).

    A word's number rises in code-point order, so the smallest (-n, own) is the wanted one also among equal counts.
    """
    item = F.struct((-F.col("n")).alias("m"), "own")
    grouped = places.groupBy("prefix", "suffix").agg(
        F.array_sort(F.collect_list(F.when(F.col("skips"), F.struct((-F.col("n")).alias("m"), "own", "extra")))).alias("held"),
        F.min(F.when(~F.col("skips"), item)).alias("whole"))  # one word at most is the pair itself
    met = grouped.where("size(held) > 1 or size(held) = 1 and whole is not null and held[0].extra")
    first_other = F.expr("get(filter(slice(held, 1, 2), y -> y.own <> x.own), 0)")
    longer = F.expr("filter(held, y -> y.extra)")
    met = met.withColumn("longer", longer)
    replaced = met.select(F.explode("held").alias("x"), "held", "whole").select(
        F.col("x.own").alias("own"),
        (F.size("held") - 1 + F.when(F.col("x.extra") & F.col("whole").isNotNull(), 1).otherwise(0)).cast("long").alias("n_near"),
        F.array_min(F.array_compact(F.array(
            F.when(first_other.isNotNull(), F.struct(first_other["m"].alias("m"), first_other["own"].alias("own"))),
            F.when(F.col("x.extra"), F.col("whole"))))).alias("best"))
    lacking = met.where("whole is not null and size(longer) > 0").select(
        F.col("whole.own").alias("own"), F.size("longer").cast("long").alias("n_near"),
        F.struct(F.col("longer")[0]["m"].alias("m"), F.col("longer")[0]["own"].alias("own")).alias("best"))
    return replaced.where("n_near > 0").unionByName(lacking).groupBy("own").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """(own, root): from each word along its ``form`` to the last. Each round doubles the steps; counts rise along forms, so no circle."""
    spark = forms.sparkSession
    path, _ = write_step(forms.where("form is not null").select("own", F.col("form").alias("root")), "roots")
    while True:
        now = spark.read.parquet(path)
        onward = now.select(F.col("own").alias("root"), F.col("root").alias("next"))
        further = now.select("own", "root").join(onward, "root", "left")
        out, _ = write_step(further.select("own", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = spark.read.parquet(out).where("moved").limit(1).count()
        drop_step(spark, path)
        path = out
        if not moved:
            return spark.read.parquet(path).select("own", "root")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """Per word of ``docs``: word, form, root, n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point turns one into the other. A word's form is its near word with
    most occurrences (ties: first in code-point order), if it occurs ``ratio`` times as often. Null texts hold no words, a null id counts as
    an empty one, repeated rows count each. Texts and words may be of any length. An empty table, or one without frequent words,
    gives no rows. Other columns are not read.
    """
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id")
    counted = count_words(docs.select(ids, F.col("text").cast("string").alias("text")), min_length)
    words, count = materialise(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "words")
    forward, same_prefix = number_nodes(words, count, False)
    backward, same_suffix = number_nodes(words, count, True)
    near, _ = materialise(near_words(node_pairs(forward, backward, same_prefix, same_suffix)), "near")
    numbered = forward.select("word", "n", F.element_at("nodes", -1).alias("own"))
    taken = -F.col("best.m") >= ratio * F.col("n")
    formed, _ = materialise(numbered.join(near, "own", "left").select(
        "own", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.own")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n")), "forms")
    named = numbered.select(F.col("own").alias("form"), F.col("word").alias("form_word"))
    roots = follow(formed).join(numbered.select(F.col("own").alias("root"), F.col("word").alias("root_word")), "root").select("own", "root_word")
    out = formed.join(named, "form", "left").join(roots, "own", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(read(spark, sf_dir, "documents", "doc_id", "text"))
