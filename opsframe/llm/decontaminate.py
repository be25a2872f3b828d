"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, then weighted shingle similarity.

Words are lower-cased runs of word characters. A window has as many words as an item. Both get a 64-bit SimHash of their
five-word shingles, weighted by how rare a shingle is among the items. The index cuts a fingerprint into blocks; two
fingerprints within the radius agree in some block up to radius // blocks bits, and the index lists every block value that near,
so no fingerprint within the radius is missed. What it finds is verified by the exact weighted Jaccard similarity of shingles.

Windows whose shingles, weighed together, can't reach the threshold with any item of their size have no fingerprint taken: the
weight of their shingles that occur in the benchmark is compared with the least weight of an item.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import read
from opsframe.llm.mixing import row_digest

SHINGLE, THRESHOLD = 5, 0.8
RADIUS, BLOCKS = 19, 4
#: Items of one index. More items are searched slice by slice, each slice broadcast for itself.
SLICE = 2000
#: Words of a text looked at together, or twice a longer item's; a longer text goes in overlapping parts.
PART = 1 << 16
#: Windows whose fingerprints are taken at once.
WINDOWS = 20_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _signs(shingles: list[tuple[str, ...]]) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash."""
    h = np.fromiter((xxhash.xxh64_intdigest(" ".join(s).encode()) for s in shingles), dtype="<u8", count=len(shingles))
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64) * 2 - 1


def _vote(weight: float) -> int:
    """A weight as a whole number, so that sums don't depend on their order."""
    return round(weight * 4096)


def _near(value: int, bits: int, radius: int) -> Iterator[int]:
    """All values of ``bits`` bits that differ from ``value`` in ``radius`` bits at most."""
    for k in range(radius + 1):
        for at in combinations(range(bits), k):
            x = value
            for b in at:
                x ^= 1 << b
            yield x


class Index:
    """The searchable form of a slice of the items; its size is bounded by SLICE items."""

    def __init__(self, items: list[tuple[int, list[str]]], weights: dict[tuple[str, ...], float], unseen: float):
        self.unseen, self.ids = unseen, [i for i, _ in items]
        #: items without a shingle by their words; they are one shingle, alike only where equal
        self.short: dict[tuple[str, ...], list[int]] = {}
        for k, (_, w) in enumerate(items):
            if len(w) < SHINGLE:
                self.short.setdefault(tuple(w), []).append(k)
        self.short_sizes = sorted({len(w) for w in self.short})
        bags = [Counter(tuple(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)) for _, w in items]
        self.bags, self.sizes = bags, [len(w) for _, w in items]
        self.weight = {s: weights[s] for b in bags for s in b}
        vocabulary = sorted({w for _, ws in items for w in ws})
        self.vocabulary = {w: k + 1 for k, w in enumerate(vocabulary)}
        keys = sorted((self._key(s), self.weight[s]) for s in self.weight)
        self.keys = np.array([k for k, _ in keys], dtype=np.uint64)
        self.key_weight = np.array([w for _, w in keys])
        total = [sum(self.weight[s] * n for s, n in b.items()) for b in bags]
        self.least = {}
        for size, t in zip(self.sizes, total):
            if size >= SHINGLE:
                self.least[size] = min(t, self.least.get(size, t))
        signs = [_signs(list(b)).T @ np.array([_vote(self.weight[s]) * n for s, n in b.items()]) if b else np.zeros(64) for b in bags]
        self.prints = np.array([np.packbits(s > 0, bitorder="little").view("<u8")[0] for s in signs], dtype=np.uint64)
        width = 64 // BLOCKS
        entries = []
        offsets = np.array(list(_near(0, width, RADIUS // BLOCKS)), dtype=np.int64)
        for k, (size, fp) in enumerate(zip(self.sizes, self.prints.tolist())):
            for b in range(BLOCKS if size >= SHINGLE else 0):
                near = ((fp >> (b * width)) & ((1 << width) - 1)) ^ offsets
                entries.append(np.stack([(size << (width + 8)) | (b << width) | near, np.full(len(near), k)]))
        table = np.concatenate(entries, axis=1) if entries else np.zeros((2, 0), dtype=np.int64)
        order = np.argsort(table[0], kind="stable")
        self.block, self.item = table[0][order], table[1][order].astype(np.int32)

    def _key(self, shingle: tuple[str, ...]) -> int:
        return int(self.mixed(np.array([[self.vocabulary[w]] for w in shingle], dtype=np.uint64))[0])

    @staticmethod
    def mixed(ids: np.ndarray) -> np.ndarray:
        """A 64-bit key of each column of SHINGLE word numbers."""
        h = np.zeros(ids.shape[1], dtype=np.uint64)
        for row in ids:
            h = (h ^ row) * _MIX
            h ^= h >> np.uint64(29)
        return h

    def hit_weights(self, words: list[str]) -> np.ndarray | None:
        """For each shingle of the words its weight if an item holds it, else 0; None if no item does."""
        get = self.vocabulary.get
        ids = np.fromiter(map(get, words, repeat(0)), dtype=np.uint64, count=len(words))
        known = ids > 0
        n = len(ids) - SHINGLE + 1
        full = np.logical_and.reduce([known[k : k + n] for k in range(SHINGLE)])
        at = np.flatnonzero(full)
        if not len(at):
            return None
        keys = self.mixed(np.stack([ids[at + k] for k in range(SHINGLE)]))
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[place] == keys
        if not found.any():
            return None
        out = np.zeros(n)
        out[at[found]] = self.key_weight[place[found]]
        return out

    def search(self, words: list[str]) -> dict[int, tuple[float, int]]:
        """Item number to (similarity, first word) of its best window, for windows at THRESHOLD or more."""
        best = self.equal(words) if self.short else {}
        n = len(words) - SHINGLE + 1
        hits = self.hit_weights(words) if n > 0 else None
        if hits is None:
            return best
        mass = np.concatenate([[0.0], np.cumsum(hits)])
        starts, sizes = [], []
        for size, least in self.least.items():
            m = size - SHINGLE + 1
            if m <= n:
                found = np.flatnonzero(mass[m:] - mass[:-m] >= THRESHOLD * least - 1e-9)
                starts.append(found)
                sizes.append(np.full(len(found), size))
        if not starts:
            return best
        start, size = np.concatenate(starts), np.concatenate(sizes)
        slides: dict[int, Slide] = {}
        for lo in range(0, len(start), WINDOWS):
            p, m = start[lo : lo + WINDOWS], size[lo : lo + WINDOWS]
            for k, item in self.within(self.window_prints(words, p, m - SHINGLE + 1), m):
                first = int(p[k])
                if item not in slides:
                    slides[item] = Slide(self, words, int(m[k]) - SHINGLE + 1, item)
                similarity = slides[item].similarity(first)
                if similarity >= THRESHOLD and (item not in best or (-similarity, first) < (-best[item][0], best[item][1])):
                    best[item] = (similarity, first)
        return best

    def equal(self, words: list[str]) -> dict[int, tuple[float, int]]:
        """The items of fewer words than a shingle, each with the first place of just its words."""
        best: dict[int, tuple[float, int]] = {}
        known = [w in self.vocabulary for w in words]
        for size in self.short_sizes:
            for p in range(len(words) - size + 1):
                if known[p]:
                    for item in self.short.get(tuple(words[p : p + size]), ()):
                        best.setdefault(item, (1.0, p))
        return best

    def window_prints(self, words: list[str], p: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows of m shingles from p on, by differences of running bit votes."""
        n = len(words) - SHINGLE + 1
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, p, 1)
        np.add.at(edge, p + m, -1)
        needed = np.flatnonzero(np.cumsum(edge)[:n] > 0)
        shingles = [tuple(words[k : k + SHINGLE]) for k in needed.tolist()]
        votes = _signs(shingles) * np.array([_vote(self.weight.get(s, self.unseen)) for s in shingles])[:, None]
        running = np.concatenate([np.zeros((1, 64), dtype=np.int64), np.cumsum(votes, axis=0)])
        place = np.searchsorted(needed, p)  # a window's shingles are all needed, so they lie side by side
        return np.packbits(running[place + m] - running[place] > 0, axis=1, bitorder="little").view("<u8").ravel()

    def within(self, prints: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
        """(number of a fingerprint, item) for the items of its size within RADIUS."""
        width, pairs = 64 // BLOCKS, []
        for b in range(BLOCKS):
            value = ((prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
            key = (sizes << (width + 8)) | (b << width) | value
            a = np.searchsorted(self.block, key)
            count = np.searchsorted(self.block, key, side="right") - a
            who = np.repeat(np.arange(len(key)), count)
            at = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
            pairs.append(np.stack([who, self.item[at]]))
        who, item = np.unique(np.concatenate(pairs, axis=1), axis=1)
        near = np.bitwise_count(prints[who] ^ self.prints[item]) <= RADIUS
        return list(zip(who[near].tolist(), item[near].tolist()))


class Slide:
    """Weighted Jaccard similarity of an item to windows of ``m`` shingles that come in order, repeats counted.

    A window near the one before costs what enters and leaves it. Sums are of whole numbers, so they don't depend on the way to a window.
    """

    def __init__(self, index: Index, words: list[str], m: int, item: int):
        self.index, self.words, self.m, self.own = index, words, m, index.bags[item]
        self.at, self.bag, self.low = 0, Counter(), 0
        self.high = sum(self._weight(s) * n for s, n in self.own.items())
        self.empty = self.high
        self.end = 0

    def _weight(self, s: tuple[str, ...]) -> int:
        return round(self.index.weight.get(s, self.index.unseen) * (1 << 40))

    def similarity(self, p: int) -> float:
        if p >= self.end:  # nothing in common with the window before
            self.at = self.end = p
            self.bag, self.low, self.high = Counter(), 0, self.empty
        for k in range(self.end, p + self.m):
            s = tuple(self.words[k : k + SHINGLE])
            if self.bag[s] < self.own[s]:
                self.low += self._weight(s)
            else:
                self.high += self._weight(s)
            self.bag[s] += 1
        for k in range(self.at, p):
            s = tuple(self.words[k : k + SHINGLE])
            self.bag[s] -= 1
            if self.bag[s] < self.own[s]:
                self.low -= self._weight(s)
            else:
                self.high -= self._weight(s)
            if not self.bag[s]:
                del self.bag[s]
        self.at, self.end = p, p + self.m
        return self.low / self.high


def parts(text: str | None, overlap: int) -> Iterator[tuple[int, list[str]]]:
    """(number of the first word, words) of PART words, or twice the ``overlap``, at most, each part starting with the last ``overlap`` words before."""
    size = max(PART, 2 * overlap)
    if not text:
        return
    if len(text) <= PART:
        yield 0, words_of(text)
        return
    held: list[str] = []
    at = 0
    for m in _WORD.finditer(text.lower()):
        held.append(m.group())
        if len(held) >= size:
            yield at, held
            at += len(held) - overlap
            held = held[len(held) - overlap :] if overlap else []
    yield at, held


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word): every row of ``docs`` with a window like an item, one row per item.

    A window of an item's number of words with a weighted shingle similarity of 0.8 or more is a leak; the best window is given, of equal
    ones the first. A shingle weighs 1 + ln(items / items that hold it), one that no item holds 1 + ln(items + 1).
    Null and empty texts have no leak, and an item without words is in no text. An item of fewer than five words is one shingle as a
    whole: it is found where just its words follow one another, with similarity 1. Of items with the same words each is
    found. Texts and items may be of any length. Equal rows of ``docs`` are each reported; an empty table on either side gives no rows. Other
    columns are not read.
    """
    return _leaks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")), benchmark)


def _leaks(wanted: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The leaks of rows (doc_id, t), with a doc_id of any type."""
    spark = wanted.sparkSession
    items = [(r[0], words_of(r[1])) for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()]
    items = [(i, w) for i, w in items if w]
    whole = sum(len(w) >= SHINGLE for _, w in items)  # those that have shingles
    held = Counter(s for _, w in items for s in {tuple(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)})
    weights = {s: 1 + log(whole / n) for s, n in held.items()}
    found = [_search(spark, wanted, Index(items[k : k + SLICE], weights, 1 + log(whole + 1))) for k in range(0, len(items), SLICE)]
    kinds = f"doc_id {dict(wanted.dtypes)['doc_id']}, item_id long, similarity double, first_word long"
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], kinds)


def _search(spark: SparkSession, docs: DataFrame, index: Index) -> DataFrame:
    shared = spark.sparkContext.broadcast(index)  # SLICE items at most
    overlap = max(index.sizes) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = shared.value
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("t")):
                best: dict[int, tuple[float, int]] = {}
                for at, words in parts(text.as_py(), overlap):
                    for item, (s, p) in idx.search(words).items():
                        if item not in best or (-s, at + p) < (-best[item][0], best[item][1]):
                            best[item] = (s, at + p)
                rows += [(doc, idx.ids[k], s, p) for k, (s, p) in sorted(best.items())]
            cols = list(zip(*rows)) or [()] * 4
            kinds = [b.schema.field("doc_id").type, pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "similarity", "first_word"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, item_id long, similarity double, first_word long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no leak; rows are told apart by id and text, not by id."""
    key = row_digest(id_col, text_col)
    found = _leaks(docs.select(key.alias("doc_id"), F.col(text_col).alias("t")), benchmark)
    found = found.select(F.col("doc_id").alias("row")).distinct()
    held = docs.select(F.struct("*").alias("doc"), key.alias("row"))  # so no name can clash
    return held.join(found, "row", "left_anti").select("doc.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it holds a copy."""
    return leaks(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
