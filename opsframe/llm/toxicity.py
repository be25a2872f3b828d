"""Toxicity by compression distance: how much shorter a toxic dictionary makes a window of text than an ordinary one.

Training reads a bounded sample of labelled rows. A base dictionary is trained on ordinary text; it holds the language that
both classes share, and its entropy tables let even a window of 64 bytes shrink byte by byte. The toxic dictionaries
add to it what zstandard's trainer picks from stretches of toxic texts that toxic documents hold far more often; the ordinary one
adds as many bytes of ordinary text, so that distances in the dictionary cost the same. A window's evidence is the difference of
its compressed lengths. Calibration rows, apart from those of the dictionaries, give each difference its log-likelihood
ratio, and a logistic fit on a document's window statistics gives the score, whose threshold is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import materialise, read
from opsframe.llm.mixing import row_digest

#: Different rows of each class that training reads at most, in the order of a hash of their id; a share goes to the dictionaries.
MAX_TOXIC, MAX_ORDINARY, DICTIONARY_SHARE = 3000, 8000, 0.65
#: Bytes of these rows of a class together; a row that would exceed them is passed over as a whole. No text is cut.
MAX_BYTES = 48 << 20
WINDOW, BASE_BYTES, EXTRA_BYTES = 64, 8192, 2500
#: Segment lengths of the trainer, one toxic dictionary each.
SEGMENTS = (50, 16)
GRAM, MIN_Z, MIN_RATIO, MIN_DOCS = 5, 5.0, 8.0, 4
LOW, HIGH = -8, 12


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The text cut at blanks into windows of at most ``size`` bytes, and again from the middle of the first one."""
    out: list[bytes] = []
    starts = [0]
    if len(text) > size:
        half = text.find(b" ", size // 2)
        starts += [half] if 0 < half < size else []
    n = len(text)
    for i in starts:
        while i < n:
            j = i + size
            if j < n:
                k = text.rfind(b" ", i + size // 2, j)
                j = k if k > 0 else j
            out.append(text[i:j])
            i = j
    return out


def _grams(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings of length GRAM as integers, with the number of documents that hold them."""
    grams, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for lo in range(0, len(docs), 500):  # merged piece by piece to hold little at once
        seen = []
        for x in docs[lo : lo + 500]:
            a = np.frombuffer(x, dtype=np.uint8).astype(np.uint64)
            if len(a) >= GRAM:
                v = np.zeros(len(a) - GRAM + 1, dtype=np.uint64)
                for i in range(GRAM):
                    v = (v << np.uint64(8)) | a[i : len(a) - GRAM + 1 + i]
                seen.append(np.unique(v))
        if seen:
            u, c = np.unique(np.concatenate(seen), return_counts=True)
            merged, back = np.unique(np.concatenate([grams, u]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, c])).astype(np.int64)
            grams = merged
    return grams, counts


def telling_grams(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Strings of GRAM bytes that toxic documents hold significantly and many times more often."""
    (u, c), (v, d), n, m = _grams(toxic), _grams(ordinary), len(toxic), len(ordinary)
    u, c = u[c >= MIN_DOCS], c[c >= MIN_DOCS]
    if not len(u) or not m:
        return set()
    at = np.minimum(np.searchsorted(v, u), max(0, len(v) - 1))
    other = np.where(v[at] == u, d[at], 0) if len(v) else np.zeros(len(u))
    p = (c + other) / (n + m)
    z = (c / n - other / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)
    keep = (z >= MIN_Z) & (c / n >= MIN_RATIO * (other + 0.5) / m)
    return {int(x).to_bytes(GRAM, "big") for x in u[keep]}


def stretches(docs: list[bytes], grams: set[bytes]) -> list[bytes]:
    """The parts of the texts that telling grams cover."""
    out = []
    for x in docs:
        begin, end = -1, -1
        for i in range(len(x) - GRAM + 1):
            if x[i : i + GRAM] in grams:
                if i >= end:
                    if begin >= 0:
                        out.append(x[begin:end])
                    begin = i
                end = i + GRAM
        if begin >= 0:
            out.append(x[begin:end])
    return out


def _trained(samples: list[bytes], size: int, **options: int) -> bytes:
    """A dictionary of ``size`` bytes at most; empty where the samples are too few for the trainer."""
    try:
        return zstandard.train_dictionary(size, samples, **options).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    params = zstandard.ZstdCompressionParameters.from_level(
        3, strategy=zstandard.STRATEGY_DFAST, min_match=4, window_log=17, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


@dataclass
class Model:
    """Dictionaries and calibration; a few dozen kilobytes, whatever the corpus."""

    ordinary: bytes
    toxic: list[bytes]
    ratios: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}  # compressors don't travel

    def open(self) -> Model:
        self._pair = (_compressor(self.ordinary).compress, [_compressor(t).compress for t in self.toxic])
        return self

    def differences(self, text: bytes) -> np.ndarray:
        """(toxic dictionary, window): bytes that the toxic dictionary saves."""
        ordinary, toxic = self._pair
        cut = windows(text)
        base = np.fromiter((len(ordinary(w)) for w in cut), dtype=np.int64, count=len(cut))
        rows = [base - np.fromiter((len(f(w)) for w in cut), dtype=np.int64, count=len(cut)) for f in toxic]
        return np.clip(np.array(rows), LOW, HIGH)

    def features(self, diff: np.ndarray) -> np.ndarray:
        if diff.shape[1] == 0:
            return np.zeros(6 * len(diff) + 4)
        out: list[float] = []
        for e, ratio in zip(diff, self.ratios):
            lr = ratio[e - LOW]
            out += [lr.mean(), lr.sum() / np.sqrt(len(e)), e.max(), (e >= 2).mean(), (e >= 3).mean(), e.mean()]
        both = diff.min(axis=0)
        return np.array([*out, both.max(), *((both >= q).mean() for q in (1, 2, 3))])

    def score(self, text: bytes) -> float:
        if not text.strip():
            return 0.0
        x = (self.features(self.differences(text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Newton steps for a ridge logistic fit; the first weight is the intercept."""
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model | float:
    """A model from sample texts; without both classes, the constant score that the labels give."""
    if len(toxic) < 10 or len(ordinary) < 10:
        n = len(toxic) + len(ordinary)
        return len(toxic) / n if n else 0.0
    cut_t, cut_o = (int(len(x) * DICTIONARY_SHARE) for x in (toxic, ordinary))
    train_t, train_o = toxic[:cut_t], ordinary[:cut_o]
    base = _trained([x[i : i + 100] for x in train_o for i in range(0, len(x), 100)], BASE_BYTES)
    base = base or b" ".join(train_o)[:BASE_BYTES]
    parts = [x for x in stretches(train_t, telling_grams(train_t, train_o)) if len(x) >= GRAM]
    samples = [b"".join(parts[i : i + 8]) for i in range(0, len(parts), 8)]
    extras = [_trained(samples, EXTRA_BYTES, k=k, d=6)[-EXTRA_BYTES:] or b"".join(parts)[:EXTRA_BYTES] for k in SEGMENTS]
    model = Model(base + base[-EXTRA_BYTES:], [base + x for x in extras]).open()
    rows = [(1, model.differences(x)) for x in toxic[cut_t:]] + [(0, model.differences(x)) for x in ordinary[cut_o:]]
    counts = np.ones((2, len(SEGMENTS), HIGH - LOW + 1))
    for label, diff in rows:
        for k, e in enumerate(diff):
            if len(e):
                np.add.at(counts[label, k], e - LOW, 1 / len(e))
    share = counts / counts.sum(axis=2, keepdims=True)
    model.ratios = np.log(share[1] / share[0])
    x, y = np.array([model.features(d) for _, d in rows]), np.array([t for t, _ in rows])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = _logistic((x - model.mean) / model.scale, y)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: CRC-32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | float:
    """Fits a model on a bounded sample of the labelled rows of ``docs`` that are not held out.

    Rows are told apart by id and text, and equal ones count once, so the sample has MAX_TOXIC + MAX_ORDINARY rows and twice
    MAX_BYTES bytes at most, however often an id occurs. Null and empty texts don't train.
    """
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("label")).where("label in (0, 1) and i is not null")
    marks = marks.where(~held_out("i")).groupBy("i").agg(F.max("label").alias("label"))
    # ids first, by the labels alone, so that few texts are read further; each id has a row at least, unless it has no text
    order = [F.xxhash64("i"), F.col("i")]
    limits = {1: MAX_TOXIC, 0: MAX_ORDINARY}
    chosen = reduce(DataFrame.union, [marks.where(F.col("label") == k).orderBy(*order).limit(n) for k, n in limits.items()])
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null and t != ''")
    found = texts.join(F.broadcast(chosen), "i")  # a row per id, of 11000 ids at most
    keys = found.select("label", "i", row_digest("i", "t").alias("row"), F.octet_length("t").alias("bytes")).distinct()
    keys, _ = materialise(keys, "labelled")
    wanted = []
    for k, n in limits.items():
        room = MAX_BYTES
        for r in keys.where(F.col("label") == k).orderBy(*order, "row").limit(n).collect():
            if r.bytes <= room:
                room -= r.bytes
                wanted.append((k, hash_of(r.i), r.row))
    rows = docs.sparkSession.createDataFrame([(bytes(r),) for _, _, r in wanted], "row binary")
    read_ = found.select(F.col("t").cast("binary").alias("t"), row_digest("i", "t").alias("row")).join(F.broadcast(rows), "row")
    held = {bytes(r.row): bytes(r.t) for r in read_.dropDuplicates(["row"]).toLocalIterator()}  # bounded by MAX_BYTES
    sample = sorted((k, h, held[bytes(r)]) for k, h, r in wanted)
    return fit([t for k, _, t in sample if k == 1], [t for k, _, t in sample if k == 0])


def hash_of(value: object) -> int:
    """An order of ids that has nothing to do with their size."""
    import xxhash

    return xxhash.xxh64_intdigest(str(value).encode())


def score(spark: SparkSession, text: Column, model: Model | float) -> Column:
    """Scores from 0 to 1; null, empty and blank texts score 0."""
    shared = spark.sparkContext.broadcast(model)  # dictionaries of bounded size

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        if isinstance(m, Model):
            m.open()
        for texts in batches:
            if isinstance(m, Model):
                yield pd.Series([m.score(t.encode()) if t else 0.0 for t in texts], dtype="float64")
            else:
                yield pd.Series([m if t and t.strip() else 0.0 for t in texts], dtype="float64")

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Only ``label 0`` and ``1`` of labelled rows that are not held out train the model; an id labelled both ways counts as toxic.
    With fewer than ten training rows of a class the score is that class's share. Null, empty and blank texts score 0. Equal texts score
    alike, and so do repeated ids by their own text. Whole texts of any length are scored, and an empty table gives no rows. Source, language and id are no inputs; other columns are not read.
    """
    model = train(docs, labels, id_col, text_col)
    s = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score(docs.sparkSession, F.col(text_col), model).alias("score"))
    return s.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, each judged by its own text; null and empty texts stay."""
    model = train(docs, labels, id_col, text_col)
    return docs.where(score(docs.sparkSession, F.col(text_col), model) < 0.5)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of their own labels."""
    return toxicity(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))
