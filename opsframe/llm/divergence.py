"""Source divergence audit: how far the words of each source are from its language and from its other sources.

A term is a run of letters; a language keeps the terms that enough of its documents hold. Shares of terms are smoothed whole numbers,
so every value is exact.

The terms of which a source has too many are found by a dominance skyband. A term's value rises with its count in the source and falls
with its count in the language, and ties go to the earlier term. A term that k others beat in all three can't be among the first k, so
every partition keeps only its terms with fewer such others; the partitions' skybands are merged the same way, and the rest is ranked.

Sources are compared with each other in blocks of a bounded number of sources and buckets of terms: a task adds up the distances
of all pairs of a block over the terms it reads and puts out sums.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsframe.llm.common import materialise, pieces, read

#: Documents of a language that must hold a term.
MIN_DOCS = 30
#: Occurrences added to each term, and the whole that shares are parts of.
SMOOTH, WHOLE = 5, 1_000_000_000
#: Terms listed per source.
TOP = 50
#: Counts that a task holds before it puts them out.
HELD = 1_000_000
#: Rows of a source that a task holds before it reduces them to their skyband, and rows of a source that one task merges.
BAND, MERGED = 20_000, 200_000
#: Sources of a block, and terms of a bucket.
SIDE, BUCKET = 128, 1024
#: A term in UTF-8 whose A-Z are lower-cased: letters a to z and all bytes of longer characters.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Documents and occurrences share one number: documents in the upper bits.
_DOC = 1 << 32


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed per task, in one pass over the texts.

    A row without a term stands for the group itself, so that groups without terms are known, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0

        def emit() -> pa.RecordBatch:
            lang, source, term, packed = [], [], [], []
            for (a, b), found in held.items():
                lang += [a] * (len(found) + 1)
                source += [b] * (len(found) + 1)
                term += [None, *found]
                packed += [0, *found.values()]
            packed = np.array(packed, dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()),
                 pa.array(packed % _DOC), pa.array(packed // _DOC)], ["lang", "source", "term", "n", "docs"])

        seen = 0
        for batch in batches:
            for text, lang, source in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
                into = held.setdefault((lang, source), {})
                before = len(into)
                data = text.as_buffer()
                counts: Counter = Counter()
                for piece in pieces(bytes(data) if data is not None else b""):
                    counts.update(_TERM.findall(piece.lower()))
                get = into.get
                for t, c in counts.items():
                    into[t] = get(t, 0) + c + _DOC
                size += len(into) - before
                seen += 1
                if size > HELD or seen >= HELD:  # far below 2**31 documents and 2**32 occurrences
                    yield emit()
                    held, size, seen = {}, 0, 0
        if held:
            yield emit()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (n + SMOOTH) / (total + SMOOTH * kept)), exact; null if nothing is kept."""
    whole = F.lit(WHOLE).cast("decimal(10,0)") * (n.cast("decimal(19,0)") + F.lit(SMOOTH).cast("decimal(1,0)"))
    parts = total.cast("decimal(19,0)") + F.lit(SMOOTH).cast("decimal(1,0)") * kept.cast("decimal(18,0)")
    return F.when(kept > 0, F.lit(1) + F.call_function("div", whole, parts)).cast("long")


def skyband(n: np.ndarray, base: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Indices of the rows that fewer than k others dominate: ``n`` as high or higher, ``base`` as low or lower, ``term`` earlier.

    Terms are distinct. Rows are taken by falling ``n``, so all that dominate a row come before it; it suffices to count
    them among the rows that stay, since the first k that dominate a row stay themselves.
    """
    place = np.empty(len(term), dtype=np.int64)
    place[np.argsort(term, kind="stable")] = np.arange(len(term))
    order = np.lexsort((place, base, -n))
    kept = np.zeros(0, dtype=np.int64)
    for a in range(0, len(order), 256):
        some = order[a : a + 256]
        above = ((base[kept][None, :] <= base[some][:, None]) & (place[kept][None, :] < place[some][:, None])).sum(axis=1)
        some, above = some[above < k], above[above < k]
        beats = (base[some][None, :] <= base[some][:, None]) & (place[some][None, :] < place[some][:, None])
        stays = np.zeros(len(some), dtype=bool)
        for i in range(len(some)):
            stays[i] = above[i] + np.count_nonzero(beats[i, :i] & stays[:i]) < k
        kept = np.concatenate([kept, some[stays]])
    return kept


def _bands(df: DataFrame, k: int) -> DataFrame:
    """The skyband of each (lang, source) among the rows of each partition, which must come sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key, size = None, 0

        def reduced() -> pa.Table:
            rows = pa.concat_tables(held)
            keep = skyband(rows["n"].to_numpy(), rows["ln"].to_numpy(), np.array(rows["term"].to_pylist(), dtype=object), k)
            return rows.take(pa.array(np.sort(keep)))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            at = 0
            while at < len(names):
                end = at + 1
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if names[at] != key:
                    if held:
                        yield from reduced().to_batches()
                    held, size, key = [], 0, names[at]
                held.append(table.slice(at, end - at))
                size += end - at
                if size > BAND:
                    held = [reduced()]
                    size = len(held[0]) // 2  # so that a large band isn't reduced anew for every batch
                at = end
        if held:
            yield from reduced().to_batches()

    return df.sortWithinPartitions("lang", "source").mapInArrow(run, df.schema)


def _top_terms(terms: DataFrame, k: int) -> DataFrame:
    """The k first terms of each source with their values: skybands of the partitions, merged until a task can hold a source's rows."""
    mine = terms.select("lang", "source", "term", "n", "ln", "p", "q").where("p > q")
    band, rows = materialise(_bands(mine, k), "band")
    while True:
        largest = band.groupBy("lang", "source").count().agg(F.max("count")).first()[0] or 0
        if largest <= MERGED:
            break
        salt = F.pmod(F.xxhash64("term", F.lit(rows)), F.lit(-(-largest // (MERGED // 4))))
        band, left = materialise(_bands(band.repartition("lang", "source", salt), k), "band")
        if left == rows:
            break
        rows = left
    last = _bands(band.repartition("lang", "source"), k).withColumn("value", F.col("p") - F.col("q"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return last.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank.alias("rank")).where(F.col("rank") <= k)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of one pair of blocks, bucket and kind, cut between terms only, with (lang, x, y, bucket, whether they are heads)."""
    rest = None
    for batch in chain(batches, [None]):  # the end lets the last term go
        new = [pa.Table.from_batches([batch])] if batch is not None else []
        table = pa.concat_tables(([rest] if rest is not None else []) + new) if rest is not None or new else None
        if table is None or not len(table):
            continue
        rows = list(zip(*(table[c].to_pylist() for c in ("lang", "x", "y", "bucket", "term"))))
        cut = len(rows) if batch is None else len(rows) - 1
        while batch is not None and cut and rows[cut - 1] == rows[-1]:
            cut -= 1
        at = 0
        for k in range(1, cut + 1):
            if k == cut or rows[k][:4] != rows[at][:4] or (rows[k][4] is None) != (rows[at][4] is None):
                yield (*rows[at][:4], rows[at][4] is None), table.slice(at, k - at)
                at = k
        rest = table.slice(cut)


def distances(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value, seen, gap): per pair of sources of a pair of blocks, the summed distance of shares over the partition's terms.

    Terms that no source of the two blocks has aren't among them; ``seen`` counts the others, ``gap`` is the distance of a missing term.
    ``rows`` hold (lang, x, y, bucket, term, block, pos, p, source), sorted by the first five: first, without a term, the sources
    of the blocks x and y with the share of a term they don't have, then the shares by term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, bucket = None, None
        names: dict[tuple[int, int], str] = {}
        sums = absent = np.zeros((2, SIDE), dtype=np.int64)
        seen = 0

        def out() -> pa.RecordBatch:
            lang, x, y = pair
            left, right = (sorted(pos for block, pos in names if block == side) for side in (x, y))
            some = [(a, b) for a in left for b in right if x < y or a < b]
            return pa.RecordBatch.from_arrays([
                pa.array([lang] * len(some), pa.string()), pa.array([names[x, a] for a, _ in some], pa.string()),
                pa.array([names[y, b] for _, b in some], pa.string()), pa.array([int(sums[a, b]) for a, b in some], pa.int64()),
                pa.array([seen] * len(some), pa.int64()), pa.array([int(abs(absent[0, a] - absent[1, b])) for a, b in some], pa.int64()),
            ], ["lang", "a", "b", "value", "seen", "gap"])

        for (lang, x, y, now, head), part in _stretches(batches):
            if (lang, x, y) != pair:
                if pair is not None:
                    yield out()
                pair, bucket, names, sums, seen = (lang, x, y), None, {}, np.zeros((SIDE, SIDE), dtype=np.int64), 0
            if now != bucket:
                bucket, absent = now, np.zeros((2, SIDE), dtype=np.int64)
            block, pos, p = (part[c].to_numpy() for c in ("block", "pos", "p"))
            if head:
                names.update({(u, v): s for u, v, s in zip(block.tolist(), pos.tolist(), part["source"].to_pylist())})
                for k, side in enumerate((x, y)):
                    absent[k, pos[block == side]] = p[block == side]
                continue
            codes = part["term"].combine_chunks().dictionary_encode().indices.to_numpy()
            seen += int(codes.max()) + 1
            left, right = (np.repeat(absent[k : k + 1], codes.max() + 1, axis=0) for k in (0, 1))
            for shares, side in ((left, x), (right, y)):
                shares[codes[block == side], pos[block == side]] = p[block == side]
            for a in range(SIDE):
                if (x, a) in names:
                    sums[a] += np.abs(right - left[:, a : a + 1]).sum(axis=0)
        if pair is not None:
            yield out()

    return rows.mapInArrow(run, "lang string, a string, b string, value long, seen long, gap long")


def _pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """Each source beside each other source of its language, with the distance of their shares over all kept terms."""
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    placed = groups.withColumn("sid", number).select(
        "lang", "source", "kept", F.floor(F.col("sid") / SIDE).cast("long").alias("block"), (F.col("sid") % SIDE).cast("long").alias("pos"),
        F.coalesce(share(F.lit(0), F.col("total"), F.col("kept")), F.lit(0)).alias("p"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("kept") / BUCKET)).cast("long")
    blocks = placed.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    placed = placed.join(blocks, "lang")
    beside = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("z")
    ends = [F.least("block", "z").alias("x"), F.greatest("block", "z").alias("y")]
    heads = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)).alias("bucket")).select("*", beside).select(
        "lang", *ends, "bucket", F.lit(None).cast("string").alias("term"), "block", "pos", "p", "source")
    cells = terms.select("lang", "source", "term", F.col("p").alias("mine")).join(placed, ["lang", "source"]).withColumn(
        "bucket", F.pmod(F.xxhash64("term"), buckets)).select("*", beside).select(
        "lang", *ends, "bucket", "term", "block", "pos", F.col("mine").alias("p"), F.lit(None).cast("string").alias("source"))
    rows = heads.unionByName(cells).repartition("lang", "x", "y", "bucket").sortWithinPartitions("lang", "x", "y", "bucket", F.asc_nulls_first("term"))
    sums = distances(rows).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("gap").alias("gap"))
    kept = groups.groupBy("lang").agg(F.max("kept").alias("kept"))
    sums = sums.join(kept, "lang").withColumn("value", F.col("value") + (F.col("kept") - F.col("seen")) * F.col("gap"))
    both = F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.select("lang", both, "value").select(
        "lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", rank)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Per language and source of ``docs``: its distance to each other source (part ``pair``) and the ``top`` terms it has too many of
    (part ``term``): lang, source, part, item, value, rank.

    Null text, lang and source count as ''. Texts are read whole. Repeated rows are documents of their own; a source without kept terms
    has the shares of no occurrences; if a language keeps no terms, all its distances are 0. Ties go to the earlier item in UTF-8 order.
    A language with one source gives no pairs, an empty table no rows. Other columns are not read.
    """
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    counted, _ = materialise(count_terms(docs.select(*blank)), "counts")
    groups = counted.where("term is null").select("lang", "source").distinct()
    by_source = counted.where("term is not null").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    kept = by_source.withColumn("ln", F.sum("n").over(over)).withColumn("ld", F.sum("docs").over(over)).withColumn(
        "first", F.row_number().over(over.orderBy("source")) == 1).where(F.col("ld") >= min_docs).drop("docs", "ld")
    kept, _ = materialise(kept, "terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("kept"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "kept")]
    groups, _ = materialise(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *zero), "groups")
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "ln", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("ln"), F.col("lang_total"), F.col("kept")).alias("q"))
    return _pairs(shares, groups).unionByName(_top_terms(shares, top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence of all sources of the documents."""
    return divergence(read(spark, sf_dir, "documents", "text", "lang", "source"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
occ AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS ln FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(ln) AS nl FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
tot AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(tot.n, 0)::HUGEINT + 5 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.ln + 5)) // (v.nl::HUGEINT + 5 * v.v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source),
dist AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(dist.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
