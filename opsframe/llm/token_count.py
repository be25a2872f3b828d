"""Token counts: words proved to be one token are counted directly, only the rest is merged.

The vocabulary is the byte-fallback piece model. Its pieces hold the word mark only in front, so no merge
crosses the place where a mark follows another character: a text's tokens are the sum over its pre-tokens,
each a run of marks and what follows up to the next mark. ``prove`` checks that on the vocabulary and
collects the strings that the library itself encodes as one token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import read

MARK = "▁"
_PRE_TOKEN = re.compile(f"{MARK}+[^{MARK}]*")
#: Counts of merged pre-tokens that a worker remembers; beyond it, it starts anew.
MEMO = 600_000
#: Longer pre-tokens are encoded each time instead of being remembered.
MEMO_CHARS = 48


def _encoder(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def prove(path: str) -> frozenset[str]:
    """The pre-tokens that are one token, each checked with the library.

    Raises if the model doesn't allow cutting at the marks: a piece with a mark behind another
    character, a normaliser that changes text, or no mark added in front.
    """
    sp = _encoder(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece spans two words")
    probe = "ﬁ Ａ  é\t\n x "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("the model changes white space or characters")
    plain = [i for i in range(len(pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    marked = [pieces[i] for i in plain if pieces[i].startswith(MARK)]
    ids = sp.encode([p[1:].replace(MARK, " ") for p in marked], num_threads=1)
    return frozenset(p for p, got in zip(marked, ids, strict=True) if len(got) == 1)


class _Counts(dict):
    """Tokens of a pre-token: 1 for the proved ones, the library's count for the rest."""

    def __init__(self, path: str, ones: frozenset[str]):
        super().__init__()
        self.sp, self.ones = _encoder(path), ones
        self.start_over()

    def start_over(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.ones, 1))

    def __missing__(self, token: str) -> int:
        # the library adds the first mark itself
        n = len(self.sp.encode(token[1:].replace(MARK, " "))) if len(token) > 1 else 1
        if len(token) <= MEMO_CHARS:
            if len(self) > MEMO + len(self.ones):
                self.start_over()
            self[token] = n
        return n


def count_tokens(spark: SparkSession, text: Column, model_path: str) -> Column:
    """Number of tokens of each whole text, as long; null and empty texts have none."""
    ones = spark.sparkContext.broadcast(prove(model_path))  # at most the vocabulary

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = _Counts(model_path, ones.value)
        get = counts.__getitem__
        for texts in batches:
            yield pd.Series(
                [sum(map(get, _PRE_TOKEN.findall(MARK + t.replace(" ", MARK)))) if t else 0 for t in texts], dtype="int64"
            )

    return run(text)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Null texts count as empty, with 0 bytes and 0 tokens. Equal rows are counted each for itself; a very
    long word is encoded whole by the library. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    n = docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
        count_tokens(docs.sparkSession, text, model_path).alias("n_tokens"),
    )
    return n.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents with the installed 32k piece model."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
