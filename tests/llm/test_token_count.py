import random

import public_tokenizers
import sentencepiece
from corpus import documents, empty

from opsframe.llm.token_count import MARK, prove, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_are_the_librarys(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(1)
    odd = ["", " ", "  a  b\n\tc ", f"{MARK}x {MARK}{MARK}", "<s> x</s><unk>", "a\u00a0b\u3000c", " " * 70, "ab" * 4000, "ﬁ é", "日本 語"]
    odd += ["".join(rng.choice(f" {MARK}ab\nthe éA1中́.,") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts(df, PATH, limit=50).collect()}
    for k, t in enumerate(odd):
        n = len(sp.encode(t))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len(t.encode()), n, n > 50)


def test_odd_rows(spark):
    docs = documents(spark)
    got = token_counts(docs, PATH)
    assert got.count() == docs.count()
    assert got.where("doc_id = 0").select("n_bytes", "n_tokens", "over_limit").first() == (0, 0, False)
    assert token_counts(empty(spark), PATH).count() == 0


def test_single_tokens_are_proved():
    ones = prove(PATH)
    assert f"{MARK}the" in ones and len(ones) > 10_000
