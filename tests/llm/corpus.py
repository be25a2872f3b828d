"""Small documents with every odd case: nulls, empty and very long texts, ties, repeated rows, names that clash."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept_id long, t string, crc long, spans string, copies long"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = [sentence(rng, 120) for _ in range(12)]
    passage = sentence(rng, 60)
    long_ = sentence(rng, 60_000)
    near = base[0].split()
    near[50] = "changed"
    return [
        None, "", " \n\t ", "one", "one two", *base, base[3], base[3], " ".join(near), f"{base[5]} {passage} {base[6]}",
        f"{passage}\n{sentence(rng, 30)}", long_, "Ünïcödé " * 60, "a" * 700, sentence(rng, 40) + " " + passage,
    ]


def documents(spark, with_repeats=True):
    rows = [(k, t, "en", f"src{k % 3}" if k % 5 else None, len(t) if t is not None else None, "x", 7, "y", 9, "z", 1) for k, t in enumerate(texts())]
    if with_repeats:
        rows += [rows[8], rows[8], (None, "a text without an id", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
