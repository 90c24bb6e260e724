from __future__ import annotations

import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def messy_rows() -> list[tuple]:
    """Documents with NULLs everywhere, empty and long texts, ties, repeated rows, copies and near-copies."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 9))) for _ in range(400)]

    def prose(n):
        return "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(n))

    base, passage = prose(180), " ".join(vocabulary[:70])
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "b", 4), (4, "one", "en", None, 3), (5, "One", "en", None, 3),
        (6, base, "en", "a", len(base)), (7, base, "en", "b", len(base)), (8, base.replace(vocabulary[3], "x"), "en", "b", 9),
        (9, prose(60) + passage + " " + prose(60), "en", "c", 1), (10, prose(30) + passage + "\n" + prose(9), "en", "c", 1),
        (11, "same words " * 4000, "en", "a", 44000), (12, "ab" * 3000, None, None, 6000), (None, base, "en", "a", 5), (None, "no id", None, None, None),
        (6, base, "en", "a", len(base)), (6, prose(40), "en", "a", 40), (13, "\n".join(["a b c d e f", "f e d c b a", "a b c d e", "", "x y"]), "en", "a", 1),
        (14, "a b c d e f g\nx y\n\na b c d e f", "en", "a", 1), (15, "<|endoftext|> \x00 日本 😀 !!", "en", "b", 1), (16, base * 30, "en", "b", 1),
    ]
    return rows + [(100 + i, prose(rnd.randint(1, 120)), "en", rnd.choice("abc"), i) for i in range(30)]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="session")
def odd(messy):
    """The same documents with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("size", "key", "part", "row", "key_id", "cells", "cell", "words", "line", "fingerprint", "root", "score", "piece", "taken", "tags", "terms", "spans"):
        messy = messy.withColumn(name, F.lit("clash"))
    return messy


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
