from __future__ import annotations

import random
import re

import pytest

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside, as extra columns of the input.
CLASHING = ["digest", "sub", "row", "_row", "component", "node", "rank", "part", "n", "copy", "starts", "_t", "_w", "_gone", "_id", "held_out", "shingle", "a.b"]


def folded(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def tricky_rows() -> list[tuple]:
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows, near and exact copies, shared passages."""
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("", "n", "rt", "é", ",", ".")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(60), prose(200)
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "a b c"), (7, "A B c"), (None, base), (None, None)]
    out += [(10 + i, base) for i in range(6)]
    out += [(20 + i, " ".join(w if j != 30 * i else "zz" for j, w in enumerate(base.split()))) for i in range(6)]
    out += [(30 + i, f"{prose(80)} {passage}\n{prose(40 + i)}") for i in range(8)]
    out += [(40, prose(30_000)), (41, "x" * 200_000), (42, "the " * 500), (43, "Abc!! " * 80), (44, "same line here\n" * 40)]
    out += [(45, "a\x00b \x1c c\u0085d é <|endoftext|>  x"), (46, passage), (46, passage), (47, prose(50)), (47, prose(50)), (-5, base.upper())]
    return out


@pytest.fixture(scope="session")
def tricky(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(tricky_rows(), "doc_id long, text string")
    for name in ["lang", "source", *CLASHING]:
        df = df.withColumn(name, F.lit("x"))
    return df.withColumn("n_chars", F.length("text").cast("long")).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark, tricky):
    return spark.createDataFrame([], tricky.schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def pairs(documents):
    return sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
