from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def some_docs(n: int = 120, seed: int = 5) -> list[tuple]:
    """Prose of invented words with copies, near copies, repeated rows, nulls, empty, odd and very long texts."""
    rnd = random.Random(seed)
    stems = ["ka", "lo", "mi", "ten", "ra", "sol", "ver", "da", "nim", "or", "pu", "gel"]
    vocab = ["".join(rnd.choices(stems, k=rnd.randint(1, 4))) for _ in range(400)]
    say = lambda k: " ".join(w + rnd.choice(["", "", "", ",", ".", ".\n"]) for w in rnd.choices(vocab, k=k))
    passage, out = say(80), []
    for i in range(n):
        text = say(rnd.randint(1, 160))
        if i % 7 == 3:
            text = say(30) + " " + passage + " " + say(20)
        if i % 9 == 4 and i > 20:
            text = out[i - 9][1]
        if i % 11 == 5 and i > 20 and out[i - 11][1]:
            words = out[i - 11][1].split(" ")
            words[rnd.randrange(len(words))] = "changed"
            text = " ".join(words)
        out.append((i, text, rnd.choice(["en", "de"]), rnd.choice(["a", "a", "b", "c", None]), len(text)))
    out[10] = (10, None, None, None, None)
    out[11] = (11, "", "en", "a", 0)
    out[12] = (12, " \t\n\x0b \r ", None, "b", 6)
    out[13] = (13, "ünï ©\x85 çødé 漢字 😀 <|endoftext|> a  b   c \n\n d ", "de", "b", 30)
    out[14] = (14, "x" * 60_000, "en", "a", 60_000)
    out[15] = (15, say(9_000), "de", "a", 50_000)
    out[16] = (16, "# $ % & | < > *\nsame line\nsame line\n\n \nsame line", "en", "c", 40)
    out[17] = (17, "one two three four five six " * 40, "en", "c", 40)
    return out + [out[30], out[30], (None, say(60), "en", "c", 60)]


@pytest.fixture(scope="session")
def doc_rows():
    return some_docs()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    """With an extra column whose name an operator might use itself."""
    from pyspark.sql import functions as F
    return spark.createDataFrame(doc_rows, DOCS).withColumn("n_words", F.lit("extra")).withColumn("size", F.lit(-1)).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
