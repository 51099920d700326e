import random

import pytest

from tests.llm import brute  # noqa: F401

VOCABULARY = ["the", "of", "and", "Ünder", "größe", "straße", "tion", "reon", "x", "alpha,", "beta.", "日本", "don't", "R2D2", "naïve", "#tag", "a|b"]


def prose(rng, n):
    return "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): prose, copies, near copies, shared passages, nulls, blanks, repeated rows, a long text."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(60)]
    passage = prose(rng, 60)
    texts += [t + passage + prose(rng, 30) for t in texts[:12]]
    texts += [texts[3], texts[3], texts[4]]
    for t in texts[10:20]:
        w = t.split(" ")
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    texts += ["stop " * 120, "na na hey " * 50, "one two three", "one two three", "", None, " \n\t ", "#$% & | < > " * 20]
    texts += [prose(rng, 30_000), "é" * 5_000, "ab" * 400]
    rng.shuffle(texts)
    out = [(i * 3 % 127, t) for i, t in enumerate(texts)]
    out += [out[5], out[5], (out[6][0], out[7][1]), (None, texts[3]), (None, None), (-4, passage)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("found", "row", "doc", "th", "variant", "marks", "kept", "size", "shard", "bucket", "name", "ids", "n", "key", "body", "answers")


@pytest.fixture(scope="session")
def docs(spark, rows):
    made = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    return made.repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


def plain(value):
    return bytes(value) if isinstance(value, bytearray) else value


def table(df, *columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
