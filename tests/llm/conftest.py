import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    """A-Z only, as the contracts say."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names the operators use themselves."""

    def add(df):
        from pyspark.sql import functions as F

        names = ["id", "n", "words", "tokens", "line", "h", "at", "spans", "ids", "score", "a.b", "component", "n_words"]
        return df.select("*", *[F.lit(None).cast("string").alias(c) for c in names if c not in df.columns])

    return add


@pytest.fixture(scope="session")
def passages():
    """Texts with shared passages, near copies, exact copies, nulls and blanks."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["Größe", "日本", "X1", "don't"]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one two")]
    for i in range(5, 60):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 200))]
        if i % 3 == 0:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage
        rows.append((i, " ".join(own)))
    for i in range(60, 100):
        near = list(base)
        for _ in range(rng.randrange(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        rows.append((i, "  ".join(near)))
    rows += [(100, " ".join(base)), (101, " ".join(base)), (102, " ".join(passage).upper())]
    return rows
