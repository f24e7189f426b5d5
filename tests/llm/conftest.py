import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from texts (doc_id by place) or from full rows."""

    def make(texts, ids=None, sources=None):
        rows = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, ties, odd spaces, junk, empty and long ones."""
    rng = random.Random(4)
    base = [words(rng, rng.choice([3, 5, 9, 40, 120, 300])) for _ in range(60)]
    out = list(base)
    for k in range(25):
        w = base[k].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = words(rng, 1)
        out.append(" ".join(w))
    out += [base[3], base[3], base[10], "", None, " \t\n", "one two", "one two", "Ünïcödé 😀 text with a hard space", "a\x0bb\x0cc\rd\ne", "x " * 50]
    line = "this line stands again and again in here\n"
    out += [line * 6 + words(rng, 30), "\n\n \n" + line, words(rng, 9000), "q" * 70000 + " " + words(rng, 40)]
    rng.shuffle(out)
    return out


CLASHING = ("node", "class_id", "copies", "size", "score", "r", "fp", "words", "h", "target", "value", "rank", "path", "url", "labels", "__key", "part")


@pytest.fixture(scope="session")
def cluttered():
    """Add extra columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})

    return add
