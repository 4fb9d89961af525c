import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, size int, hash string, row string, target double, w string, items string, label double, component long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and extra columns whose names the operators use themselves."""
    rng = random.Random(7)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    long_ = words(rng, 60_000, 5000)
    near = base[0].split()
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, None, None, None, None), (101, "", "en", None, 0), (102, " \t\n\r ", "fr", "s0", 5), (None, "no id here", "en", "s1", 10), (None, None, None, None, None)]
    rows += [(103, long_, "en", "s0", len(long_)), (104, base[1], "en", "s0", 1), (104, base[1], "en", "s0", 1), (105, base[1].upper(), "de", "s9", 1), (5, base[5], "en", "s2", len(base[5]))]
    rows += [(106, "É é ñ 日本語 \U0001f600 A" * 3, "es", "s1", 20), (107, "x" * 50_000, "en", "s1", -3), (108, " ".join(near[:3]), "en", "s1", 3), (109, "\0 nul", "en", "s1", 3)]
    extra = ("k", 1, 2, "h", "r", 0.5, "w", "i", 1.0, 9)
    return spark.createDataFrame([r + extra for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
