"""Small tables with every awkward case, shared by the operators' tests."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocab = [f"w{i:x}" + "aeiou"[i % 5] for i in range(words)]
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids, texts, langs and sources; empty, blank, tiny and very long
    texts; exact and near copies; repeated rows."""
    base = prose(1, 120)
    rows = [(1, base, "en", "src1", 1), (2, base, "en", "src1", 1), (3, base + " tail", "en", "src0", 2),
            (4, prose(2, 120), "fr", "src0", 3), (5, None, "en", None, None), (6, "", None, "src2", 0), (7, " \t\n", "de", "src2", 0),
            (8, "one", "en", "src1", 1), (9, "one", "en", "src1", 1), (10, "one two three four", "de", "", 1),
            (11, prose(3, 20_000), "en", "src0", 9), (None, prose(4, 60), "en", "src1", 1), (4, prose(2, 120), "fr", "src0", 3),
            (12, "ÀÉ ß 東京 🙂 naïve", "fr", "src3", 1), (13, "12345 !!! --", None, "src3", 1)]
    rows += [(100 + i, prose(100 + i, 30 + i), "en" if i % 2 else "fr", f"src{i % 3}", i) for i in range(40)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
