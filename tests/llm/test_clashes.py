"""Extra columns keep their values, whatever they are called: each operator is
run with columns of all its internal names, in both cases, and compared by value
with a run on the bare columns."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import promptscreen.llm as package
from promptscreen.llm import decontaminate, language, mixing, near, quality, sharding
from tests.llm.conftest import prose

FOLDER = Path(package.__file__).parent


def names_in(module):
    """Every word in quotes in a module's source: its column names are among them."""
    found = set(re.findall(r"[\"']([A-Za-z_][A-Za-z0-9_]*)[\"']", (FOLDER / f"{module}.py").read_text()))
    found |= {"carried_columns", "text_", "c0", "c1"}
    return sorted({n for n in found if n.lower() not in {"text", "doc_id", "lang", "source"}})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, prose(k % 7, 40 + k % 3), "en" if k % 2 else "fr", f"src{k % 3}") for k in range(24)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def clashing(docs, module, upper):
    """``docs`` with a column of every internal name, its value told from the id."""
    seen, cols = set(), []
    for n in names_in(module):
        n = n.upper() if upper else n.lower()
        if n.lower() not in seen:
            seen.add(n.lower())
            cols.append(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n))
    return docs.select("*", *cols)


def crf_of(docs):
    return language.fit(docs)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, prose(3, 40)), (2, "not there at all " * 5)], "item_id long, text string")


OPERATORS = {
    "near": (lambda d, b: near.one_of_each(d), ()),
    "language": (lambda d, b: language.accepted(d, _crf[0]), ()),
    "decontaminate": (lambda d, b: decontaminate.without_documents(d, b), ()),
    "decontaminate spans": (lambda d, b: decontaminate.without_spans(d, b), ()),
    "sharding": (lambda d, b: sharding.shard(d, 4), sharding.ADDED),
    "quality": (lambda d, b: quality.score(d, np.linspace(-1, 1, 1 << quality.BITS)), ("score",)),
    "mixing": (lambda d, b: mixing.mix(d, mixing.MIX), mixing.ADDED),
}
_crf: list = []


@pytest.mark.parametrize("upper", [False, True])
@pytest.mark.parametrize("name", list(OPERATORS))
def test_values_of_clashing_columns_stay(name, upper, docs, benchmark):
    if name == "language" and not _crf:
        _crf.append(crf_of(docs))
    run, added = OPERATORS[name]
    full = clashing(docs, name.split()[0], upper)
    own = ["doc_id", "text", "lang", "source", *added]
    got = run(full, benchmark)
    kept = [c for c in full.columns if c.lower() not in {a.lower() for a in added}]
    assert [c for c in got.columns if c not in added] == kept
    rows = got.collect()
    assert rows
    for r in rows:
        for c in kept:
            if c not in own:
                assert r[c] == f"{c}:{r['doc_id']}", c
    bare = run(docs, benchmark)
    assert sorted(map(str, (tuple(r[c] for c in own) for r in rows))) == sorted(map(str, (tuple(r[c] for c in own) for r in bare.collect())))
