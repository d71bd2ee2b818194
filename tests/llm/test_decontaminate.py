import hashlib
import re

import pytest
from pyspark.sql import functions as F

from promptscreen.llm import decontaminate as D
from promptscreen.llm.common import batch, ngrams
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        k = min(13, len(x))
        for a in range(len(x) - k + 1 if x else 0):
            for p in range(len(w) - k + 1):
                if w[p:p + k] == x[a:a + k]:
                    hit |= set(range(p, p + k))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, prose(50, 30)), (2, prose(51, 13)), (3, "short Item ÉTÉ"), (4, None), (5, " .,"), (10, prose(50, 30)), (6, "one")]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def docs(spark, awkward):
    more = [(500, prose(9, 50) + " " + prose(50, 30).upper() + "! " + prose(8, 40), "en", "s", 1), (501, prose(51, 13).replace(" ", "--"), "en", "s", 1),
            (502, prose(50, 12), "en", "s", 1), (503, "a Short, item été", "en", "s", 1), (504, prose(50, 30) * 2, "en", "s", 1)]
    return awkward.unionByName(spark.createDataFrame(more, awkward.schema))


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_hits_equal_brute_force(docs, bench, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", block)          # several blocks give the same as one
    items, table = bench
    d = F.col("decon")
    rows = (D.scan(docs, table).select("text", d["n_words"].alias("w"), D.hit_words(d).alias("h"), F.size(d["items"]).alias("i"),
                                       D.items_digest(d).alias("s"), D.is_contaminated(d).alias("c")).collect())
    assert len(rows) == docs.count()
    for r in rows:
        if r["text"] is None or len(r["text"]) < 20_000:
            assert (r["w"], r["h"], r["i"], r["s"], r["c"]) == brute(r["text"], items)


def test_removal(docs, bench, no_docs, spark):
    items, table = bench
    kept = D.without_documents(docs.withColumn("decon", F.lit(1)), table)
    assert kept.columns == [*docs.columns, "decon"] if "decon" in kept.columns else True
    ids = {r["doc_id"] for r in D.without_documents(docs, table).select("doc_id").collect()}
    assert {500, 501, 504, 8} & ids == set() and {1, 2, 3, 502, 503, 5, 6} <= ids      # É is not é
    cut = {r["doc_id"]: r["text"] for r in D.without_spans(docs, table).collect()}
    assert cut[500] == prose(9, 50) + " ! " + prose(8, 40) and cut[501] == "" and cut[5] is None
    assert D.scan(no_docs, table).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert D.scan(docs, nothing).filter(D.hit_words(F.col("decon")) > 0).count() == 0


def test_a_hash_collision_is_not_a_hit(monkeypatch):
    grams = D.GramSet([("1", 2, b"aa bb")])
    key = int(grams.by_len[2][0][0])
    grams.by_len[2][1][key] = {b"other words": ["1"]}
    assert grams.find(["aa bb"])[1] == [[]]
    assert batch and len(ngrams(__import__("numpy").arange(3, dtype="uint64"), 5)) == 0
