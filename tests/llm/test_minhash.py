import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptscreen.llm import common, minhash
from promptscreen.llm.q_minhash import op11_minhash
from tests.llm.conftest import DOCS, prose
from tests.llm.test_near import brute, edited, shingles

A, B = [int(x) for x in minhash.FACTOR], [int(x) for x in minhash.OFFSET]


def plain_signature(text):
    """One permutation and one shingle at a time, in Python numbers."""
    w = common.split_words(text)
    h = common.Words([text]).hashes()
    size = min(5, len(w))
    x = [int(common.ngrams(h[i:i + size], size)[0]) for i in range(len(w) - size + 1)] if w else []
    low = [min(((a * v + b) % 2**64 for v in x), default=2**64 - 1) for a, b in zip(A, B, strict=True)]
    return (common.mix(np.array(low, np.uint64)) >> np.uint64(48)).astype(np.uint16)


def test_signatures_equal_one_permutation_at_a_time():
    texts = ["", None, "one", "one two three four", "a b c d e", prose(1, 90), prose(2, 6), " \n", "É é ß 東京 🙂 x y", prose(3, 700)]
    found = minhash.signatures(texts)
    assert (found == np.stack([plain_signature(t) for t in texts])).all()
    assert minhash.signatures([]).shape == (0, 128) and len(minhash.as_hex(found)[0]) == 512
    assert (minhash.of_hex(minhash.as_hex(found)) == found).all()
    assert all(f % 2 for f in A)                # odd factors permute the 64-bit numbers


def test_agreement_estimates_the_similarity():
    rng = random.Random(4)
    for edits in (0, 2, 8, 30):
        root = prose(edits, 300)
        other = edited(root, rng, edits)
        a, b = shingles(root), shingles(other)
        x, y = minhash.signatures([root, other])
        assert abs(minhash.agreement(x[None], y[None])[0] - len(a & b) / len(a | b)) < 0.15


def follow(rows):
    """Rows (id, text) in the stated order, each with its successor."""
    def tie(t):
        return ties[t or ""]
    ties = {t or "": None for _, t in rows}
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    for r in spark.createDataFrame([(t,) for t in ties], "t string").select("t", F.xxhash64("t").alias("h")).collect():
        ties[r["t"]] = r["h"]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
    return [(a, b) for a, b in zip(order, order[1:] + order[:1], strict=True)]


def expected(rows):
    out = []
    for (i, a), (_, b) in follow(rows):
        a, b = a or "", b or ""
        n = len(a)
        e = a[:n - n // 2] + b[:n // 2]
        sa, se, sb = (plain_signature(t) for t in (a, e, b))
        out.append((i, n, hashlib.sha256(e.encode()).hexdigest(), minhash.as_hex(sa[None])[0], minhash.as_hex(se[None])[0],
                    float((sa == se).mean()), float((sa == sb).mean())))
    return out


@pytest.mark.parametrize("size", [300, 256 << 20])
def test_query_and_operator_against_one_text_at_a_time(spark, awkward, tmp_path, size, monkeypatch):
    if size == 300:
        monkeypatch.setattr(common, "CHUNK_BYTES", 1000)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    found = minhash.against_next(awkward, range_bytes=size)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected(rows), key=str)
    if size > 300:
        awkward.write.parquet(str(tmp_path / "documents.parquet"))
        got = op11_minhash(spark, str(tmp_path))
        assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(rows), key=str)


def test_one_row_no_rows_and_one_id(spark, no_docs):
    one = spark.createDataFrame([(3, "a b c d e f g h", None, None, 1)], DOCS)
    r = minhash.against_next(one).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"a b c d a b c d").hexdigest()
    assert minhash.against_next(no_docs).count() == 0 and minhash.against_next(one.filter("doc_id = 9")).columns == minhash.AGAINST_NEXT.names
    # a third of all rows without an id, and texts that repeat
    rows = [(None if k % 3 else k, f"text {k % 50} " * 9) for k in range(400)] + [(2**63 - 1, "x y"), (-2**63 + 1, "z")]
    got = minhash.against_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), range_bytes=200)
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == sorted((r[:3] for r in expected(rows)), key=str)
    assert key


def test_ranges_split_equal_ids_by_hash():
    bounds = [(1, -5), (4, 7), (4, 9), (8, 0)]
    at = np.array([1, 1, 3, 4, 4, 4, 4, 5, 8, 9, 8])
    tie = np.array([-5, 9, 0, 6, 7, 8, 9, 0, 0, 0, -1])
    assert minhash.range_of(bounds, at, tie).tolist() == [0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 2]


def test_near_duplicates_equal_brute_force(spark, awkward):
    rng = random.Random(8)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for f in range(10):
        root = prose(4000 + f, rng.choice([12, 40, 150, 300]))
        # similarities of 0.8 and more: a band is shared
        rows += [(2000 + 20 * f + k, edited(root, rng, rng.randint(0, max(1, len(root.split()) // 45)))) for k in range(9)]
    rows += [(5000 + k, prose(3000 + k, rng.randint(3, 80)) + " " + prose(77, 60)) for k in range(50)]
    rows += [(6000 + k, edited(prose(88, 100), rng, 1)) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(df)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == sorted(brute(rows), key=str)


def test_fingerprints_as_a_column(spark, awkward, no_docs):
    df = awkward.withColumnRenamed("lang", "Fingerprint")
    got = minhash.fingerprinted(df)
    assert got.columns == ["doc_id", "text", "source", "n_chars", "fingerprint"]
    by = {}
    for r in got.collect():
        by.setdefault(r["text"], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values()) and by[None] == by[""]
    pair = spark.createDataFrame([(prose(1, 50), prose(1, 50)), ("a b", "c d"), (None, "x")], "a string, b string")
    both = minhash.fingerprinted(minhash.fingerprinted(pair, "a", "fa"), "b", "fb").withColumn("fc", F.when(F.col("a").isNotNull(), F.col("fa")))
    assert [r[0] for r in both.select(minhash.likeness("fc", "fb")).collect()] == [1.0, 0.0, None]
    assert minhash.fingerprinted(no_docs).count() == minhash.near_duplicates(no_docs).count() == 0
