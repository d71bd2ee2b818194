import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from promptscreen.llm import resample as R
from promptscreen.llm.q_resample import op12_resample
from tests.llm.conftest import DOCS, prose


def words(t):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())


def buckets(t):
    w = words(t)
    return [zlib.crc32(b" ".join(w[i:i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target):
    """[(id, features, weight, score, rank)] of (id, text) rows, one by one."""
    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in buckets(x))
        rows.append([i, len(buckets(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [k for k, (_, x) in enumerate(docs) if len(words(x)) >= 20]
    able.sort(key=lambda k: (-rows[k][3], docs[k][0] is None, docs[k][0]))
    for r, k in enumerate(able[:5 * len(able) // 100], 1):
        rows[k][4] = r
    return [tuple(r) for r in rows]


def test_features_equal_checksums_of_the_runs():
    rng = random.Random(5)
    texts = [None, "", " ", "one", "ONE two", "x" * 500 + " " + "y" * 64 + " " + "é" * 200, "a-b_c d,e\0f"]
    texts += ["".join(rng.choice("abC9 é-東🙂") for _ in range(rng.randint(0, 300))) for _ in range(100)]
    off, runs = R.features(texts)
    for i, t in enumerate(texts):
        found = [int(b) for r in runs for b in r[off[i]:off[i + 1]] if b >= 0]
        assert found == buckets(t)
    assert R.features([])[0].tolist() == [0]


def keys_of(spark, values):
    return spark.createDataFrame([(int(a), 0, int(b), int(c)) for a, b, c in values], "low long, last long, id long, tie long").repartition(5)


@pytest.mark.parametrize("kind", ["spread", "one score", "one id", "few scores", "all equal"])
def test_cutoff_is_exact_for_any_bracket(spark, kind):
    rng = np.random.default_rng(3)
    n = 1200
    low, ids, tie = rng.integers(-10**6, 10**6, n), rng.permutation(n), rng.integers(-2**60, 2**60, n)
    if kind in ("one score", "one id", "all equal"):
        low[:] = 7
    if kind == "few scores":
        low = rng.choice([-5, 0, 9], n)
    if kind in ("one id", "all equal"):
        ids[:] = 1
    if kind == "all equal":
        tie[:] = 2
    values = list(zip(low.tolist(), ids.tolist(), tie.tolist(), strict=True))
    rows, want = keys_of(spark, values).cache(), sorted(values)
    for k in (1, 700, n):
        for most in (1, 10**6):                 # rows that may be sorted
            low_, _, id_, tie_ = R.cutoff(rows, k, most)
            assert (low_, id_, tie_) == want[k - 1], (kind, k, most)
    assert R.cutoff(rows, 0) is None and R.cutoff(rows, n + 1) is None and R.cutoff(rows.limit(0), 1) is None


def test_a_cutoff_at_the_edge_of_a_value_ends(spark):
    rows = keys_of(spark, [(k >= 600, k, 0) for k in range(1200)]).cache()
    for k in (600, 601):
        assert R.cutoff(rows, k, 100)[2] == k - 1


def test_a_wrong_sketch_widens_the_bracket(spark, monkeypatch):
    rows = keys_of(spark, [(k, k, k) for k in range(1000)]).cache()
    seen = []
    real = R.F.percentile_approx
    monkeypatch.setattr(R.F, "percentile_approx", lambda c, p, a: seen.append(1) or real(R.F.lit(999_999_999), p, a))
    assert R._bracket(rows, "low", 300, 1000)[0] == 0 and len(seen) > 1
    monkeypatch.undo()
    lo, hi, below, inside = R._bracket(rows, "low", 300, 1000)
    assert lo <= 299 <= hi and below == lo and inside == hi - lo + 1 < 50


def test_query_against_brute_force(spark, awkward, tmp_path):
    rng = random.Random(9)
    extra = [(300 + k, prose(rng.randint(0, 40), rng.randint(15, 60)), "en", "s", 1) for k in range(600)]
    df = awkward.filter("doc_id is null or doc_id <> 4").unionByName(spark.createDataFrame(extra, DOCS))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    target = [(k, prose(k, 30)) for k in range(5)] + [(90, None), (91, "")]
    spark.createDataFrame(target, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, op12_resample(spark, str(tmp_path)).collect()), key=str)
    want = brute([(r[0], r[1]) for r in df.collect()], [t for _, t in target])
    assert got == sorted(want, key=str) and sum(r[4] is not None for r in got) > 20


def test_drawn_documents_lean_to_the_target(spark):
    near = [(k, prose(k, 60, words=30), "en", "s", 1) for k in range(100)]
    far = [(1000 + k, " ".join(f"z{x}" for x in prose(k, 60).split()), "en", "s", 1) for k in range(900)]
    target = spark.createDataFrame([(1, prose(5000, 80, words=30))], "item_id long, text string")
    got = R.resample(spark.createDataFrame(near + far, DOCS).repartition(4), target).collect()
    assert len(got) == 50 and all(r["doc_id"] < 1000 for r in got)


def test_operator_on_awkward_tables(spark, awkward, no_docs):
    target = awkward.select("doc_id", "text").limit(3)
    none = target.limit(0)
    assert R.resample(no_docs, target).count() == R.resample(no_docs, none).count() == 0
    many = awkward.filter("doc_id = 1").select("doc_id", F_text()).crossJoin(spark.range(200).select())
    assert R.resample(many, none, percent=33).count() == 66            # equal rows: the number is exact
    # small brackets give the draw of one sort
    key = lambda df: sorted((str(r["doc_id"]), r["text"]) for r in df.collect())
    assert key(R.resample(awkward, target, percent=40, sort_rows=1)) == key(R.resample(awkward, target, percent=40))


def F_text():
    from pyspark.sql import functions as F
    return F.col("text")


def test_clashing_columns_keep_their_values(spark, awkward):
    names = {"lang": "LOW", "source": "tie", "n_chars": "Weight"}
    got = R.resample(awkward.withColumnsRenamed(names), awkward, percent=100)
    assert got.columns == ["doc_id", "text", "LOW", "tie", "Weight", "weighted"]
    want = R.resample(awkward, awkward, percent=100)
    assert sorted(map(str, (tuple(r)[:5] for r in got.collect()))) == sorted(map(str, (tuple(r)[:5] for r in want.collect())))
    assert R.weighted(awkward.withColumnRenamed("lang", "WEIGHTED"), R.fitted(awkward, awkward)).columns == ["doc_id", "text", "source", "n_chars", "weighted"]
