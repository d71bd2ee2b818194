"""Language identification, quality and language model: fits, edges, and the
model's own arithmetic against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptscreen.llm import language, quality
from promptscreen.llm import language_model as lm
from promptscreen.llm.common import id_crc, table
from tests.conftest import SF001, SF01


@pytest.fixture(scope="module")
def crf(spark):
    docs = table(spark, SF01, "documents")
    return language.fit(docs.filter(id_crc(F.col("doc_id")) % 4 != 2))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    counts = np.array([3, 0, 1, 4])
    score, jump = rng.standard_normal((8, 2)), rng.standard_normal((2, 2))
    post = language.forward_backward(score, counts, jump)[0]
    at = 0
    for n in counts:
        want = np.zeros((n, 2))
        for path in range(2**n):
            y = [(path >> i) & 1 for i in range(n)]
            w = math.exp(sum(score[at + i, y[i]] for i in range(n)) + sum(jump[y[i], y[i + 1]] for i in range(n - 1)))
            for i in range(n):
                want[i, y[i]] += w
        if n:
            assert np.allclose(post[at:at + n], want / want.sum(1, keepdims=True))
        at += n


def test_language_of_held_out_documents(spark, crf):
    docs = table(spark, SF01, "documents")
    found = language.identify(docs.filter(id_crc(F.col("doc_id")) % 4 == 2), crf).select("lang", "lang_pred", "lang_score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97 and all(0 <= r["lang_score"] <= 1 for r in found)


def test_code_switching_and_edges(spark, crf, awkward, no_docs):
    by = {r["lang"]: r["text"] for r in table(spark, SF01, "documents").filter("length(text) > 900").collect()}
    mixed = " ".join(by["en"].split()[:60] + by["fr"].split()[:20])
    (pred, score, shares), = language.decode([mixed], crf)
    assert pred == "en" and 0.6 < score < 0.9 and shares[crf.labels.index("fr")] > 10
    assert [x[:2] for x in language.decode([None, "", "12 --", "—…"], crf)] == [("und", 0.0)] * 4
    rows = language.identify(awkward.withColumn("lang_pred", F.lit(1)), crf, shares="parts").collect()
    assert len(rows) == awkward.count()
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (5, 6, 7, 13)} == dict.fromkeys((5, 6, 7, 13), "und")
    kept = language.accepted(awkward, crf)
    assert kept.columns == awkward.columns and not {5, 6, 7, 13} & {r["doc_id"] for r in kept.collect()}
    assert language.identify(no_docs, crf).count() == 0
    nothing = language.fit(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.identify(awkward, nothing).collect()} == {"und"}


def test_quality(spark, awkward, no_docs):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    held = id_crc(F.col("doc_id")) % 5 == 0
    w = quality.fit(docs.filter(~held), labels)
    got = quality.score(docs.filter(held), w).join(labels, "doc_id").select("score", "quality").collect()
    assert np.mean([(r["score"] >= quality.THRESHOLD) == (r["quality"] == 1) for r in got]) > 0.93
    odd = labels.limit(3).selectExpr("cast(null as long) doc_id", "quality").unionByName(labels.limit(3).selectExpr("doc_id", "cast(null as int) quality"))
    assert np.allclose(quality.fit(docs.filter(~held), labels.select("doc_id", "quality").unionByName(odd)), w)
    rows = quality.score(awkward.withColumn("score", F.lit("x")), w).collect()
    assert len(rows) == awkward.count() and all(0 < r["score"] < 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (5, 6, 7)}) == 1
    assert quality.score(no_docs, w).count() == 0
    assert {r["score"] for r in quality.score(awkward, quality.fit(no_docs, labels)).collect()} == {0.5}


def test_sparse_dot_product_equals_the_plain_sum():
    w = np.random.default_rng(0).standard_normal(1 << quality.BITS)
    texts = ["The cat, the CAT!! 12", "", None, "one", "ab " * 3000]
    p = quality.score_texts(texts, w)
    for t, s in zip(texts, p, strict=True):
        ids, _, n = quality.features([t])
        assert math.isclose(s, 1 / (1 + math.exp(-max(-35, min(35, w[0] + w[ids].sum() / math.sqrt(max(1, n[0])))))), abs_tol=1e-9)


def test_gradient_of_the_language_model():
    v = lm.Vocabulary(10, 5, np.array([lm.END], np.uint64), np.zeros(1), np.array([lm.END], np.uint64), np.array([0]), np.array([3]),
                      np.zeros(lm.SPELLED), np.full(lm.SPELLED + 1, 1 / (lm.SPELLED + 1)))
    p = {k: x.astype(np.float64) for k, x in lm.start_weights(v).items()}
    y = np.array([[70, 0, 66, 0], [0, 65, 64, 70]])

    def loss():
        total = 0.0
        for row in y:
            h = np.zeros((1, lm.HIDDEN))
            for t in row:
                total += float(lm.log_probs(p, h, np.array([t]), 1)[0])
                h = lm.cell(p, np.array([t]), h)[0] * (t != 0)
        return total

    tr = lm.Trainer(p, 1, 0, 0.0, 2)
    grads = {}
    tr._adam = lambda name, grad, rows: grads.__setitem__(name, (grad, rows))
    tr._window(y, np.zeros((2, lm.HIDDEN)))
    for name, at in (("u", (3, 40)), ("wc", (5, 3)), ("wo", (0, 2, 0)), ("bc", (4,)), ("u", (7, 20))):
        p[name][at] += 1e-5
        up = loss()
        p[name][at] -= 2e-5
        down = loss()
        p[name][at] += 1e-5
        assert math.isclose(grads[name][0][at] * 8, (up - down) / 2e-5, rel_tol=1e-3, abs_tol=1e-6), name
    grad, rows = grads["a"]
    i = int(np.flatnonzero(rows == 70)[0])
    p["a"][70, 40] += 1e-5
    up = loss()
    p["a"][70, 40] -= 2e-5
    assert math.isclose(grad[i, 40] * 8, (up - loss()) / 2e-5, rel_tol=1e-3, abs_tol=1e-6)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    v = lm.Vocabulary(10, 5, np.array([lm.END], np.uint64), np.zeros(1), np.arange(100, dtype=np.uint64), np.arange(100), rng.integers(1, 50, 100),
                      np.zeros(lm.SPELLED), np.full(lm.SPELLED + -(-100 // lm.SLOTS), 1 / (lm.SPELLED + -(-100 // lm.SLOTS))))
    p = lm.start_weights(v)
    h = rng.standard_normal((1, lm.HIDDEN)).astype(np.float32)
    n = v.classes * lm.SLOTS + lm.SPELLED
    assert math.isclose(np.exp(lm.log_probs(p, np.repeat(h, n, 0), np.arange(n), v.classes)).sum(), 1, rel_tol=1e-4)


def test_scores_go_on_across_windows():
    rng = np.random.default_rng(3)
    v = lm.Vocabulary(10, 5, np.array([lm.END], np.uint64), np.zeros(1), np.arange(64, dtype=np.uint64), np.arange(64), rng.integers(1, 50, 64),
                      np.zeros(lm.SPELLED), np.full(lm.SPELLED + 1, 1 / (lm.SPELLED + 1)))
    p, counts = lm.start_weights(v), np.array([5, 200, 1, 77])
    y = rng.integers(0, 64 + lm.SPELLED, counts.sum())
    got, at = lm.score_tokens(p, y, counts, 1), 0
    for n in counts:
        h = np.zeros((1, lm.HIDDEN), np.float32)
        for t in range(at, at + n):
            assert math.isclose(got[t], float(lm.log_probs(p, h, y[t:t + 1], 1)[0]), abs_tol=1e-4)
            h = lm.cell(p, y[t:t + 1], h)[0]
        at += n


@pytest.mark.parametrize("known", [1 << 20, 500])
def test_base_counts_and_gain(spark, known, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", known)
    docs = table(spark, SF001 if known < 1000 else SF01, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + ["end"] for r in docs.collect()}
    c = Counter(x for i, w in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in w)
    total, types = sum(c.values()), len(c)
    rows = lm.score_documents(docs, id_crc(F.col("doc_id")) % 5 != 1).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w), rel_tol=1e-9)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("unit", [1 << 20, 40_000])
def test_partitions_of_the_input_do_not_change_the_model(spark, unit, monkeypatch):
    monkeypatch.setattr(lm, "UNIT", unit)
    docs = table(spark, SF01, "documents").select("doc_id", "text")
    learn, gains = id_crc(F.col("doc_id")) % 5 != 1, []
    for parts in (1, 4, 32):
        rows = lm.score_documents(docs.repartition(parts), learn).collect()
        held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1]
        gains.append(sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held))
    assert min(gains) > 0 and max(gains) < min(gains) * 1.001, gains


def test_language_model_edges(spark, awkward, no_docs):
    rows = lm.score_documents(awkward, F.lit(True)).collect()
    assert len(rows) == awkward.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (5, 6, 7)} == {1}
    assert lm.score_documents(no_docs, F.lit(True)).count() == 0
    blank = lm.score_documents(awkward, F.lit(False)).collect()
    assert {r["train_tokens"] for r in blank} == {0} and {r["n_known"] for r in blank} == {0}
    assert all(abs(r["base_score"]) < 1e-6 for r in blank)


def test_tokens_are_the_words():
    texts = ["One  two\tTHREE\n\x0b\x0c\r four", None, "", " ", "a" * 41, "abcdefgh abcdefghi abcdefg\x00 abcdefg ÀÉ x", "x"]
    t, w = lm.Tokens(texts), lm.Words(texts)
    cut = lambda z: [z.raw[a:b] for a, b in zip(z.start.tolist(), z.end.tolist(), strict=True)]
    assert cut(t) == cut(w) and t.counts.tolist() == w.counts.tolist() and t.doc.tolist() == w.doc.tolist()
    assert len(set(t.hashes().tolist())) == len(set(cut(t))) and (lm.spelled(t) == lm.spelled(w)).all()
    assert len(lm.Tokens([])) == len(lm.Tokens([None]).hashes()) == 0


def test_look_ups_and_sums_of_the_language_model():
    rng = np.random.default_rng(5)
    head = np.unique(np.concatenate([rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2), np.arange(7, dtype=np.uint64) << np.uint64(40)]))
    h = np.concatenate([head, head + np.uint64(1), np.array([(1 << 64) - 1], np.uint64)])
    assert lm.found(h, head).tolist() == [*range(len(head)), *[-1] * (len(head) + 1)]
    assert lm.found(h, head[:1]).tolist() == [0, *[-1] * (len(h) - 1)] and len(lm.found(h[:0], head)) == 0
    for keys in (rng.integers(0, 40, 500), np.array([70_000, 3, 70_000]), np.array([2])):
        rows = rng.standard_normal((len(keys), 6))
        met, sums = lm.sums_by(keys, rows)
        assert met.tolist() == sorted(set(keys.tolist()))
        assert np.allclose(sums, [rows[keys == k].sum(0) for k in met])


def test_a_text_scores_the_same_in_any_company():
    rng = np.random.default_rng(6)
    v = lm.Vocabulary(10, 5, np.array([lm.END], np.uint64), np.zeros(1), np.arange(64, dtype=np.uint64), np.arange(64), rng.integers(1, 50, 64),
                      np.zeros(lm.SPELLED), np.full(lm.SPELLED + 1, 1 / (lm.SPELLED + 1)))
    p, counts = lm.start_weights(v), rng.integers(1, 9, lm.SIDE + 40)      # more than are scored side by side
    y = rng.integers(0, 64 + lm.SPELLED, counts.sum())
    got, start = lm.score_tokens(p, y, counts, 1), np.cumsum(counts) - counts
    for i in (0, 1, lm.SIDE, len(counts) - 1):
        own = slice(start[i], start[i] + counts[i])
        assert np.allclose(got[own], lm.score_tokens(p, y[own], counts[i:i + 1], 1), atol=1e-4)
