import random

import numpy as np
import pytest

from promptscreen.llm import common, near
from tests.llm.conftest import prose


def words(t):
    return (t or "").encode().lower().split()


def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """{index: smallest id of its component} of (id, text) rows."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 4 * len(a & b) >= 3 * len(a | b):
                x, y = top(i), top(j)
                label[max(x, y)] = min(x, y)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return [(d, len(s), low.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(text, rng, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.random():.6f}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(awkward):
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    passage = prose(77, 60)
    for f in range(12):                                     # families around the threshold
        root = prose(1000 + f, rng.choice([9, 40, 150, 400]))
        for k in range(9):
            rows.append((2000 + 20 * f + k, edited(root, rng, rng.randint(0, max(1, len(root.split()) // 28)))))
    for k in range(60):                                     # a passage that many unlike texts share
        rows.append((5000 + k, prose(3000 + k, rng.randint(3, 80)) + " " + passage))
    rows += [(6000 + k, edited(prose(88, 100), rng, 1)) for k in range(80)]     # one large group
    return rows


@pytest.mark.parametrize("tile", [2048, 6])
def test_components_equal_brute_force(spark, corpus, tile, monkeypatch):
    monkeypatch.setattr(near, "TILE", tile)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    got = near.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(corpus), key=key)


def test_one_of_each(spark, corpus, awkward, no_docs):
    kept = near.one_of_each(awkward).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(4) == 1 and ids.count(None) == 1 and 1 in ids and 2 not in ids and 3 not in ids and 9 not in ids
    assert {5, 6, 7, 8, 10, 11, 12, 13} <= set(ids)         # empty texts are linked with nothing
    assert near.one_of_each(no_docs).count() == 0 and near.near_duplicates(no_docs).count() == 0


def test_bound_is_never_too_low():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a = np.unique(rng.choice(pool, rng.integers(1, 250)))
        b = np.unique(rng.choice(pool, rng.integers(1, 250)))
        true = len(np.intersect1d(a, b))
        assert true <= near.overlap_bound(near.bitmap(a), near.bitmap(b), len(a), len(b)) <= min(len(a), len(b))


def test_prefixes_share_a_shingle():
    for na in range(1, 60):
        for nb in range(1, na + 1):
            for overlap in range(nb + 1):
                if near.enough(overlap, na, nb):            # the worst case: what is common comes last in both
                    assert na - overlap < near.prefix_length(na) and nb - overlap < near.prefix_length(nb)


def test_hashes_tell_words_apart():
    w = common.Words(["ab ba abc bca cab", "ab", "", None, "x" * 500])
    h = w.hashes()
    assert len(set(h[:5].tolist())) == 5 and h[0] == h[5] and w.counts.tolist() == [5, 1, 0, 0, 1]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 90)] + [(200, 200 + i) for i in range(1, 50)] + [(300, 301), (301, 302), (302, 300)]
    rng.shuffle(links)
    got = {r["node"]: r["label"] for r in near.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(91)}, **{200 + i: 200 for i in range(50)}, 300: 300, 301: 300, 302: 300}


def test_one_row_of_each_component_by_row(spark):
    a, b, c, d = (prose(900 + k, 40) for k in range(4))
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c), (None, c + " end"), (3, d), (None, d), (None, ""), (None, ""), (4, ""), (4, None), (4, a)]
    got = near.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    full = sorted((r["text"], r["doc_id"] or 0) for r in got if r["text"] and r["text"] not in (c, c + " end"))
    assert full == sorted([(a, 1), (b, 2), (d, 3)])
    assert sum(r["text"] in (c, c + " end") for r in got) == 1
    assert sorted((r["doc_id"] or 0) for r in got if not r["text"]) == [0, 0, 4]
