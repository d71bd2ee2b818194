import numpy as np
import pandas as pd
import pytest

from promptscreen.llm import neighbours as N

KIND = "vec_id long, embedding array<float>, label int"


def rows_of(seed, n=260, d=24):
    rng = np.random.default_rng(seed)
    out, number = [], 0
    for label in (1, 2):
        x = rng.standard_normal((n, d))
        x[40:120] = x[0] + 0.05 * rng.standard_normal((80, d))          # a large near group
        x[130:140] = x[5] + 0.12 * rng.standard_normal((10, d))         # about the threshold
        x[150:170] = x[6]                                               # equal vectors
        x[171] = 7 * x[170]                                             # the same direction
        for v in x.astype(np.float32):
            out.append((number, v.tolist(), label))
            number += 1
    nan, inf = float("nan"), float("inf")
    out += [(9000, None, 1), (9001, [0.0] * d, 1), (9002, [nan] + [1.0] * (d - 1), 1), (9003, [inf] + [1.0] * (d - 1), 1),
            (9004, [None] + [1.0] * (d - 1), 1), (9005, out[0][1], None), (9006, [], 1), (None, out[300][1], 2), out[3], (9007, out[0][1][:5], 1)]
    return out


def brute(rows):
    seen, keys = {}, []
    for i, v, y in rows:
        ok = v is not None and y is not None and len(v) and all(e is not None and np.isfinite(e) for e in v) and any(v)
        k = (i, y, tuple(v)) if ok else None
        keys.append(k)
        if ok:
            seen.setdefault(k, None)
    nodes = list(seen)
    links, label = [0] * len(nodes), list(range(len(nodes)))

    def top(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(nodes)):
        for b in range(a):
            x, y = np.array(nodes[a][2]), np.array(nodes[b][2])
            if nodes[a][1] == nodes[b][1] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = top(a), top(b)
                label[max(p, q)] = min(p, q)
    low = {}
    for a, k in enumerate(nodes):
        if k[0] is not None:
            low[top(a)] = min(low.get(top(a), k[0]), k[0])
    at = {k: a for a, k in enumerate(nodes)}
    return [(r[0], links[at[k]], low.get(top(at[k]))) if k else (r[0], 0, r[0]) for r, k in zip(rows, keys, strict=True)]


@pytest.mark.parametrize("shard", [16_384, 60])
def test_links_and_components(spark, shard):
    rows = rows_of(4)
    got = N.near_vectors(spark.createDataFrame(rows, KIND).repartition(3), shard_rows=shard).collect()
    want = brute(rows)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got, kept = [tuple(r)[:3] for r in got], [(r["vec_id"] == r["component_id"]) == r["kept"] for r in got]
    assert all(kept) and len(got) == len(want)
    found, true = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.98 * true <= found <= true
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty(spark):
    assert N.near_vectors(spark.createDataFrame([], KIND)).count() == 0


def test_recall_of_a_larger_graph():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 32))
    for c in range(40):
        x[50 * c:50 * c + 20] = x[50 * c] + 0.08 * rng.standard_normal((20, 32))
    norm = np.linalg.norm(x, axis=1)
    graph = N.Graph(x / norm[:, None])
    found, beam = N.links_of(graph, x, norm, x, norm, 0.98, np.arange(len(x)))
    cos = (x @ x.T) / (norm[:, None] * norm)
    np.fill_diagonal(cos, -1)
    true = (cos >= 0.98).sum()
    assert 0.97 * true <= sum(map(len, found)) <= true and beam < len(x)
    assert all((cos[i][nodes] >= 0.98).all() for i, nodes in enumerate(found))


def sparse_pairs(seed, n, d, pairs):
    """``n`` vectors far from each other, and partners up to the threshold's angle away from ``pairs`` of them (at ``which``)."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    which = rng.permutation(n)[:pairs]
    side = rng.standard_normal((pairs, d))
    u = x[which] / np.linalg.norm(x[which], axis=1)[:, None]
    side -= np.einsum("nd,nd->n", side, u)[:, None] * u
    angle = 0.99 * np.arccos(0.98) * rng.random((pairs, 1))
    return x, np.cos(angle) * u + np.sin(angle) * side / np.linalg.norm(side, axis=1)[:, None], which


def test_audit_of_rare_links_measures():
    """Links so rare that the sampled queries have none."""
    x, y, which = sparse_pairs(7, 12_000, 64, 400)
    q = np.random.default_rng(8).standard_normal((12_000, 64))
    at = np.random.default_rng(3).permutation(len(q))[-400:]             # the audit's sample are the first
    q[at] = y
    norm = np.linalg.norm(x, axis=1)
    found, beam = N.links_of(N.Graph(x / norm[:, None]), x, norm, q, np.linalg.norm(q, axis=1), 0.98, np.full(len(q), -1))
    assert sum(found[i].tolist() == [j] for i, j in zip(at, which, strict=True)) >= 0.98 * 400 and beam < len(x)


def test_passing_needs_every_class_and_counts_by_query():
    group, none = np.arange(5000), np.zeros(0, int)
    assert not N.passed([], []) and not N.passed([none], [none])
    assert N.passed([group, group[:1]], [group, group[:1]])
    assert not N.passed([group] * 200 + [none], [group] * 200 + [group[:1]])         # one link of a million


def test_sparse_pairs_over_full_shards(spark):
    x, y, which = sparse_pairs(9, 40_000, 64, 400)
    v = np.concatenate([x, y]).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": list(v), "label": 1}), KIND).repartition(8)
    got = {r["vec_id"]: r for r in N.near_vectors(rows).filter("n_links > 0").collect()}
    first = dict(zip([*range(40_000, 40_400), *which.tolist()], [*which.tolist()] * 2, strict=True))
    assert set(got) <= set(first) and len(got) >= 0.98 * 800
    assert all(r["n_links"] == 1 and r["component_id"] in (i, first[i]) for i, r in got.items())
