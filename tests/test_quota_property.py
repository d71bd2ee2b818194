"""Quota and split allocation against a plain-Python statement of the rules."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from promptscreen.operators import sampling


def py_quotas(sizes: dict, n: int) -> dict:
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (-sizes[s], s))
    out, allocated = {}, 0
    for i, s in enumerate(order):
        if i == len(order) - 1:
            q = max(n - allocated, 0)
        else:
            x = sizes[s] / total * n
            q = int(round(x))                  # Python round is half-even
        q = min(q, sizes[s])
        out[s] = q
        allocated += q
    return out


def largest_remainder(counts: dict, draw: int) -> dict:
    total = sum(counts.values())
    fl = {s: (c * draw) // total for s, c in counts.items()}
    rem = {s: (c * draw) % total for s, c in counts.items()}
    need = draw - sum(fl.values())
    for s in sorted(counts, key=lambda s: (-rem[s], s))[:need]:
        fl[s] += 1
    return fl


def py_split(counts: dict) -> dict:
    n = sum(counts.values())
    train = largest_remainder(counts, n - math.ceil(0.3 * n))
    rest = {s: counts[s] - train[s] for s in counts}
    m = sum(rest.values())
    val = largest_remainder(rest, m - math.ceil(0.5 * m)) if m else {s: 0 for s in counts}
    return {s: (train[s], val[s], rest[s] - val[s]) for s in counts}


def _df(spark, sizes):
    rows, i = [], 0
    for s, k in sizes.items():
        for _ in range(k):
            rows.append((i, s, 1))
            i += 1
    return spark.createDataFrame(rows, "prompt_id bigint, data_type string, label int")


sizes_st = st.dictionaries(st.sampled_from(list("abcde")), st.integers(1, 40), min_size=1, max_size=4)


@settings(max_examples=8, deadline=None)
@given(sizes=sizes_st, n=st.integers(0, 120))
def test_quotas_match_rules(spark, sizes, n):
    got = {r.data_type: r.quota for r in
           sampling.allocate_quotas(_df(spark, sizes), {1: n}).collect()}
    assert got == py_quotas(sizes, n)


@settings(max_examples=8, deadline=None)
@given(sizes=sizes_st)
def test_split_quotas_match_rules(spark, sizes):
    got = {r.data_type: (r.n_train, r.n_val, r.n_test) for r in
           sampling.split_quotas(_df(spark, sizes)).collect()}
    assert got == py_split(sizes)
