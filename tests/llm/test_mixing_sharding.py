import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from promptscreen.llm import mixing, sharding
from promptscreen.llm.mixing import MIX, MixSpec, mix


def brute_share(budget, children):
    """children: {name: (capacity, weight)}; capped proportional shares."""
    got, open_ = {}, {k: v for k, v in children.items() if v[1] > 0}
    left = Fraction(budget)
    while open_:
        total = sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if c * total <= w * left]
        if not full:
            break
        for k in full:
            got[k] = open_.pop(k)[0]
            left -= got[k]
    if open_:
        total = sum(w for _, w in open_.values())
        share = {k: left * w / total for k, (_, w) in open_.items()}
        extra = int(left - sum(int(s) for s in share.values()))
        order = sorted(share, key=lambda k: (-(share[k] - int(share[k])), k))
        for i, k in enumerate(order):
            got[k] = int(share[k]) + (i < extra)
    return got


def test_budgets_follow_the_tree(spark):
    rng = random.Random(5)
    leaves = {(f"d{d}", lang, f"src{s}"): rng.randint(1, 4000) for d in range(4) for lang in ("en", "fr", "xx") for s in range(4) if rng.random() < 0.8}
    spec = MixSpec(weights=({"d0": 9, "d3": 0}, {"en": 5}, {"src0": 3}), budget_num=2, budget_den=1, max_epochs=3)
    weight = [lambda n, i=i: spec.weights[i].get(n, 1) for i in range(3)]
    live = {k: t * 3 * all(weight[i](k[i]) for i in range(3)) for k, t in leaves.items()}
    budget = {(): sum(leaves.values()) * 2}
    for level in range(3):
        families = defaultdict(dict)
        for k, c in live.items():
            old = families[k[:level]].get(k[level], (0, 0))
            families[k[:level]][k[level]] = (old[0] + c, weight[level](k[level]))
        budget = {(*p, n): b for p, kids in families.items() if p in budget for n, b in brute_share(budget[p], kids).items()}
    df = spark.createDataFrame([(*k, t) for k, t in leaves.items()], "mix_domain string, mix_lang string, mix_source string, tokens long")
    got = {tuple(r[:3]): int(r["budget"]) for r in mixing.leaf_budgets(df, spec).collect()}
    assert got == {k: v for k, v in budget.items() if k in leaves}


def test_mix_takes_whole_epochs_and_a_prefix(awkward):
    rows = mix(awkward, MIX).collect()
    by_leaf, totals = defaultdict(Counter), Counter()
    for r in rows:
        assert 0 < r.mix_take <= r.mix_tokens
        assert len(r.text.split()) == r.mix_take
        by_leaf[r.mix_domain, r.mix_lang, r.mix_source][r.mix_epoch] += r.mix_take
    for r in mix(awkward, MixSpec(domain=MIX.domain, weights=MIX.weights, budget_num=1, budget_den=1, max_epochs=1)).collect():
        totals[r.mix_domain, r.mix_lang, r.mix_source] += r.mix_take
    cut = Counter((r.mix_domain, r.mix_lang, r.mix_source) for r in rows if r.mix_take < r.mix_tokens)
    assert max(cut.values(), default=0) <= 1            # at most one cut document in a leaf
    for leaf, epochs in by_leaf.items():
        assert all(epochs[e] == totals[leaf] for e in range(max(epochs)))
    taken = sum(sum(e.values()) for e in by_leaf.values())
    assert taken == sum(totals.values()) * 3 // 5
    lean = mix(awkward, MIX, with_text=False)
    assert "text" not in lean.columns and sorted(lean.groupBy().agg(F.sum("mix_take")).first()) == [taken]


def test_mix_edges(awkward, no_docs):
    assert mix(no_docs, MIX).count() == 0
    assert mix(awkward.filter("text is null"), MIX).count() == 0
    assert mix(awkward, MixSpec(domain=MIX.domain, budget_tokens=0)).count() == 0
    again = mix(awkward.withColumn("mix_take", F.lit(-1)), MIX)     # a column named like an added one is replaced
    assert again.columns == mix(awkward, MIX).columns and again.filter("mix_take < 0").count() == 0


@pytest.mark.parametrize("case", range(4))
def test_cuts_are_the_best(spark, case):
    rng = random.Random(case)
    import hashlib
    n, shards = [(1, 2), (40, 24), (3000, 24), (3000, 3)][case]
    rows = sorted((hashlib.md5(f"{case}-{i}".encode()).hexdigest(), int(rng.paretovariate(1.2) * 40) + 8) for i in range(n))
    if case == 2:
        rows[7] = (rows[7][0], sum(s for _, s in rows) // 3)            # a third of all bytes in one group
    sizes = [s for _, s in rows]
    capacity, cuts = sharding.best_cuts(spark.createDataFrame(rows, "key string, size long"), shards)
    best = sharding.smallest_capacity(sizes, shards, max(sizes), sum(sizes))
    assert capacity == best and len(sharding.walk(sizes, best - 1)) >= shards or best == max(sizes)
    wanted = [rows[i][0] for i in sharding.walk(sizes, best)]
    assert len(cuts) == len(wanted) and all(w.startswith(c) for w, c in zip(wanted, cuts))


def test_shard_rows(awkward, no_docs):
    rows = sharding.shard(awkward.withColumn("shard", F.lit("mine")), 5).collect()
    assert len(rows) == awkward.count() and rows[0].__fields__[:5] == awkward.columns
    slots, group = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        group[r["text"] or ""].add(r["shard"])
        assert r["size"] == len((r["text"] or "").encode()) + 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert all(len(s) == 1 for s in group.values())
    assert sharding.shard(no_docs).count() == 0
