"""The forest as a node table: the same trees on any partitioning, walked like plain code walks them."""

import random

import pytest

from promptscreen.operators import ensemble
from promptscreen.operators import tfidf as T
from promptscreen.sources import io

SPEC = T.TfidfSpec(max_features=60, ngram_max=1, stop_words=())


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for k in range(80):
        label = int(k % 3 == 0)
        text = rng.choices(words, k=rng.randint(3, 25)) + (["idiot"] * rng.randint(1, 3) if label and rng.random() < 0.8 else [])
        rows.append((k, " ".join(text), label))
    return spark.createDataFrame([*rows, (900, "", 0), (901, None, 1)], "prompt_id long, prompt string, label int")


@pytest.fixture(scope="module")
def forest(train):
    return ensemble.fit(train.repartition(3), SPEC, num_trees=6, max_depth=4)


def test_the_same_trees_on_any_partitioning(train, forest):
    again = ensemble.fit(train.coalesce(1), SPEC, num_trees=6, max_depth=4)
    nodes = [sorted(map(tuple, f.nodes.drop("gain").collect())) for f in (forest, again)]
    assert nodes[0] == nodes[1] and len(nodes[0]) > 30
    assert sorted(map(tuple, ensemble.fit(train, SPEC, num_trees=6, max_depth=4, seed=7).nodes.drop("gain").collect())) != nodes[0]


def test_scores_equal_a_plain_walk(spark, train, forest):
    nodes = {r["pos"]: r for r in forest.nodes.collect()}
    base = T.by_id(train)
    x = T.transform(T.doc_terms(base, SPEC), forest.vocab, SPEC)
    bins: dict = {}
    for r in x.collect():
        bins.setdefault(r["prompt_id"], {})[r["idx"]] = int(r["weight"] * ensemble.BINS) + 1
    for r in forest.score(train).collect():
        total = 0.0
        for tree in range(6):
            n = nodes[tree]
            while n["feature"] >= 0:
                n = nodes[n["child"] + (bins.get(r["prompt_id"], {}).get(n["feature"], 0) >= n["cut"])]
            assert n["tree"] == tree
            total += n["p"]
        assert abs(total / 6 - r["prob_harmful"]) < 1e-8
    assert forest.score(train.limit(0)).count() == 0
    by = {r["prompt_id"]: r["prob_harmful"] for r in forest.score(train).collect()}
    assert by[900] == by[901]                       # a null text is scored like an empty one


def test_nodes_hold_together(forest):
    nodes = {r["pos"]: r for r in forest.nodes.collect()}
    for n in nodes.values():
        assert n["heap"] < 2 ** 5
        if n["feature"] >= 0:
            a, b = nodes[n["child"]], nodes[n["child"] + 1]
            assert (a["heap"], b["heap"]) == (2 * n["heap"], 2 * n["heap"] + 1)
            assert (a["n_h"] + b["n_h"], a["n_b"] + b["n_b"]) == (n["n_h"], n["n_b"]) and n["gain"] > 0
            assert min(a["n_h"] + a["n_b"], b["n_h"] + b["n_b"]) > 0
        else:
            assert n["feature"] == ensemble.LEAF


def test_importances_name_the_planted_word(forest):
    every = ensemble.importances(forest, None).collect()
    assert abs(sum(r["importance"] for r in every) - 1) < 1e-9
    assert ensemble.importances(forest, 1).first()["feature"] == "idiot"


def test_saved_and_loaded(spark, train, forest):
    path = io.scratch_dir(spark, "forest")
    forest.save(path)
    back = ensemble.TreeScorer.load(spark, path, SPEC)
    key = lambda f: sorted((r["prompt_id"], r["prob_harmful"]) for r in f.score(train).collect())
    assert key(back) == key(forest) and back.trees == 6


def test_one_class_is_refused(train):
    with pytest.raises(ValueError, match="both classes"):
        ensemble.fit(train.filter("label = 0"), SPEC, num_trees=2, max_depth=2)


def test_poisson_limits():
    limits = ensemble.poisson_limits()
    assert limits == sorted(limits) and limits[0] == 1580030168 and limits[-1] < 2**32


def test_counts_of_a_task_equal_plain_counts(monkeypatch):
    """Small runs of documents, pairs and held counts add up to the same."""
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd
    rng, trees, size = np.random.default_rng(5), 3, 12
    docs = [(int(k % 2), sorted(rng.choice(size, 5, replace=False).tolist()), rng.integers(0, 3, trees)) for k in range(40)]
    frame = pd.DataFrame({"label": [y for y, _, _ in docs], "_idx": [np.array(i) if k else None for k, (_, i, _) in enumerate(docs)],
                          "_steps": [np.arange(1, 6) for _ in docs], "_draws": [n for _, _, n in docs]})
    table = {"feature": np.full(trees, ensemble.OPEN), "cut": np.zeros(trees, int), "child": np.zeros(trees, int)}
    drawn = np.array([[1, 4, 7], [0, 2, -1], [11, 10, 9]])
    want: dict = {}
    for k, (y, idx, n) in enumerate(docs):
        for tree in range(trees):
            for step, i in enumerate(idx, 1):
                if k and n[tree] and i in drawn[tree]:
                    key = (tree, i, step)
                    h, b = want.get(key, (0, 0))
                    want[key] = (h + y * n[tree], b + (1 - y) * n[tree])
    shared = SimpleNamespace(value={"table": table, "pos": np.arange(trees), "drawn": drawn})
    for docs_at_once, pairs, held in ((512, 50_000, 4_000_000), (7, 5, 16)):
        monkeypatch.setattr(ensemble, "DOCS", docs_at_once)
        monkeypatch.setattr(ensemble, "PAIRS", pairs)
        monkeypatch.setattr(ensemble, "HELD", held)
        got: dict = {}
        for part in ensemble._histograms(shared, trees, 0, size, iter([frame.iloc[:25], frame.iloc[25:]])):
            for r in part.itertuples(index=False):
                h, b = got.get((r.pos, r.idx, r.cut), (0, 0))
                got[r.pos, r.idx, r.cut] = (h + r.h, b + r.b)
        assert got == want


def test_tasks_draw_the_features_of_open_nodes(spark):
    """Not the planner: over a local table it would work the draws out on the driver alone."""
    drawn = ensemble.candidates(spark, ensemble.Nodes(400), 50, 1)
    assert "md5" in drawn._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["pos"]: r["_drawn"] for r in drawn.collect()}
    few = ensemble.candidates(spark, ensemble.Nodes(2), 50, 1).collect()
    assert len(rows) == 400 and all(rows[r["pos"]] == r["_drawn"] for r in few)
