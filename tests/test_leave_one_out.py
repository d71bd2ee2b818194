"""Texts without a word: built a document at a time, handed on in pieces."""

import pandas as pd

from promptscreen.operators import batch_model, explain
from promptscreen.plans.workflow import Workflow
from tests.conftest import SF01


def test_each_word_is_left_out_everywhere(monkeypatch):
    monkeypatch.setattr(explain, "VARIANT_CHARS", 5)
    frame = pd.DataFrame({"prompt_id": [1, 2, 3], "_t": [["aa", "bb", "aa"], [], None], "_s": [["<", " ", "-", ">"], ["x"], None]})
    parts = list(explain._without_each("prompt_id", iter([frame])))
    assert len(parts) == 2
    assert [tuple(r) for p in parts for r in p.itertuples(index=False)] == [(1, "aa", "< bb->"), (1, "bb", "<aa -aa>")]


def test_black_box_and_linear_model_agree(spark):
    wf = Workflow.get(spark, SF01)
    rows = spark.createDataFrame([(1, "Idiot, the idiot ran;  idiot\n"), (2, "Straße İstanbul stupid"), (3, ""), (4, None)],
                                 "prompt_id long, prompt string")
    black_box = batch_model.BatchUdfScorer(batch_model.export_linear(wf.model))
    key = lambda df: {(r["prompt_id"], r["word"]): r["attribution"] for r in df.collect()}
    a, b = key(explain.leave_one_out(black_box, rows)), key(explain.leave_one_out(wf.model, rows))
    assert a.keys() == b.keys() and {w for _, w in a} >= {"idiot", "the", "stupid"}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-5
