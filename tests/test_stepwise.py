import math

import pytest
import regex
from pyspark.sql import functions as F

from promptscreen.constants import STOP_WORDS, TOKEN_PATTERN
from promptscreen.operators import perturb, stepwise
from promptscreen.operators.batch_model import export_linear, make_linear_predict_fn
from promptscreen.plans.workflow import Workflow
from tests.conftest import SF01


def _plain(predict, lexicon, rows):
    """The attack as a loop over texts, every one scored whole."""
    pat = regex.compile(TOKEN_PATTERN)
    out = {}
    for pid, prompt, y in rows:
        text = (prompt or "").lower()
        toks, seps = pat.findall(text), pat.split(text)

        def built(parts):
            return seps[0] + "".join(t + s for t, s in zip(parts, seps[1:], strict=True))

        def true(texts):
            return [p if y == 1 else 1 - p for p in predict(texts)]

        p0 = predict([text])[0]
        if int(p0 >= 0.5) != y:
            out[pid] = ("Skipped", text, 0)
            continue
        current = true([text])[0]
        ranked = []
        for i, t in enumerate(toks):
            if t in lexicon:
                variants = ["[UNK]", *lexicon[t]]
                got = true([built(toks[:i] + [v] + toks[i + 1:]) for v in variants])
                ranked.append((i, current - got[0], max(current - g for g in got[1:])))
        total = sum(math.exp(s) for _, s, _ in ranked)
        ranked.sort(key=lambda x: (-math.exp(x[1]) / total * x[2], x[0]))
        parts, changes, kind = list(toks), 0, "Failed"
        for i, _, _ in ranked:
            got = true([built(parts[:i] + [v] + parts[i + 1:]) for v in lexicon[toks[i]]])
            best = min(range(len(got)), key=lambda j: (got[j], j))
            if got[best] < current:
                current, changes = got[best], changes + 1
                parts[i] = lexicon[toks[i]][best]
                if int((current if y == 1 else 1 - current) >= 0.5) != y:
                    kind = "Successful"
                    break
        out[pid] = (kind, built(parts), changes)
    return out


def _compare(scorer, src, synonyms):
    log = stepwise.stepwise_substitution(scorer, src, synonyms)
    got = {r.prompt_id: r for r in log.collect()}
    lex = {}
    for r in perturb.prepare_synonyms(synonyms).orderBy("word", "syn_rank").collect():
        if r.word not in STOP_WORDS:
            lex.setdefault(r.word, []).append(r.synonym)
    rows = [(r.prompt_id, r.prompt, r.label) for r in src.collect()]
    want = _plain(make_linear_predict_fn(export_linear(scorer))(), lex, rows)
    assert got.keys() == want.keys()
    for pid, (kind, text, changes) in want.items():
        r = got[pid]
        assert (r.result_type, r.num_changes) == (kind, changes), pid
        assert (r.perturbed_text or "") == text
    return got, log


@pytest.mark.parametrize("which", ["gate", "model"])
def test_equals_the_plain_loop(spark, which):
    wf = Workflow.get(spark, SF01)
    src = wf.split.filter(F.col("split") != "train").drop("split")
    got, log = _compare(getattr(wf, which), src, wf.synonyms)
    kinds = {r.result_type for r in got.values()}
    assert {"Successful", "Skipped"} <= kinds and any(r.num_changes > 1 for r in got.values())
    once = perturb.greedy_substitution(getattr(wf, which), src, wf.synonyms)
    assert log.columns == once.columns and log.schema["num_changes"].dataType == once.schema["num_changes"].dataType


def test_odd_rows(spark):
    wf = Workflow.get(spark, SF01)
    word = wf.synonyms.first()["word"]
    rows = [(1, None, 1, "x"), (2, "", 0, "x"), (3, f"{word}", 0, None), (4, f"{word} " * 3000, 1, "x"),
            (5, f"the {word}-{word}, THE {word.upper()}!", 1, "x"), (6, f"the {word}-{word}, THE {word.upper()}!", 0, "x")]
    src = spark.createDataFrame(rows, "prompt_id bigint, prompt string, label int, data_type string")
    _compare(wf.model, src, wf.synonyms)
    assert stepwise.stepwise_substitution(wf.model, src.limit(0), wf.synonyms).count() == 0
    assert {r.num_changes for r in stepwise.stepwise_substitution(wf.model, src, wf.synonyms.limit(0)).collect()} == {0}


def test_other_scorers_are_refused(spark):
    with pytest.raises(TypeError):
        stepwise.stepwise_substitution(object(), spark.range(0), spark.range(0))
