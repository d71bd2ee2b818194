"""Variants of a text through the batch model: scored in the task that makes them."""

import random

import numpy as np
import pytest

from promptscreen.operators import batch_model, explain

WORDS = ["idiot", "clown", "calm", "river", "the", "of", "stone", "art", "artparty", "x", "Straße", "σσς", "ΟΔΟΣ", "İt", "_", "42"]
KNOWN = ["idiot", "clown", "calm", "art", "42", "straße", "σσς", "οδος", "i̇t", "fool", "calm river", "idiot clown", "clown idiot",
         "idiot idiot", "art idiot", "42 42", "harm fool", "classify idiot"]


def model(ngram_max=2, sublinear=True, prefix=None, max_tokens=None):
    rng = random.Random(5)
    terms = {t: (1.0 + rng.random(), rng.uniform(-2, 2)) for t in KNOWN}
    return {"terms": terms, "bias": 0.25, "ngram_max": ngram_max, "stop_words": ["the", "of"], "sublinear": sublinear,
            "prefix": prefix, "max_tokens": max_tokens}


def texts_of(seed):
    rng = random.Random(seed)
    gap = lambda: rng.choice([" ", ", ", "\n", " - ", ".", "  "])
    return "".join(rng.choice(WORDS) + gap() for _ in range(rng.randint(0, 60)))


def variants(text, seed):
    rng = random.Random(seed)
    low = text.lower()
    made = [low.replace(w, "") for w in ("idiot", "the", "art", "σ", "42", " ")] + [low[:n] for n in (1, 40, len(low))]
    made += [low[5:], low + " idiot", text.upper(), low.replace("calm", "fool"), "", None, text, "".join(rng.sample(low, len(low)))]
    return made


@pytest.mark.parametrize("given", [{}, {"ngram_max": 1}, {"sublinear": False}, {"prefix": "If fulfilled, harm: "},
                                   {"prefix": "Classify "}, {"max_tokens": 9}])
def test_a_batch_scores_as_its_texts_do_alone(given):
    predict, alone = batch_model.make_linear_predict_fn(model(**given))(), batch_model.make_linear_predict_fn(model(**given))
    for seed in range(25):
        text = texts_of(seed)
        whole, made = explain._edited(*split(text.lower()))
        for first in (whole, text):
            batch = [first, *(t for _, t in made), *variants(text, seed)]
            got = predict(np.array(batch, dtype=object))
            want = np.array([alone()(np.array([t], dtype=object))[0] for t in batch])
            assert np.abs(got - want).max() < 1e-9


def split(low):
    import regex
    pat = regex.compile(r"[\p{L}\p{N}_]{2,}")
    return pat.findall(low), pat.split(low)


def test_variants_of_a_text_are_not_each_read_whole(monkeypatch):
    """1,500 distinct words: the texts without one of them, 25 at a time, are cut into words a few times in all."""
    text = " ".join(f"word{i}" for i in range(1500))
    read = []
    whole = batch_model.LinearTexts.terms
    monkeypatch.setattr(batch_model.LinearTexts, "terms", lambda self, t: read.append(t) or whole(self, t))
    import pyarrow as pa
    toks, seps = split(text)
    batch = pa.RecordBatch.from_pydict({"id": pa.array([2**60 + 1, None]), "_p0": [0.5, 0.5], "_t": [toks, None], "_s": [seps, None]})
    out = list(explain._scored_without_each("id", batch_model.make_linear_predict_fn(model()), 25, iter([batch])))
    assert sum(b.num_rows for b in out) == 1500 and set(out[0].column("id").to_pylist()) == {2**60 + 1}
    assert len(read) <= 3


def test_no_edited_text_leaves_its_task(spark):
    rows = spark.createDataFrame([(1, "idiot clown, the idiot")], "prompt_id long, prompt string")
    lost = explain.leave_one_out(batch_model.BatchUdfScorer(model()), rows)
    plan = lost._jdf.queryExecution().executedPlan().toString()
    assert "_text" not in plan and "MapInArrow" in plan


def test_repeated_and_null_ids_meet_by_id_and_word(spark):
    scorer = batch_model.BatchUdfScorer(model())

    class ByRow:
        """The same scorer, its texts rows of a table."""
        score = staticmethod(scorer.score)

    rows = [(1, "idiot clown"), (1, "idiot clown"), (2, "calm river idiot"), (2, "idiot art"), (None, "idiot of art"),
            (None, "idiot, idiot"), (2**60 + 1, "Clown 42"), (3, ""), (4, None), (5, "?")]
    df = spark.createDataFrame(rows, "prompt_id long, prompt string")
    key = lambda s: sorted((str(r["prompt_id"]), r["word"], round(r["attribution"], 9)) for r in explain.leave_one_out(s, df).collect())
    found = key(scorer)
    assert len(found) == 8 + (3 + 2 + 2) + (3 + 1 + 2) + 2
    # ids of the other path pass through pandas, as floats when some are null
    assert [r for r in found if r[0] != str(2**60 + 1)] == [r for r in key(ByRow) if r[0] not in (str(2**60 + 1), str(2**60))]
