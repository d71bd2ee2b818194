"""Step-wise greedy word substitution (M12), each swap chosen on the current text.

The order of positions is that of :func:`perturb.greedy_substitution` (softmax of
saliency times best drop, on the original text). A prompt then walks its
positions in that order: every synonym of the position is scored on the text as
it is by then, and the best (ties: lower rank) is taken if it lowers P(true
class). The walk ends with the first swap that changes the verdict.

Ranking is bulk DataFrame work. The walk of a prompt depends on no other
prompt, so it runs where the prompt lies: a task takes a batch of prompts with
their plans and the broadcast model (at most ``max_features`` terms), and keeps
per prompt the sums of the linear score and the counts of its known terms. A
candidate costs the 1-2 grams around it, not its text; no edited text is built
but the result's. There is no cap on positions.

Defined results: a prompt already wrong is ``Skipped``; without positions or
without a flip it is ``Failed`` and holds the swaps taken; null texts have no
positions; rows that repeat an id are not allowed, as for the other attacks.
"""

from __future__ import annotations

from collections import Counter
from functools import partial
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptscreen.constants import DECIMALS, MAX_SYNONYMS, STOP_WORDS, THRESHOLD
from promptscreen.functions.text import rebuild_text
from promptscreen.operators import delta, perturb


class Walk:
    """A text as lists of feature words by position, and the sums of its linear
    score: ``bias + n / sqrt(q)`` over its known terms."""

    def __init__(self, model: dict, words: list[list[str]]):
        self.model, self.words = model, words
        self.counts: Counter = Counter()
        self.n = self.q = 0.0
        flat = [w for part in words for w in part]
        self._add(self._changes([], self._grams(flat)))

    def _grams(self, seq: list[str]) -> list[str]:
        pairs = [f"{a} {b}" for a, b in pairwise(seq)] if self.model["ngram_max"] > 1 else []
        return [t for t in [*seq, *pairs] if t in self.model["terms"]]

    def _changes(self, old: list[str], new: list[str]) -> dict[str, int]:
        change = Counter(new)
        change.subtract(old)
        return {t: d for t, d in change.items() if d}

    def _sums(self, change: dict[str, int]) -> tuple[float, float]:
        dn = dq = 0.0
        for t, d in change.items():
            idf, coef = self.model["terms"][t]
            before, after = (self._weight(c) * idf for c in (self.counts[t], self.counts[t] + d))
            dn += coef * (after - before)
            dq += after * after - before * before
        return dn, dq

    def _weight(self, tf: int) -> float:
        if tf <= 0:
            return 0.0
        return 1.0 + np.log(tf) if self.model["sublinear"] else float(tf)

    def _add(self, change: dict[str, int]) -> None:
        dn, dq = self._sums(change)
        self.n, self.q = self.n + dn, self.q + dq
        for t, d in change.items():
            self.counts[t] += d
            if not self.counts[t]:
                del self.counts[t]

    def around(self, pos: int, middle: list[str]) -> list[str]:
        """``middle`` between the nearest feature words on both sides of a position."""
        left = next((self.words[i][-1:] for i in range(pos - 1, -1, -1) if self.words[i]), [])
        right = next((self.words[i][:1] for i in range(pos + 1, len(self.words)) if self.words[i]), [])
        return [*left, *middle, *right]

    def change(self, pos: int, new: list[str]) -> dict[str, int]:
        return self._changes(self._grams(self.around(pos, self.words[pos])), self._grams(self.around(pos, new)))

    def prob(self, change: dict[str, int] | None = None) -> float:
        """P(harmful) of the text, or of the text after a change."""
        dn, dq = self._sums(change or {})
        known = len(self.counts) + sum((self.counts[t] + d > 0) - (self.counts[t] > 0) for t, d in (change or {}).items())
        s = (self.n + dn) / np.sqrt(max(self.q + dq, 1e-300)) if known else 0.0
        return float(1 / (1 + np.exp(-np.round(s + self.model["bias"], DECIMALS))))

    def take(self, pos: int, new: list[str], change: dict[str, int]) -> None:
        self._add(change)
        self.words[pos] = new


def attack(model: dict, threshold: float, label: int, words: list[list[str]], plan: list) -> tuple[list, int]:
    """``(swaps taken, verdict on the last text)`` of one prompt; ``plan`` lists
    ``(pos, synonyms)`` in order, each synonym as ``(synonym, its feature words)`` by rank."""
    walk = Walk(model, words)

    def true(p):
        return p if label == 1 else 1 - p

    current, taken = true(walk.prob()), []
    for pos, synonyms in plan:
        best = None
        for synonym, feature_words in synonyms:
            change = walk.change(pos, feature_words)
            p = walk.prob(change)
            if best is None or true(p) < true(best[0]):
                best = p, synonym, feature_words, change
        if best and true(best[0]) < current:
            walk.take(pos, *best[2:])
            current = true(best[0])
            taken.append((pos, best[1]))
            if int(best[0] >= threshold) != label:
                return taken, 1 - label
    return taken, label


def _walks(shared, threshold, id_col, frames):
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            plan = [(p["pos"], [(x["synonym"], list(x["words"])) for x in p["synonyms"]]) for p in r.plan]
            taken, verdict = attack(shared.value, threshold, r.label, [list(w) for w in r.words], plan)
            out.append((getattr(r, id_col), len(taken), verdict, [{"pos": p, "synonym": s} for p, s in taken]))
        yield pd.DataFrame(out, columns=[id_col, "k", "perturbed_output", "taken"])


def stepwise_substitution(scorer, rows: DataFrame, lexicon: DataFrame, stop_words=None,
                          max_synonyms: int = MAX_SYNONYMS, threshold: float = THRESHOLD,
                          id_col: str = "prompt_id") -> DataFrame:
    """The attack log of :func:`perturb.greedy_substitution`, each swap chosen on
    the current text. ``scorer`` is linear over whole, unprefixed texts."""
    if not delta.supports(scorer):
        raise TypeError("stepwise_substitution needs a linear scorer over whole, unprefixed texts")
    from promptscreen.operators.batch_model import export_linear

    spec, spark = scorer.spec, rows.sparkSession
    r = perturb._ranked(scorer, rows, lexicon, stop_words, max_synonyms, threshold, id_col)
    stop = list(STOP_WORDS if stop_words is None else stop_words)
    syn = perturb.prepare_synonyms(lexicon, max_synonyms).filter(~F.col("word").isin(*stop))
    choices = syn.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(
        "syn_rank", "synonym", delta.words("synonym", spec).alias("words")))).alias("synonyms"))
    # which word stands at a position of the plan is told by the text: nothing but the order is joined to it
    live = r.live.withColumns(perturb._pieces())
    order = r.positions.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("order", "pos"))).alias("_o"))
    at = live.join(order, id_col).select(id_col, F.inline(F.transform("_o", lambda o: F.struct(
        o["order"].alias("order"), o["pos"].alias("pos"), F.get("_toks", o["pos"]).alias("word")))))
    plan = at.join(perturb.lexicon_side(choices), "word").groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("order", "pos", "synonyms"))).alias("plan"))
    feature_words = F.transform("_toks", lambda t: F.filter(F.array(t), lambda w: ~w.isin(*spec.stop_words)))
    todo = live.join(plan, id_col).select(id_col, "label", feature_words.alias("words"), "plan")

    shared = spark.sparkContext.broadcast(export_linear(scorer))
    kind = rows.schema[id_col].dataType.simpleString()
    done = perturb.stored(todo.mapInPandas(partial(_walks, shared, threshold, id_col),
                                           f"{id_col} {kind}, k int, perturbed_output int, taken array<struct<pos: int, synonym: string>>"))
    shared.unpersist()
    swap = F.map_from_entries("taken")
    text = rebuild_text(F.col("_seps"), F.transform("_toks", lambda t, i: F.coalesce(F.element_at(swap, i), t)))
    res = live.select(id_col, "_toks", "_seps", F.col("label").alias("_y")).join(done, id_col).select(
        id_col, "k", text.alias("_text"), "perturbed_output", (F.col("perturbed_output") != F.col("_y")).cast("int").alias("_ok"))
    return perturb._attack_log(r.live, res, r.skipped, id_col)
