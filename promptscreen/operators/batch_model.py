"""Batched inference with a model that lives outside Spark.

``predict_batch_udf`` loads the model once per Python worker and feeds it
Arrow batches. A transformer would plug in the same way; with no deep
learning runtime installed, the model shipped here is the fitted linear
scorer evaluated in numpy, which must agree with the SQL scoring.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscreen.constants import DECIMALS, TOKEN_PATTERN
from promptscreen.functions.scalar import logit_of

ALIKE = 32      # characters at either end in which a variant equals its text


def export_linear(scorer) -> dict:
    """The linear model as a plain dict (at most ``max_features`` terms)."""
    rows = scorer.vocab.select("term", "idf", "weight").collect()
    return {"terms": {r["term"]: (float(r["idf"]), float(r["weight"])) for r in rows},
            "bias": float(scorer.bias), "ngram_max": scorer.spec.ngram_max,
            "stop_words": list(scorer.spec.stop_words), "sublinear": scorer.spec.sublinear_tf,
            "prefix": scorer.spec.prefix, "max_tokens": scorer.spec.max_tokens}


def make_linear_predict_fn(model: dict):
    """Factory for ``predict_batch_udf``: returns ``texts -> P(harmful)``; a
    null text has no terms, so it gets the bias's probability."""
    def make():
        return LinearTexts(model).predict
    return make


class LinearTexts:
    """The exported model over batches of texts.

    A batch may hold variants of its first text. Each is compared with it to the
    last character; one that lacks whole words of it, and nothing else, has the
    other words in their order, so they need not be cut out and counted again:
    its sums are those of the first text less what changed. Any other text is
    read whole.
    """

    def __init__(self, model: dict):
        import re
        import regex
        self.pat, self.plain = regex.compile(TOKEN_PATTERN), re.compile(r"\w{2,}", re.ASCII)     # the same on ASCII
        self.numbers = {t: i for i, t in enumerate(model["terms"])}
        both = zip(*model["terms"].values()) if self.numbers else ((), ())
        self.idf, self.weight = (np.array(x, np.float64) for x in both)
        self.per_n, self.per_q = (self.weight * self.idf).tolist(), (self.idf * self.idf).tolist()
        self.stop, self.prefix, self.most = set(model["stop_words"]), model.get("prefix") or "", model.get("max_tokens")
        self.bigrams, self.sublinear, self.bias = model["ngram_max"] >= 2, model["sublinear"], model["bias"]
        self.held = None

    def cut(self, low: str):
        return self.plain if low.isascii() else self.pat

    def grams(self, words: list[str]) -> list[int]:
        """Numbers of the unigrams, then of the bigrams; -1 for one not in the model."""
        found = [self.numbers.get(t, -1) for t in words]
        if self.bigrams:
            found += [self.numbers.get(f"{a} {b}", -1) for a, b in zip(words, words[1:], strict=False)]
        return found

    def terms(self, text) -> list[int]:
        whole = (self.prefix + text).lower() if text is not None else ""
        return self.grams([t for t in self.cut(whole).findall(whole)[:self.most] if t not in self.stop])

    def sums(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """``sum(weight * v)`` and ``sum(v * v)`` of each list of terms."""
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        term = np.fromiter((i for x in lists for i in x), np.int64, len(row))
        row, term = row[term >= 0], term[term >= 0]
        pair, tf = np.unique(row * max(1, len(self.idf)) + term, return_counts=True)
        row, term = pair // max(1, len(self.idf)), pair % max(1, len(self.idf))
        v = ((1.0 + np.log(tf)) if self.sublinear else tf) * self.idf[term]
        return np.bincount(row, self.weight[term] * v, len(lists)), np.bincount(row, v * v, len(lists))

    def predict(self, texts: np.ndarray) -> np.ndarray:
        first = self.first(texts)
        s, q, whole = np.zeros(len(texts)), np.zeros(len(texts)), []
        for k, text in enumerate(texts):
            gone = first.lacking(text) if first and text is not None else None
            if gone is None:
                whole.append(k)
            else:
                s[k], q[k] = first.without(gone)
        if whole:
            s[whole], q[whole] = self.sums([self.terms(texts[k]) for k in whole])
        logit = np.round(s / np.sqrt(np.where(q > 0, q, 1.0)) + self.bias, DECIMALS)
        return 1.0 / (1.0 + np.exp(-logit))

    def first(self, texts) -> ReadText | None:
        """The first text as read, if others begin or end as it does. The last
        one read is kept, for a text may have several batches of variants."""
        if not len(texts) or texts[0] is None or self.most is not None:
            return None
        text = texts[0]
        if self.held is None or self.held.text != text:
            begins, ends = text[:ALIKE], text[-ALIKE:]
            if not any(t is not None and (t.startswith(begins) or t.endswith(ends)) for t in texts[1:]):
                return None
            self.held = ReadText(self, text)
        return self.held


class ReadText:
    """A text cut into words and counted, for texts that lack some of its words."""

    def __init__(self, model: LinearTexts, text: str):
        self.model, self.text = model, text
        whole = model.prefix + text
        self.low = whole.lower()
        # then no letter changes, whatever stands beside it, nor does a text made of parts of this one
        self.is_low = self.low == whole
        spans = [m.span() for m in model.cut(self.low).finditer(self.low)]
        self.token_at, self.ends = {i: n for n, (i, _) in enumerate(spans)}, [j for _, j in spans]
        self.place, self.words, self.near = [], [], 0
        for i, j in spans:
            word = self.low[i:j]
            if word in model.stop:
                self.place.append(-1)
            else:
                self.place.append(len(self.words))
                self.words.append(word)
        self.grams = model.grams(self.words)
        self.tf = Counter(g for g in self.grams if g >= 0)
        s, q = model.sums([self.grams])
        self.s, self.q = float(s[0]), float(q[0])

    def lacking(self, text: str) -> list[int] | None:
        """Numbers of the tokens that ``text`` lacks; None if that is not all it
        differs in. A token is a whole run of letters, so none arises where
        one was left out."""
        a, b = self.model.prefix + text if self.model.prefix else text, self.low
        if not self.is_low:
            a = a.lower()
        len_a, len_b, same = len(a), len(b), a.startswith
        # variants often come in the order of what they lack: begin where the last one first differed
        i = j = self.near if same(b[:self.near]) else 0
        gone = []
        while len_a - i <= len_b - j:
            if len_a - i == len_b - j and same(b[j:], i):
                return gone
            step = 16
            while j + step <= len_b and same(b[j:j + step], i):
                i, j, step = i + step, j + step, 2 * step
            while step := step // 2:
                if j + step <= len_b and same(b[j:j + step], i):
                    i, j = i + step, j + step
            n = self.token_at.get(j)
            if n is None:
                return None
            if not gone:
                self.near = j
            gone.append(n)
            j = self.ends[n]
        return None

    def without(self, gone: list[int]) -> tuple[float, float]:
        """The sums of the text without these tokens, given in order."""
        m, words, last = self.model, self.words, len(self.words) - 1
        places = [p for n in gone if (p := self.place[n]) >= 0]
        change: dict[int, int] = {}
        for k, p in enumerate(places):
            change[self.grams[p]] = change.get(self.grams[p], 0) - 1
            if not m.bigrams:
                continue
            starts = not k or places[k - 1] != p - 1
            if starts:
                left = p - 1
            for e in (p - 1, p) if starts else (p,):      # bigram e is of words e and e + 1
                if 0 <= e < last:
                    g = self.grams[len(words) + e]
                    change[g] = change.get(g, 0) - 1
            if (k + 1 == len(places) or places[k + 1] != p + 1) and left >= 0 and p < last:
                g = m.numbers.get(f"{words[left]} {words[p + 1]}", -1)
                change[g] = change.get(g, 0) + 1
        s, q, terms = self.s, self.q, len(self.tf)
        for g, d in change.items():
            if g < 0 or not d:
                continue
            was = self.tf.get(g, 0)
            u, v = self.value(was), self.value(was + d)
            s += m.per_n[g] * (v - u)
            q += m.per_q[g] * (v * v - u * u)
            terms += (was + d > 0) - (was > 0)
        return (s, q) if terms else (0.0, 0.0)      # whatever rounding left

    def value(self, tf: int) -> float:
        return 0.0 if not tf else 1.0 + math.log(tf) if self.model.sublinear else float(tf)


def batch_scorer(model: dict, batch_size: int = 25):
    return predict_batch_udf(make_linear_predict_fn(model), return_type=T.DoubleType(),
                             batch_size=batch_size)


class BatchUdfScorer:
    """Scorer interface over a ``predict_batch_udf`` (no shuffle: row-local).

    ``make`` gives the function of texts itself, to a task that makes the texts.
    """

    def __init__(self, model: dict, batch_size: int = 25):
        self.make, self.batch_size = make_linear_predict_fn(model), batch_size
        self.udf = batch_scorer(model, batch_size)

    def score(self, df: DataFrame, text_col: str = "prompt", id_col: str = "prompt_id",
              partitioned: bool = False) -> DataFrame:
        p = self.udf(F.col(text_col))
        return df.withColumn("prob_harmful", p).withColumn("logit", logit_of("prob_harmful"))
