"""Attribution of verdicts.

The attribution of term ``t`` to the logit is gradient x input, ``coef_t *
x_t``; to the probability it is ``p (1 - p) coef_t x_t``. For a linear scorer
it is exact (the terms sum to the logit when the bias is 0); a network gives
the slope at the text (``network.contributions``). Token positions
share their unigram term's attribution equally, so position scores also add
up to the unigram part of the logit.
"""

from __future__ import annotations

from functools import partial
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptscreen.constants import (CASES_PER_FIGURE, EXCLUDED_TOKENS, MIN_TOKEN_COUNT,
                                    N_SAMPLES_PER_CASE, SPECIAL_TOKENS, TOKENS_PER_ROW,
                                    TOP_K_TOKENS, TOP_N)
from promptscreen.functions.scalar import face_color, sigmoid
from promptscreen.functions.text import tokens, with_prefix
from promptscreen.operators import delta, sampling
from promptscreen.operators import tfidf as T
from promptscreen.session import ensure_checkpoint_dir

VARIANT_CHARS = 4_000_000       # characters of edited texts a task hands on together
VARIANT_ROWS = 20_000           # scores of such texts that it hands on together


def attribution(scorer, df: DataFrame, target: str = "logit", text_col: str = "prompt",
                id_col: str = "prompt_id", partitioned: bool = False) -> DataFrame:
    """``(id, term, idx, tf, x, coef, attribution)`` per known term."""
    base = df if partitioned else T.by_id(df, id_col)
    c = scorer.contributions(base.select(id_col, text_col), text_col, id_col)
    if target == "logit":
        return c.withColumn("attribution", F.col("contribution")).drop("contribution", "logit")
    if target != "probability":
        raise ValueError("target is 'logit' or 'probability'")
    if "logit" in c.columns:        # of a scorer whose contributions do not add up to it
        logit = F.col("logit")
    else:
        logit = F.round(F.sum("contribution").over(Window.partitionBy(id_col)) + F.lit(scorer.bias), 6)
    p = sigmoid(logit)
    return c.withColumn("attribution", p * (F.lit(1.0) - p) * F.col("contribution")).drop("contribution", "logit")


def position_scores(scorer, df: DataFrame, text_col: str = "prompt",
                    id_col: str = "prompt_id", partitioned: bool = False,
                    target: str = "logit", include_prefix: bool = False) -> DataFrame:
    """``(id, pos, token, score)`` for every word token of the text (F15), for
    the logit or the probability; with ``include_prefix`` the words of the
    scorer's instruction prefix count as tokens too, as the model sees them.

    ``score`` = unigram attribution / tf of that unigram; 0 for tokens that
    are stop words or out of the vocabulary. Positions and attributions are
    both partitioned by id, so the (id, token) join needs no new shuffle when
    the session lets joins co-partition on a subset of their keys.

    A scorer without term contributions (a forest, a batch model) is read by
    leaving words out: each position of a word gets an equal share of what the
    word's loss takes from P(harmful).
    """
    base = (df if partitioned else T.by_id(df, id_col)).select(id_col, text_col)
    if not hasattr(scorer, "contributions"):
        at = base.select(id_col, F.posexplode(tokens(text_col)).alias("pos", "token"))
        share = F.col("attribution") / F.count("*").over(Window.partitionBy(id_col, "token"))
        lost = leave_one_out(scorer, base, text_col, id_col).withColumnRenamed("word", "token")
        return at.join(lost, [id_col, "token"]).select(id_col, "pos", "token", share.alias("score"))
    a = attribution(scorer, base, target, text_col, id_col, partitioned=True)
    uni = a.filter(~F.col("term").contains(" ")).select(
        id_col, F.col("term").alias("token"), (F.col("attribution") / F.col("tf")).alias("_s"))
    prefix = scorer.spec.prefix if include_prefix else None
    seen = tokens(with_prefix(text_col, prefix) if prefix else text_col)
    pos = base.select(id_col, F.posexplode(seen).alias("pos", "token"))
    j = pos.join(uni, [id_col, "token"], "left")
    return j.select(id_col, "pos", "token", F.coalesce(F.col("_s"), F.lit(0.0)).alias("score"))


def leave_one_out(scorer, df: DataFrame, text_col: str = "prompt",
                  id_col: str = "prompt_id") -> DataFrame:
    """``(id, word, attribution)`` for any scorer, including black-box ones.

    The attribution of a word is ``P(x) - P(x without every occurrence of the
    word)``. Each distinct word of each text is one variant, and all variants
    are scored in one bulk job. A linear scorer takes them from the changed
    terms (:mod:`delta`), linear in the text; any other scorer gets the edited
    texts, at a cost of distinct words times text length per prompt. A batch
    model gets them in the task that makes them, and no text leaves it. There
    is no cap.
    """
    from promptscreen.functions.text import separators

    base = T.by_id(df.select(id_col, text_col), id_col)
    toks = tokens(text_col)
    if delta.supports(scorer):
        known, stats = delta.prepared(scorer, base, text_col, id_col)
        gone = delta.removals(delta.token_rows(base, scorer.spec, text_col, id_col), scorer.spec, id_col)
        vs = delta.variant_scores(scorer, gone, known, stats, ["word"], id_col).select(
            id_col, "word", F.col("prob_harmful").alias("_pv"))
        w = base.select(id_col, F.explode(F.array_distinct(toks)).alias("word"))
        w = delta.original_scores(scorer, w, stats, id_col).join(vs, [id_col, "word"], "left")
        # a word that features are not made of changes nothing
        return w.select(id_col, "word", F.coalesce(F.col("prob_harmful") - F.col("_pv"), F.lit(0.0))
                        .alias("attribution"))
    # a text becomes as many as it has words: its partitions are not to be put together by their size now
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    base = df.select(id_col, text_col).repartition(parts, id_col)
    orig = scorer.score(base, text_col=text_col, id_col=id_col, partitioned=True).select(
        id_col, text_col, F.col("prob_harmful").alias("_p0"))
    kind = base.schema[id_col].dataType.simpleString()
    if hasattr(scorer, "make"):
        lost = orig.select(id_col, "_p0", toks.alias("_t"), separators(text_col).alias("_s")).mapInArrow(
            partial(_scored_without_each, id_col, scorer.make, scorer.batch_size),
            f"`{id_col}` {kind}, word string, _p0 double, _pv double")
        # a text is compared with the variants of all texts of its id, as by a join on id and word
        of_id = F.collect_list("_p0").over(Window.partitionBy(id_col, "word"))
        lost = lost.select(id_col, "word", "_pv", of_id.alias("_all")).select(
            id_col, "word", "_pv", F.explode("_all").alias("_p0"))
        return lost.select(id_col, "word", (F.col("_p0") - F.col("_pv")).alias("attribution"))
    named = F.concat_ws(":", F.col(id_col).cast("string"), F.col("word"))
    texts = orig.select(id_col, toks.alias("_t"), separators(text_col).alias("_s")).mapInPandas(
        partial(_without_each, id_col), f"`{id_col}` {kind}, word string, _text string")
    vs = scorer.score(texts.select(named.alias("_vid"), "_text"), text_col="_text", id_col="_vid").select(
        "_vid", F.col("prob_harmful").alias("_pv"))
    v = orig.select(id_col, "_p0", F.explode(F.array_distinct(toks)).alias("word")).withColumn("_vid", named)
    return v.join(vs, "_vid").select(id_col, "word", (F.col("_p0") - F.col("_pv")).alias("attribution"))


def _edited(toks, seps):
    """A text of tokens and what stands between them, and pairs of each of its
    distinct words and the text without it."""
    pieces, at, end = [seps[0]], {}, len(seps[0])
    for t, s in zip(toks, seps[1:], strict=True):
        at.setdefault(t, []).append(end)
        pieces += [t, s]
        end += len(t) + len(s)
    whole = "".join(pieces)

    def without():
        for word, starts in at.items():
            ends = [0, *(k + len(word) for k in starts)]
            yield word, "".join([whole[i:k] for i, k in zip(ends, [*starts, len(whole)], strict=True)])

    return whole, without()


def _without_each(id_col: str, frames):
    """The text without each of its distinct words, from tokens ``_t`` and what
    stands between them ``_s``; a few MB of texts at a time."""
    for frame in frames:
        ids, words, texts, held = [], [], [], 0
        for i, toks, seps in zip(frame[id_col], frame["_t"], frame["_s"], strict=True):
            if toks is None or not len(toks):
                continue
            for word, text in _edited(toks, seps)[1]:
                ids.append(i), words.append(word), texts.append(text)
                held += len(text)
                if held > VARIANT_CHARS:
                    yield pd.DataFrame({id_col: ids, "word": words, "_text": texts})
                    ids, words, texts, held = [], [], [], 0
        if ids:
            yield pd.DataFrame({id_col: ids, "word": words, "_text": texts})


def _scored_without_each(id_col: str, make, batch_size: int, batches):
    """``(id, word, _p0, _pv)``: the model's score of the text without each of
    its distinct words. The model gets batches of whole texts, the unedited one
    first in each."""
    predict = make()
    for batch in batches:
        rows, words, scores = [], [], []
        for k, (toks, seps) in enumerate(zip(*(batch.column(c).to_pandas() for c in ("_t", "_s")), strict=True)):
            if toks is None or not len(toks):
                continue
            whole, variants = _edited(toks, seps)
            for part in batched(variants, max(1, batch_size - 1)):
                rows += [k] * len(part)
                words += [word for word, _ in part]
                scores.append(predict(np.array([whole, *(text for _, text in part)], dtype=object))[1:])
            if len(rows) >= VARIANT_ROWS:
                yield _of_rows(batch, id_col, rows, words, scores)
                rows, words, scores = [], [], []
        if rows:
            yield _of_rows(batch, id_col, rows, words, scores)


def _of_rows(batch, id_col: str, rows, words, scores):
    at = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column(id_col).take(at), pa.array(words, pa.string()), batch.column("_p0").take(at),
         pa.array(np.concatenate(scores), pa.float64())], [id_col, "word", "_p0", "_pv"])


def valid_token(c="token"):
    """Not a special token, punctuation piece or word continuation."""
    col = F.col(c)
    return ~col.isin(*EXCLUDED_TOKENS) & ~col.startswith("##")


def token_importance(pos_scores: DataFrame, min_count: int = MIN_TOKEN_COUNT,
                     top_n: int = TOP_N) -> DataFrame:
    """Mean |score| per token seen at least ``min_count`` times, top ``top_n``."""
    keep = ~F.col("token").isin(*SPECIAL_TOKENS) & ~F.col("token").startswith("##")
    g = pos_scores.filter(keep).groupBy("token").agg(
        F.avg(F.abs("score")).alias("average_abs_gradient_input"), F.count("*").alias("n"))
    g = g.filter(F.col("n") >= min_count)
    return g.orderBy(F.col("average_abs_gradient_input").desc(), F.col("token")).limit(top_n)


def top_positions(pos_scores: DataFrame, k: int = TOP_K_TOKENS,
                  id_col: str = "prompt_id") -> DataFrame:
    """The ``k`` strongest valid positions per prompt by |score|, lower position
    first on ties; a repeated word can be chosen twice (W5)."""
    w = Window.partitionBy(id_col).orderBy(F.abs("score").desc(), F.col("pos").asc())
    return (pos_scores.filter(valid_token()).withColumn("token_rank", F.row_number().over(w))
            .filter(F.col("token_rank") <= k))


def normalized(pos_scores: DataFrame, id_col: str = "prompt_id") -> DataFrame:
    """Scores divided by the prompt's max |score| + 1e-8."""
    m = F.max(F.abs("score")).over(Window.partitionBy(id_col))
    return pos_scores.withColumn("norm_score", F.col("score") / (m + F.lit(1e-8)))


def error_cases(results: DataFrame, attacks: DataFrame | None = None,
                pred_col: str = "predicted_label") -> DataFrame:
    """FP and FN rows of a result table, plus benign prompts an attack pushed to
    harmful (P12). Columns: ``case_type, prompt_id, prompt, label, token_rank``
    (the flipped position of an attack row, null otherwise): a prompt flipped
    at two positions is two cases."""
    y, p = F.col("label"), F.col(pred_col)
    case = F.when((y == 0) & (p == 1), F.lit("FP")).when((y == 1) & (p == 0), F.lit("FN"))
    none = F.lit(None).cast("int")
    out = results.select(case.alias("case_type"), "prompt_id", "prompt", "label",
                         none.alias("token_rank")).filter(F.col("case_type").isNotNull())
    if attacks is not None:
        adv = attacks.filter((F.col("label") == 0) & (F.col("new_predicted_label") == 1)).select(
            F.lit("ADV_BEN_FP").alias("case_type"), "prompt_id",
            F.col("original_prompt").alias("prompt"), "label", "token_rank")
        out = out.unionByName(adv)
    return out


def case_layout(scorer, cases: DataFrame, n_per_case: int = N_SAMPLES_PER_CASE,
                tokens_per_row: int = TOKENS_PER_ROW,
                cases_per_part: int = CASES_PER_FIGURE) -> DataFrame:
    """Token attribution table of sampled error cases, laid out for display.

    Per case type up to ``n_per_case`` cases in seeded order, numbered from 1;
    each token gets row/column, its normalised score and color, and the case
    its title ``TYPE #n [VERDICT] P(harmful)=... P(benign)=...`` (W8, W9, F13, F14).
    """
    if "token_rank" not in cases.columns:
        cases = cases.withColumn("token_rank", F.lit(None).cast("int"))
    # nulls are left out of the id: FP and FN cases are named by type and prompt
    keyed = cases.withColumn("_case_id", F.concat_ws(
        ":", "case_type", F.col("prompt_id").cast("string"), F.col("token_rank").cast("string")))
    # cases come from scored (and attacked) prompts: sampling reads them three times
    ensure_checkpoint_dir(keyed.sparkSession)
    keyed = keyed.checkpoint(eager=True)
    picked = sampling.sample_n(keyed, n_per_case, id_col="_case_id", salt="cases", by=["case_type"])
    w = Window.partitionBy("case_type").orderBy(sampling.order_key("_case_id", "cases"), "_case_id")
    picked = T.by_id(picked.withColumn("case_no", F.row_number().over(w)), "_case_id")
    s = scorer.score(picked, id_col="_case_id", partitioned=True)
    ps = normalized(position_scores(scorer, picked, id_col="_case_id", partitioned=True),
                    "_case_id")
    title = F.format_string("%s #%d [%s] P(harmful)=%.3f P(benign)=%.3f", F.col("case_type"),
                            F.col("case_no"),
                            F.when(F.col("prob_harmful") > 0.5, "HARMFUL").otherwise("BENIGN"),
                            F.col("prob_harmful"), F.lit(1.0) - F.col("prob_harmful"))
    head = s.select("_case_id", "case_type", "prompt_id", "case_no",
                    ((F.col("case_no") - 1) / cases_per_part).cast("int").alias("_p"),
                    title.alias("title"))
    out = ps.join(head, "_case_id")
    return out.select(
        "case_type", "prompt_id", "case_no", (F.col("_p") + 1).alias("part"), "title", "pos",
        "token", "score", "norm_score",
        F.floor(F.col("pos") / tokens_per_row).cast("int").alias("row"),
        (F.col("pos") % tokens_per_row).cast("int").alias("col"),
        face_color("norm_score").alias("color"))
