"""Scores of edited texts from per-document statistics.

A linear TF-IDF score of a text is ``bias + N / sqrt(Q)`` with ``N = sum(coef *
v)`` and ``Q = sum(v * v)`` over its known terms, ``v = (1 + ln tf) * idf``. An
edit changes the counts of the few 1-2 grams around it, so its score follows
from ``(N, Q, number of known terms)`` of the document and the old and new
counts of those terms. No edited text is built, moved or read again: variants
are rows of changed terms, and their cost is linear in those.

Only a scorer that is linear over whole, unprefixed texts qualifies
(:func:`supports`); others are scored on the edited texts themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptscreen.constants import DECIMALS
from promptscreen.functions.scalar import sigmoid
from promptscreen.functions.text import ngrams, remove_stop_words, tokens
from promptscreen.operators import tfidf as T
from promptscreen.operators.linear import LinearScorer
from promptscreen.session import ensure_checkpoint_dir


def supports(scorer) -> bool:
    return (isinstance(scorer, LinearScorer) and scorer.spec.prefix is None
            and scorer.spec.max_tokens is None)


def words(c, spec: T.TfidfSpec):
    """The tokens of a text that features are made of."""
    return remove_stop_words(tokens(c), spec.stop_words)


def token_rows(base: DataFrame, spec: T.TfidfSpec, text_col: str = "prompt",
               id_col: str = "prompt_id") -> DataFrame:
    """``(id, pos, token, kept, prev, next)``: every token, whether features are
    made of it, and the nearest such tokens on both sides (null at the ends).
    ``base`` is partitioned by id, so the windows move nothing."""
    rows = base.select(id_col, F.posexplode(tokens(text_col)).alias("pos", "token"))
    if spec.stop_words:
        rows = rows.withColumn("kept", ~F.col("token").isin(*spec.stop_words))
    else:
        rows = rows.withColumn("kept", F.lit(True))
    feature = F.when(F.col("kept"), F.col("token"))
    before = Window.partitionBy(id_col).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("prev", F.last(feature, ignorenulls=True).over(before.orderBy("pos")))
            .withColumn("next", F.last(feature, ignorenulls=True).over(before.orderBy(F.desc("pos")))))


def removals(rows: DataFrame, spec: T.TfidfSpec, id_col: str = "prompt_id") -> DataFrame:
    """``(id, word, edit)`` for the loss of every occurrence of a word, from
    :func:`token_rows`: its unigrams and bigrams go; what stood on both sides of
    a run of it becomes one bigram."""
    rows = rows.filter("kept")
    t, prev, after = F.col("token"), F.col("prev"), F.col("next")
    up_to = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(prev.isNull() | (prev != t), F.struct(prev.alias("w")))
    run = F.last(starts, ignorenulls=True).over(up_to).getField("w")
    ends = after.isNull() | (after != t)
    changes = [(t, -1)]
    if spec.ngram_max > 1:
        changes += [(F.concat(prev, F.lit(" "), t), -1), (F.when(ends, F.concat(t, F.lit(" "), after)), -1),
                    (F.when(ends, F.concat(run, F.lit(" "), after)), 1)]
    found = F.array(*[F.struct(c.alias("term"), F.lit(d).alias("d")) for c, d in changes])
    rows = rows.withColumn("edit", found)
    return rows.select(id_col, t.alias("word"), F.filter("edit", lambda e: e["term"].isNotNull()).alias("edit"))


def edit(prev, old, new, after, spec: T.TfidfSpec):
    """Changed terms, ``array<struct<term, d>>``, when the words ``old`` between
    the words ``prev`` and ``after`` (either may be null) become ``new``. The
    words on both sides count once each way and cancel out."""
    def seq(middle):
        return F.filter(F.concat(F.array(prev), middle, F.array(after)), lambda w: w.isNotNull())

    def signed(middle, d):
        return F.transform(ngrams(seq(middle), spec.ngram_max),
                           lambda t: F.struct(t.alias("term"), F.lit(d).alias("d")))

    return F.concat(signed(old, -1), signed(new, 1))


def _v(tf, spec: T.TfidfSpec):
    """Term weight before normalisation, without idf; 0 for an absent term."""
    if not spec.sublinear_tf:
        return tf.cast("double")
    return F.when(tf > 0, F.lit(1.0) + F.log(F.greatest(tf, F.lit(1)))).otherwise(F.lit(0.0))


def known_terms(scorer: LinearScorer, base: DataFrame, text_col: str = "prompt",
                id_col: str = "prompt_id") -> DataFrame:
    """``(id, idx, tf, idf, coef)`` of the known terms of each document."""
    v = scorer.vocab.select("term", "idx", "idf", F.col("weight").alias("coef"))
    dt = T.known_terms(base.select(id_col, text_col), v, scorer.spec, text_col, id_col, carry=("coef",))
    return dt.select(id_col, "idx", "tf", "idf", "coef")


def prepared(scorer: LinearScorer, base: DataFrame, text_col: str = "prompt",
             id_col: str = "prompt_id") -> tuple[DataFrame, DataFrame]:
    """``(known terms, statistics)`` of the documents, as one stored numeric table."""
    ensure_checkpoint_dir(base.sparkSession)
    known = known_terms(scorer, base, text_col, id_col).checkpoint(eager=True)
    return known, statistics(scorer, known, id_col)


def statistics(scorer: LinearScorer, known: DataFrame, id_col: str = "prompt_id") -> DataFrame:
    """``(id, _n, _q, _k)`` of each document with known terms."""
    v = _v(F.col("tf"), scorer.spec) * F.col("idf")
    return known.groupBy(id_col).agg(F.sum(F.col("coef") * v).alias("_n"), F.sum(v * v).alias("_q"),
                                     F.count("*").alias("_k"))


def _logit(scorer, n, q, k):
    # without a known term the score is the bias, whatever rounding left in N and Q
    s = F.when(k > 0, n / F.sqrt(F.greatest(q, F.lit(1e-300)))).otherwise(F.lit(0.0))
    return F.round(s + F.lit(scorer.bias), DECIMALS)


def changed_terms(scorer: LinearScorer, edits: DataFrame, known: DataFrame, keys: list[str],
                  id_col: str = "prompt_id") -> DataFrame:
    """``(id, *keys, idx, idf, coef, d, tf)``: net change of each known term by
    each variant, with its count in the document. ``edits`` is ``(id, *keys,
    edit)``; one document and variant may have several rows."""
    v = scorer.vocab.select("term", "idx", "idf", F.col("weight").alias("coef"))
    rows = edits.select(id_col, *keys, F.explode("edit").alias("_e")).select(
        id_col, *keys, "_e.term", "_e.d").join(F.broadcast(v), "term")
    net = (rows.groupBy(id_col, *keys, "idx").agg(F.sum("d").alias("d"), F.first("idf").alias("idf"),
                                                  F.first("coef").alias("coef")).filter("d <> 0"))
    return net.join(known.select(id_col, "idx", "tf"), [id_col, "idx"], "left").withColumn(
        "tf", F.coalesce("tf", F.lit(0)))


def _deltas(spec, before, after):
    """Changes of N, Q and of the number of known terms, when counts change."""
    a, b = _v(before, spec) * F.col("idf"), _v(after, spec) * F.col("idf")
    return [F.sum(F.col("coef") * (b - a)).alias("_dn"), F.sum(b * b - a * a).alias("_dq"),
            F.sum((after > 0).cast("int") - (before > 0).cast("int")).alias("_dk")]


def _scored(scorer, rows: DataFrame, stats: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``_dn, _dq, _dk`` (null: nothing changed) and their scores."""
    j = rows.join(stats, id_col, "left")
    total = [F.coalesce(c, F.lit(0)) + F.coalesce(d, F.lit(0)) for c, d in
             ((F.col("_n"), F.col("_dn")), (F.col("_q"), F.col("_dq")), (F.col("_k"), F.col("_dk")))]
    return j.withColumn("logit", _logit(scorer, *total)).withColumn(
        "prob_harmful", sigmoid("logit")).drop("_n", "_q", "_k", "_dn", "_dq", "_dk")


def original_scores(scorer: LinearScorer, rows: DataFrame, stats: DataFrame,
                    id_col: str = "prompt_id") -> DataFrame:
    """``rows`` with ``logit`` and ``prob_harmful`` of the unedited documents."""
    none = {c: F.lit(None).cast("double") for c in ("_dn", "_dq", "_dk")}
    return _scored(scorer, rows.withColumns(none), stats, id_col)


def variant_scores(scorer: LinearScorer, edits: DataFrame, known: DataFrame, stats: DataFrame,
                   keys: list[str], id_col: str = "prompt_id") -> DataFrame:
    """``(id, *keys, logit, prob_harmful)`` of each variant of each document."""
    tf, d = F.col("tf"), F.col("d")
    per = changed_terms(scorer, edits, known, keys, id_col).groupBy(id_col, *keys).agg(
        *_deltas(scorer.spec, tf, tf + d))
    every = edits.select(id_col, *keys).distinct()
    return _scored(scorer, every.join(per, [id_col, *keys], "left"), stats, id_col)


def step_scores(scorer: LinearScorer, edits: DataFrame, known: DataFrame, stats: DataFrame,
                step: str = "k", id_col: str = "prompt_id") -> DataFrame:
    """``(id, step, logit, prob_harmful)`` after each of a series of edits, every
    one made on the text that the earlier ones left. Counts of a term run over
    its own steps, sums of changes over the document's."""
    net = changed_terms(scorer, edits, known, [step], id_col)
    of_term = Window.partitionBy(id_col, "idx").orderBy(step)
    after = F.col("tf") + F.sum("d").over(of_term.rowsBetween(Window.unboundedPreceding, 0))
    net = net.withColumn("_after", after)
    per = net.groupBy(id_col, step).agg(*_deltas(scorer.spec, F.col("_after") - F.col("d"), F.col("_after")))
    every = edits.select(id_col, step).distinct().join(per, [id_col, step], "left")
    so_far = Window.partitionBy(id_col).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    every = every.select(id_col, step, *(F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(c)
                                         for c in ("_dn", "_dq", "_dk")))
    return _scored(scorer, every, stats, id_col)
