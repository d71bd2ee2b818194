"""TF-IDF as relational jobs.

Same definition as the common Python TF-IDF defaults used by the workflow:
tokens of two or more word characters, stop words removed before n-grams,
1-2 grams, vocabulary = the ``max_features`` most frequent terms of the
training corpus (ties by term), sublinear tf ``1 + ln tf``, smooth idf
``ln((1 + n) / (1 + df)) + 1``, L2 norm per document. ``pyspark.ml``'s IDF
differs in all of these, so this is written as DataFrame jobs.

The sparse matrix is a long table ``(prompt_id, term, tf, weight)``. Input
rows are hash-partitioned by id once (the text moves, not the far larger
n-gram rows); per-document counting and norms then need no other shuffle.
Scoring groups the rows of known terms alone (:func:`known_terms`).
The vocabulary is capped at ``max_features`` rows, which is what makes its
broadcast safe.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptscreen.constants import MAX_FEATURES, NGRAM_MAX, STOP_WORDS
from promptscreen.functions.text import ngrams, remove_stop_words, tokens, truncate_tokens, with_prefix


@dataclass(frozen=True)
class TfidfSpec:
    max_features: int = MAX_FEATURES
    ngram_max: int = NGRAM_MAX
    stop_words: tuple = field(default_factory=lambda: tuple(STOP_WORDS))
    sublinear_tf: bool = True
    max_tokens: int | None = None   # None: whole text
    prefix: str | None = None       # instruction in front of the text


def terms_column(text_col: str, spec: TfidfSpec):
    toks = tokens(with_prefix(text_col, spec.prefix) if spec.prefix else text_col)
    if spec.max_tokens:
        toks = truncate_tokens(toks, spec.max_tokens)
    return ngrams(remove_stop_words(toks, spec.stop_words), spec.ngram_max)


def doc_terms(df: DataFrame, spec: TfidfSpec, text_col: str = "prompt",
              id_col: str = "prompt_id", keep: tuple = ()) -> DataFrame:
    """``(id, *keep, term, tf)``: term counts per document.

    Expects ``df`` partitioned by ``id_col`` (see :func:`by_id`) so the count
    needs no shuffle of its own.
    """
    exploded = df.select(id_col, *keep, F.explode(terms_column(text_col, spec)).alias("term"))
    return exploded.groupBy(id_col, *keep, "term").agg(F.count("*").alias("tf"))


def by_id(df: DataFrame, id_col: str = "prompt_id") -> DataFrame:
    """``df`` hashed by id. The number of partitions is given, because adaptive
    execution would put texts together up to one task per core by their size,
    and their term rows are many times larger."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, id_col)


def term_stats(dterms: DataFrame, label_col: str | None = "label") -> DataFrame:
    """Corpus count, document frequency (and per class) per term."""
    aggs = [F.sum("tf").alias("cnt"), F.count("*").alias("df")]
    if label_col:
        aggs += [F.count_if(F.col(label_col) == 1).alias("df_h"),
                 F.count_if(F.col(label_col) == 0).alias("df_b")]
    return dterms.groupBy("term").agg(*aggs)


def term_rows(docs: DataFrame, spec: TfidfSpec, text_col: str = "prompt",
              label_col: str | None = "label") -> DataFrame:
    """``([label,] once, term)``: every term of every text (``once`` 0), and again
    each distinct one (``once`` 1). One row is one document, so neither its text
    nor its counts are moved."""
    return _rows_of(docs, terms_column(text_col, spec), label_col)


def merged_term_rows(base: DataFrame, spec: TfidfSpec, text_col: str = "prompt", id_col: str = "prompt_id",
                     label_col: str = "label") -> DataFrame:
    """:func:`term_rows` when rows of one id and label are one document. Expects
    ``base`` partitioned by ``id_col``."""
    docs = base.groupBy(id_col, label_col).agg(F.collect_list(text_col).alias("_texts"))
    return _rows_of(docs, F.flatten(F.transform("_texts", lambda t: terms_column(t, spec))), label_col)


def _rows_of(docs: DataFrame, terms, label_col: str | None) -> DataFrame:
    keep = [label_col] if label_col else []
    rows = docs.select(*keep, terms.alias("_t"))
    rows = rows.select(*keep, F.posexplode(F.array(F.col("_t"), F.array_distinct("_t"))).alias("once", "_t"))
    return rows.select(*keep, "once", F.explode("_t").alias("term"))


def row_stats(rows: DataFrame, label_col: str | None = "label") -> DataFrame:
    """The statistics of :func:`term_stats` from :func:`term_rows`."""
    once = F.col("once") == 1
    aggs = [F.count_if(~once).alias("cnt"), F.count_if(once).alias("df")]
    if label_col:
        aggs += [F.count_if(once & (F.col(label_col) == 1)).alias("df_h"),
                 F.count_if(once & (F.col(label_col) == 0)).alias("df_b")]
    return rows.groupBy("term").agg(*aggs)


def fit_vocabulary(dterms: DataFrame, n_docs, spec: TfidfSpec,
                   label_col: str | None = "label") -> DataFrame:
    """``(idx, term, cnt, df, [df_h, df_b,] idf)`` for the kept terms (T5, M1).

    ``n_docs`` is a column (a scalar subquery) or a number.
    """
    return vocabulary_from_stats(term_stats(dterms, label_col), n_docs, spec)


def vocabulary_from_stats(stats: DataFrame, n_docs, spec: TfidfSpec) -> DataFrame:
    """Top ``max_features`` terms by corpus count (ties by term), indexed
    alphabetically, with smooth idf."""
    top = stats.orderBy(F.col("cnt").desc(), F.col("term").asc()).limit(spec.max_features)
    # ``top`` has at most max_features rows, so one ordered window is bounded.
    n = n_docs if not isinstance(n_docs, (int, float)) else F.lit(n_docs)
    return (top.withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)
            .withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)))


def transform(dterms: DataFrame, vocab: DataFrame, spec: TfidfSpec,
              id_col: str = "prompt_id", carry: tuple = ()) -> DataFrame:
    """``(id, idx, term, tf, weight)``: L2-normalised TF-IDF of known terms (M2).

    Unknown terms drop out in the join; a document with no known term has no
    rows here (its vector is empty).
    """
    v = F.broadcast(vocab.select("term", "idx", "idf", *carry))
    return _weighted(dterms.join(v, "term"), spec, id_col, carry)


def known_terms(df: DataFrame, vocab: DataFrame, spec: TfidfSpec, text_col: str = "prompt",
                id_col: str = "prompt_id", carry: tuple = (), keep: tuple = ()) -> DataFrame:
    """``(id, idx, term, idf, *carry, tf)``: :func:`doc_terms` of the known terms,
    joined with their vocabulary rows. Unknown terms, most of a large corpus, end
    at the broadcast, before any row is grouped. ``keep`` only groups: columns
    that depend on the id, under names of their own."""
    v = F.broadcast(vocab.select("term", "idx", "idf", *carry))
    kept = {f"_keep{i}": F.col(f"`{c}`") for i, c in enumerate(keep)}
    rows = df.select(id_col, *(c.alias(n) for n, c in kept.items()), F.explode(terms_column(text_col, spec)).alias("term"))
    cols = [id_col, "idx", "term", "idf", *carry]
    return rows.join(v, "term").groupBy(*cols, *kept).agg(F.count("*").alias("tf")).select(*cols, "tf")


def features(df: DataFrame, vocab: DataFrame, spec: TfidfSpec, text_col: str = "prompt",
             id_col: str = "prompt_id", carry: tuple = (), keep: tuple = ()) -> DataFrame:
    """:func:`transform` of the texts of ``df``, which is partitioned by ``id_col``."""
    return _weighted(known_terms(df, vocab, spec, text_col, id_col, carry, keep), spec, id_col, carry)


def _weighted(known: DataFrame, spec: TfidfSpec, id_col: str, carry: tuple) -> DataFrame:
    tfw = (F.lit(1.0) + F.log(F.col("tf"))) if spec.sublinear_tf else F.col("tf").cast("double")
    x = known.withColumn("_v", tfw * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(Window.partitionBy(id_col)))
    return x.withColumn("weight", F.col("_v") / norm).select(
        id_col, "idx", "term", "tf", "weight", *carry)
