"""Linear text scorers over TF-IDF (A9, A11, M6, M7) and the scorer interface.

The stage-2 model is pluggable. The built-in one is linear over the TF-IDF
table: either closed-form log-odds weights (pure SQL, exactly checkable) or
a class-weighted ``pyspark.ml`` logistic regression. A scorer adds
``logit`` and ``prob_harmful`` to a DataFrame of prompts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptscreen.constants import DECIMALS
from promptscreen.functions.scalar import sigmoid
from promptscreen.operators import tfidf as T
from promptscreen.session import ensure_checkpoint_dir


@dataclass
class LinearScorer:
    """Vocabulary with per-term weights; ``logit = bias + sum(weight * tfidf)``."""
    spec: T.TfidfSpec
    vocab: DataFrame      # idx, term, idf, weight, ...  (at most max_features rows)
    bias: float = 0.0

    @property
    def weights(self) -> DataFrame:
        return self.vocab.select("term", "weight")

    def materialize(self) -> "LinearScorer":
        """Write the model table to the checkpoint folder: later scoring jobs
        read one small table instead of re-running the training plan."""
        self.vocab = self.vocab.checkpoint(eager=True)
        return self

    def features(self, df: DataFrame, text_col: str = "prompt",
                 id_col: str = "prompt_id") -> DataFrame:
        return T.features(df, self.vocab, self.spec, text_col, id_col)

    def contributions(self, df: DataFrame, text_col: str = "prompt",
                      id_col: str = "prompt_id") -> DataFrame:
        """``(id, idx, term, tf, x, coef, contribution)`` per known term
        (one broadcast join of the model table)."""
        v = self.vocab.select("term", "idx", "idf", F.col("weight").alias("coef"))
        x = T.features(df, v, self.spec, text_col, id_col, carry=("coef",)).withColumnRenamed("weight", "x")
        return x.withColumn("contribution", F.col("coef") * F.col("x"))

    def score(self, df: DataFrame, text_col: str = "prompt", id_col: str = "prompt_id",
              partitioned: bool = False) -> DataFrame:
        """``df`` + ``logit`` (rounded to 6 places) + ``prob_harmful``.

        A prompt with no known term has logit ``bias``. The rows are hashed by
        id once. The term branch keeps the row's other columns as grouping keys
        of the per-document count (they depend on the id, so the groups do not
        change); it therefore reads the same exchange as the join back, which
        Spark reuses: the text is shuffled once.
        """
        base = df if partitioned else T.by_id(df, id_col)
        others = tuple(c for c in base.columns if c not in (id_col, text_col))
        v = self.vocab.select("term", "idx", "idf", F.col("weight").alias("coef"))
        x = T.features(base, v, self.spec, text_col, id_col, carry=("coef",), keep=others)
        sums = x.groupBy(id_col).agg(F.sum(F.col("coef") * F.col("weight")).alias("_s"))
        out = base.join(sums, id_col, "left")
        logit = F.round(F.coalesce(F.col("_s"), F.lit(0.0)) + F.lit(self.bias), DECIMALS)
        return out.withColumn("logit", logit).withColumn(
            "prob_harmful", sigmoid("logit")).drop("_s")


def class_counts(train: DataFrame, label_col: str = "label"):
    """Rows, harmful rows and benign rows of ``train`` as one scalar subquery."""
    c = train.agg(F.struct(F.count("*").alias("n"),
                           F.count_if(F.col(label_col) == 1).alias("n_h"),
                           F.count_if(F.col(label_col) == 0).alias("n_b"))).scalar()
    return c.getField("n"), c.getField("n_h"), c.getField("n_b")


def train_term_stats(train: DataFrame, spec: T.TfidfSpec, text_col: str = "prompt",
                     id_col: str = "prompt_id", label_col: str = "label") -> DataFrame:
    """Per-term corpus count and document frequencies (overall and per class).
    A task's only table is one of its distinct terms: documents are counted inside
    their row."""
    base = T.by_id(train.select(id_col, text_col, label_col), id_col)
    return T.row_stats(T.merged_term_rows(base, spec, text_col, id_col, label_col), label_col)


def fit_logodds(train: DataFrame, spec: T.TfidfSpec | None = None, alpha: float = 1.0,
                text_col: str = "prompt", id_col: str = "prompt_id",
                label_col: str = "label", stats: DataFrame | None = None) -> LinearScorer:
    """Closed-form class-balanced log-odds weights.

    ``w_t = ln((df_h + a*n_h/n) / n_h) - ln((df_b + a*n_b/n) / n_b)``: the
    smoothing is proportional to class size, so a rare term does not lean to
    the smaller class. Bias 0 is the balanced prior.

    ``stats`` may be term statistics of a larger n-gram range over the same
    rows (a 1-2 gram table serves a unigram model: unigrams hold no space),
    so several models share one pass over the training text.
    """
    spec = spec or T.TfidfSpec()
    if stats is None:
        stats = train_term_stats(train, spec, text_col, id_col, label_col)
    elif spec.ngram_max == 1:
        stats = stats.filter(~F.col("term").contains(" "))
    n_docs, n_h, n_b = class_counts(train, label_col)
    vocab = T.vocabulary_from_stats(stats, n_docs, spec)
    n = n_h + n_b
    a = F.lit(float(alpha))
    w = (F.log((F.col("df_h") + a * n_h / n) / n_h)
         - F.log((F.col("df_b") + a * n_b / n) / n_b))
    w = F.when((n_h > 0) & (n_b > 0), w).otherwise(
        F.raise_error(F.lit("fit_logodds needs training rows of both classes")).cast("double"))
    return LinearScorer(spec, vocab.withColumn("weight", w), 0.0)


def class_weights(train: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced class weights ``n / (k * n_c)``."""
    counts = train.groupBy(label_col).agg(F.count("*").alias("n_c"))
    everything = Window.partitionBy()          # two rows
    return counts.withColumn(
        "weight", F.sum("n_c").over(everything) / (F.count("*").over(everything) * F.col("n_c")))


def with_class_weight(train: DataFrame, label_col: str = "label") -> DataFrame:
    """Attach the balanced weight of each row's class (J4: two-row broadcast)."""
    return train.join(F.broadcast(class_weights(train, label_col).select(label_col, "weight")),
                      label_col)


def weighted_logloss(scored: DataFrame, weights: DataFrame, label_col: str = "label",
                     prob_col: str = "prob_harmful") -> DataFrame:
    """Class-weighted cross-entropy ``sum(w * nll) / sum(w)``."""
    eps = 1e-15
    p = F.least(F.greatest(F.col(prob_col), F.lit(eps)), F.lit(1 - eps))
    nll = -F.when(F.col(label_col) == 1, F.log(p)).otherwise(F.log(F.lit(1.0) - p))
    j = scored.join(F.broadcast(weights.select(label_col, F.col("weight").alias("_w"))), label_col)
    return j.agg((F.sum(F.col("_w") * nll) / F.sum("_w")).alias("weighted_logloss"),
                 F.count("*").alias("n"))


def fit_logreg(train: DataFrame, spec: T.TfidfSpec | None = None, reg_param: float = 0.0,
               max_iter: int = 100, stats: DataFrame | None = None, tol: float = 1e-6) -> LinearScorer:
    """Class-weighted logistic regression on TF-IDF vectors.

    The fitted coefficients (one per vocabulary term) become the weights of
    a :class:`LinearScorer`, so scoring stays in SQL like the closed form.
    """
    from pyspark.ml.classification import LogisticRegression
    from promptscreen.operators.forest import stored_vectors

    spec = spec or T.TfidfSpec()
    if stats is None:
        stats = train_term_stats(train, spec)
    n_docs, _, _ = class_counts(train)
    vocab = T.vocabulary_from_stats(stats, n_docs, spec).checkpoint(eager=True)
    base = T.by_id(with_class_weight(train.select("prompt_id", "prompt", "label")))
    x = T.features(base.select("prompt_id", "prompt"), vocab, spec)
    v = stored_vectors(x, base.drop("prompt"), spec.max_features).select(
        "features", F.col("label").cast("double").alias("label"), "weight")
    lr = LogisticRegression(weightCol="weight", regParam=reg_param, maxIter=max_iter,
                            tol=tol, standardization=False)
    m = lr.fit(v)
    coef = m.coefficients.toArray()           # one value per vocabulary term
    spark = train.sparkSession
    w = spark.createDataFrame([(i, float(c)) for i, c in enumerate(coef)], "idx int, weight double")
    vocab_w = vocab.join(F.broadcast(w), "idx")
    return LinearScorer(spec, vocab_w, float(m.intercept))


def select_by_val_f1(train: DataFrame, val: DataFrame, spec: T.TfidfSpec, alphas: list[float],
                     stats: DataFrame | None = None, threshold: float = 0.5,
                     id_col: str = "prompt_id") -> DataFrame:
    """Score the validation split once for every smoothing candidate (M7).

    The vocabulary and document frequencies do not depend on the smoothing,
    so they are computed once; candidate weights are the vocabulary rows
    expanded by the candidate list. Returns per candidate the counters,
    precision, recall, F1 and ``best`` (highest F1, lowest candidate on ties).
    """
    from promptscreen.operators import metrics

    # the model table is read twice, the candidates' figures three times: both are stored
    ensure_checkpoint_dir(train.sparkSession)
    base = fit_logodds(train, spec, 1.0, stats=stats).materialize()
    n_docs, n_h, n_b = class_counts(train)
    n = n_h + n_b
    cands = F.posexplode(F.array(*[F.lit(float(a)) for a in alphas])).alias("candidate", "alpha")
    vocab = base.vocab.select("term", "idx", "idf", "df_h", "df_b", cands)
    a = F.col("alpha")
    vocab = vocab.withColumn("coef", F.log((F.col("df_h") + a * n_h / n) / n_h)
                             - F.log((F.col("df_b") + a * n_b / n) / n_b))
    vb = T.by_id(val.select(id_col, "prompt", "label"), id_col)
    x = T.features(vb.select(id_col, "prompt"), base.vocab, spec, "prompt", id_col).select(id_col, "term", F.col("weight").alias("x"))
    contrib = x.join(F.broadcast(vocab.select("term", "candidate", "alpha", "coef")), "term")
    sums = contrib.groupBy(id_col, "candidate").agg(F.sum(F.col("coef") * F.col("x")).alias("_s"))
    grid = vb.select(id_col, "label", F.posexplode(F.array(*[F.lit(float(v)) for v in alphas]))
                     .alias("candidate", "alpha"))
    scored = grid.join(sums, [id_col, "candidate"], "left").withColumn(
        "logit", F.round(F.coalesce(F.col("_s"), F.lit(0.0)), 6))
    scored = scored.withColumn("predicted_label",
                               ((F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit")))) >= threshold)
                               .cast("int"))
    per = metrics.prf(scored, by=["candidate", "alpha"]).checkpoint(eager=True)
    best = metrics.best_candidate(per).select("candidate", F.lit(True).alias("best"))
    return per.join(best, "candidate", "left").withColumn(
        "best", F.coalesce(F.col("best"), F.lit(False)))
