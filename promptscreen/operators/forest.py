"""Random-forest gate on TF-IDF vectors (M3, M4, M5) via ``pyspark.ml``.

The sparse TF-IDF table becomes ``VectorUDT`` only at the classifier
boundary. Spark bins features (``maxBins``), so trees differ from exact-split
implementations: quality is comparable, predictions are not identical.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from promptscreen.constants import FOREST_DEPTH, FOREST_TREES, SEED, TOP_N
from promptscreen.functions.scalar import logit_of
from promptscreen.operators import linear
from promptscreen.operators import tfidf as T
from promptscreen.sources import io


@F.udf(VectorUDT(), useArrow=True)
def _sparse(size, entries):
    if not entries:
        return SparseVector(size, [], [])
    return SparseVector(size, [e[0] for e in entries], [e[1] for e in entries])


def vectors(features: DataFrame, rows: DataFrame, size: int, id_col: str = "prompt_id") -> DataFrame:
    """``rows`` + ``features`` (sparse vector); a row with no known term gets
    an empty vector. ``features`` is the long TF-IDF table."""
    per_doc = features.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("_e"))
    j = rows.join(per_doc, id_col, "left")
    return j.withColumn("features", _sparse(F.lit(size), F.col("_e"))).drop("_e")


def stored_vectors(features: DataFrame, rows: DataFrame, size: int, id_col: str = "prompt_id") -> DataFrame:
    """:func:`vectors`, written once as the Parquet form of sparse vectors and read
    back as such: no Python worker holds them, and a solver's passes build them no more."""
    per_doc = features.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("_e"))

    def entries(field: str, kind: str):
        return F.coalesce(F.col(f"_e.{field}").cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>"))

    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"),
                      entries("idx", "int").alias("indices"), entries("weight", "double").alias("values"))
    path = io.scratch_dir(rows.sparkSession, "vectors")
    table = rows.join(per_doc, id_col, "left").withColumn("features", vector).drop("_e")
    table.write.parquet(path)
    schema = StructType([StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in table.schema])
    return rows.sparkSession.read.schema(schema).parquet(path)


@dataclass
class ForestScorer:
    """Vocabulary + fitted forest; ``score`` adds ``prob_harmful``."""
    spec: T.TfidfSpec
    vocab: DataFrame
    size: int
    model: RandomForestClassificationModel

    def featurize(self, df: DataFrame, text_col: str = "prompt", id_col: str = "prompt_id",
                  partitioned: bool = False) -> DataFrame:
        base = df if partitioned else T.by_id(df, id_col)
        x = T.features(base.select(id_col, text_col), self.vocab, self.spec, text_col, id_col)
        return vectors(x, base, self.size, id_col)

    def score(self, df: DataFrame, text_col: str = "prompt", id_col: str = "prompt_id",
              partitioned: bool = False) -> DataFrame:
        v = self.featurize(df, text_col, id_col, partitioned)
        out = self.model.transform(v)
        p = vector_to_array(F.col("probability"))[1]
        return (out.withColumn("prob_harmful", p).withColumn("logit", logit_of("prob_harmful"))
                .drop("features", "rawPrediction", "probability", "prediction"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/forest")
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")

    @staticmethod
    def load(spark: SparkSession, path: str, spec: T.TfidfSpec) -> "ForestScorer":
        vocab = spark.read.parquet(f"{path}/vocab")
        model = RandomForestClassificationModel.load(f"{path}/forest")
        return ForestScorer(spec, vocab, model.numFeatures, model)


def fit_forest(train: DataFrame, spec: T.TfidfSpec | None = None, num_trees: int = FOREST_TREES,
               max_depth: int = FOREST_DEPTH, seed: int = SEED, stats: DataFrame | None = None,
               vocab: DataFrame | None = None, max_memory_mb: int = 512) -> ForestScorer:
    """Class-balanced random forest on TF-IDF (M3): balanced weights as ``weightCol``,
    ``sqrt`` features per split."""
    spec = spec or T.TfidfSpec()
    if vocab is None:
        if stats is None:
            stats = linear.train_term_stats(train, spec)
        n_docs, _, _ = linear.class_counts(train)
        vocab = T.vocabulary_from_stats(stats, n_docs, spec).checkpoint(eager=True)
    size = spec.max_features
    base = T.by_id(linear.with_class_weight(train.select("prompt_id", "prompt", "label")))
    v = stored_vectors(T.features(base.select("prompt_id", "prompt"), vocab, spec), base.drop("prompt"), size).select(
        "features", F.col("label").cast("double").alias("label"), "weight")
    rf = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed,
                                weightCol="weight", featureSubsetStrategy="sqrt",
                                maxMemoryInMB=max_memory_mb, cacheNodeIds=True)
    return ForestScorer(spec, vocab, size, rf.fit(v))


def importances(spark: SparkSession, scorer: ForestScorer, top_n: int = TOP_N) -> DataFrame:
    """Top features by impurity importance, with names.

    The importance vector has one entry per vocabulary term (bounded by
    ``max_features``), so it is read from the model on the driver.
    """
    imp = scorer.model.featureImportances
    rows = [(int(i), float(v)) for i, v in zip(imp.indices, imp.values)]
    df = spark.createDataFrame(rows, "idx int, importance double")
    named = df.join(F.broadcast(scorer.vocab.select("idx", F.col("term").alias("feature"))), "idx")
    return named.orderBy(F.col("importance").desc(), F.col("feature")).limit(top_n).select(
        "feature", "importance")
