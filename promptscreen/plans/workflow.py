"""The standard screening workflow over one data directory.

Every intermediate is a lazy DataFrame built once per :class:`Workflow`;
queries and the bench pick the pieces they need. Nothing here collects.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptscreen.constants import N_BENIGN, N_HARMFUL
from promptscreen.operators import linear, prepare, sampling
from promptscreen.operators import tfidf as T
from promptscreen.session import ensure_checkpoint_dir
from promptscreen.sources import fixture, io

GATE_SPEC = T.TfidfSpec(ngram_max=1)     # cheap stage-1 gate: unigrams
MODEL_SPEC = T.TfidfSpec(ngram_max=2)    # stage-2 model: 1-2 grams
# Sample sizes per class used for the registered sampling queries (FIXTURES.md).
SAMPLE_N = {1: 45, 0: 200}


class Workflow:
    _cache: dict = {}

    @classmethod
    def get(cls, spark: SparkSession, sf_dir: str) -> "Workflow":
        """One materialized workflow per (application, data folder): the split
        and the models are built once and read by every later query, as a
        deployment trains once and scores many times."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._cache:
            cls._cache[key] = cls(spark, sf_dir)
        return cls._cache[key]

    def __init__(self, spark: SparkSession, sf_dir: str,
                 gate_spec: T.TfidfSpec = GATE_SPEC, model_spec: T.TfidfSpec = MODEL_SPEC,
                 alpha: float = 1.0, materialize: bool = True):
        self.spark, self.sf_dir = spark, sf_dir
        self.materialize = materialize
        if materialize:
            ensure_checkpoint_dir(spark)
        self.gate_spec, self.model_spec, self.alpha = gate_spec, model_spec, alpha

    @cached_property
    def raw_files(self) -> tuple[DataFrame, DataFrame]:
        return fixture.raw_files(self.spark, self.sf_dir)

    @cached_property
    def raw(self) -> DataFrame:
        return prepare.union_raw(*self.raw_files)

    @cached_property
    def prompts(self) -> DataFrame:
        return prepare.prepare_prompts(self.raw)

    @cached_property
    def split(self) -> DataFrame:
        split = sampling.stratified_split(self.prompts)
        if not self.materialize:
            return split
        # Train, validation and test each read their own folder of one Parquet table.
        path = io.scratch_dir(self.spark, "split")
        io.write_splits(split, path)
        return io.read_splits(self.spark, path).select(*split.columns)

    def part(self, name: str) -> DataFrame:
        return self.split.filter(F.col("split") == name).drop("split")

    @cached_property
    def train(self) -> DataFrame:
        return self.part("train")

    @cached_property
    def val(self) -> DataFrame:
        return self.part("val")

    @cached_property
    def test(self) -> DataFrame:
        return self.part("test")

    @cached_property
    def train_stats(self) -> DataFrame:
        """1-2 gram statistics of the training text, shared by gate and model."""
        return linear.train_term_stats(self.train, self.model_spec)

    def _fit_both(self) -> None:
        """Fit gate and model from one pass over the training text; the shared
        statistics are kept only while both model tables are written."""
        stats = self.train_stats
        if self.materialize:
            stats = stats.persist()
        m = linear.fit_logodds(self.train, self.model_spec, self.alpha, stats=stats)
        g = linear.fit_logodds(self.train, self.gate_spec, self.alpha, stats=stats)
        if self.materialize:
            m.materialize()
            g.materialize()
            stats.unpersist()
        self.__dict__["model"], self.__dict__["gate"] = m, g

    @cached_property
    def model(self) -> linear.LinearScorer:
        self._fit_both()
        return self.__dict__["model"]

    @cached_property
    def gate(self) -> linear.LinearScorer:
        self._fit_both()
        return self.__dict__["gate"]

    @cached_property
    def forest(self):
        """The forest gate (200 trees of depth 10), fitted once on the training split."""
        from promptscreen.operators import ensemble
        return ensemble.fit(self.train, self.model_spec, vocab=self.model.vocab)

    @cached_property
    def network(self):
        """The non-linear stage-2 model, trained in epochs and chosen on the validation split."""
        from promptscreen.operators import network
        return network.fit(self.train, self.val, self.model_spec, vocab=self.model.vocab)

    @cached_property
    def sampled(self) -> DataFrame:
        """The reference's order of work: sample per class, then split the sample."""
        return sampling.stratified_split(sampling.stratified_sample(self.prompts, {1: N_HARMFUL, 0: N_BENIGN}))

    @cached_property
    def requests(self) -> DataFrame:
        return fixture.requests(self.spark, self.sf_dir)

    @cached_property
    def synonyms(self) -> DataFrame:
        return fixture.synonyms(self.spark)
