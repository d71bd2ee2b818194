"""Scoring a stream of prompts.

Requests arrive as files. Each micro-batch is written to its own folder with
overwrite, so a batch replayed after a failure replaces its own output: the
sink is idempotent. Batch numbers start at 0 with every new checkpoint, so the
folders lie under the run they belong to, ``run=/batch_id=``; the run's name is
kept in the checkpoint folder. A restart goes on with its run, another
checkpoint on the same sink starts another one and overwrites nothing.

* :func:`start_scoring` runs the batch cascade (or the single model) on each
  micro-batch. Per-prompt TF-IDF needs a per-prompt aggregation, which is why
  this is ``foreachBatch`` and not a plain append query.
* :func:`start_reusing` keeps the verdict of each prompt text in keyed state for
  a time: repeated requests get it without being scored again, also after a
  restart. State is dealt by a hash of the text and expires, so it is bounded by
  the distinct texts of that time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from promptscreen.operators import cascade

REQUEST_SCHEMA = "prompt_id bigint, prompt string"


def run_name(spark: SparkSession, checkpoint_dir: str) -> str:
    """The run that a checkpoint folder belongs to: made once, then read."""
    path = f"{checkpoint_dir.rstrip('/')}-run"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        spark.createDataFrame([(uuid.uuid4().hex[:12],)], "run string").coalesce(1).write.text(path)
    return spark.read.text(path).first()[0]


def _requests(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


def _start(stream: DataFrame, write: Callable, checkpoint_dir: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def start_scoring(spark: SparkSession, model, source_dir: str, sink_dir: str,
                  checkpoint_dir: str, gate=None, available_now: bool = True,
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    folder = f"{sink_dir}/run={run_name(spark, checkpoint_dir)}"

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        cached: list = []
        if gate is not None:
            out = cascade.cascade(gate, model, batch, keep=cached)
        else:
            out = cascade.score_requests(model, batch)
        out.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")
        for df in cached:
            df.unpersist()

    return _start(_requests(spark, source_dir, max_files_per_trigger), score_batch, checkpoint_dir, available_now)


class _Once:
    """A factory whose product a task makes once, not for every key."""

    def __init__(self, make: Callable):
        self.make, self.made = make, None

    def __call__(self):
        if self.made is None:
            self.made = self.make()
        return self.made


VERDICTS = "prompt_id bigint, prompt string, harmful_probability double, reused boolean"


def _verdicts(make_predict: Callable, keep_ms: int, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState):
    """The requests of one text: the kept verdict, or a new one that is kept."""
    if state.hasTimedOut:
        state.remove()
        return
    for pdf in rows:
        reused = np.ones(len(pdf), bool)
        if not state.exists:
            text = pdf["prompt"].iloc[0]
            state.update((float(make_predict()(np.array([text], object))[0]),))
            state.setTimeoutDuration(keep_ms)
            reused[0] = False
        yield pd.DataFrame({"prompt_id": pdf["prompt_id"], "prompt": pdf["prompt"], "harmful_probability": state.get[0], "reused": reused})


def start_reusing(spark: SparkSession, make_predict: Callable, source_dir: str, sink_dir: str, checkpoint_dir: str,
                  keep_ms: int = 3_600_000, available_now: bool = True,
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    """``VERDICTS`` of a stream by a batch model (``make_predict()`` maps texts to
    P(harmful)); a text's verdict is kept for ``keep_ms`` after it was made."""
    folder = f"{sink_dir}/run={run_name(spark, checkpoint_dir)}"
    stream = _requests(spark, source_dir, max_files_per_trigger).withColumn("key", F.coalesce(F.sha2("prompt", 256), F.lit("null")))
    out = stream.groupBy("key").applyInPandasWithState(
        partial(_verdicts, _Once(make_predict), keep_ms), VERDICTS, "p double", "append", GroupStateTimeout.ProcessingTimeTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    # Batches without requests, run for timeouts alone, would keep a run over the files at hand from
    # ending; what is over by then expires with the next requests.
    idle, before = "spark.sql.streaming.noDataMicroBatches.enabled", None
    if available_now:
        before = spark.conf.get(idle, "true")
        spark.conf.set(idle, "false")
    try:
        return _start(out, write, checkpoint_dir, available_now)
    finally:
        if before is not None:
            spark.conf.set(idle, before)


def read_results(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The verdicts of all runs, with ``batch_id``."""
    return spark.read.parquet(sink_dir).drop("run")
