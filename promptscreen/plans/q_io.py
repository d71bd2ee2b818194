"""Queries: sources and sinks, model round trip, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.functions.scalar import decide
from promptscreen.operators import batch_model, prepare
from promptscreen.plans.oracle import STD_MODELS, score_ctes, with_ctes
from promptscreen.plans.q_prepare import _IN_EVAL
from promptscreen.plans.registry import fin, query
from promptscreen.plans.workflow import Workflow
from promptscreen.sources import io
from promptscreen.streaming import stream


@query("s1_read_raw_tsv", with_ctes(["raw"]) + f"""
SELECT prompt_id, data_type, CASE WHEN {_IN_EVAL} THEN NULL ELSE vanilla END AS vanilla,
       adversarial
FROM raw""")
def s1_read_raw_tsv(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    raw_train, raw_eval = wf.raw_files
    d = io.scratch_dir(spark, "raw")
    io.write_raw(raw_train, f"{d}/train.tsv")
    io.write_raw(raw_eval, f"{d}/eval.tsv")
    return prepare.union_raw(io.read_raw(spark, f"{d}/train.tsv"),
                             io.read_raw(spark, f"{d}/eval.tsv")).select(
        "prompt_id", "data_type", "vanilla", "adversarial")


@query("s2_read_split", with_ctes(["split"]) + """
SELECT prompt_id, prompt, data_type, label FROM split WHERE split = 'test'""")
def s2_read_split(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    d = io.scratch_dir(spark, "csv")
    io.write_csv(wf.test.select("prompt_id", "prompt", "data_type", "label"), d)
    return io.read_split_csv(spark, d)


@query("s3_write_read_splits", with_ctes(["split"]) + "SELECT * FROM split")
def s3_write_read_splits(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    d = io.scratch_dir(spark, "splits")
    io.write_splits(wf.split, d)
    return io.read_splits(spark, d).select("prompt_id", "prompt", "data_type", "label", "split")


_SCORED = with_ctes(["train", "test"], STD_MODELS + "," + score_ctes("te", "m2", "test", 2))


@query("s4_model_roundtrip", _SCORED + """
SELECT prompt_id, logit, round(prob_harmful, 6) AS prob_harmful,
       CAST(prob_harmful >= 0.5 AS INTEGER) AS predicted_label FROM te_scored""")
def s4_model_roundtrip(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    d = io.scratch_dir(spark, "model")
    io.save_linear(wf.model, d)
    m = io.load_linear(spark, d)
    s = m.score(wf.test).withColumn("predicted_label", decide("prob_harmful"))
    return fin(s.select("prompt_id", "logit", "prob_harmful", "predicted_label"))


@query("r1_stream_scores", with_ctes(["train", "requests"], STD_MODELS + "," +
                                     score_ctes("rq", "m2", "requests", 2)) + """
SELECT prompt_id, prompt, CASE WHEN prob_harmful > 0.5 THEN 'HARMFUL' ELSE 'BENIGN' END AS prediction_label,
       round(prob_harmful, 6) AS harmful_probability, round(1 - prob_harmful, 6) AS benign_probability
FROM rq_scored""")
def r1_stream_scores(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    d = io.scratch_dir(spark, "stream")
    # The request feed arrives as several files; each trigger takes one.
    wf.requests.repartition(4, "prompt_id").write.parquet(f"{d}/in")
    q = stream.start_scoring(spark, wf.model, f"{d}/in", f"{d}/out", f"{d}/ckpt",
                             max_files_per_trigger=1)
    q.awaitTermination()
    return fin(stream.read_results(spark, f"{d}/out").drop("batch_id"))


@query("r1_stream_cascade", with_ctes(["train", "test"], STD_MODELS + "," +
                                      score_ctes("te", "m2", "test", 2) + "," +
                                      score_ctes("ge", "m1", "test", 1)) + """
SELECT g.prompt_id, CASE WHEN g.prob_harmful > 0.5 THEN 1
                         ELSE CASE WHEN m.prob_harmful > 0.5 THEN 1 ELSE 0 END END AS pipeline_predicted_label
FROM ge_scored g JOIN te_scored m ON g.prompt_id = m.prompt_id""")
def r1_stream_cascade(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    d = io.scratch_dir(spark, "stream")
    wf.test.select("prompt_id", "prompt").repartition(3, "prompt_id").write.parquet(f"{d}/in")
    q = stream.start_scoring(spark, wf.model, f"{d}/in", f"{d}/out", f"{d}/ckpt", gate=wf.gate,
                             max_files_per_trigger=1)
    q.awaitTermination()
    return stream.read_results(spark, f"{d}/out").select("prompt_id", "pipeline_predicted_label")


@query("r1_stream_reuse", with_ctes(["train", "requests"], STD_MODELS + "," +
                                    score_ctes("rq", "m2", "requests", 2)) + """
SELECT md5(prompt) AS prompt_key, 3 * count(*) AS asked, 1 AS scored, round(max(prob_harmful), 6) AS harmful_probability
FROM rq_scored GROUP BY 1""")
def r1_stream_reuse(spark, sf_dir):
    """Every request asked three times, the last time after a restart: each text is scored once."""
    wf = Workflow.get(spark, sf_dir)
    d = io.scratch_dir(spark, "stream")
    predict = batch_model.make_linear_predict_fn(batch_model.export_linear(wf.model))
    for asked in (1, 2):
        again = wf.requests.select("prompt_id", "prompt", F.explode(F.sequence(F.lit(asked), F.lit(2))))
        again.select("prompt_id", "prompt").repartition(2).write.mode("append").parquet(f"{d}/in")
        stream.start_reusing(spark, predict, f"{d}/in", f"{d}/out", f"{d}/ckpt", max_files_per_trigger=1).awaitTermination()
    out = stream.read_results(spark, f"{d}/out")
    return fin(out.groupBy(F.md5("prompt").alias("prompt_key")).agg(
        F.count("*").alias("asked"), F.count_if(~F.col("reused")).alias("scored"), F.max("harmful_probability").alias("harmful_probability")))
