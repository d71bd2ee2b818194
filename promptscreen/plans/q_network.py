"""Queries: the non-linear stage-2 model.

Its weights are fitted, so SQL cannot give its rows; ``tests/test_network.py``
holds training, scores and slopes against plain versions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.operators import cascade, explain, metrics, perturb
from promptscreen.plans.registry import fin, query
from promptscreen.plans.workflow import Workflow


@query("m6_network_epochs")
def m6_network_epochs(spark, sf_dir):
    """Training loss and validation figures of every epoch, and which is kept (M6, M7)."""
    return fin(Workflow.get(spark, sf_dir).network.candidates)


@query("m6_network_scores")
def m6_network_scores(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    return fin(wf.network.scorer.score(wf.test).select("prompt_id", "label", "logit", "prob_harmful"))


@query("m9_cascade_network")
def m9_cascade_network(spark, sf_dir):
    """The cascade of the forest gate and the network, by sample type."""
    wf = Workflow.get(spark, sf_dir)
    return fin(metrics.breakdown(cascade.cascade(wf.forest, wf.network.scorer, wf.test), pred="pipeline_predicted_label"))


@query("m10_network_attribution")
def m10_network_attribution(spark, sf_dir):
    """Gradient x input of every known term of the test prompts, on P(harmful)."""
    wf = Workflow.get(spark, sf_dir)
    a = explain.attribution(wf.network.scorer, wf.test, "probability")
    return fin(a.select("prompt_id", "term", "tf", "x", "coef", "attribution"))


@query("a10_network_importance")
def a10_network_importance(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    return fin(explain.token_importance(explain.position_scores(wf.network.scorer, wf.test, target="probability")))


@query("w5_network_top_tokens")
def w5_network_top_tokens(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    t = explain.top_positions(explain.position_scores(wf.network.scorer, wf.test))
    return fin(t.select("prompt_id", "token_rank", "pos", "token", "score"))


@query("m11_network_flips")
def m11_network_flips(spark, sf_dir):
    """Synonym substitution guided by the network's gradients."""
    wf = Workflow.get(spark, sf_dir)
    src = wf.split.filter(F.col("split") != "train").drop("split")
    return perturb.synonym_flips(wf.network.scorer, src, wf.synonyms)
