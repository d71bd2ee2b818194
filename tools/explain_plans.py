"""Write docs/PLANS.md: physical plans of headline operators (sf0.01).

Usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from promptscreen.operators import cascade, explain, metrics, perturb, sampling  # noqa: E402
from promptscreen.functions.scalar import decide  # noqa: E402
from promptscreen.plans.workflow import SAMPLE_N, Workflow  # noqa: E402
from promptscreen.session import get_spark  # noqa: E402


def plan_text(df) -> str:
    df.collect()   # run once so the adaptive plan shows its final form
    full = df._jdf.queryExecution().executedPlan().toString()
    # cut at the top-level marker only (cached relations nest their own plans)
    final = re.split(r"(?m)^\+- == Initial Plan ==", full)[0]
    lines = [ln if len(ln) <= 300 else ln[:297] + "..." for ln in final.splitlines() if ln.strip()]
    return re.sub(r"#\d+L?", "", "\n".join(lines))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    raw = Workflow(spark, sf, materialize=False)
    wf = Workflow.get(spark, sf)
    src = wf.split.filter("split <> 'train'").drop("split")
    items = [
        ("Prepared prompts from the parquet scans (pruned columns, pushed filters)", raw.prompts),
        ("Exact stratified sample: bucketed ranks, quota broadcast after a count",
         sampling.stratified_sample(raw.prompts, SAMPLE_N)),
        ("Stage-2 scoring: one exchange of the rows, reused by the term branch",
         wf.model.score(wf.test)),
        ("Cascade: gate over all rows, model over passed rows only",
         cascade.cascade(wf.gate, wf.model, wf.test)),
        ("Breakdown by sample type (rollup, partial aggregation)",
         metrics.breakdown(wf.model.score(wf.test).withColumn("predicted_label",
                                                             decide("prob_harmful")))),
        ("Synonym substitution attack: bulk candidates, one re-score",
         perturb.synonym_flips(wf.model, src, wf.synonyms)),
        ("Position scores: (id, token) join co-partitioned by id",
         explain.position_scores(wf.model, wf.test)),
    ]
    out = ["# Physical plans (sf0.01, local[8], AQE final plans)", "",
           "Generated by `tools/explain_plans.py`. Expression ids are stripped.", ""]
    for title, df in items:
        out += [f"## {title}", "", "```", plan_text(df), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs",
                        "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out))
    print("wrote", path)


if __name__ == "__main__":
    main()
