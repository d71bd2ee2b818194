"""Throughput at 1x / 4x / 16x replicated input.

Documents, labels and conversations of one data folder are replicated k times
by Spark (replica r gets ids + r * 10**9) into a scratch folder; the whole
workflow -- split, gate and model fit, cascade, per-type breakdown -- then
runs on each. Prints one JSON line per factor with seconds and prompts/s.

Usage: python tools/scaling.py [sf_dir] [factors, e.g. 1,4,16]
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from promptscreen.operators import cascade, metrics  # noqa: E402
from promptscreen.plans.workflow import Workflow  # noqa: E402
from promptscreen.session import get_spark  # noqa: E402

OFFSET = 10 ** 9


def replicate(spark, src: str, dst: str, k: int) -> None:
    reps = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_r")
    for name, key in (("documents", "doc_id"), ("labels", "doc_id"), ("conversations", "conv_id")):
        df = spark.read.parquet(f"{src}/{name}.parquet")
        out = df.select("*", reps).withColumn(key, F.col(key) + F.col("_r").cast("bigint") * F.lit(OFFSET).cast("bigint")).drop("_r")
        out.write.mode("overwrite").parquet(f"{dst}/{name}.parquet")


def main() -> None:
    src = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    factors = [int(x) for x in (sys.argv[2] if len(sys.argv) > 2 else "1,4,16").split(",")]
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus * 2, driver_memory="16g")
    base = tempfile.mkdtemp(prefix="run-scaling-", dir="/tmp")
    for k in factors:
        d = f"{base}/x{k}"
        replicate(spark, src, d, k)
        t0 = time.time()
        wf = Workflow(spark, d)
        n = wf.prompts.count()
        wf.model, wf.gate            # split + both fits (materialized)
        t1 = time.time()
        r = cascade.cascade(wf.gate, wf.model, wf.test)
        metrics.breakdown(r, pred="pipeline_predicted_label").collect()
        t2 = time.time()
        print(json.dumps({"factor": k, "prompts": n, "fit_sec": round(t1 - t0, 2),
                          "cascade_sec": round(t2 - t1, 2), "total_sec": round(t2 - t0, 2),
                          "prompts_per_sec": round(n / (t2 - t0), 1)}), flush=True)


if __name__ == "__main__":
    main()
