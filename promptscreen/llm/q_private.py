"""Query of the personal-data operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.llm.common import table
from promptscreen.llm.private import as_string, scan
from promptscreen.llm.registry import query


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


@query("op7_private")
def op7_private(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["base"])
    count = {f"n_{k}": F.size(F.filter(base, of_kind(k))).cast("bigint") for k in ("email", "ip", "card", "phone")}
    return found.select("doc_id", *(c.alias(k) for k, c in count.items()), F.sha2(as_string(base), 256).alias("base_sha256"),
                        as_string(F.col("pii")).alias("spans"), F.size(F.filter("pii", of_kind("secret"))).cast("bigint").alias("n_secret"))
