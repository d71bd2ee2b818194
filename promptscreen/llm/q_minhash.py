"""Query of the MinHash fingerprints."""

from __future__ import annotations

from promptscreen.llm.common import table
from promptscreen.llm.minhash import against_next
from promptscreen.llm.registry import query


@query("op11_minhash")
def op11_minhash(spark, sf_dir):
    return against_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
