"""Query of the page-text operator."""

from __future__ import annotations

from promptscreen.llm.common import table
from promptscreen.llm.pages import main_text
from promptscreen.llm.registry import query


@query("op6_pages")
def op6_pages(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
