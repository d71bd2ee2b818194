"""Importing this module registers every query of the subpackage."""

from __future__ import annotations

import importlib

from promptscreen.llm.registry import ORACLE, QUERIES

MODULES = ("q_mixing", "q_sharding", "q_decontaminate", "q_quality", "q_private", "q_language", "q_near", "q_pages", "q_neighbours",
           "q_language_model", "q_fim", "q_resample", "q_minhash")

for _name in MODULES:
    importlib.import_module(f"promptscreen.llm.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
