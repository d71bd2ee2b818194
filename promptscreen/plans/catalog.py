"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from promptscreen.plans import (q_cascade, q_checks, q_explain, q_greedy, q_io, q_ml,  # noqa: F401
                                q_model, q_network, q_prepare)
from promptscreen.plans.registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
