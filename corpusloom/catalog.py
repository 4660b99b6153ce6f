"""Every registered query of the library (the llm subpackage registers its own)."""

from __future__ import annotations

from corpusloom.plans import control, curation, datasets, drift, evaluation, grammars, layout, master, references, retrieval, rules, structure, units  # noqa: F401
from corpusloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
