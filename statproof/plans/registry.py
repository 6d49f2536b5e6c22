"""All registered queries and their oracles."""
from __future__ import annotations

import importlib

FAMILIES = ["corpus", "extraction", "ranking", "evidence", "ranked_evidence", "snapshot", "queue", "evaluation", "lab", "eda", "streaming"]


def _modules():
    for name in FAMILIES:
        try:
            yield importlib.import_module(f"statproof.plans.{name}_queries")
        except ModuleNotFoundError as e:
            if e.name != f"statproof.plans.{name}_queries":
                raise


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLE.items()}


def flagship(spark, folder):
    return queries()["d13_verify_summary"](spark, folder)
