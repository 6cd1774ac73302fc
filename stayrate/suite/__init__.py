"""Every operator as a query over the test tables, with its SQL twin."""

from __future__ import annotations

import importlib

MODULES = (
    "cohort_queries",
    "profile_queries",
    "cleaning_queries",
    "panel_queries",
    "preparation_queries",
    "metric_queries",
    "relation_queries",
    "model_queries",
    "storage_queries",
    "flow_queries",
    "flow_report_queries",
)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"stayrate.suite.{name}"), attribute)
        repeated = merged.keys() & part.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        merged.update(part)
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
