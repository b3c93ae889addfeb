"""All grid queries."""

from __future__ import annotations

import importlib

from .base import ORACLES, QUERIES

MODULES = ["q_sources", "q_stats", "q_detect", "q_masks", "q_curate", "q_eval", "q_inject", "q_stream"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"quiltra.plans.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
