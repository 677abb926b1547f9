"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

from .plans.registry import ORACLE_SQL, QUERIES

for _name in ("scores", "pair_sets", "policies", "monitoring", "resampling", "models", "scalars"):
    importlib.import_module(f"{__package__}.plans.{_name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
