"""Registered queries: every operator on the test tables, with SQL that checks it."""

import importlib

from tieweave.plans.registered.base import ORACLES, QUERIES

for _name in ("search", "network", "building", "wording", "evaluation", "changing"):
    importlib.import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
