"""All registered queries and their SQL twins."""

import importlib

from airgrid.catalog.registry import ORACLES, QUERIES

MODULES = ("core", "trips", "robustness", "routes", "sites", "reports")
for _module in MODULES:
    importlib.import_module(f"airgrid.catalog.{_module}")

__all__ = ["ORACLES", "QUERIES"]
