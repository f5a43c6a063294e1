"""Importing this package fills the query registry."""

import importlib

from plumbline.plans.registry import ORACLES, QUERIES

for _module in ("detection", "calibration", "audit", "geometry", "comparison", "models", "reports"):
    importlib.import_module(f"plumbline.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
