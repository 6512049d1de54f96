"""Imports every query module so that the registry is complete."""

import importlib
import pkgutil

import larkspan.plans as _plans
from larkspan.plans.registry import QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(_plans.__path__) if m.name.startswith("queries_")):
    importlib.import_module(f"larkspan.plans.{_module}")

__all__ = ["QUERIES"]
