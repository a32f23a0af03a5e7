"""All registered queries of the library's own operators."""

import importlib

from ..registry import ORACLE, QUERIES

MODULES = ("texts", "data", "metrics", "files", "learning")
for _name in MODULES:
    importlib.import_module(f"{__name__}.{_name}")

__all__ = ["ORACLE", "QUERIES"]
