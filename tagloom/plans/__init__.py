"""Registered queries: each module pairs Spark queries with equivalent SQL over the same tables."""
from importlib import import_module

from .registry import ORACLES, QUERIES

for _name in ("tags", "captions", "library", "match", "duplicates", "boxes", "files", "runs", "requests", "replies", "streams"):
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
