"""Registered queries of the llm operators, with SQL where it can express them."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict = {}
for _name in ("q_places", "q_tokens", "q_mixture", "q_names", "q_register", "q_boilerplate", "q_residue", "q_ocr"):
    try:
        _m = importlib.import_module(f"{__package__}.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"{__package__}.{_name}":
            raise
        continue
    QUERIES.update(_m.QUERIES)
    SQL.update(_m.SQL)
