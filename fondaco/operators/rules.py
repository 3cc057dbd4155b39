"""Declarative rules compiled to columns: conditions, ordered first-match rules, message lists, named captures."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def condition(name: str, test: Any, columns: dict[str, Column]) -> Column:
    """One condition: a plain value is equality; {"between": [a, b]}, {"greater": a}, {"in": [...]}, {"contains": s}, {"matches": p}.

    A null value fulfils no condition.
    """
    c = columns[name]
    if not isinstance(test, dict):
        hit = c == F.lit(test)
    else:
        (op, v), = test.items()
        hit = {
            "between": lambda: c.between(*v), "greater": lambda: c > v, "less": lambda: c < v, "in": lambda: c.isin(v),
            "contains": lambda: F.lower(c).contains(str(v).lower()), "matches": lambda: c.rlike(v), "equals": lambda: c == F.lit(v),
        }[op]()
    return F.coalesce(hit, F.lit(False))


def first_rule(rules: list[dict[str, Any]], columns: dict[str, Column], fallback: str) -> Column:
    """The id of the first rule all of whose conditions hold, else the fallback."""
    out: Column | None = None
    for r in rules:
        hit = reduce(lambda a, b: a & b, [condition(k, v, columns) for k, v in r.get("when", {}).items()], F.lit(True))
        out = F.when(hit, r["id"]) if out is None else out.when(hit, r["id"])
    return F.lit(fallback) if out is None else out.otherwise(fallback)


def messages(tests: list[tuple[Column, str]], otherwise: str) -> Column:
    """The messages of all tests that hold, in order; a single other one when none does."""
    found = F.filter(F.array(*[F.when(t, m) for t, m in tests]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(otherwise)))


def captures(text: Column, patterns: dict[str, list[str]]) -> dict[str, Column]:
    """Per field the first pattern's first group that isn't empty, else null."""
    return {k: F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in ps]) for k, ps in patterns.items()}
