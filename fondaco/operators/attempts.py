"""Search attempts from conditional templates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A query's text with {variables}; it applies where all of them are known and none of ``unless`` is."""

    name: str
    text: str
    unless: tuple[str, ...] = ()

    def column(self) -> Column:
        parts = [F.col(p[1:-1]) if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", self.text) if p]
        said = F.struct(F.lit(self.name).alias("template"), F.concat(*parts).alias("query"))
        known = F.concat(*parts).isNotNull()
        for c in self.unless:
            known = known & F.col(c).isNull()
        return F.when(known, said)


def attempts(templates: list[Template], most: int) -> Column:
    """The first ``most`` attempts that apply, each query once, as array<struct<template, query>>."""
    return F.slice(F.filter(F.array(*[t.column() for t in templates]), lambda x: x.isNotNull()), 1, most)
