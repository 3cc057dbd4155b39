"""Queries over streams, with the batch result as their check."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.intake import event_windows
from .base import Registry

query = Registry()


@query("st10_event_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return event_windows(spark, d).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES, SQL = query.QUERIES, query.SQL
