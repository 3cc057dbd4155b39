"""Interfaces of sources that need a network, a browser, a recogniser or a model. None is opened here.

An adapter brings rows into the engine; everything behind it (interpretation, dedup, claims) works on tables. Implement
:class:`Adapter` and register it with ``spark.dataSource.register`` as a Python data source, whose partitions are the planned
requests, so that executors fetch in parallel and a retry repeats one request only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Adapter(Protocol):
    """Answers one planned request with rows of the declared schema."""

    def schema(self) -> str: ...

    def plan(self) -> list[dict[str, Any]]: ...

    def fetch(self, request: dict[str, Any]) -> Iterator[tuple]: ...


class AdapterSource(DataSource):
    """A data source over an adapter; subclasses set ``adapter``."""

    adapter: Adapter | None = None

    @classmethod
    def name(cls) -> str:
        return "fondaco_adapter"

    def schema(self) -> str:
        return self._adapter().schema()

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self._adapter())

    def _adapter(self) -> Adapter:
        if self.adapter is None:
            raise NotImplementedError("an adapter for this kind of source has to be supplied")
        return self.adapter


class _Reader(DataSourceReader):
    def __init__(self, adapter: Adapter) -> None:
        self._adapter = adapter

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self._adapter.plan()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self._adapter.fetch(partition.value)
