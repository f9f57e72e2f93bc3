"""The registry of source adapters, and a Python data source over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Migrate = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Adapter:
    """Reads sources of certain formats."""

    name: str
    formats: frozenset[str]
    migrate: Migrate

    def supports(self, fmt: str) -> bool:
        return fmt in self.formats


class Registry:
    """Adapters by name; each format belongs to one."""

    def __init__(self) -> None:
        self._adapters: dict[str, Adapter] = {}

    def register(self, adapter: Adapter) -> None:
        for other in self._adapters.values():
            if other.name != adapter.name and (taken := other.formats & adapter.formats):
                raise ValueError(f"{sorted(taken)} belong to {other.name}")
        self._adapters[adapter.name] = adapter

    def unregister(self, name: str) -> None:
        self._adapters.pop(name, None)

    def find(self, fmt: str) -> Adapter:
        for adapter in self._adapters.values():
            if adapter.supports(fmt):
                return adapter
        raise KeyError(fmt)

    def dispatch(self, spark: SparkSession, fmt: str, source: str, target: str) -> DataFrame:
        """Reads a source; source and target must not lie in each other."""
        a, b = source.rstrip("/") + "/", target.rstrip("/") + "/"
        if a.startswith(b) or b.startswith(a):
            raise ValueError("source and target overlap")
        return self.find(fmt).migrate(spark, source)
