"""A log of numbered entries and named settings over a keyed store, as consensus libraries want it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import KeyNotFound
from .store import Store

_ENTRY, _SETTING = "log:", "meta:"


def bounds(entries: DataFrame, index: str = "index") -> DataFrame:
    """(first_index, last_index) of entries; 0 and 0 for none."""
    return entries.agg(F.coalesce(F.min(index), F.lit(0)).cast("long").alias("first_index"), F.coalesce(F.max(index), F.lit(0)).cast("long").alias("last_index"))


def without_range(entries: DataFrame, low: int, high: int, index: str = "index") -> DataFrame:
    """Entries outside low..high, both ends included."""
    return entries.where(~F.col(index).between(low, high))


class IndexedLog:
    """Entries keep a fixed-width key, so key order is index order."""

    def __init__(self, store: Store):
        self.store = store

    @staticmethod
    def _key(index: int) -> str:
        return f"{_ENTRY}{index:020d}"

    def entries(self) -> DataFrame:
        """(index, value)."""
        own = self.store.state().where(F.startswith("key", F.lit(_ENTRY)))
        return own.select(F.substring("key", len(_ENTRY) + 1, 20).cast("long").alias("index"), "value")

    def bounds(self) -> tuple[int, int]:
        return tuple(bounds(self.entries()).first())

    def get(self, index: int):
        return self.store.get(self._key(index))

    def append(self, entries: dict[int, object]) -> None:
        """All entries or none; an index that exists is overwritten."""
        tx = self.store.begin()
        for index, value in entries.items():
            tx.put(self._key(index), value)
        tx.commit()

    def delete_range(self, low: int, high: int) -> None:
        doomed = self.entries().where(F.col("index").between(low, high)).select(F.concat(F.lit(_ENTRY), F.lpad(F.col("index").cast("string"), 20, "0")).alias("key"))
        self.store.write(doomed, delete=True)

    def set(self, name: str, value) -> None:
        self.store.put(_SETTING + name, value)

    def setting(self, name: str, default=None):
        try:
            return self.store.get(_SETTING + name)
        except KeyNotFound:
            return default


__all__ = ["IndexedLog", "bounds", "without_range"]
