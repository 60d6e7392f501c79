"""Thin faces of a store for code that expects a cache, a plain key-value store or a write batch."""

from __future__ import annotations

from ..errors import KeyNotFound
from .store import Store


class Cache:
    """get, set, delete; values never expire."""

    def __init__(self, store: Store):
        self._store = store

    def get(self, key: str):
        return self._store.get(key)

    def set(self, key: str, value) -> None:
        self._store.put(key, value)

    def delete(self, key: str) -> None:
        self._store.delete(key)


class KeyValue(Cache):
    """``get`` tells a missing key by its second result; other errors are raised."""

    def get(self, key: str):
        try:
            return self._store.get(key), True
        except KeyNotFound:
            return None, False

    def keys(self) -> list[str]:
        return [r["key"] for r in self._store.keys().orderBy("key").toLocalIterator()]

    def batch(self) -> Batch:
        return Batch(self._store)


class Batch:
    """Writes that become visible together on commit."""

    def __init__(self, store: Store):
        self._tx = store.begin()

    def set(self, key: str, value) -> None:
        self._tx.put(key, value)

    def delete(self, key: str) -> None:
        self._tx.delete(key)

    def commit(self) -> int:
        return self._tx.commit()
