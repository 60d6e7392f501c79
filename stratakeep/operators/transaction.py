"""Buffered transactions with requirements, committed as one version of a store."""

from __future__ import annotations

from pyspark.sql import Column, Row
from pyspark.sql import functions as F

from ..errors import ConditionFailed, InvalidCondition, KeyNotFound, TransactionDone, VersionConflict
from ..plans.changelog import DELETE, PUT


class Transaction:
    """Operations are buffered; reads see the buffer first, then committed state (read-committed).

    ``commit`` checks every requirement against the committed state it builds upon and publishes
    all operations as one version, or nothing. If another writer publishes first, requirements are
    checked again on the newer state. A failed requirement ends the transaction.
    """

    def __init__(self, store, attempts: int = 16):
        self._store, self._attempts = store, attempts
        self._ops: list[tuple[int, str, object, int]] = []
        self._requirements: list[tuple[str, Column]] = []
        self._done = False

    def _open(self) -> None:
        if self._done:
            raise TransactionDone("the transaction is over")

    def get(self, key: str):
        """The newest buffered value (its ttl does not apply yet), or the committed one."""
        self._open()
        for type_, k, value, _ in reversed(self._ops):
            if k == key:
                if type_ == DELETE:
                    raise KeyNotFound(key)
                return value
        return self._store.get(key)

    def put(self, key: str, value, ttl_ns: int = 0) -> None:
        self._open()
        self._ops.append((PUT, key, value, ttl_ns))

    def delete(self, key: str) -> None:
        self._open()
        self._ops.append((DELETE, key, None, 0))

    def require(self, key: str, condition: Column | str | None) -> None:
        """``condition`` is an expression over ``current`` and ``found``."""
        self._open()
        if condition is None:
            raise InvalidCondition("a condition is needed")
        self._requirements.append((key, F.expr(condition) if isinstance(condition, str) else condition))

    def rollback(self) -> None:
        """Forget the buffer; nothing is written."""
        self._open()
        self._done = True

    def _check(self, now_ns: int) -> None:
        names = sorted({k for k, _ in self._requirements})
        if not names:
            return
        spark, state = self._store.spark, self._store.state(now_ns)
        wanted = spark.createDataFrame([Row(key=k) for k in names], "key string")
        now = state.join(wanted, "key", "left_semi").select(F.col("key").alias("_key"), F.col("value").alias("current"))
        rows = wanted.join(now, F.col("key") == F.col("_key"), "left").withColumn("found", F.col("_key").isNotNull())
        tests = [F.min(F.when(F.col("key") == k, F.coalesce(c, F.lit(False))).otherwise(True)).alias(f"c{i}") for i, (k, c) in enumerate(self._requirements)]
        held = rows.agg(*tests).first()
        for (key, _), ok in zip(self._requirements, held):
            if not ok:
                self._done = True
                raise ConditionFailed(key)

    def commit(self) -> int:
        """Publish; returns the version. Expiry counts from now, the time of commit."""
        self._open()
        for attempt in range(self._attempts):
            now, base = self._store.clock(), self._store.refresh()
            self._check(now)
            if not self._ops:
                self._done = True
                return base
            try:
                version = self._store._append_rows(self._ops, now, base)
            except VersionConflict:
                if attempt + 1 == self._attempts:
                    raise
                continue
            self._done = True
            return version
        raise VersionConflict("no attempt is left")
