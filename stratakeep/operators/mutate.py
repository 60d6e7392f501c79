"""Conditional writes as set operations.

A batch has one row a key: (key, value, expires_at_ns). Conditions see ``current`` (the live value,
null if there is none) and ``found`` (whether there is one; expired counts as missing). Every function returns
the batch with ``applied``, so that refused rows are seen; :func:`accepted` makes log entries of the
rest. Where a batch holds several operations on one key, :func:`fold` applies them in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidCondition
from ..plans.changelog import DELETE, PUT


def against(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch with ``current`` and ``found`` of each key, by one left join."""
    now = state.select(F.col("key").alias("_key"), F.col("value").alias("current"))
    joined = batch.join(now, F.col("key") == F.col("_key"), "left")
    return joined.withColumn("found", F.col("_key").isNotNull()).drop("_key")


def apply_if(state: DataFrame, batch: DataFrame, condition: Column | str | None) -> DataFrame:
    """Batch rows with ``applied``: whether the condition on (current, found, and the batch's columns) is true."""
    if condition is None:
        raise InvalidCondition("a condition is needed")
    condition = F.expr(condition) if isinstance(condition, str) else condition
    out = against(state, batch)
    return out.withColumn("applied", F.coalesce(condition, F.lit(False)))


put_if = delete_if = apply_if


def put_if_absent(state: DataFrame, batch: DataFrame) -> DataFrame:
    return apply_if(state, batch, ~F.col("found"))


def accepted(outcome: DataFrame, pos: Column, delete: bool = False, tx_id: int = 0) -> DataFrame:
    """Log entries of the applied rows at the given positions."""
    done = outcome.where("applied")
    value = F.when(F.lit(not delete), F.col("value")) if "value" in done.columns else F.lit(None)
    expiry = F.col("expires_at_ns") if "expires_at_ns" in done.columns and not delete else F.lit(0).cast("long")
    return done.select(pos.cast("long").alias("pos"), F.lit(DELETE if delete else PUT).alias("type"), F.lit(tx_id).cast("long").alias("tx_id"), "key", value.alias("value"), F.lit(None).cast("long").alias("link_pos"), expiry.alias("expires_at_ns"))


def require(state: DataFrame, requirements: DataFrame, condition: Column | str) -> DataFrame:
    """(tx, holds) for requirements (tx, key, ...): all of a transaction's must be true of the committed state."""
    judged = apply_if(state, requirements, condition)
    return judged.groupBy("tx").agg(F.min("applied").alias("holds"))


def guarded(state: DataFrame, operations: DataFrame, requirements: DataFrame, condition: Column | str) -> DataFrame:
    """Operations (tx, ...) of the transactions whose requirements hold; one without requirements passes."""
    failed = require(state, requirements, condition).where(~F.col("holds")).select("tx")
    return operations.join(failed, "tx", "left_anti")


def fold(operations: DataFrame, order: str, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, result): operations of each key applied one after the other in order.

    ``step(accumulated, operation)`` is an expression over structs. Outcomes of one key depend on
    each other, so the operations of a key are gathered in one array: a key's batch must fit there.
    """
    fields = [order, *[c for c in operations.columns if c not in ("key", order)]]
    gathered = operations.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_ops"))
    return gathered.select("key", F.aggregate("_ops", start, step).alias("result"))
