"""Replicated commands and snapshots as JSON lines.

A command is ``{"op": "put" | "delete", "key": ..., "value": base64 bytes, "ttl": nanoseconds}``.
Unknown operations are ignored, as a state machine must do that is older than its log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.changelog import DELETE, PUT, change_log

SCHEMA = "op string, key string, value string, ttl long"


def parse(lines: DataFrame, pos: Column | str, applied_ns: Column | int, line: str = "line") -> DataFrame:
    """A change log with string values from a column of commands; expiry counts from ``applied_ns``."""
    applied = F.lit(applied_ns) if isinstance(applied_ns, int) else applied_ns
    c = F.from_json(line, SCHEMA)
    parsed = lines.withColumn("_c", c).where(F.col("_c.op").isin("put", "delete") & F.col("_c.key").isNotNull())
    put = F.col("_c.op") == "put"
    expiry = F.when(put & (F.col("_c.ttl") > 0), applied + F.col("_c.ttl")).otherwise(F.lit(0))
    text = F.when(put, F.decode(F.unbase64(F.coalesce("_c.value", F.lit(""))), "UTF-8"))
    return change_log(parsed, pos, F.col("_c.key"), text, type=F.when(put, PUT).otherwise(DELETE), expires_at_ns=expiry)


def malformed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that are no command object at all."""
    return lines.where(F.from_json(line, SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull() | F.col(line).isNull())


def snapshot(state: DataFrame, now_ns: int) -> DataFrame:
    """(line): a put command for each live key of a string-valued state, with what is left of its ttl."""
    left = F.when(F.col("expires_at_ns") > 0, F.col("expires_at_ns") - F.lit(now_ns)).otherwise(F.lit(0))
    return state.select(F.to_json(F.struct(F.lit("put").alias("op"), "key", F.base64(F.encode("value", "UTF-8")).alias("value"), left.alias("ttl"))).alias("line"))


def restore(lines: DataFrame, now_ns: int, pos: Column | None = None) -> DataFrame:
    """The change log of a snapshot's puts; replaying it after an older log overlays that."""
    return parse(lines, F.monotonically_increasing_id() if pos is None else pos, now_ns).where(F.col("type") == PUT)
