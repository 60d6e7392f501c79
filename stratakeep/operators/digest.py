"""State digests: SHA-256 leaves of values and roots over them in key order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical

EMPTY = "0" * 64


def leaves(state: DataFrame, raw: Column | None = None) -> DataFrame:
    """(key, leaf): hexadecimal SHA-256 of each value's bytes, by default its canonical encoding."""
    raw = canonical("value", state.schema["value"].dataType) if raw is None else raw
    return state.select("key", F.sha2(raw, 256).alias("leaf"))


def _chain(key: str) -> Column:
    return F.expr(f"sha2(listagg(concat(encode(`{key}`, 'UTF-8'), unhex(leaf))) WITHIN GROUP (ORDER BY `{key}`), 256)")


def root(leaf: DataFrame) -> DataFrame:
    """(root): SHA-256 over key and leaf bytes in bytewise key order; 64 zeros for no keys.

    One ordered aggregate in one task, for parity with digests of small stores; see :func:`tree_root`.
    """
    return leaf.agg(_chain("key").alias("root")).select(F.coalesce("root", F.lit(EMPTY)).alias("root"))


def buckets(leaf: DataFrame, count: int = 4096) -> DataFrame:
    """(bucket, leaf): the root of each hash bucket of keys, in parallel."""
    bucket = F.lpad(F.pmod(F.xxhash64("key"), F.lit(count)).cast("string"), 10, "0")
    return leaf.groupBy(bucket.alias("bucket")).agg(_chain("key").alias("leaf"))


def tree_root(leaf: DataFrame, count: int = 4096) -> DataFrame:
    """(root) of two levels, a root over bucket roots: only ``count`` rows reach one task.

    It differs from :func:`root` by construction and is compared with its like only.
    """
    return root(buckets(leaf, count).select(F.col("bucket").alias("key"), "leaf"))


def sized_root(leaf: DataFrame, few: int = 1 << 22, per_bucket: int = 1 << 16) -> DataFrame:
    """(root): :func:`root` of up to ``few`` keys, beyond that :func:`tree_root` with buckets as many as the keys ask for.

    Which one it is depends on the number of keys only, so equal states have equal roots.
    """
    n = leaf.count()
    return root(leaf) if n <= few else tree_root(leaf, -(-n // per_bucket))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, side) where two leaf sets differ: only in ``left``, only in ``right``, or ``changed``."""
    a = left.select(F.col("key").alias("_a"), F.col("leaf").alias("_la"))
    b = right.select(F.col("key").alias("_b"), F.col("leaf").alias("_lb"))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").when(F.col("_la") != F.col("_lb"), "changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias("key"), side.alias("side")).where("side is not null")
