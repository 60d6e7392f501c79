"""A Bloom filter as a table of 64-bit words, built and probed by built-in functions.

Its size is fixed by ``slots``; deletes do not clear bits, so a filter is rebuilt, not updated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS, PROBES = 1 << 20, 7


def _places(key: Column | str, slots: int, probes: int) -> Column:
    if slots <= 0:
        raise ValueError("a filter needs at least one slot")
    a, b = F.pmod(F.xxhash64(F.lit("a"), key), F.lit(slots)), F.pmod(F.xxhash64(F.lit("b"), key), F.lit(slots))
    return F.array(*[F.pmod(a + i * b, F.lit(slots)) for i in range(max(1, probes))])


def build(keys: DataFrame, slots: int = SLOTS, probes: int = PROBES) -> DataFrame:
    """(word, bits): at most slots / 64 rows, combined before the shuffle."""
    place = keys.select(F.explode(_places("key", slots, probes)).alias("p"))
    return place.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))


def might_contain(keys: DataFrame, bloom: DataFrame, slots: int = SLOTS, probes: int = PROBES) -> DataFrame:
    """(key, might_contain) of each given key; false only for keys that were never added.

    The filter's words are joined by broadcast; their number is bounded by ``slots``.
    """
    probe = keys.select("key").distinct().withColumn("p", F.explode(F.array_distinct(_places("key", slots, probes))))
    hit = probe.join(F.broadcast(bloom), F.shiftright("p", 6) == F.col("word"), "left")
    bit = F.coalesce(F.expr("shiftright(bits, cast(p % 64 as int)) & 1"), F.lit(0))
    return hit.groupBy("key").agg((F.min(bit) == 1).alias("might_contain"))
