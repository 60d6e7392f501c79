"""Value de-duplication: the first put of a value holds it, later ones link to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .changelog import LINK, PUT
from .replay import visible


def link_duplicates(log: DataFrame) -> DataFrame:
    """Turn puts whose value an earlier put of the log holds into links to the first of them.

    Values are compared themselves, never by hash alone. The holders are one aggregate of (value,
    least position), joined back, so a value that a third of all entries share is no hot window.
    Puts inside transactions stay as they are: whether they become visible is not known here.
    """
    puts = (F.col("type") == PUT) & (F.col("tx_id") == 0)
    holder = log.where(puts & F.col("value").isNotNull()).groupBy(F.col("value").alias("_value")).agg(F.min("pos").alias("_first"))
    joined = log.join(holder, puts & (F.col("value") == F.col("_value")), "left")
    again = F.col("_first").isNotNull() & (F.col("pos") > F.col("_first"))
    return joined.select(
        "pos",
        F.when(again, LINK).otherwise(F.col("type")).cast("int").alias("type"),
        "tx_id",
        "key",
        F.when(~again, F.col("value")).alias("value"),
        F.when(again, F.col("_first")).otherwise(F.col("link_pos")).alias("link_pos"),
        "expires_at_ns",
    )


def resolve(entries: DataFrame, log: DataFrame, depth: int) -> DataFrame:
    """Fill the values of link entries by following ``link_pos`` in the log, ``depth`` hops at most.

    The expiry stays that of the linking entry. A chain that is longer, cyclic, or leads nowhere
    raises an error when the row is computed.
    """
    columns = entries.columns
    held = log.where(F.col("type").isin(PUT, LINK)).select(F.col("pos").alias("_pos"), F.col("type").alias("_type"), F.col("value").alias("_value"), F.col("link_pos").alias("_next"))
    plain = entries.where(F.col("type") != LINK)
    open_ = entries.where(F.col("type") == LINK)
    for _ in range(depth):
        open_ = open_.join(held, F.col("link_pos") == F.col("_pos"), "left")
        bad = F.col("_pos").isNull()
        kind = F.when(bad, F.raise_error(F.concat(F.lit("link leads nowhere, at "), F.col("pos").cast("string"))).cast("int")).when(F.col("type") == LINK, F.col("_type")).otherwise(F.col("type"))
        fresh = F.when(F.col("type") == LINK, F.col("_value")).otherwise(F.col("value"))
        open_ = open_.select(*[kind.alias("type") if c == "type" else fresh.alias("value") if c == "value" else F.coalesce("_next", "link_pos").alias("link_pos") if c == "link_pos" else F.col(c) for c in columns])
    # the errors hang on the value, which no projection that reads it can prune
    endless = F.raise_error(F.concat(F.lit("link chain too long or cyclic, at "), F.col("pos").cast("string")))
    value = F.when(F.col("type") == LINK, endless).otherwise(F.col("value"))
    return plain.unionByName(open_.withColumn("value", value))


def broken_links(log: DataFrame) -> DataFrame:
    """(pos, link_pos) of visible links whose target was not visible when they took effect.

    A target of the same transaction counts, whatever the order; expired or overwritten targets count too.
    """
    seen = visible(log)
    held = seen.where(F.col("type").isin(PUT, LINK)).select(F.col("pos").alias("_pos"), F.col("eff").alias("_eff"))
    links = seen.where(F.col("type") == LINK).join(held, F.col("link_pos") == F.col("_pos"), "left")
    return links.where(F.col("_eff").isNull() | (F.col("_eff") > F.col("eff")) | ((F.col("_eff") == F.col("eff")) & (F.col("tx_id") == 0))).select("pos", "link_pos")


def link_stats(log: DataFrame) -> DataFrame:
    """(puts, links, distinct_values) of a log after :func:`link_duplicates`."""
    return log.agg(F.count(F.when(F.col("type") == PUT, 1)).alias("puts"), F.count(F.when(F.col("type") == LINK, 1)).alias("links"), F.countDistinct("value").alias("distinct_values"))
