"""The change log: one row an entry, totally ordered by ``pos``.

Columns: ``pos`` long, ``type`` int, ``tx_id`` long (0: takes effect at once), ``key`` string,
``value`` of any one type, ``link_pos`` long (position of the entry that holds a link's value),
``expires_at_ns`` long (0: never).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Entry types of the log.
PUT, DELETE, COMMIT, ROLLBACK, LINK = 0, 1, 2, 3, 4
COLUMNS = ("pos", "type", "tx_id", "key", "value", "link_pos", "expires_at_ns")


def log_schema(value: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("pos", T.LongType()),
            T.StructField("type", T.IntegerType()),
            T.StructField("tx_id", T.LongType()),
            T.StructField("key", T.StringType()),
            T.StructField("value", value),
            T.StructField("link_pos", T.LongType()),
            T.StructField("expires_at_ns", T.LongType()),
        ]
    )


def change_log(df: DataFrame, pos, key, value, type=None, tx_id=None, link_pos=None, expires_at_ns=None) -> DataFrame:
    """A change log from any DataFrame; arguments are columns or names, left out ones take neutral values."""

    def pick(c, kind, default):
        c = F.lit(default) if c is None else F.col(c) if isinstance(c, str) else c
        return c.cast(kind) if kind else c

    return df.select(
        pick(pos, "long", None).alias("pos"),
        pick(type, "int", PUT).alias("type"),
        pick(tx_id, "long", 0).alias("tx_id"),
        pick(key, "string", None).alias("key"),
        pick(value, None, None).alias("value"),
        pick(link_pos, "long", None).alias("link_pos"),
        pick(expires_at_ns, "long", 0).alias("expires_at_ns"),
    )


def is_data(type_: Column | str = "type") -> Column:
    type_ = F.col(type_) if isinstance(type_, str) else type_
    return type_.isin(PUT, DELETE, LINK)


def violations(log: DataFrame) -> DataFrame:
    """(pos, rule) of each entry that breaks a rule which one row shows; a sound log gives no rows."""
    type_, tx = F.col("type"), F.col("tx_id")
    rule = (
        F.when(type_.isNull() | ~type_.isin(PUT, DELETE, COMMIT, ROLLBACK, LINK), "unknown entry type")
        .when((type_ == COMMIT) & (tx == 0), "commit marker without transaction")
        .when((type_ == ROLLBACK) & (tx == 0), "rollback marker without transaction")
        .when((type_ == LINK) & F.col("link_pos").isNull(), "link without target")
        .when(is_data() & F.col("key").isNull(), "data entry without key")
    )
    return log.select("pos", rule.alias("rule")).where("rule is not null")


def next_transaction_id(log: DataFrame, clock_ns: int = 0) -> DataFrame:
    """(next_tx_id): above every id in the log and above the clock."""
    return log.agg((F.greatest(F.coalesce(F.max("tx_id"), F.lit(0)), F.lit(clock_ns)) + 1).cast("long").alias("next_tx_id"))


def segment_stats(log: DataFrame) -> DataFrame:
    """(segment, entries, first_pos, last_pos, active): the highest segment is the active one."""
    from pyspark.sql import Window

    from ..functions import position_segment

    s = log.groupBy(position_segment("pos").alias("segment")).agg(F.count("*").alias("entries"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return s.withColumn("active", F.col("segment") == F.max("segment").over(Window.partitionBy()))


def entry_at(log: DataFrame, pos: int) -> DataFrame:
    """The entry at a position, none if there is none; the filter reaches the scan."""
    return log.where(F.col("pos") == pos)


def segment(log: DataFrame, number: int) -> DataFrame:
    """The entries of one segment in order of position; a range of positions, which prunes row groups."""
    return log.where((F.col("pos") >= number << 32) & (F.col("pos") < (number + 1) << 32)).orderBy("pos")
