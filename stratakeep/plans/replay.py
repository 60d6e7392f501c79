"""Replay of a change log to its current state.

An entry outside transactions takes effect at its own position. An entry of a transaction takes
effect at the first terminator of its id that follows it, if that is a commit; a rollback discards
it, and without terminator it never happened. Of a key's visible entries the last in order of
(effect, position) counts; only then is its expiry looked at, so an expired newest value hides
older ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import live
from .changelog import COMMIT, DELETE, LINK, ROLLBACK, is_data


#: A transaction of more entries than this is worked on in slices of about as many.
LONG_TRANSACTION = 1 << 22


def visible(log: DataFrame, transactions: bool = True) -> DataFrame:
    """Data entries that take effect, with ``eff``, the position where they do.

    Only entries of transactions are windowed; those without go straight through and cost no shuffle.
    ``transactions``: whether the log has any; one known to have none is read once only.
    """
    direct = log.where(is_data() & (F.col("tx_id") == 0)).withColumn("eff", F.col("pos"))
    if not transactions:
        return direct
    staged = _ended(log.where("tx_id <> 0"))
    staged = staged.where(is_data() & (F.col("_end.type") == COMMIT)).withColumn("eff", F.col("_end.pos")).select(*direct.columns)
    return direct.unionByName(staged)


def _ended(staged: DataFrame) -> DataFrame:
    """The entries with ``_end``, the position and type of the next terminator of their transaction, null if there is none.

    The window runs backwards, so its frame only ever grows. A long transaction is dealt to slices of equal ranges of
    positions, and a slice that ends without terminator takes the first one of the later slices. Both tables that are
    broadcast for this have less than two rows for LONG_TRANSACTION entries of the log: for 10^12 entries some 30 MB.
    """
    end = F.when(F.col("type").isin(COMMIT, ROLLBACK), F.struct("pos", "type"))
    sizes = staged.groupBy(F.col("tx_id").alias("_tx")).agg(F.count("*").alias("_n"), F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    slices = F.ceil(F.col("_n") / LONG_TRANSACTION)
    long_ = sizes.where(F.col("_n") > LONG_TRANSACTION).select("_tx", "_lo", (F.expr("(_hi - _lo)").cast("double") / slices + 1).cast("long").alias("_width"))
    slice_ = F.expr("(pos - _lo) div _width")

    parts = staged.join(F.broadcast(long_), F.col("tx_id") == F.col("_tx")).groupBy("_tx", slice_.alias("_part")).agg(F.min(end).alias("_first"))
    behind = Window.partitionBy("_tx").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(F.col("_tx").alias("_of"), "_part", F.last("_first", ignorenulls=True).over(behind).alias("_carried"))

    later = Window.partitionBy("tx_id", "_slice").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    dealt = staged.join(F.broadcast(long_), F.col("tx_id") == F.col("_tx"), "left").withColumn("_slice", F.coalesce(slice_, F.lit(-1)))
    dealt = dealt.withColumn("_own", F.last(end, ignorenulls=True).over(later))
    dealt = dealt.join(F.broadcast(carried), (F.col("tx_id") == F.col("_of")) & (F.col("_slice") == F.col("_part")), "left")
    return dealt.withColumn("_end", F.coalesce("_own", "_carried"))


def latest(log: DataFrame, transactions: bool = True) -> DataFrame:
    """The entry of each key that counts, deletes included; one partial aggregate before the shuffle."""
    entry = F.struct("pos", "type", "value", "link_pos", "expires_at_ns")
    return visible(log, transactions).groupBy("key").agg(F.max_by(entry, F.struct("eff", "pos")).alias("_e")).select("key", "_e.*")


def latest_over(base: DataFrame, tail: DataFrame, transactions: bool = True) -> DataFrame:
    """:func:`latest` of a compacted log and the entries behind it; only the tail is aggregated.

    A compacted log has one plain put a key, and every entry of the tail comes later, so the
    base's entry counts for the keys that the tail does not touch. A small tail is joined by broadcast.
    """
    now = latest(tail, transactions)
    touched = now.select(F.col("key").alias("_touched"))
    return base.join(touched, F.col("key") == F.col("_touched"), "left_anti").select(*now.columns).unionByName(now)


def state(log: DataFrame, now_ns: int, include_expired: bool = False, link_depth: int = 0, transactions: bool = True) -> DataFrame:
    """(key, value, expires_at_ns, pos) of the live keys at ``now_ns``.

    ``link_depth``: links of up to so many hops are followed to their values; 0 for logs without links.
    ``include_expired`` keeps values whose time is over but which nothing has overwritten.
    """
    return settled(latest(log, transactions), log, now_ns, include_expired, link_depth)


def settled(entries: DataFrame, log: DataFrame, now_ns: int, include_expired: bool = False, link_depth: int = 0) -> DataFrame:
    """The state that the entries which count make; links lead into ``log``."""
    current = entries.where(F.col("type") != DELETE)
    if not include_expired:
        current = current.where(live("expires_at_ns", now_ns))
    if link_depth:
        from .links import resolve

        current = resolve(current, log, link_depth)
    return current.select("key", "value", "expires_at_ns", "pos")


def compacted(log: DataFrame, link_depth: int = 0, transactions: bool = True) -> DataFrame:
    """The log that a compaction leaves: one plain put for each key that is not deleted.

    Expired entries stay, since an older snapshot clock may still see them; positions and expiries
    are kept and links are replaced by their values.
    """
    kept = state(log, 0, include_expired=True, link_depth=link_depth, transactions=transactions)
    return kept.select("pos", F.lit(0).alias("type"), F.lit(0).cast("long").alias("tx_id"), "key", "value", F.lit(None).cast("long").alias("link_pos"), "expires_at_ns")


def reclaim(log: DataFrame, size, transactions: bool = True) -> DataFrame:
    """(entries, kept, dead, bytes, kept_bytes, dead_bytes) that a compaction would find.

    ``size`` is a column expression over the log, an entry's bytes.
    """
    marked = log.withColumn("_size", size)
    kept = latest(log, transactions).where(F.col("type") != DELETE).select(F.col("pos").alias("_p"))
    sums = marked.join(kept, F.col("pos") == F.col("_p"), "left").agg(
        F.count("*").alias("entries"), F.count("_p").alias("kept"), F.coalesce(F.sum("_size"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum(F.when(F.col("_p").isNotNull(), F.col("_size"))), F.lit(0)).cast("long").alias("kept_bytes")
    )
    return sums.select("entries", "kept", (F.col("entries") - F.col("kept")).alias("dead"), "bytes", "kept_bytes", (F.col("bytes") - F.col("kept_bytes")).alias("dead_bytes"))


__all__ = ["LINK", "compacted", "latest", "latest_over", "reclaim", "settled", "state", "visible"]
