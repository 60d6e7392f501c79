"""Column functions shared by plans and operators; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pack_position(segment: Column | str, offset: Column | str) -> Column:
    """One long that orders by segment, then offset: segment in the high 32 bits."""
    return F.shiftleft(_col(segment).cast("long"), 32).bitwiseOR(_col(offset).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def position_segment(pos: Column | str) -> Column:
    return F.shiftrightunsigned(_col(pos), 32)


def position_offset(pos: Column | str) -> Column:
    return _col(pos).bitwiseAND(F.lit(0xFFFFFFFF))


def expires_at(now_ns: int, ttl_ns: Column | int) -> Column:
    """Expiry of a write: now + ttl, or 0 (never) for a ttl that is not positive."""
    ttl = F.lit(ttl_ns) if isinstance(ttl_ns, int) else ttl_ns
    return F.when(ttl > 0, F.lit(now_ns) + ttl).otherwise(F.lit(0)).cast("long")


def expired(expires: Column | str, now_ns: int) -> Column:
    """Inclusive: a value is gone at the very instant of its expiry."""
    return (_col(expires) > 0) & (F.lit(now_ns) >= _col(expires))


def live(expires: Column | str, now_ns: int) -> Column:
    return ~expired(expires, now_ns)


def canonical(value: Column | str, kind: T.DataType) -> Column:
    """Bytes of a value for digests: strings as UTF-8, binary as is, structs as their fields, each behind its length.

    A field's length is in bytes and ends with ``:``; a null field is ``-``, so that no two structs share their bytes.
    """
    value = _col(value)
    if isinstance(kind, T.BinaryType):
        return value
    if isinstance(kind, T.StructType):
        text = [value[f.name].cast("string") for f in kind.fields]
        parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]
        return F.encode(F.concat(*parts), "UTF-8")
    return F.encode(F.coalesce(value.cast("string"), F.lit("")), "UTF-8")
