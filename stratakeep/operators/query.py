"""Point, index and full-scan queries with a fluent result.

Steps apply in call order, as they are written: ``limit(10).offset(5)`` skips five of the ten rows,
and sorting after a limit sorts what the limit left. Each call adds to one logical plan; nothing
runs before rows are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import KeyNotFound


def predicate(f: Callable[..., pd.Series], *columns: Column | str) -> Column:
    """A condition out of a Python function over pandas Series (DataFrames for structs), an Arrow batch at a time.

    For what expressions cannot say; it goes wherever a condition does (filters, requirements, conditional writes). Nothing
    of it reaches the scan, so put expressions in a filter of their own before it. A null counts as false.
    """

    def run(*batch: pd.Series) -> pd.Series:
        return f(*batch).astype("boolean").fillna(False).astype(bool)

    return F.pandas_udf(run, "boolean")(*columns)


class Result:
    """An immutable chain of steps over a DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = df

    def filter(self, condition: Column | str) -> Result:
        """Keep rows for which the condition is true; null drops a row."""
        return Result(self.df.where(condition))

    def sort(self, *by: Column | str, tiebreak: str | None = "key") -> Result:
        """Order the rows; ``tiebreak`` is appended where the column exists, so that ties are stable."""
        extra = [tiebreak] if tiebreak and tiebreak in self.df.columns else []
        return Result(self.df.orderBy(*by, *extra))

    def limit(self, n: int) -> Result:
        if n < 0:
            raise ValueError("limit is negative")
        return Result(self.df.limit(n))

    def offset(self, n: int) -> Result:
        """Skip n rows; past the end nothing is left."""
        if n < 0:
            raise ValueError("offset is negative")
        return Result(self.df.offset(n))

    def select(self, *columns: Column | str) -> Result:
        return Result(self.df.select(*columns))

    def all(self) -> list[Row]:
        return self.df.collect()

    def __iter__(self) -> Iterator[Row]:
        return self.df.toLocalIterator()


class Indexes:
    """Named equality indexes: each is an expression over the value, read as a string.

    An index is a view of the state: it is complete at any time, and stale entries cannot occur.
    Adding a name again replaces its expression.
    """

    def __init__(self):
        self.extractors: dict[str, Column] = {}

    def add(self, name: str, extractor: Column | str) -> None:
        self.extractors[name] = F.expr(extractor) if isinstance(extractor, str) else extractor

    def names(self) -> list[str]:
        return sorted(self.extractors)

    def lookup(self, state: DataFrame, name: str, value: str) -> Result:
        """Live rows whose indexed value equals ``value``; an unknown index or value gives none."""
        if name not in self.extractors:
            return Result(state.where(F.lit(False)))
        return Result(state.where(self.extractors[name].cast("string") == value))

    def inverted(self, state: DataFrame, name: str) -> DataFrame:
        """(index_value, key): the inverted index as rows; no key set is gathered."""
        return state.select(self.extractors[name].cast("string").alias("index_value"), "key")


def get(state: DataFrame, key: str) -> DataFrame:
    """The row of one key, or no row. On a replayed log the filter reaches the scan below the aggregate."""
    return state.where(F.col("key") == key)


def get_value(state: DataFrame, key: str) -> Row:
    found = get(state, key).take(1)
    if not found:
        raise KeyNotFound(key)
    return found[0]


def multi_get(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of all given keys by one semi join; missing ones are left out."""
    return state.join(keys.select("key").distinct(), "key", "left_semi")


def keys(state: DataFrame) -> DataFrame:
    return state.select("key")


def for_each(state: DataFrame, f: Callable[[str, object], bool | None]) -> None:
    """Call ``f(key, value)`` for each live row on the driver, a partition at a time; an exception or False stops it."""
    for row in state.select("key", "value").toLocalIterator():
        if f(row["key"], row["value"]) is False:
            return


def scan(state: DataFrame, where: Iterable[Column | str] = ()) -> Result:
    for condition in where:
        state = state.where(condition)
    return Result(state)
