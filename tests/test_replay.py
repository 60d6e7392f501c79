"""Replay rules on random logs against a sequential reading of them, and the named scenarios."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratakeep.plans import replay
from stratakeep.plans.changelog import COMMIT, DELETE, LINK, PUT, ROLLBACK, log_schema, violations
from stratakeep.plans.links import broken_links, link_duplicates
from stratakeep.plans.replay import compacted, state
from pyspark.sql import types as T

SCHEMA = log_schema(T.StringType())


def log_of(spark, entries):
    """entries: (type, tx, key, value, expires or link)"""
    rows = []
    for pos, (type_, tx, key, value, extra) in enumerate(entries):
        rows.append((pos, type_, tx, key, value, extra if type_ == LINK else None, extra if type_ != LINK else 0))
    return spark.createDataFrame(rows, SCHEMA)


def sequential(entries, now):
    live, pending = {}, {}

    def apply(op):
        type_, _, key, value, expires = op
        if type_ == DELETE or (expires and now >= expires):
            live.pop(key, None)
        else:
            live[key] = value

    for op in entries:
        type_, tx = op[:2]
        if type_ in (PUT, DELETE):
            pending.setdefault(tx, []).append(op) if tx else apply(op)
        elif type_ == COMMIT:
            for x in pending.pop(tx, []):
                apply(x)
        else:
            pending.pop(tx, None)
    return live


def read(df):
    return {r["key"]: r["value"] for r in df.collect()}


@pytest.mark.parametrize("seed", range(8))
def test_random_logs(spark, monkeypatch, seed):
    monkeypatch.setattr(replay, "LONG_TRANSACTION", (1 << 22, 7, 60, 1)[seed % 4])  # of about 40 entries
    r = random.Random(seed)
    entries = []
    for i in range(300):
        tx = r.choice([0, 0, 1, 2, 3, 4])
        type_ = r.choice([PUT, PUT, PUT, DELETE, COMMIT, ROLLBACK]) if tx else r.choice([PUT, PUT, DELETE])
        entries.append((type_, tx, f"k{r.randrange(25)}" if type_ in (PUT, DELETE) else "", f"v{i}" if type_ == PUT else None, r.choice([0, 0, 50, 150]) if type_ == PUT else 0))
    log = log_of(spark, entries).repartition(3, "key")
    assert read(state(log, 100)) == sequential(entries, 100)
    assert read(state(compacted(log), 100)) == sequential(entries, 100)
    assert read(state(compacted(log), 10)) == sequential(entries, 10)


def test_commit_order_and_unfinished_transactions(spark):
    entries = [(PUT, 0, "a", "base", 0), (PUT, 10, "a", "committed", 0), (PUT, 0, "a", "between", 0), (COMMIT, 10, "", None, 0), (PUT, 11, "a", "open", 0), (DELETE, 12, "a", None, 0), (PUT, 20, "b", "x", 0), (ROLLBACK, 20, "", None, 0)]
    assert read(state(log_of(spark, entries), 0)) == {"a": "committed"}


def test_expired_newest_hides_old_and_boundary_is_inclusive(spark):
    log = log_of(spark, [(PUT, 0, "a", "old", 0), (PUT, 0, "a", "new", 15), (PUT, 0, "b", "x", 20)])
    assert read(state(log, 15)) == {"b": "x"}
    assert read(state(log, 14)) == {"a": "new", "b": "x"}
    assert read(state(log, 99, include_expired=True)) == {"a": "new", "b": "x"}


@pytest.mark.parametrize("ends", [(COMMIT,), (ROLLBACK,), (), (COMMIT, ROLLBACK)])
def test_a_long_transaction_is_sliced(spark, monkeypatch, ends):
    monkeypatch.setattr(replay, "LONG_TRANSACTION", 10)
    entries = [(PUT, 5, f"k{i}", "v", 0) for i in range(95)] + [(e, 5, "", None, 0) for e in ends] + [(PUT, 0, "other", "v", 0)]
    assert read(state(log_of(spark, entries), 0)) == sequential(entries, 0)
    slices = replay._ended(log_of(spark, entries).where("tx_id <> 0")).groupBy("_slice").count().collect()
    assert len(slices) == 10 and max(s["count"] for s in slices) <= 11


def test_empty_log(spark):
    assert read(state(log_of(spark, []), 0)) == {}


def test_links_keep_their_own_expiry(spark):
    log = link_duplicates(log_of(spark, [(PUT, 0, "short", "same", 15), (PUT, 0, "forever", "same", 0)]))
    assert read(state(log, 20, link_depth=1)) == {"forever": "same"}


def test_bad_links(spark):
    log = log_of(spark, [(PUT, 0, "a", "x", 0), (LINK, 0, "b", None, 7), (LINK, 0, "c", None, 3), (LINK, 0, "d", None, 2)])
    assert {r["pos"] for r in broken_links(log).collect()} == {1, 2}
    with pytest.raises(PySparkException, match="nowhere"):
        state(log.where("key = 'b'").unionByName(log.where("key = 'a'")), 0, link_depth=2).collect()
    with pytest.raises(PySparkException, match="cyclic"):
        state(log.where("key in ('c', 'd')"), 0, link_depth=3).collect()


def test_violations(spark):
    log = log_of(spark, [(COMMIT, 0, "", None, 0), (ROLLBACK, 0, "", None, 0), (9, 0, "a", None, 0), (LINK, 0, "a", None, None), (PUT, 0, None, "v", 0), (PUT, 0, "", "v", 0)])
    assert sorted(r["pos"] for r in violations(log).collect()) == [0, 1, 2, 3, 4]
    assert log.where(F.col("key") == "").count() == 3
