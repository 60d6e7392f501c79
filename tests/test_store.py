"""The store: versions, conditions, transactions, expiry, compaction, integrity, ingest, adapters, commands."""

import io
import os
import threading

import pytest
from pyspark.sql import functions as F

from stratakeep.cli import run
from stratakeep.errors import Closed, ConditionFailed, Corrupt, DirectoryLocked, InvalidCondition, KeyExists, KeyNotFound, TransactionDone, VersionNotFound
from stratakeep.operators.query import predicate
from stratakeep.sources.adapters import KeyValue
from stratakeep.sources.commands import malformed, parse
from stratakeep.sources.indexed_log import IndexedLog
from stratakeep.sources.store import Store
from stratakeep.streaming import ingest


class Clock:
    def __init__(self):
        self.now = 1000

    def __call__(self):
        return self.now


@pytest.fixture
def store(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), "city string, version int", clock=Clock()) as s:
        yield s


@pytest.fixture
def text(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "t"), clock=Clock()) as s:
        yield s


def test_put_get_delete_and_reopen(spark, store):
    store.put("a", ("Rome", 1))
    store.put("a", ("Turin", 2))
    store.delete("never there")
    assert tuple(store.get("a")) == ("Turin", 2)
    other = Store.open(spark, store.files.root, "city string, version int", readonly=True)
    assert tuple(other.get("a")) == ("Turin", 2)
    store.delete("a")
    with pytest.raises(KeyNotFound):
        store.get("a")
    assert other.state(version=2).count() == 1  # an older version stays readable


def test_index_follows_updates(store):
    store.add_index("city", "value.city")
    store.put("a", ("Rome", 1))
    store.put("b", ("Rome", 1))
    store.put("a", ("Turin", 2))
    assert [r["key"] for r in store.get_by_index("city", "Rome").sort("key", tiebreak=None).all()] == ["b"]
    assert store.get_by_index("city", "Oslo").all() == store.get_by_index("none", "x").all() == []


def test_ttl(text):
    text.put("a", "old")
    text.put("a", "new", ttl_ns=10)
    text.clock.now = 1009
    assert text.get("a") == "new"
    text.clock.now = 1010
    with pytest.raises(KeyNotFound):
        text.get("a")
    text.put_if_absent("a", "again")
    assert text.get("a") == "again"


def test_conditions_write_all_or_nothing(store):
    store.put_if_absent("a", ("Rome", 1))
    before = store.version
    with pytest.raises(KeyExists):
        store.put_if_absent("a", ("Oslo", 1))
    with pytest.raises(ConditionFailed):
        store.put_if("a", ("Oslo", 3), "current.version = 2")
    with pytest.raises(InvalidCondition):
        store.put_if("a", ("Oslo", 3), None)
    assert store.version == before
    store.put_if("a", ("Oslo", 2), "found and current.version = 1")
    store.delete_if("a", "current.version = 2")
    store.delete_if("missing", "not found")
    assert store.keys().count() == 0


def test_python_predicates(store):
    for i, city in enumerate(["Turin", None, "Rome", "Trento"]):
        store.put(f"k{i}", (city, i))
    starts = predicate(lambda v: v["city"].str.startswith("T"), "value")
    assert [r["key"] for r in store.scan().filter("value.version < 9").filter(starts).sort("key").limit(1).offset(0).all()] == ["k0"]
    assert sorted(r["key"] for r in store.scan().filter(~starts).all()) == ["k1", "k2"]
    same = predicate(lambda now, key: now["city"].str.len() == key.str.len() + 2, "current", "key")
    store.put_if("k2", ("Oslo", 5), same)
    with pytest.raises(ConditionFailed):
        store.put_if("k0", ("Oslo", 5), same)
    with pytest.raises(ConditionFailed):
        store.delete_if("none", same)  # nothing there, so null
    assert store.get("k2")["version"] == 5 and store.get("k0")["version"] == 0


def test_transactions(store):
    tx = store.begin()
    tx.put("a", ("Rome", 1))
    tx.put("b", ("Rome", 1))
    tx.delete("b")
    assert tuple(tx.get("a")) == ("Rome", 1)
    with pytest.raises(KeyNotFound):
        tx.get("b")
    assert store.keys().count() == 0
    tx.commit()
    with pytest.raises(TransactionDone):
        tx.commit()
    assert [r["key"] for r in store.keys().collect()] == ["a"]
    guard = store.begin()
    guard.require("a", "current.version = 1")
    guard.require("lock", "found")
    guard.put("c", ("x", 1))
    with pytest.raises(ConditionFailed):
        guard.commit()
    with pytest.raises(TransactionDone):
        guard.put("d", ("x", 1))
    undone = store.begin()
    undone.put("e", ("x", 1))
    undone.rollback()
    assert store.keys().count() == 1


def test_racing_writers_have_one_winner(spark, store):
    wins, losses = [], []

    def race(i):
        s = Store(spark, store.files, store.value_type, False, store.clock, None)
        try:
            s.put_if_absent("k", ("w", i))
            wins.append(i)
        except KeyExists:
            losses.append(i)

    threads = [threading.Thread(target=race, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(wins) == 1 and len(losses) == 3
    store.refresh()
    assert store.get("k")["version"] == wins[0]


def test_batches_compaction_digest_and_vacuum(spark, text):
    text.write(spark.range(100).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("v").alias("value")))
    text.write(spark.range(50).select(F.concat(F.lit("k"), "id").alias("key")), delete=True)
    text.write(spark.createDataFrame([("k1", "a", 1), ("k1", "b", 2)], "key string, value string, ord long"))
    digest = text.digest()
    assert text.keys().count() == 51 and text.get("k1") == "b"
    assert text.reclaimable().first()["dead"] == 101
    text.compact()
    assert text.digest() == digest and text.log().count() == 51
    assert text.compact() == text.version
    assert len(text.vacuum()) == 3 and text.digest() == digest
    text.verify()


def test_dedup_links(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "d"), dedup=True, clock=Clock()) as s:
        s.put("source", "shared")
        s.put("linked", "shared")
        assert {r["type"] for r in s.log().collect()} == {0, 4}
        s.delete("source")
        assert s.get("linked") == "shared"
        s.verify()
        s.compact()
        s.vacuum()
        assert s.get("linked") == "shared" and {r["type"] for r in s.log().collect()} == {0}


def test_damage_is_found(spark, text):
    text.write(spark.range(20).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value")))
    text.verify()
    folder = f"{text.files.local}/data/{text._live_manifests()[0]['dir']}"
    part = max((f for f in os.listdir(folder) if f.endswith(".parquet")), key=lambda f: os.path.getsize(f"{folder}/{f}"))
    os.remove(f"{folder}/{part}")
    with pytest.raises(Corrupt):
        text.verify()


def test_unpublished_files_do_not_exist(spark, text):
    text.put("a", "x")
    spark.range(1).write.parquet(f"{text.files.root}/data/v-torn")
    assert text.keys().count() == 1
    assert "v-torn" in text.vacuum()


def test_lock_and_close(spark, text):
    with pytest.raises(DirectoryLocked):
        Store.open(spark, text.files.root)
    text.close()
    with pytest.raises(Closed):
        text.get("a")


def test_streaming_ingest_is_exactly_once(spark, text, tmp_path):
    spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1)], "key string, value string, n int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, value string, n int").parquet(str(tmp_path / "in"))
    ingest(stream, text, "q", str(tmp_path / "c1"), order="n").awaitTermination()
    version = text.version
    ingest(stream, text, "q", str(tmp_path / "c2"), order="n").awaitTermination()  # the same batch again
    assert text.get("a") == "2" and text.version == version


def test_adapters_and_indexed_log(text):
    kv = KeyValue(text)
    kv.set("a", "1")
    assert kv.get("a") == ("1", True) and kv.get("b") == (None, False)
    batch = kv.batch()
    batch.set("b", "2")
    batch.delete("a")
    batch.commit()
    assert kv.keys() == ["b"]
    log = IndexedLog(text)
    assert log.bounds() == (0, 0) and log.setting("term") is None
    log.append({i: f"e{i}" for i in range(5, 10)})
    log.set("term", "3")
    log.delete_range(5, 6)
    assert log.bounds() == (7, 9) and log.get(8) == "e8" and log.setting("term") == "3"


def test_commands(spark):
    lines = spark.createDataFrame([(0, '{"op":"put","key":"a","value":"eA==","ttl":5}'), (1, '{"op":"fly","key":"a"}'), (2, "broken"), (3, None)], "n long, line string")
    assert [tuple(r) for r in parse(lines, "n", 100).select("pos", "value", "expires_at_ns").collect()] == [(0, "x", 105)]
    assert [r["n"] for r in malformed(lines).orderBy("n").collect()] == [2, 3]


def test_command_line(spark, tmp_path):
    def call(*argv):
        out = io.StringIO()
        assert run(spark, ["--path", str(tmp_path / "cli"), *argv], out) == 0
        return out.getvalue().strip()

    call("put", "a", "1")
    call("load", "5")
    assert call("get", "a") == "1"
    call("del", "a")
    assert run(spark, ["--path", str(tmp_path / "cli"), "get", "a"]) == 1
    call("compact")
    assert call("verify") == "ok" and len(call("list", "3").splitlines()) == 3 and "base" in call("stats") and len(call("digest")) == 64


def test_batches_stay_known_after_compaction_and_vacuum(spark, text):
    batch = lambda k: spark.createDataFrame([(k, "v")], "key string, value string")
    for number in range(3):
        text.write(batch(f"k{number}"), tag=f"q/{number}")
    text.write(batch("x"), tag="one of a kind")
    text.compact()
    text.vacuum()
    version = text.version
    other = Store.open(spark, text.files.root, readonly=True)
    for s in (text, other):
        assert s.write(batch("again"), tag="q/2") == s.write(batch("again"), tag="q/0") == s.write(batch("again"), tag="one of a kind") == version
    assert text.write(batch("k3"), tag="q/3") == version + 1 and text.write(batch("k3"), tag="q/3") == version + 1
    text.compact()
    text.vacuum()
    assert text.write(batch("again"), tag="q/2") == text.version and text.keys().count() == 5


def test_unreadable_versions_raise(text):
    assert text.state(version=0).count() == 0
    text.put("a", "1")
    text.put("b", "2")
    assert text.state(version=0).count() == 0 and text.state(version=1).count() == 1
    with pytest.raises(VersionNotFound):
        text.state(version=3)
    text.compact()
    text.vacuum()
    for version in (0, 1, 2):
        with pytest.raises(VersionNotFound):
            text.state(version=version)
    assert text.state(version=3).count() == 2


def test_state_of_base_and_tail(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "b"), dedup=True, clock=Clock()) as s:
        for k in "abcd":
            s.put(k, f"value {k}")
        s.compact()
        s.put("a", "new")
        s.put("e", "value b")  # a link into the base
        s.delete("c")
        s.put("f", "soon gone", ttl_ns=5)
        want = {"a": "new", "b": "value b", "d": "value d", "e": "value b"}
        assert {r["key"]: r["value"] for r in s.state().where("key <> 'f'").collect()} == want
        s.clock.now += 5
        assert {r["key"]: r["value"] for r in s.state().collect()} == want
        digest = s.digest()
        s.compact()
        assert s.digest() == digest and "Exchange" not in s.state()._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_reads_by_position_and_version(text):
    text.put("a", "1")
    text.put("b", "2")
    assert [(r["key"], r["value"]) for r in text.entry(2 << 32).collect()] == [("b", "2")]
    assert text.entry((2 << 32) + 1).collect() == []
    assert [r["key"] for r in text.version_log(1).collect()] == [r["key"] for r in text.segment(1).collect()] == ["a"]
    text.compact()
    assert [r["key"] for r in text.version_log(3).collect()] == ["a", "b"] and [r["value"] for r in text.entry(1 << 32).collect()] == ["1"]
    with pytest.raises(VersionNotFound):
        text.version_log(9)


def test_cache_keeps_values_of_the_newest_version(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "c"), clock=Clock(), cache=2, rows_per_file=10, bloom_keys=100) as s:
        s.write(spark.range(35).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value")))
        assert len([f for f in os.listdir(f"{s.files.local}/data/{s._live_manifests()[0]['dir']}") if f.endswith(".parquet")]) >= 4
        assert [s.get(k) for k in ("1", "2", "3", "3")] == ["v"] * 4 and list(s._cache) == ["2", "3"]
        s.put("3", "w", ttl_ns=10)
        assert s.get("3") == "w" and list(s._cache) == ["3"]
        s.clock.now += 10
        with pytest.raises(KeyNotFound):
            s.get("3")


def test_compactor_runs_by_itself(text):
    import time

    text.start_compactor(0.2, versions=3)
    for k in "abc":
        text.put(k, k)
    until = time.time() + 60
    while time.time() < until and (len(text._live_manifests()) >= 3 or len(text.files.names("_log")) > 2):
        time.sleep(0.2)
    text.stop_compactor()
    assert text._live_manifests()[0]["kind"] == "base" and text.keys().count() == 3
    text.verify()


def test_damaged_row_is_located(spark, text):
    text.put("a", "x")
    text.put("b", "y")
    where = f"{text.files.root}/data/{text._live_manifests()[1]['dir']}"
    rows = spark.createDataFrame(spark.read.parquet(where).withColumn("value", F.lit("z")).collect(), text._row)
    rows.write.mode("overwrite").parquet(where)
    with pytest.raises(Corrupt, match=f"version 2.*position {2 << 32}"):
        text.verify()


def test_digests_tell_fields_apart(spark):
    from stratakeep.operators import digest

    rows = [("a|b", "c"), ("a", "b|c"), ("", None), (None, ""), ("1:a", ""), ("1", "a")]
    leaf = digest.leaves(spark.createDataFrame([(str(i), r) for i, r in enumerate(rows)], "key string, value struct<x:string,y:string>"))
    assert leaf.select("leaf").distinct().count() == len(rows)
    assert digest.sized_root(leaf).first() == digest.root(leaf).first()
    assert digest.sized_root(leaf, few=2, per_bucket=2).first() == digest.tree_root(leaf, 3).first()
