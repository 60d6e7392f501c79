"""Queries over the test tables, one an operator, each with its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import pack_position, position_offset, position_segment
from .operators import digest, membership, mutate
from .operators.query import Indexes, Result, get, keys, multi_get
from .plans.changelog import COMMIT, DELETE, PUT, ROLLBACK, change_log, entry_at, next_transaction_id, segment, segment_stats, violations
from .plans.links import broken_links, link_duplicates, link_stats, resolve
from .plans.replay import compacted, latest, latest_over, reclaim, state, visible
from .sources.commands import parse, restore, snapshot
from .sources.indexed_log import bounds, without_range

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DAY_US, DAY_NS = 86_400_000_000, 86_400_000_000_000
NOW_NS = 1_707_955_200_000_000_000  # 2024-02-15 00:00 UTC


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# states and logs of the tables


def orders_state(spark, d):
    o = read(spark, d, "orders")
    return state(change_log(o, "o_orderkey", "o_orderkey", F.struct("o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))), NOW_NS)


def customer_state(spark, d):
    c = read(spark, d, "customer")
    return state(change_log(c, "c_custkey", F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.struct("c_name", "c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))), NOW_NS)


def cents(c="value"):
    return F.round(F.col(c) * 100).cast("long")


def micros(c="ts"):
    return F.unix_micros(F.col(c).cast("timestamp"))


def user_log(spark, d, deletes=False, ttl=False):
    """Events as writes to the user's key in time order; errors delete, every fifth write lives a day."""
    e = read(spark, d, "events")
    pos = micros() * 8 + F.pmod("event_id", F.lit(8))
    e = e.withColumn("pos", pos)
    kind = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT) if deletes else None
    expiry = F.when(F.col("event_id") % 5 == 0, (micros() + DAY_US) * 1000).otherwise(0) if ttl else None
    return change_log(e, "pos", "user_id", F.struct(cents().alias("v"), "event_type", "event_id"), type=kind, expires_at_ns=expiry)


def tx_log(spark, d):
    """The transaction log made of events: purchases commit, errors roll back, signups delete."""
    e = read(spark, d, "events").withColumn("tx", F.col("user_id") % 50)
    kind = (
        F.when((F.col("tx") != 0) & (F.col("event_type") == "purchase"), COMMIT)
        .when((F.col("tx") != 0) & (F.col("event_type") == "error"), ROLLBACK)
        .when(F.col("event_type") == "signup", DELETE)
        .otherwise(PUT)
    )
    key = F.concat(F.lit("k"), ((F.col("event_id") * 7) % 97).cast("string"))
    return change_log(e, "event_id", key, cents(), type=kind, tx_id="tx")


USER_SQL = """
u as (
  select user_id::varchar as key, event_id, event_type, round(value * 100)::bigint as v, epoch_us(ts) * 8 + event_id % 8 as pos,
    case when event_id % 5 = 0 then (epoch_us(ts) + 86400000000) * 1000 else 0 end as expires_at_ns from events
)"""
TX_SQL = """
e as (
  select event_id as pos, user_id % 50 as tx, 'k' || (event_id * 7) % 97 as key, round(value * 100)::bigint as v,
    case when user_id % 50 <> 0 and event_type = 'purchase' then 2 when user_id % 50 <> 0 and event_type = 'error' then 3 when event_type = 'signup' then 1 else 0 end as type
  from events
), t as (
  select *, first_value(case when type in (2, 3) then pos end ignore nulls) over w as end_pos, first_value(case when type in (2, 3) then type end ignore nulls) over w as end_type
  from e window w as (partition by tx order by pos rows between 1 following and unbounded following)
), vis as (
  select *, case when tx = 0 then pos when end_type = 2 then end_pos end as eff from t where type in (0, 1)
), cur as (
  select * from (select *, row_number() over (partition by key order by eff desc, pos desc) as rn from vis where eff is not null) where rn = 1
)"""

# point, index and scan queries


@query("select o_orderkey::varchar as key, o_custkey, o_orderstatus, round(o_totalprice * 100)::bigint as cents from orders where o_orderkey = (select min(o_orderkey) from orders)")
def kv_get(spark, d):
    first = str(read(spark, d, "orders").agg(F.min("o_orderkey")).first()[0])
    return get(orders_state(spark, d), first).select("key", "value.*")


@query("select o_orderkey::varchar as key, o_custkey, o_orderstatus, round(o_totalprice * 100)::bigint as cents from orders where false")
def kv_get_missing(spark, d):
    return get(orders_state(spark, d), "no such order").select("key", "value.*")


@query("select o_orderkey::varchar as key, o_custkey, o_orderstatus, round(o_totalprice * 100)::bigint as cents from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 45)")
def kv_multi_get(spark, d):
    wanted = read(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").cast("string").alias("key"))
    return multi_get(orders_state(spark, d), wanted).select("key", "value.*")


def _segment_index():
    index = Indexes()
    index.add("segment", "value.c_mktsegment")
    return index


CUSTOMER = "lpad(c_custkey::varchar, 10, '0') as key, c_name, c_mktsegment, round(c_acctbal * 100)::bigint as cents"


def flat(result: Result | DataFrame) -> DataFrame:
    df = result.df if isinstance(result, Result) else result
    return df.select("key", "value.*")


@query(f"select {CUSTOMER} from customer where c_mktsegment = 'BUILDING'")
def kv_index_lookup(spark, d):
    return flat(_segment_index().lookup(customer_state(spark, d), "segment", "BUILDING"))


@query(f"select {CUSTOMER} from customer where false")
def kv_index_unknown_value(spark, d):
    s, index = customer_state(spark, d), _segment_index()
    return flat(index.lookup(s, "segment", "no such segment")).union(flat(index.lookup(s, "no such index", "BUILDING")))


@query("select c_mktsegment as index_value, lpad(c_custkey::varchar, 10, '0') as key from customer")
def kv_index_inverted(spark, d):
    return _segment_index().inverted(customer_state(spark, d), "segment")


@query(f"select {CUSTOMER} from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0 order by cents desc, key limit 10")
def kv_filter_sort_limit(spark, d):
    found = _segment_index().lookup(customer_state(spark, d), "segment", "BUILDING")
    return flat(found.filter("value.cents > 0").sort(F.desc("value.cents")).limit(10))


@query(f"select * from (select * from (select {CUSTOMER} from customer) order by key limit 10) order by key offset 5")
def kv_limit_then_offset(spark, d):
    return flat(Result(customer_state(spark, d)).sort("key", tiebreak=None).limit(10).offset(5))


@query(f"select * from (select {CUSTOMER} from customer) order by key limit 10 offset 5")
def kv_offset_then_limit(spark, d):
    return flat(Result(customer_state(spark, d)).sort("key", tiebreak=None).offset(5).limit(10))


@query(f"select * from (select * from (select {CUSTOMER} from customer) order by key limit 20) order by cents desc, key limit 5")
def kv_sort_after_limit(spark, d):
    return flat(Result(customer_state(spark, d)).sort("key", tiebreak=None).limit(20).sort(F.desc("value.cents")).limit(5))


@query(f"select {CUSTOMER} from customer where false")
def kv_offset_past_end(spark, d):
    return flat(Result(customer_state(spark, d)).sort("key").offset(10**9))


@query(f"select * from (select * from (select {CUSTOMER} from customer) order by key limit 50) where cents > 0")
def kv_filter_after_limit(spark, d):
    return flat(Result(customer_state(spark, d)).sort("key").limit(50).filter("value.cents > 0"))


# replay, expiry, deletes


@query(f"with {USER_SQL} select key, v, event_type, event_id from (select *, row_number() over (partition by key order by pos desc) as rn from u) where rn = 1")
def kv_latest_per_key(spark, d):
    return flat(state(user_log(spark, d), NOW_NS))


@query(f"with {USER_SQL} select key, v, event_type, event_id from (select *, row_number() over (partition by key order by pos desc) as rn from u) where rn = 1 and event_type <> 'error'")
def kv_tombstones(spark, d):
    return flat(state(user_log(spark, d, deletes=True), NOW_NS))


@query(f"with {USER_SQL} select key, v, event_type, event_id from (select *, row_number() over (partition by key order by pos desc) as rn from u) where rn = 1 and (expires_at_ns = 0 or {NOW_NS} < expires_at_ns)")
def kv_expired_newest_hides_old(spark, d):
    return flat(state(user_log(spark, d, ttl=True), NOW_NS))


@query(f"with {USER_SQL} select key from (select *, row_number() over (partition by key order by pos desc) as rn from u) where rn = 1 and event_type <> 'error' and (expires_at_ns = 0 or {NOW_NS} < expires_at_ns)")
def kv_keys_live(spark, d):
    return keys(state(user_log(spark, d, deletes=True, ttl=True), NOW_NS))


@query(f"with {USER_SQL} select count(*) as n, sum(v)::bigint as total from (select *, row_number() over (partition by key order by pos desc) as rn from u) where rn = 1 and event_type <> 'error'")
def kv_foreach(spark, d):
    return state(user_log(spark, d, deletes=True), NOW_NS).agg(F.count("*").alias("n"), F.sum("value.v").alias("total"))


@query("select event_id::varchar as key, round(value * 100)::bigint as v from events where (epoch_us(ts) + 86400000000) * 1000 > (select min(epoch_us(ts) + 86400000000) * 1000 from events)")
def kv_ttl_boundary(spark, d):
    e = read(spark, d, "events")
    log = change_log(e, "event_id", "event_id", cents(), expires_at_ns=(micros() + DAY_US) * 1000)
    return state(log, log.agg(F.min("expires_at_ns")).first()[0]).select("key", F.col("value").alias("v"))


@query(f"with {USER_SQL} select event_type as index_value, count(*) as n from (select *, row_number() over (partition by key order by pos desc) as rn from u) where rn = 1 group by 1")
def kv_index_after_update(spark, d):
    index = Indexes()
    index.add("type", "value.event_type")
    return index.inverted(state(user_log(spark, d), NOW_NS), "type").groupBy("index_value").agg(F.count("*").alias("n"))


# transactions


@query(f"with {TX_SQL} select key, v from cur where type = 0")
def kv_tx_replay(spark, d):
    return state(tx_log(spark, d), NOW_NS).select("key", F.col("value").alias("v"))


@query(f"with {TX_SQL} select pos, tx as tx_id, key from t where type in (0, 1) and tx <> 0 and end_type is null")
def kv_tx_uncommitted(spark, d):
    """Entries that no terminator follows and that must stay invisible."""
    log = tx_log(spark, d)
    last = log.where("type in (2, 3)").groupBy(F.col("tx_id").alias("_t")).agg(F.max("pos").alias("_last"))
    seen = visible(log).select(F.col("pos").alias("_p"))
    open_ = log.where("type in (0, 1) and tx_id <> 0").join(last, F.col("tx_id") == F.col("_t"), "left").where("_last is null or pos > _last")
    return open_.join(seen, F.col("pos") == F.col("_p"), "left_anti").select("pos", "tx_id", "key")


@query(f"with {TX_SQL} select tx as tx_id, eff, count(*) as entries, min(pos) as first_pos from vis where eff is not null and tx <> 0 group by 1, 2")
def kv_tx_reused_id(spark, d):
    """What each commit of a reused id takes: only entries since the terminator before it."""
    return visible(tx_log(spark, d)).where("tx_id <> 0").groupBy("tx_id", "eff").agg(F.count("*").alias("entries"), F.min("pos").alias("first_pos"))


@query("select c_custkey::varchar as key, c_custkey % 7 <> 0 and not exists (select 1 from orders where o_custkey = c_custkey) as applied from customer")
def kv_put_if_absent(spark, d):
    """New customers against keys that orders have; every seventh is refused by its own condition."""
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("v"))
    s = state(change_log(o, "v", "o_custkey", "v"), NOW_NS)
    c = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").alias("value"))
    absent = mutate.put_if_absent(s, c)
    return absent.select("key", (F.col("applied") & (F.col("value") % 7 != 0)).alias("applied"))


@query("select o_orderkey::varchar as key, case when o_orderstatus = 'F' then round(o_totalprice * 100)::bigint + 1 else round(o_totalprice * 100)::bigint end as v from orders")
def kv_put_if_version(spark, d):
    """Raise the price of finished orders by one; the state after the batch."""
    s = orders_state(spark, d)
    batch = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), (F.round(F.col("o_totalprice") * 100).cast("long") + 1).alias("value"))
    done = mutate.put_if(s, batch, "found and current.o_orderstatus = 'F' and current.cents = value - 1")
    old = s.select(F.col("pos"), F.lit(PUT).alias("type"), F.lit(0).cast("long").alias("tx_id"), "key", F.col("value.cents").alias("value"), F.lit(None).cast("long").alias("link_pos"), "expires_at_ns")
    new = mutate.accepted(done, F.lit(1 << 40) + F.col("key").cast("long"))
    return state(old.unionByName(new), NOW_NS).select("key", F.col("value").alias("v"))


@query("select o_orderkey::varchar as key from orders where not (o_orderstatus = 'P' and o_custkey % 2 = 0)")
def kv_delete_if(spark, d):
    s = orders_state(spark, d)
    batch = s.select("key").union(spark.range(3).select(F.concat(F.lit("missing"), "id").alias("key")))
    done = mutate.delete_if(s, batch, "not found or (current.o_orderstatus = 'P' and current.o_custkey % 2 = 0)")
    gone = mutate.accepted(done, F.monotonically_increasing_id() + (1 << 50), delete=True)
    old = s.select("pos", F.lit(PUT).alias("type"), F.lit(0).cast("long").alias("tx_id"), "key", F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("link_pos"), "expires_at_ns")
    return keys(state(old.unionByName(gone.withColumn("value", F.lit(None).cast("string"))), NOW_NS))


@query("select o_custkey as tx, count(*) as operations from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0 and c_mktsegment <> 'BUILDING') group by 1")
def kv_require_guard(spark, d):
    """A transaction a customer; it requires a positive balance and another segment at once."""
    s = state(change_log(read(spark, d, "customer"), "c_custkey", "c_custkey", F.struct("c_mktsegment", cents("c_acctbal").alias("cents"))), NOW_NS)
    ops = read(spark, d, "orders").select(F.col("o_custkey").alias("tx"), F.col("o_orderkey").alias("op"))
    own = ops.select("tx", F.col("tx").cast("string").alias("key")).distinct()
    needs = own.withColumn("need", F.lit(1)).union(own.withColumn("need", F.lit(2)))
    held = mutate.guarded(s, ops, needs, "found and ((need = 1 and current.cents > 0) or (need = 2 and current.c_mktsegment <> 'BUILDING'))")
    return held.groupBy("tx").agg(F.count("*").alias("operations"))


FOLD_SQL = """
with recursive o as (
  select user_id::varchar as key, row_number() over (partition by user_id order by event_id) as rn, (event_id % 4)::bigint as expected from events
), f as (
  select key, 0::bigint as rn, 0::bigint as version, 0::bigint as applied from (select distinct key from o)
  union all
  select f.key, o.rn, case when o.expected = f.version % 4 then f.version + 1 else f.version end, case when o.expected = f.version % 4 then f.applied + 1 else f.applied end
  from f join o on o.key = f.key and o.rn = f.rn + 1
)
select key, arg_max(version, rn) as version, arg_max(applied, rn) as applied from f group by key
"""


@query(FOLD_SQL)
def kv_version_fold(spark, d):
    """Compare-and-set on one version a user: each event expects a version modulo 4 and raises it if it is met."""
    ops = read(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", (F.col("event_id") % 4).alias("expected"))
    start = F.struct(F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("applied"))

    def step(acc, op):
        met = (op["expected"] == acc["version"] % 4).cast("long")
        return F.struct((acc["version"] + met).alias("version"), (acc["applied"] + met).alias("applied"))

    return mutate.fold(ops, "event_id", start, step).select("key", "result.*")


# de-duplication


def document_log(spark, d):
    return change_log(read(spark, d, "documents"), "doc_id", "doc_id", "text")


LINKS_SQL = "select doc_id as pos, case when doc_id > min(doc_id) over (partition by text) then 4 else 0 end::integer as type, case when doc_id > min(doc_id) over (partition by text) then min(doc_id) over (partition by text) else -1 end as link_pos from documents"


@query(LINKS_SQL)
def kv_dedup_links(spark, d):
    return link_duplicates(document_log(spark, d)).select("pos", "type", F.coalesce("link_pos", F.lit(-1).cast("long")).alias("link_pos"))


@query("select doc_id::varchar as key, sha256(text) as digest from documents")
def kv_link_resolve(spark, d):
    return state(link_duplicates(document_log(spark, d)), NOW_NS, link_depth=1).select("key", F.sha2("value", 256).alias("digest"))


@query(f"with l as ({LINKS_SQL}) select count(*) filter (type = 0) as puts, count(*) filter (type = 4) as links, (select count(distinct text) from documents) as distinct_values from l")
def kv_dedup_stats(spark, d):
    return link_stats(link_duplicates(document_log(spark, d)))


CHAIN_SQL = "select doc_id::varchar as key, sha256(text) as digest, n_chars + 100 as expires_at_ns from documents"


@query(CHAIN_SQL)
def kv_link_chain(spark, d):
    """Links of two hops; the expiry is the link's own."""
    docs = read(spark, d, "documents")
    base = change_log(docs, "doc_id", F.lit("held"), "text")
    hop = change_log(docs, F.col("doc_id") + (1 << 40), F.lit("hop"), F.lit(None).cast("string"), type=F.lit(4), link_pos="doc_id")
    top = change_log(docs, F.col("doc_id") + (1 << 41), "doc_id", F.lit(None).cast("string"), type=F.lit(4), link_pos=F.col("doc_id") + (1 << 40), expires_at_ns=F.col("n_chars") + 100)
    return resolve(top, base.unionByName(hop), 2).select("key", F.sha2("value", 256).alias("digest"), "expires_at_ns")


@query("select doc_id + 1000000 as pos, doc_id + 2000000 as link_pos from documents where doc_id % 10 = 0 union all select doc_id + 1000000, doc_id + 3000000 from documents where doc_id % 10 = 1")
def kv_broken_links(spark, d):
    """Links to nothing, and to an entry of a transaction that never committed."""
    docs = read(spark, d, "documents")
    nothing = F.col("doc_id") % 10
    target = F.when(nothing == 0, F.col("doc_id") + 2_000_000).when(nothing == 1, F.col("doc_id") + 3_000_000).otherwise(F.col("doc_id"))
    puts = change_log(docs, "doc_id", "doc_id", "lang")
    staged = change_log(docs, F.col("doc_id") + 3_000_000, "doc_id", "lang", tx_id=F.lit(7))
    links = change_log(docs, F.col("doc_id") + 1_000_000, "doc_id", F.lit(None).cast("string"), type=F.lit(4), link_pos=target)
    return broken_links(puts.unionByName(staged).unionByName(links))


# compaction, digests


@query(f"with {TX_SQL} select key, v, pos from cur where type = 0")
def kv_compact_state(spark, d):
    return state(compacted(tx_log(spark, d)), NOW_NS).select("key", F.col("value").alias("v"), "pos")


@query(f"with {TX_SQL}, s as (select pos, length(key) + 37 as size from e), k as (select pos from cur where type = 0) select (select count(*) from s) as entries, count(*) as kept, (select count(*) from s) - count(*) as dead, (select sum(size) from s)::bigint as bytes, sum(size)::bigint as kept_bytes, ((select sum(size) from s) - sum(size))::bigint as dead_bytes from s where pos in (select pos from k)")
def kv_compact_reclaim(spark, d):
    return reclaim(tx_log(spark, d), F.length("key") + 37)


def _names(spark, d, changed=False):
    c = read(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 100 == 1, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")) if changed else F.col("c_name")
    return state(change_log(c.where("c_custkey % 100 <> 2") if changed else c, "c_custkey", "c_custkey", name), NOW_NS)


ROOT_SQL = "sha256(unhex(string_agg(hex(encode(k)) || sha256(v), '' order by k)))"


@query("select c_custkey::varchar as key, sha256(c_name) as leaf from customer")
def kv_digest_leaves(spark, d):
    return digest.leaves(_names(spark, d))


@query(f"select {ROOT_SQL} as root from (select c_custkey::varchar as k, c_name as v from customer)")
def kv_digest_root(spark, d):
    return digest.root(digest.leaves(_names(spark, d)))


@query("select repeat('0', 64) as root")
def kv_digest_empty(spark, d):
    return digest.root(digest.leaves(_names(spark, d).where(F.lit(False))))


@query("select c_custkey::varchar as key, case when c_custkey % 100 = 1 then 'changed' else 'left' end as side from customer where c_custkey % 100 in (1, 2)")
def kv_digest_diff(spark, d):
    return digest.diff(digest.leaves(_names(spark, d)), digest.leaves(_names(spark, d, changed=True)))


@query("select true as same, false as same_after_change")
def kv_digest_tree(spark, d):
    """The two-level digest agrees with itself over another partitioning and notices changes."""
    s = digest.leaves(_names(spark, d))
    a, b, c = (digest.tree_root(x).select(F.col("root").alias(n)) for x, n in ((s, "a"), (s.repartition(7, "leaf"), "b"), (digest.leaves(_names(spark, d, changed=True)), "c")))
    return a.join(b, F.col("a") == F.col("b"), "left").join(c, F.col("a") == F.col("c"), "left").select(F.col("b").isNotNull().alias("same"), F.col("c").isNotNull().alias("same_after_change"))


# log metadata


@query("select user_id as segment, count(*) as entries, min(event_id) + (user_id << 32) as first_pos, max(event_id) + (user_id << 32) as last_pos, user_id = (select max(user_id) from events) as active from events group by user_id")
def kv_segment_stats(spark, d):
    e = read(spark, d, "events")
    return segment_stats(change_log(e, pack_position("user_id", "event_id"), "event_id", "value"))


@query("select l_orderkey * 4294967296 + l_linenumber as pos, l_orderkey as segment, l_linenumber::bigint as off from lineitem")
def kv_pos_pack_unpack(spark, d):
    p = read(spark, d, "lineitem").select(pack_position("l_orderkey", "l_linenumber").alias("pos"))
    return p.select("pos", position_segment("pos").alias("segment"), position_offset("pos").alias("off"))


@query("select (max(user_id % 50) + 1)::bigint as next_tx_id from events")
def kv_next_tx_id(spark, d):
    return next_transaction_id(tx_log(spark, d))


@query("""select event_id as pos, case when event_type = 'click' then 'unknown entry type' when user_id % 50 = 0 and event_type = 'purchase' then 'commit marker without transaction'
  when user_id % 50 = 0 and event_type = 'error' then 'rollback marker without transaction' when event_type = 'view' then 'link without target' end as rule from events
  where event_type in ('click', 'view') or (user_id % 50 = 0 and event_type in ('purchase', 'error'))""")
def kv_validate_log(spark, d):
    e = read(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", 9).when(F.col("event_type") == "purchase", COMMIT).when(F.col("event_type") == "error", ROLLBACK).when(F.col("event_type") == "view", 4).otherwise(PUT)
    return violations(change_log(e, "event_id", "event_id", cents(), type=kind, tx_id=F.col("user_id") % 50))


# replicated commands, numbered logs, membership


def _commands(spark, d):
    e = read(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "noop").otherwise("put")
    line = F.to_json(F.struct(op.alias("op"), F.concat(F.lit("u"), "user_id").alias("key"), F.base64(F.encode(cents().cast("string"), "UTF-8")).alias("value"), F.when(F.col("event_id") % 5 == 0, DAY_NS).otherwise(0).alias("ttl")))
    return parse(e.select("event_id", micros().alias("us"), line.alias("line")), "event_id", F.col("us") * 1000)


COMMAND_SQL = f"""
with c as (
  select 'u' || user_id as key, round(value * 100)::bigint::varchar as v, event_type, case when event_type <> 'error' and event_id % 5 = 0 then epoch_us(ts) * 1000 + {DAY_NS} else 0 end as expires_at_ns,
    row_number() over (partition by user_id order by event_id desc) as rn from events where event_type <> 'view'
)
select key, v from c where rn = 1 and event_type <> 'error' and (expires_at_ns = 0 or {NOW_NS} < expires_at_ns)
"""


@query(COMMAND_SQL)
def kv_command_log(spark, d):
    return state(_commands(spark, d), NOW_NS).select("key", F.col("value").alias("v"))


@query(COMMAND_SQL)
def kv_snapshot_restore(spark, d):
    """A snapshot written as commands and replayed gives the state it was taken of."""
    lines = snapshot(state(_commands(spark, d), NOW_NS), NOW_NS)
    return state(restore(lines, NOW_NS), NOW_NS).select("key", F.col("value").alias("v"))


def _entries(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("index"), "event_type")


@query("select min(event_id) as first_index, max(event_id) as last_index from events")
def kv_log_first_last(spark, d):
    return bounds(_entries(spark, d))


@query("select event_id as index, event_type from events where event_id not between 100 and 300")
def kv_log_delete_range(spark, d):
    return without_range(_entries(spark, d), 100, 300)


@query()
def kv_bloom_might_contain(spark, d):
    """Parts with an even key are added; odd ones show the rate of false positives."""
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"))
    even = F.col("key").cast("long") % 2 == 0
    return membership.might_contain(p, membership.build(p.where(even)))


@query("with c as (select event_id, user_id, row_number() over (partition by user_id order by event_id) as rn from events) select count(*) as winners, (select count(*) from events) - count(*) as refused from c where rn = 1")
def kv_first_writer_wins(spark, d):
    """Racing put-if-absent in log order: one winner a key."""
    e = read(spark, d, "events")
    first = e.withColumn("won", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1)
    return first.agg(F.count(F.when(F.col("won"), 1)).alias("winners"), F.count(F.when(~F.col("won"), 1)).alias("refused"))


@query(f"with {USER_SQL} select key, pos, case when event_type = 'error' then 1 else 0 end::integer as type from (select *, row_number() over (partition by key order by pos desc) as rn from u) where rn = 1")
def kv_latest_entries(spark, d):
    return latest(user_log(spark, d, deletes=True)).select("key", "pos", "type")


@query("select p_partkey::varchar as key, true as might_contain from part where p_partkey % 2 = 0")
def kv_bloom_added(spark, d):
    """Every added key may be in the filter."""
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key")).where(F.col("p_partkey") % 2 == 0)
    return membership.might_contain(p, membership.build(p))


def _segmented(spark, d):
    e = read(spark, d, "events")
    return change_log(e, pack_position(F.floor(F.col("event_id") / 100) + 1, F.col("event_id") % 100), "user_id", cents())


@query("select ((event_id // 100 + 1) << 32) + event_id % 100 as pos, user_id::varchar as key, round(value * 100)::bigint as v from events where event_id = 150")
def kv_entry_at(spark, d):
    """One entry of the log by its position."""
    return entry_at(_segmented(spark, d), (2 << 32) + 50).select("pos", "key", F.col("value").alias("v"))


@query("select ((event_id // 100 + 1) << 32) + event_id % 100 as pos, user_id::varchar as key, round(value * 100)::bigint as v from events where event_id between 200 and 299")
def kv_segment_scan(spark, d):
    """The entries of one sealed segment."""
    return segment(_segmented(spark, d), 3).select("pos", "key", F.col("value").alias("v"))


@query("select user_id::varchar as key, max(event_id) as pos from events group by user_id")
def kv_base_and_tail(spark, d):
    """A compacted log and the entries behind it give the state of the whole log."""
    log = change_log(read(spark, d, "events"), "event_id", "user_id", cents())
    cut = 5000 if log.where("pos >= 5000").take(1) else 50
    return latest_over(compacted(log.where(F.col("pos") < cut)), log.where(F.col("pos") >= cut)).select("key", "pos")
