"""N-gram Jaccard join by parity sketches.

A text's set holds its distinct word shingles as 64-bit hashes. Texts with equal sets are one node.
Two sets of sizes a and b with Jaccard similarity of at least t differ in at most
(a + b) * (1 - t) / (1 + t) shingles, which bounds the distance of any parity sketch: a sketch
XORs a pattern for each shingle, and a shingle that only one side has changes one place.

*Size bands* hold the sizes that can link; a set is sketched for its band and the next. Two sets of
band g - 1, and one of g - 1 and one of g, meet in group g, whose largest sizes bound the difference d.

*Pigeonhole join.* Hashing deals the shingles into k = d + 1 + m segments, each with its own XOR
word. Two linked sets agree in at least 1 + m words, so they meet under (group, segment, word).
Words of empty segments say nothing; sets with at most m empty segments skip them, since one of
the agreeing words must then belong to a segment that is not empty. Sets with more of them pair
each with all words of a second dealing, of which one must agree as well. Where d is 1,
the whole set's XOR and all its one-deletion variants are the keys.

*Keys with the same members.* Two similar sets share hundreds of keys, so keys are then named by their
members (count, XOR, least and greatest of their hashes) and each name is kept once with its members.
Two keys that get one name by chance only bring more sets together.

*Verification.* A whole-set sketch of 1024 bits drops pairs whose Hamming distance exceeds the
bound, then one of 8192 bits those of large sets; what remains is compared exactly. Only connected components are wanted, so a key's members
are not all paired with each other: first each is compared with the key's hub, its smallest node,
which settles all keys of two. Then keys whose members are one component are done. In the others a growing
number of leaders is compared with the members of other components, then leaves, until no key joins two
components. Every pair that meets is thus either in one component or has been compared.

64-bit hashes stand for shingles and sets; at 10**11 different sets a few hundred are expected to
coincide by chance.
"""

from __future__ import annotations

from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import discard, durable, table

SKETCH_WORDS = 16
#: Longs of the wider sketch, which sets of more than WIDE_FROM shingles have besides.
WIDE_WORDS, WIDE_FROM = 128, 512
LEADERS = 16
#: Pairs that are few enough for their nodes to be broadcast when their texts are looked up; they are counted first.
FEW = 1 << 20
_SCHEMA = "doc_id long, n_shingles long, node long, sketch array<long>, wide array<long>"
_KEYS = "node long, keys array<long>"
_SETS = "node long, shingles array<long>"


_bands: dict[tuple[int, int], tuple[int, ...]] = {}
_plans: dict[tuple[int, int, int], tuple[int, int, int]] = {}


def bands(percent: int, upto: int) -> tuple[int, ...]:
    """Smallest size of each band; a set of one band links into its own or the next band at most."""
    if (percent, upto) in _bands:
        return _bands[percent, upto]
    lows = [1]
    while lows[-1] <= upto:
        lows.append(lows[-1] * 100 // percent + 1)
    return _bands.setdefault((percent, upto), (*lows, lows[-1] * 100 // percent + 1))


def group_plan(percent: int, low: int, middle: int, high: int) -> tuple[int, int, int]:
    """(d, k, m) of a band group: a lower band from ``low`` to ``middle`` and an upper one to ``high``."""
    if (percent, low, high) in _plans:
        return _plans[percent, low, high]
    d = (middle + high) * (100 - percent) // (100 + percent)
    m = 1
    for _ in range(4):
        k = d + 1 + m
        m = 1 + ceil(1.5 * k * exp(-low / k))
    return _plans.setdefault((percent, low, high), (d, d + 1 + m, m))


def _xor_by(slot: np.ndarray, k: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XOR of the values dealt to each of ``k`` slots, and how many there are."""
    slot = slot.astype(np.uint16 if k <= 65536 else np.int64)
    order = np.argsort(slot, kind="stable")
    count = np.bincount(slot, minlength=k)
    words = np.zeros(k, np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        begin = np.concatenate([[0], np.cumsum(count[full])[:-1]])
        words[full] = np.bitwise_xor.reduceat(values[order], begin)
    return words, count


def bucket_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys under which a set meets every set that it can link to (other than an equal one)."""
    n = len(shingles)
    lows = bands(percent, 1 << max(10, n.bit_length() + 1))
    band = int(np.searchsorted(lows, n, "right")) - 1
    marks = tk.mix(shingles + np.uint64(0x51A9))
    out = []
    for g in (band, band + 1):
        d, k, m = group_plan(percent, lows[max(g - 1, 0)], lows[g] - 1, lows[g + 1] - 1)
        if d == 0:
            continue
        salt = np.uint64(tk.mix_int(0xB0B + g))
        if d == 1:
            whole = np.bitwise_xor.reduce(marks)
            out.append(tk.mix(np.concatenate([[whole], whole ^ marks]) + salt))
            continue
        first = tk.mix(marks + salt)
        words, count = _xor_by(first % np.uint64(k), k, marks)
        places = tk.mix(np.arange(k, dtype=np.uint64) + salt)
        full = count > 0
        out.append(tk.mix(words[full] ^ places[full]))
        empty = np.flatnonzero(~full)
        if len(empty) > m:
            second, _ = _xor_by(tk.mix(first + salt) % np.uint64(k), k, marks)
            other = tk.mix(second + tk.mix(np.arange(k, dtype=np.uint64) ^ salt))
            out += [tk.mix(other + places[i]) for i in empty]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def text_sets(column: pa.Array, width: int):
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    w = tk.words(column, lower=True)
    windows = tk.window_hashes(w.hashes, width, seed=width)
    short = tk.sequence_hashes(w, seed=width)
    for i, (a, b) in enumerate(zip(w.off[:-1].tolist(), w.off[1:].tolist())):
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        else:
            yield short[i : i + 1] if b > a else short[:0]


def node_of(shingles: np.ndarray) -> int:
    total = int(tk.mix(shingles + np.uint64(0x7E57)).sum(dtype=np.uint64)) + 0x1F3D * len(shingles)
    return tk.mix_int(total)


def _sketch(shingles: np.ndarray, size: int = SKETCH_WORDS) -> np.ndarray:
    parity = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (64 * size - 1), minlength=64 * size) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _describe(width: int):
    def run(batches):
        done: set[int] = set()  # a set that this task has described already needs no second sketch
        for part in tk.pieces(batches):
            n, nodes, sketches, wide = [], [], [], []
            none = np.zeros(0, np.int64)
            for s in text_sets(part.column("text"), width):
                node = node_of(s) if len(s) else 0
                new = len(s) > 0 and node not in done
                done.add(node)
                n.append(len(s))
                nodes.append(node)
                sketches.append(_sketch(s) if new else none)
                wide.append(_sketch(s, WIDE_WORDS) if new and len(s) > WIDE_FROM else none)
            lists = [tk.list_array(np.concatenate(x), np.cumsum([0, *map(len, x)])) for x in (sketches, wide)]
            node = pa.array(tk.signed(np.array(nodes, np.uint64)), mask=np.array(n) == 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), node, *lists], names=["doc_id", "n_shingles", "node", "sketch", "wide"])

    return run


def _keyed(width: int, percent: int):
    def run(batches):
        done: set[int] = set()
        for part in tk.pieces(batches):
            nodes, keys = [], [np.zeros(0, np.int64)]
            for s in text_sets(part.column("text"), width):
                node = node_of(s) if len(s) else 0
                if len(s) and node not in done:
                    done.add(node)
                    nodes.append(node)
                    keys.append(tk.signed(bucket_keys(s, percent)))
            lists = tk.list_array(np.concatenate(keys), np.cumsum([len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(np.array(nodes, np.uint64))), lists], names=["node", "keys"])

    return run


def _sets(width: int):
    def run(batches):
        for part in tk.pieces(batches):
            sets = [s for s in text_sets(part.column("text"), width) if len(s)]
            nodes = tk.signed(np.array([node_of(s) for s in sets], np.uint64))
            flat = tk.signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), tk.list_array(flat, np.cumsum([0, *map(len, sets)]))], names=["node", "shingles"])

    return run


def _hamming(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH_WORDS)), F.lit(0))


def _bound(distance: Column, percent: int) -> Column:
    """Whether sets of na and nb shingles can link if their sketches are so far apart."""
    return distance * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)


def _near(percent: int) -> Column:
    """Whether (na, ka) and (nb, kb) can link by their sizes and sketches."""
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & _bound(_hamming("ka", "kb"), percent)


def _far(percent: int) -> Column:
    """Whether the wide sketches wa and wb tell that a pair cannot link; they do not if a set has none."""
    apart = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (F.size("wa") > 0) & (F.size("wb") > 0) & ~_bound(apart, percent)


def _verified(near: DataFrame, nodes: DataFrame, seen: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of (a, b, na, nb) whose sets link; sets are made anew, of the texts in question only."""
    wide = lambda c: nodes.select(F.col("node").alias(c), F.col("wide").alias(f"w{c}"))
    near = durable(near.join(wide("a"), "a").join(wide("b"), "b").where(~_far(percent)).select("a", "b", "na", "nb"), "near")
    small = F.broadcast if near.count() <= FEW else lambda df: df
    ids = durable(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "compared")
    rows = durable(seen.where("node is not null").select("node", "doc_id").join(small(ids), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("_id")).select("_id").distinct(), "rows")
    texts = docs.join(small(rows), docs.doc_id.eqNullSafe(rows["_id"]), "left_semi")
    held = durable(texts.mapInArrow(_sets(width), _SETS).join(small(ids), "node", "left_semi").dropDuplicates(["node"]), "sets")
    both = near.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(held.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    links = durable(both.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b"), "links")
    discard(near, ids, rows, held)
    return links


def _empty(df: DataFrame) -> bool:
    return not df.take(1)


def _flatten(parent: DataFrame) -> DataFrame:
    """Follow the (comp, up) pointers of a table, each to a smaller component, to their roots by pointer doubling."""
    moved = True
    while moved:
        upper = parent.select(F.col("comp").alias("_c"), F.col("up").alias("_u"))
        step = durable(parent.join(upper, parent.up == F.col("_c"), "left").select("comp", F.coalesce("_u", "up").alias("up"), F.col("_u").isNotNull().alias("moved")), "pointers")
        discard(parent)
        moved, parent = not _empty(step.where("moved")), step
    return parent


def merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Merge the components (node, comp) along verified links (a, b), until no link crosses two; both tables are used up."""
    while True:
        left = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        right = comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        cross = durable(links.select("a", "b").join(left, "a").join(right, "b").where("ca <> cb"), "links")
        discard(links)
        if _empty(cross):
            discard(cross)
            return comps
        up = cross.groupBy(F.greatest("ca", "cb").alias("comp")).agg(F.min(F.least("ca", "cb")).alias("up"))
        root = _flatten(durable(up, "pointers"))
        above = root.select(F.col("comp").alias("_c"), "up")
        now = durable(comps.join(above, comps.comp == F.col("_c"), "left").select("node", F.coalesce("up", "comp").alias("comp")), "components")
        discard(comps, root)
        comps, links = now, cross


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of (doc_id, text).

    Two texts link if ``100 * common >= percent * union`` of their distinct shingles of ``width``
    words, lower-cased in A-Z; component_id is the smallest doc_id reachable by links. Null and
    empty texts have no shingles and are alone under their own id. Rows with equal sets share a
    component; repeated rows and ids come out once a row. Null ids are ignored by the minimum, and
    a component of null ids only has a null id. Very long texts are sets like any other, and no rows
    give none. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = durable(docs.mapInArrow(_describe(width), _SCHEMA), "shingles")
    # keys are made in a pass of their own and go straight into the shuffle: stored, they would double its disk
    met = docs.mapInArrow(_keyed(width, percent), _KEYS).select("node", F.explode("keys").alias("key")).repartition("key")
    same = Window.partitionBy("key")
    met = met.select("node", F.min("node").over(same).alias("hub"), F.max("node").over(same).alias("_last"), F.count("*").over(same).alias("_n"), F.bit_xor(F.xxhash64("node")).over(same).alias("_all"))
    shared = durable(met.where("hub <> _last").select(F.xxhash64("hub", "_last", "_n", "_all").alias("key"), "node", "hub").distinct(), "met")
    members = durable(shared.select("node").distinct(), "members")
    described = seen.where(F.size("sketch") > 0).select("node", "n_shingles", "sketch", "wide")
    nodes = durable(described.join(members, "node", "left_semi").dropDuplicates(["node"]), "nodes")
    verified = lambda pairs: _verified(pairs, nodes, seen, docs, width, percent)

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"k{c}"))
    first = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    links = verified(first.where(_near(percent)).select("a", "b", "na", "nb"))
    comps = merge(durable(members.select("node", F.col("node").alias("comp")), "components"), links)
    left, leaders = durable(shared.where("node <> hub").select("key", "node"), "left"), LEADERS
    discard(shared, members)
    while True:
        now = left.join(comps, "node")
        open_keys = now.groupBy("key").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).where("_x <> _y").select("key")
        ranked = now.join(open_keys, "key", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("node")))
        ranked = durable(ranked, "open")
        discard(left)
        if _empty(ranked):
            break
        # sizes and sketches are compared inside the join, so it puts out only pairs that may link
        known = ranked.join(nodes.drop("wide"), "node")
        lead = known.where(F.col("rank") <= leaders).select("key", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("rank").alias("ra"), F.col("n_shingles").alias("na"), F.col("sketch").alias("ka"))
        rest = known.select("key", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("rank").alias("rb"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("kb"))
        pairs = rest.join(lead, "key").where((F.col("rb") > F.col("ra")) & (F.col("ca") != F.col("cb")) & _near(percent)).select("a", "b", "na", "nb").distinct()
        comps = merge(comps, verified(pairs))
        left, leaders = durable(ranked.where(F.col("rank") > leaders).select("key", "node"), "left"), 8 * leaders
        discard(ranked)
    discard(ranked, nodes)

    placed = seen.select("doc_id", "n_shingles", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # ids of a component: one partial minimum a task, so a component may hold any share of the rows
    least = placed.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_n")).where("_n > 1").select(F.col("comp").alias("_c"), "component_id")
    out = placed.join(least, F.col("comp") == F.col("_c"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("_c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=90)


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), s as (
  select doc_id, case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w
), e as (
  select doc_id, len(sh) as n, unnest(sh) as x from s
), p as (
  select a.doc_id as a, b.doc_id as b, a.n + b.n as n, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) group by all
), l as (
  select a, b from p where 100 * c >= 90 * (n - c) union select b, a from p where 100 * c >= 90 * (n - c)
), r as (
  select doc_id as d, doc_id as c from s
  union
  select l.b, r.c from r join l on l.a = r.d
)
select s.doc_id, len(s.sh)::bigint as n_shingles, m.component_id from s join (select d, min(c) as component_id from r group by d) m on m.d = s.doc_id
"""
