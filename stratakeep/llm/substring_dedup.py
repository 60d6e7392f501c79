"""Substring de-duplication by recompression.

Recompression names runs of equal tokens, then round after round names adjacent pairs whose left
part is in one random half of the alphabet and whose right part is in the other. Whether two
neighbours merge depends on them alone, so equal substrings get equal symbols but for a few at
their borders. Names are hashes of what they name: they agree across all documents and executors
without a dictionary that grows with the corpus.

Each symbol also carries its *context*, the exact span of words that decided its making. A window
of ``width`` words holds a symbol in all its occurrences if the context lies inside the window. The
longest such symbol is the window's *anchor*; windows without a long one take their least word.
Equal windows thus have equal anchors. Consecutive windows with one anchor are a *block*.

Spark rounds: (1) per anchor, are there several blocks, and do they all have the same words?
Anchors of one block are settled: unique, but for windows that recur inside it, which the survey finds
in the text itself. Where all blocks are equal, all their windows repeat.
(2) Only for anchors with differing blocks, at the borders of what is shared, single windows are
hashed with 128 bits and counted. (3) Covered words are cut. Equal texts are worked on once a task
and repeat as a whole. Per-anchor statistics are pre-aggregated and joined back by a sort-merge
join that can split hot anchors; no anchor's blocks are ever gathered in one place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import durable, table

ROUNDS = 11
SHORTEST = 5
_FAR = 1 << 40
_SCHEMA = "doc_id long, sid long, n_words long, whole string, anchors array<long>, blocks array<long>, lo array<int>, cnt array<int>, own array<int>"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class _Symbols:
    """Symbols of one level: name, words [s, e), context [lo, hi), and the text each is in."""

    def __init__(self, name, s, e, lo, hi, text):
        self.name, self.s, self.e, self.lo, self.hi, self.text = name, s, e, lo, hi, text

    def neighbours(self):
        """Contexts reached by looking one symbol left and right; a text's edge is no word's context."""
        same = self.text[1:] == self.text[:-1]
        left, right = np.full(len(self.name), -_FAR), np.full(len(self.name), _FAR)
        left[1:][same] = self.lo[:-1][same]
        right[:-1][same] = self.hi[1:][same]
        return same, left, right


def name_runs(hashes: np.ndarray, text: np.ndarray) -> _Symbols:
    """Level 0: maximal runs of one word, named by word and length; the words beside a run end it."""
    n = len(hashes)
    begin = np.ones(n, bool)
    begin[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    s = np.flatnonzero(begin)
    e = np.append(s[1:], n)
    name = np.where(e - s > 1, tk.mix(hashes[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), hashes[s])
    level = _Symbols(name, s, e, s, e, text[s])
    _, left, right = level.neighbours()
    level.lo, level.hi = np.where(left > -_FAR, s - 1, -_FAR), np.where(right < _FAR, e + 1, _FAR)
    return level


def name_pairs(x: _Symbols, round_no: int) -> _Symbols:
    """One round of pair compression."""
    if len(x.name) < 2:
        return x
    same, left, right = x.neighbours()
    side = (tk.mix(x.name + np.uint64(0xC0DE + 977 * round_no)) >> np.uint64(40)) & np.uint64(1) == 1  # True: right half
    joins = same & ~side[:-1] & side[1:]
    head, tail = np.append(joins, False), np.insert(joins, 0, False)
    lo = np.where(side & ~tail, np.minimum(x.lo, left), x.lo)
    hi = np.where(~side & ~head, np.maximum(x.hi, right), x.hi)
    # who stays single saw one neighbour, with all of that one's context
    prev_hi, next_lo = np.append(-_FAR, x.hi[:-1]), np.append(x.lo[1:], _FAR)
    hi = np.where(side & ~tail & (left > -_FAR), np.maximum(hi, prev_hi), hi)
    lo = np.where(~side & ~head & (right < _FAR), np.minimum(lo, next_lo), lo)
    first = np.flatnonzero(head)
    name, e = x.name.copy(), x.e.copy()
    name[first] = tk.mix(x.name[first] * np.uint64(0x9FB21C651E98DF25) + x.name[first + 1] + np.uint64(round_no))
    e[first] = x.e[first + 1]
    lo[first] = np.minimum(x.lo[first], x.lo[first + 1])
    hi[first] = np.maximum(x.hi[first], x.hi[first + 1])
    keep = ~tail
    return _Symbols(name[keep], x.s[keep], e[keep], lo[keep], hi[keep], x.text[keep])


def window_anchors(hashes: np.ndarray, text: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window start, 0 where no window begins (``valid`` is false)."""
    n = len(hashes)
    best = np.zeros(n, np.uint64)
    level = name_runs(hashes, text)
    keys, los, widths = [], [], []
    for r in range(ROUNDS):
        level = name_pairs(level, r)
        size, span = level.e - level.s, level.hi - level.lo
        fit = (size >= SHORTEST) & (span <= width)
        keys.append((size[fit].astype(np.uint64) << np.uint64(57)) | (level.name[fit] >> np.uint64(7)))
        los.append(level.lo[fit])
        widths.append(span[fit])
    key, lo, span = map(np.concatenate, (keys, los, widths))
    order = np.argsort(key)  # of several symbols for one window, the last, largest one stays
    key, lo, room = key[order], lo[order], width - span[order]
    for off in range(width):
        live = room >= off
        if not live.all():
            key, lo, room = key[live], lo[live], room[live]
        at = lo - off
        ok = at >= 0
        at, now = at[ok], key[ok]
        best[at] = np.maximum(best[at], now)
    best[~valid] = 0
    bare = np.flatnonzero(valid & (best == 0))
    for a in range(0, len(bare), 1 << 16):  # the least word stands in where no long symbol fits
        at = bare[a : a + (1 << 16)]
        best[at] = tk.mix(hashes[at[:, None] + np.arange(width)]).min(1) >> np.uint64(7)
    return best


def text_ids(w: tk.Words) -> np.ndarray:
    return tk.signed(tk.sequence_hashes(w, seed=0x5EED))


def joined(w: tk.Words, body: bytes, starts: list[int], ends: list[int], a: int, b: int) -> bytes:
    return b" ".join([body[starts[i] : ends[i]] for i in range(a, b)])


def _survey(width: int):
    def run(batches):
        done: set[int] = set()
        for part in tk.pieces(batches):
            w = tk.words(part.column("text"))
            counts, n = w.counts, len(w.hashes)
            ids = text_ids(w)
            body, starts, ends = w.body.tobytes(), w.starts.tolist(), w.ends.tolist()
            whole = [hashlib.sha256(joined(w, body, starts, ends, a, b)).hexdigest() for a, b in zip(w.off[:-1].tolist(), w.off[1:].tolist())]
            fresh = np.zeros(len(counts), bool)
            for i, sid in enumerate(ids.tolist()):
                if counts[i] >= width and sid not in done:
                    done.add(sid)
                    fresh[i] = True
            text = np.repeat(np.arange(len(counts)), counts)
            valid = fresh[text] & (np.arange(n) + width <= w.off[1:][text])
            empty = np.zeros(0, np.int64)
            first = cnt = own = empty
            names = blocks = np.zeros(0, np.uint64)
            if valid.any():
                best = window_anchors(w.hashes, text, valid, width)
                begin = valid.copy()
                begin[1:] &= ~valid[:-1] | (best[1:] != best[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(begin)
                stop = valid.copy()
                stop[:-1] &= ~valid[1:] | (best[1:] != best[:-1]) | (text[1:] != text[:-1])
                cnt = np.flatnonzero(stop) - first + 1
                names = best[first]
                power, inverse = tk._power_tables(n + 1)
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(w.hashes * power[:n], out=total[1:])
                blocks = tk.mix((total[first + cnt + width - 1] - total[first]) * inverse[first] + cnt.astype(np.uint64))
                # windows that recur within a window's length, as in text with a short period
                one = np.zeros(n, np.uint64)
                one[: n - width + 1] = tk.window_hashes(w.hashes, width)
                again = np.zeros(n, bool)
                for d in range(1, width):
                    eq = np.flatnonzero(one[d:] == one[:-d])
                    if len(eq):
                        eq = eq[valid[eq] & valid[eq + d] & (text[eq] == text[eq + d])]
                        again[eq] = True
                        again[eq + d] = True
                # and further apart, which within one block only long ones hold
                wide = np.flatnonzero(cnt > width)
                of = np.repeat(wide, cnt[wide])
                at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(cnt[wide]) - cnt[wide], cnt[wide])
                order = np.lexsort((one[at], of))
                of, at = of[order], at[order]
                eq = np.flatnonzero((one[at[1:]] == one[at[:-1]]) & (of[1:] == of[:-1]))
                again[at[eq]] = True
                again[at[eq + 1]] = True
                own = np.flatnonzero(again)
            per = lambda at: np.searchsorted(at, w.off)
            local = lambda at: (at - w.off[:-1][text[at]]).astype(np.int32)
            lists = [tk.list_array(x, per(at)) for x, at in ((tk.signed(names), first), (tk.signed(blocks), first), (local(first), first), (cnt.astype(np.int32), first), (local(own), own))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(ids), pa.array(counts), pa.array(whole, pa.string()), *lists], names=["doc_id", "sid", "n_words", "whole", "anchors", "blocks", "lo", "cnt", "own"])

    return run


def _packed(width: int):
    """(sid, packed words) of each text with a window, once a task."""

    def run(batches):
        done: set[int] = set()
        squeeze = zstandard.ZstdCompressor(level=1)
        for part in tk.pieces(batches):
            w = tk.words(part.column("text"))
            body, off = w.body.tobytes(), w.text_off.tolist()
            ids, data = [], []
            for i, sid in enumerate(text_ids(w).tolist()):
                if w.off[i + 1] - w.off[i] >= width and sid not in done:
                    done.add(sid)
                    ids.append(sid)
                    data.append(squeeze.compress(body[off[i] : off[i + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["sid", "data"])

    return run


def _texts(batches):
    """Batches of (sid, data, marks) with the words of each text, a bounded number of bytes at a time."""
    for batch in batches:
        sizes = [zstandard.frame_content_size(x) for x in batch.column("data").to_pylist()]
        at = 0
        while at < batch.num_rows:
            end, total = at, 0
            while end < batch.num_rows and (end == at or total + sizes[end] <= tk.CHUNK_BYTES):
                total += sizes[end]
                end += 1
            part = batch.slice(at, end - at)
            yield part, tk.words(pa.array([zstandard.decompress(x) for x in part.column("data").to_pylist()], pa.binary()))
            at = end


def _border_windows(width: int):
    def run(batches):
        for part, w in _texts(batches):
            sids, at, place = [], [], []
            for i, (sid, marks) in enumerate(zip(part.column("sid").to_pylist(), part.column("marks").to_pylist())):
                p = np.concatenate([np.arange(m >> 8, (m >> 8) + (m & 255)) for m in marks]) if marks else np.zeros(0, np.int64)
                sids.append(np.full(len(p), sid))
                at.append(p + w.off[i])
                place.append(p)
            where = np.concatenate(at).astype(np.int64)
            cols = [pa.array(np.concatenate(sids).astype(np.int64)), pa.array(np.concatenate(place).astype(np.int32))]
            for seed in (0, 0xF00D):
                h = tk.window_hashes(w.hashes, width, seed)
                cols.append(pa.array(tk.signed(h[where])))
            yield pa.RecordBatch.from_arrays(cols, names=["sid", "p", "w1", "w2"])

    return run


def _cut(width: int):
    def run(batches):
        for part, w in _texts(batches):
            body, starts, ends = w.body.tobytes(), w.starts.tolist(), w.ends.tolist()
            removed, kept = [], []
            for i, marks in enumerate(part.column("marks").to_pylist()):
                a, n = int(w.off[i]), int(w.off[i + 1] - w.off[i])
                m = np.array(marks, np.int64)
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, m >> 8, 1)
                np.add.at(step, np.minimum((m >> 8) + (m & 255) - 1 + width, n), -1)
                gone = np.cumsum(step)[:n] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([body[starts[a + j] : ends[a + j]] for j in np.flatnonzero(~gone).tolist()]))
            yield pa.RecordBatch.from_arrays([part.column("sid"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["sid", "n_removed", "kept"])

    return run


def _marks(rows: DataFrame) -> DataFrame:
    """Per text, its window ranges as start * 256 + count; long ranges come in pieces of 255."""
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("cnt") - 1) / 255).cast("int")))
    rows = rows.select("sid", "lo", "cnt", piece.alias("k"))
    mark = (F.col("lo").cast("long") + 255 * F.col("k")) * 256 + F.least(F.lit(255), F.col("cnt") - 255 * F.col("k"))
    return rows.groupBy("sid").agg(F.collect_set(mark).alias("marks"))


def cut_repeats(docs: DataFrame, width: int = 35, text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) and with ``text`` also kept_text for each row of (doc_id, text).

    Every word is removed that lies in a window of ``width`` words which occurs anywhere else, in
    the same text or in another one; windows are judged on the input. Null and empty texts have no
    words; texts of fewer words keep all. Rows with equal words repeat each other as a whole.
    ``kept_text`` is null where nothing was removed. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = durable(docs.mapInArrow(_survey(width), _SCHEMA), "survey")
    block = seen.where(F.size("anchors") > 0).select("sid", F.explode(F.arrays_zip("anchors", "blocks", "lo", "cnt")).alias("x")).select("sid", "x.*")
    block = block.withColumn("occ", F.xxhash64("sid", "lo"))
    of = block.groupBy("anchors").agg(F.min("occ").alias("o1"), F.max("occ").alias("o2"), F.min("blocks").alias("b1"), F.max("blocks").alias("b2")).where("o1 <> o2")
    of = of.select(F.col("anchors").alias("_anchor"), (F.col("b1") != F.col("b2")).alias("mixed"))
    hits = durable(block.join(of, F.col("anchors") == F.col("_anchor")).select("sid", "lo", "cnt", "mixed"), "blocks")
    packed = docs.mapInArrow(_packed(width), "sid long, data binary")
    windows = packed.join(_marks(hits.where("mixed")), "sid").mapInArrow(_border_windows(width), "sid long, p int, w1 long, w2 long")
    windows = durable(windows, "windows").withColumn("occ", F.xxhash64("sid", "p"))
    # a table of its own, so that both sides of the join are plain exchanges and Spark can split a hot window's rows
    twice = windows.groupBy("w1", "w2").agg(F.min("occ").alias("o1"), F.max("occ").alias("o2")).where("o1 <> o2").select(F.col("w1").alias("_1"), F.col("w2").alias("_2"))
    twice = durable(twice, "twice")
    border = windows.join(twice, (F.col("w1") == F.col("_1")) & (F.col("w2") == F.col("_2"))).select("sid", F.col("p").alias("lo"), F.lit(1).alias("cnt"))
    own = seen.where(F.size("own") > 0).select("sid", F.explode("own").alias("lo"), F.lit(1).alias("cnt"))
    copies = durable(seen.where(F.col("n_words") >= width).groupBy("sid").agg(F.count("*").alias("n")).where("n > 1").select("sid"), "copies")
    ranges = _marks(hits.where("not mixed").select("sid", "lo", "cnt").union(border).union(own)).join(copies, "sid", "left_anti")
    cut = packed.join(ranges, "sid").mapInArrow(_cut(width), "sid long, n_removed long, kept binary")
    cut = cut.select("sid", "n_removed", F.sha2("kept", 256).alias("sha"), *(["kept"] if text else [])).dropDuplicates(["sid"])
    cut = cut.select(F.col("sid").alias("_cut"), F.col("n_removed").alias("_n"), "sha", *(["kept"] if text else []))
    out = seen.select("doc_id", "sid", "n_words", "whole").join(cut, F.col("sid") == F.col("_cut"), "left").join(copies.select(F.col("sid").alias("_copy")), F.col("sid") == F.col("_copy"), "left")
    copy = F.col("_copy").isNotNull() & (F.col("n_words") >= width)
    columns = ["doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("_n", F.lit(0).cast("long"))).alias("n_removed"), F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256")]
    if text:
        columns.append(F.when(copy, F.lit("")).otherwise(F.col("kept").cast("string")).alias("kept_text"))
    return out.select(*columns)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"), text=False)


ORACLE = r"""
with w as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), p as (
  select r, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35
), h as (
  select p.r, p.i, array_to_string(list_slice(w.ws, p.i, p.i + 34), ' ') as k from p join w using (r)
), d as (
  select r, i from (select r, i, count(*) over (partition by k) as n from h) where n > 1
), g as (
  select distinct r, i + o as j from d, (select unnest(range(0, 35)) as o)
), x as (
  select r, list(j) as js from g group by r
)
select w.doc_id, len(ws)::bigint as n_words, coalesce(len(js), 0)::bigint as n_removed,
  sha256(array_to_string(case when js is null then ws else list_transform(list_filter(range(1, len(ws) + 1), lambda j: not list_contains(js, j)), lambda j: ws[j]) end, ' ')) as kept_sha256
from w left join x using (r)
"""
