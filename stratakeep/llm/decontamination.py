"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages; hashed TF-IDF vectors of all passages give, in one distributed
pass, the product of their covariance with a random matrix, from which a randomised (Nystroem) SVD
takes the leading directions. Windows of every document, at the lengths of the benchmark items, and
every item are projected on them; windows whose cosine with an item is high are candidates. A longest
common subsequence of words then decides: a document holds an item if a stretch of at most twice the
item's length and EXTRA words has most of the item's words in order, which also holds for light
paraphrases. Weaker matches count only if the item's answer is given and found beside them; so do items
of few words, all of which must be there, as so few prove nothing by themselves.

A cosine bounds no subsequence, so an exact search follows for the items that retrieval has not found in
a document: where at most ``size - need`` words of an item are missing, at least HITS of its ``size - need
+ HITS`` rarest words lie in the stretch. It adds what retrieval has lost, and each row tells which way
it was found, so every run measures the recall of the retrieval.

Statistics of the corpus are a fixed-size table each task adds to. Items are searched in blocks of
a fixed number, each against all documents; only such a block and the directions are broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import block_sums, durable, ship, shipped, table

TERMS = 1 << 14
RANK = 48
PASSAGE = 64
BLOCK = 1024
ITEMS = 4096
LEAST_WORDS = 5
COSINE, SHORT_COSINE = 0.45, 0.15
CELL = 4  # words: windows begin and end at multiples of it
SLAB = 1 << 12  # cells that are searched at a time
SHORT = 16  # words of an item below which SHORT_COSINE counts and windows of more than its length are searched too
LONGER = 1.6
LADDER = 1.25  # from one window length to the next
_HELD = 1 << 10
_ROWS = 1 << 12  # words that are projected at a time, so that their vectors stay in the cache
STRONG, WEAK = 0.7, 0.5
EXTRA = 8
HITS = 3
MOST_HITS = 1 << 22  # that are held at a time
_PIECE = 1 << 20
_PLAIN = tk.LOWER.copy()
_PLAIN[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = 32
_FOUND = "doc_id long, item_id long, cosine double, lcs double, answer_found boolean, retrieved boolean"


def _terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(13)) & np.uint64(TERMS - 1)


def _blocks(rows: np.ndarray, seen: float):
    for k in range(0, len(rows), BLOCK):
        yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([seen], pa.float64()), pa.array([rows[k : k + BLOCK].astype(np.float32).tobytes()], pa.binary())], names=["block", "seen", "data"])


_BLOCK_SCHEMA = "block int, seen double, data binary"


def _sum_blocks(batches):
    total: dict[int, list] = {}
    for batch in batches:
        for k, seen, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            x = np.frombuffer(data, np.float32).astype(np.float64)
            total[k] = [total[k][0] + seen, total[k][1] + x] if k in total else [seen, x]
    for k, (seen, x) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([seen], pa.float64()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["block", "seen", "data"])


def _gather(docs: DataFrame, f, columns: int) -> tuple[float, np.ndarray]:
    """Sum over tasks of a TERMS x columns table, one fixed-size part a task."""
    found = block_sums(docs.select("text").mapInArrow(f, _BLOCK_SCHEMA), _sum_blocks, TERMS // BLOCK).toArrow()
    out, seen = np.zeros((TERMS, columns)), 0.0
    for k, s, data in zip(*(found.column(i).to_pylist() for i in range(3))):
        out[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(data, np.float32).reshape(-1, columns)
        seen = s
    return seen, out


def _row_sums(weighted: np.ndarray, term: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """For each row of places the sum of the vectors of their terms."""
    out = np.empty((len(grid), weighted.shape[1]), np.float32)
    step = max(1, _ROWS // grid.shape[1])
    for k in range(0, len(grid), step):
        np.einsum("ijk->ik", weighted.take(term[grid[k : k + step]], axis=0), out=out[k : k + step])
    return out


def _passages(w: tk.Words) -> np.ndarray:
    """The passage number of each word: PASSAGE words of one text each, the last one shorter."""
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    inside = (np.arange(len(w.hashes)) - w.off[:-1][text]) // PASSAGE
    return np.cumsum(np.append(False, (inside[1:] != inside[:-1]) | (text[1:] != text[:-1]))) if len(text) else text


def _frequencies(batches):
    df, n = np.zeros(TERMS), 0
    for part in tk.pieces(batches, limit=_PIECE):
        w = tk.words(part.column("text"), mapping=_PLAIN)
        if len(w.hashes):
            p, t = _passages(w), _terms(w.hashes).astype(np.uint16)
            order = np.argsort(t, kind="stable")  # places of one term side by side, passages in order
            p, t = p[order], t[order]
            new = np.append(True, (t[1:] != t[:-1]) | (p[1:] != p[:-1]))
            df += np.bincount(t[new], minlength=TERMS)
            p = p.max(keepdims=True)
            n += int(p[-1]) + 1
    yield from _blocks(df[:, None], float(n))


def _covariance(model):
    def run(batches):
        idf, omega = shipped(model)
        weighted = np.vstack([omega * idf[:, None], np.zeros((1, RANK), np.float32)])
        out, n = np.zeros((TERMS, RANK)), 0
        for part in tk.pieces(batches, limit=_PIECE):
            w = tk.words(part.column("text"), mapping=_PLAIN)
            if not len(w.hashes):
                continue
            t, p = _terms(w.hashes).astype(np.uint16), _passages(w)
            # sums over rows of one length are several times as fast as over runs of any length
            grid, _ = tk.grid(np.bincount(p), PASSAGE)
            x = _row_sums(weighted, np.append(t, TERMS), grid)
            # squared lengths of the passages, as the random directions show them
            x /= np.maximum((x * x).sum(1, keepdims=True) * (TERMS / RANK), 1e-9)
            order = np.argsort(t, kind="stable")
            held = np.bincount(t, minlength=TERMS)
            terms = np.flatnonzero(held)
            grid, first = tk.grid(held[terms], 8)
            x = np.vstack([x, np.zeros((1, RANK), np.float32)])
            out[terms] += np.add.reduceat(_row_sums(x, np.append(p[order], len(x) - 1), grid), first, axis=0)
            n += len(x) - 1
        yield from _blocks(out * idf[:, None], float(n))

    return run


def directions(docs: DataFrame, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Each term's idf, and TERMS x RANK: its idf times its place in the leading directions of all passages.

    Directions are scaled to equal variance: the first ones tell languages and styles apart, which
    says nothing about who copied from whom.
    """
    n, df = _gather(docs, _frequencies, 1)
    idf = np.log1p(n / (df[:, 0] + 1)).astype(np.float32)
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((TERMS, RANK)))[0].astype(np.float32)
    _, y = _gather(docs, _covariance(ship(docs.sparkSession, (idf, omega))), RANK)
    y += 1e-6 * max(np.abs(y).max(), 1e-12) * omega  # keeps the small matrix definite
    core = omega.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    scale = np.where(values > 1e-9 * max(values.max(), 1e-30), 1 / np.sqrt(np.maximum(values, 1e-300)), 0)
    u, size, _ = np.linalg.svd(y @ (vectors * scale), full_matrices=False)
    return idf, (idf[:, None] * u * np.where(size > 1e-4 * size[0], 1 / np.maximum(size, 1e-12), 0)).astype(np.float32)


def lcs_length(masks: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    ones = (1 << size) - 1
    v = ones
    for word in text:
        m = masks.get(word)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & ones
    return size - v.bit_count()


def stretches(masks: dict[int, int], size: int, reach: int, text: list[int], least: int):
    """(start, stop, length of the longest common subsequence) of the stretches that reach ``least``.

    One for each place in ``text`` with a word of the item: of the next ``reach`` words, those up to
    the last one that makes the subsequence longer.
    """
    hits = [(k, masks[word]) for k, word in enumerate(text) if word in masks]
    ones = (1 << size) - 1
    stop = 0
    if lcs_length(masks, size, [text[k] for k, _ in hits]) < least:
        return
    for first, (start, _) in enumerate(hits):
        while stop < len(hits) and hits[stop][0] < start + reach:
            stop += 1
        if stop - first < least:
            continue
        v, end = ones, start
        for k, m in hits[first:stop]:
            u = v & m
            x = ((v + u) | (v - u)) & ones
            if x.bit_count() < v.bit_count():
                end = k + 1
            v = x
        if size - v.bit_count() >= least:
            yield start, end, size - v.bit_count()


def _joined(item: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges in order by item and text, those that overlap made one."""
    if not len(item):
        return item, text, begin, end
    # both ends only grow within an item and a text, so a range is new where it begins beyond the one before
    new = np.append(True, (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (begin[1:] > end[:-1]))
    return item[new], text[new], begin[new], end[np.append(new[1:], True)]


def _window(words: float) -> int:
    """Cells of the windows for so many words: the nearest step of the ladder."""
    return round(LADDER ** round(np.log(max(words / CELL, 1)) / np.log(LADDER)))


class Items:
    """A block of benchmark items: words, answers, latent vectors by window length, and their rarest words."""

    def __init__(self, ids: list[int], texts: list[str], answers: list[str | None], idf: np.ndarray, latent: np.ndarray):
        w = tk.words(pa.array(texts, pa.string()), mapping=_PLAIN)
        a = tk.words(pa.array(answers, pa.string()), mapping=_PLAIN)
        self.ids, self.words, self.masks, self.answers, self.least, self.strong, vectors, rare, hits = [], [], [], [], [], [], [], [], []
        for i, item in enumerate(ids):
            h = w.hashes[w.off[i] : w.off[i + 1]]
            answer = a.hashes[a.off[i] : a.off[i + 1]].tolist()
            few = len(h) < LEAST_WORDS
            if not len(h) or few and not answer:
                continue
            masks: dict[int, int] = {}
            for k, x in enumerate(h.tolist()):
                masks[x] = masks.get(x, 0) | 1 << k
            self.ids.append(item)
            self.words.append(len(h))
            self.masks.append(masks)
            self.answers.append(answer)
            self.strong.append(2.0 if few else STRONG)  # no share alone is enough for a short item
            share = 1.0 if few else WEAK if answer else STRONG
            self.least.append(next(n for n in range(len(h) + 1) if n / len(h) >= share))
            hits.append(min(HITS, self.least[-1]))
            rare.append(np.unique(h[np.lexsort((h, -idf[_terms(h)]))][: len(h) - self.least[-1] + hits[-1]]))
            v = latent[_terms(h)].sum(0, dtype=np.float64)
            vectors.append(v / max(np.linalg.norm(v), 1e-12))
        self.vectors, self.hits = vectors, np.array(hits, np.int64)
        self.reach = 2 * np.array(self.words, np.int64) + EXTRA
        self.rare, self.rare_word = np.unique(np.concatenate(rare), return_inverse=True) if rare else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.rare_item = np.repeat(np.arange(len(rare)), [len(x) for x in rare])
        lengths: dict[int, list[int]] = {}
        for i, size in enumerate(self.words):
            for cells in {_window(size), _window(LONGER * size if size < SHORT else size)}:
                lengths.setdefault(cells, []).append(i)
        cosine = np.where(np.array(self.words) < SHORT, SHORT_COSINE, COSINE).astype(np.float32)
        self.windows = [(cells, np.array(index), np.stack([vectors[i] for i in index]).astype(np.float32), cosine[index]) for cells, index in sorted(lengths.items())]
        # which of the rare words an item may have, by the last bits of their numbers
        self.held = np.zeros((len(self.ids), _HELD), bool)
        self.held[self.rare_item, self.rare_word & (_HELD - 1)] = True

    def seldom(self, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """The places of all items' rare words, in order, and their numbers."""
        if not len(self.rare):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.rare, w.hashes), len(self.rare) - 1)
        place = np.flatnonzero(self.rare[at] == w.hashes)
        return place, at[place]

    def alike(self, w: tk.Words, latent: np.ndarray, seldom: tuple[np.ndarray, np.ndarray]):
        """(item, text, begin, end): where a stretch must lie that meets a window whose cosine with the item is high.

        Left out are those that the subsequence cannot accept, as they have too few of the item's rarest words.
        """
        if not self.ids or not len(w.hashes):
            return
        cells = -(-w.counts // CELL)
        off = np.append(0, np.cumsum(cells))
        text = np.repeat(np.arange(len(cells)), cells)
        nth = np.arange(off[-1]) - off[text]
        grid, _ = tk.grid(w.counts, CELL)
        weighted = np.vstack([latent, np.zeros((1, latent.shape[1]), np.float32)])
        term = np.append(_terms(w.hashes).astype(np.uint16), TERMS)
        for slab in range(0, off[-1], SLAB):
            mine = np.arange(slab, min(slab + SLAB, off[-1]))
            x = _row_sums(weighted, term, grid[slab : slab + SLAB + self.windows[-1][0]])
            total = np.zeros((len(x) + 1, x.shape[1]), np.float32)
            np.cumsum(x, axis=0, out=total[1:])
            for length, index, vectors, least in self.windows:
                step = max(1, round(length / 3))
                # from every step of a text until one window has its end
                starts = mine[(nth[mine] % step == 0) & ((nth[mine] == 0) | (nth[mine] + length - step < cells[text[mine]]))]
                few = max(1, MOST_HITS // len(index))
                for k in range(0, len(starts), few):
                    start = starts[k : k + few]
                    stop = np.minimum(start + length, off[text[start] + 1])
                    x = total.take(stop - slab, axis=0)
                    x -= total.take(start - slab, axis=0)
                    size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                    at, item = np.divmod(np.flatnonzero((x @ vectors.T >= np.maximum(size, 1e-12) * least).ravel()), len(index))
                    order = np.argsort(item, kind="stable")
                    item, at = index[item[order]], at[order]
                    t = text[start[at]]
                    begin = (nth[start[at]] * CELL) + w.off[t] - self.reach[item]
                    end = (stop[at] - off[t]) * CELL + w.off[t] + self.reach[item]
                    yield from self._possible(*seldom, *_joined(item, t, np.maximum(begin, w.off[t]), np.minimum(end, w.off[t + 1])))

    def _possible(self, place: np.ndarray, number: np.ndarray, item: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Those of the ranges in which a stretch has as many of the item's rarest words as it must have."""
        first, last = np.searchsorted(place, begin), np.searchsorted(place, end)
        part = np.cumsum(last - first) // MOST_HITS
        for k in np.unique(part):
            mine = np.flatnonzero(part == k)
            n = (last - first)[mine]
            each = np.repeat(mine, n)
            at = np.arange(len(each)) + np.repeat(first[mine] - np.cumsum(n) + n, n)
            ok = self.held.ravel()[item[each] * _HELD + (number[at] & (_HELD - 1))]
            each, p = each[ok], place[at[ok]]
            to = np.arange(len(p)) + self.hits[item[each]] - 1
            of = np.flatnonzero(to < len(p))
            to = to[of]
            ok = (each[to] == each[of]) & (p[to] - p[of] < self.reach[item[each[of]]])
            mine = np.unique(each[of[ok]])
            yield from zip(item[mine].tolist(), text[mine].tolist(), begin[mine].tolist(), end[mine].tolist())

    def near(self, w: tk.Words, seldom: tuple[np.ndarray, np.ndarray]):
        """(item, text, begin, end) in order: where a stretch that is near an item must lie within."""
        if not len(self.rare):
            return
        place, number = seldom
        order = np.argsort(number, kind="stable")
        begin = np.searchsorted(number[order], np.arange(len(self.rare) + 1))
        place = place[order]
        text = np.repeat(np.arange(len(w.counts)), w.counts)
        many = (begin[1:] - begin[:-1])[self.rare_word]
        part = np.cumsum(np.bincount(self.rare_item, many, len(self.ids))) // MOST_HITS
        for k in np.unique(part):
            mine = np.flatnonzero(part[self.rare_item] == k)
            n = many[mine]
            item = np.repeat(self.rare_item[mine], n)
            p = place[np.repeat(begin[self.rare_word[mine]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            order = np.lexsort((p, item))
            item, p = item[order], p[order]
            last = np.arange(len(p)) + self.hits[item] - 1
            first = np.flatnonzero(last < len(p))
            last = last[first]
            ok = (item[last] == item[first]) & (text[p[last]] == text[p[first]]) & (p[last] - p[first] < self.reach[item[first]])
            i, a, b = item[first[ok]], p[first[ok]], p[last[ok]]
            t = text[a]
            a, b = np.maximum(b - self.reach[i] + 1, w.off[t]), np.minimum(a + self.reach[i], w.off[t + 1])
            yield from zip(*(x.tolist() for x in _joined(i, t, a, b)))


def _holds(text: list[int], answer: list[int]) -> bool:
    return bool(answer) and any(text[i : i + len(answer)] == answer for i in range(len(text) - len(answer) + 1))


def _search(model):
    def run(batches):
        items, latent = shipped(model)
        for part in tk.pieces(batches, limit=_PIECE):
            w = tk.words(part.column("text"), mapping=_PLAIN)
            best: dict[tuple[int, int], tuple[float, bool, int, int, bool]] = {}
            seldom = items.seldom(w)
            ways = (True, items.alike(w, latent, seldom)), (False, items.near(w, seldom))
            for by_cosine, (item, doc, begin, end) in ((way, x) for way, ranges in ways for x in ranges):
                size, strong, until = items.words[item], items.strong[item], end
                now = best.get((doc, item), (0.0, False, 0, 0, False))
                if now[0] >= strong:
                    continue
                for a, b, length in stretches(items.masks[item], size, int(items.reach[item]), w.hashes[begin:end].tolist(), items.least[item]):
                    a, b, share = a + begin, b + begin, length / size
                    if a > until:  # a strong match is behind
                        break
                    around = w.hashes[max(w.off[doc], a - 2 * size) : min(w.off[doc + 1], b + 2 * size)].tolist()
                    answered = _holds(around, items.answers[item])
                    if now[0] < strong <= share:
                        until = a + int(items.reach[item])
                    # strong before weak, then those with the answer beside them, then the longest
                    if (share >= strong, answered, share) > (now[0] >= strong, now[1], now[0]):
                        now = (share, answered, a, b, now[4] or by_cosine and (share >= strong or answered))
                best[doc, item] = now
            found = []
            for (doc, item), (share, answered, a, b, retrieved) in sorted(best.items()):
                if share >= items.strong[item] or answered:
                    v = latent[_terms(w.hashes[a:b])].sum(0, dtype=np.float64)
                    found.append((doc, item, float(v @ items.vectors[item] / max(np.linalg.norm(v), 1e-12)), share, answered, retrieved))
            doc = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()).take(doc), pa.array([items.ids[x[1]] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64()), pa.array([x[3] for x in found], pa.float64()), pa.array([x[4] for x in found], pa.bool_()), pa.array([x[5] for x in found], pa.bool_())], names=["doc_id", "item_id", "cosine", "lcs", "answer_found", "retrieved"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer_found, retrieved) of each document that holds a benchmark item.

    Reads (doc_id, text) and (item_id, text, and answer if there is one). A row of ``docs`` gives
    at most one row an item; repeated rows are searched alike, very long texts whole. Null and empty texts
    match nothing; items of fewer than five words match only with their answer. Repeated items are items
    of their own. Answers (words in a row) are looked for within twice the item's length around a stretch
    and may be null. Without documents or items nothing is found. Other columns are not read. ``retrieved``
    is false in rows that only the exact search has found.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = durable(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer")).where("text is not null").withColumn("_row", F.monotonically_increasing_id()), "items")
    idf, latent = directions(docs)
    out, at = None, -1
    while True:
        block = items.where(F.col("_row") > at).orderBy("_row").limit(ITEMS).collect()
        if block or out is None:
            model = ship(spark, (Items([r.item_id for r in block], [r.text for r in block], [r.answer for r in block], idf, latent), latent))
            found = docs.mapInArrow(_search(model), _FOUND)
            out = found if out is None else out.union(found)
        if len(block) < ITEMS:
            return out
        at = block[-1]["_row"]


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
