"""LM scoring with a hashed maximum-entropy model.

A token's probability is P(class | context) * P(token | class). Classes group frequent words by the
group of documents (``hint``, here the language) that uses them most and by frequency rank; the end
token is a class, and so is the tail of rare and unknown words. P(class | context) is a softmax over
classes whose features are hashed: the previous word, the previous two, and a skip over one word. Each feature is a row of one weight a class in a
table of fixed size. That is the prior of a second model, which grows with the input: the counts of all
pairs of a word and the word behind it (frequent words, the end, and the tail as one) in the training
texts. With n of a word, m of a pair: (m + PRIOR * p) / (n + PRIOR), where p is the prior's probability.

Counts cover all training tokens. Training is distributed: in each round every task runs gradient
updates over its part of that round's documents from the same start, and weights are averaged by how
often each task saw each feature. All training documents are used once. What leaves a task is the
fixed-size table, added up in blocks; what reaches the driver is one table.

Pairs are dealt by their hash to as many parts as the training tokens ask for; what is asked of them goes
the same way, together with the rows it came from, and is answered part by part. No part is broadcast.

Words beyond the frequent ones, however many, are scored by a join with their counts; the frequent
ones and the weights are broadcast, bounded by HEAD and ROWS.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import block_sums, durable, ship, shipped, table

HEAD = 1 << 18
HINTS = 8
BANDS = 8
SIZES = (4096, 8192, 4096)  # rows for: previous word, previous two words, skip over one word
ROWS = sum(SIZES)
BLOCK = 1024
BATCH = 4096
ROUNDS = 2
RATE = 0.7
PRIOR = 100.0
PART_TOKENS = 1 << 20  # training tokens a part of the pairs
MOST_PARTS = 1 << 15
KEY_BYTES = 5
STEPS = 2000  # of a unit of log10 that a prior probability travels in
_RANGE = np.uint64(44)
END = np.uint64(0xE0D0E0D0E0D0E0D1)
_START = np.uint64(0x57A2757A2757A27)
_TAIL = np.uint64(0x7A117A117A117A1)
_COUNTS = "h long, hint int, n long"
_PART = "block int, seen binary, weights binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, head_known long, base_head double, model_head double, tail array<long>, _row long"
_ASKED = "part int, kind int, piece long, keys binary, rows binary, p binary"
_ANSWERS = "kind int, piece long, rows binary, gain binary"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each ended by END, and the texts' offsets into them."""
    w = tk.words(column, lower=True)
    off = w.off + np.arange(len(w.off))
    out = np.empty(len(w.hashes) + len(w.off) - 1, np.uint64)
    inner = np.ones(len(out), bool)
    inner[off[1:] - 1] = False
    out[inner] = w.hashes
    out[~inner] = END
    return out, off


def features(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of the weight table that each token's context selects, one column a feature."""
    begin = np.repeat(off[:-1], np.diff(off))
    place = np.arange(len(h)) - begin
    prev = []
    for k in (1, 2):
        x = np.full(len(h), _START)
        x[k:] = np.where(place[k:] >= k, h[:-k], _START)
        prev.append(x)
    keys = (prev[0], prev[0] * np.uint64(0x9E3779B97F4A7C15) + prev[1], prev[1])
    base = np.cumsum((0, *SIZES[:-1]))
    return np.stack([(tk.mix(x + np.uint64(71 * j + 5)) % np.uint64(s)).astype(np.int32) + b for j, (x, s, b) in enumerate(zip(keys, SIZES, base.tolist()))], 1)


class Vocabulary:
    """Frequent words: sorted hashes, counts, classes; class 0 is the tail."""

    def __init__(self, h: np.ndarray, n: np.ndarray, hint: np.ndarray, total: int):
        order = np.argsort(h)
        self.h, self.n, hint = h[order], n[order], hint[order]
        self.cls = np.zeros(len(h), np.int32)
        used = 1
        for g in np.unique(hint):
            mine = np.flatnonzero((hint == g) & (self.h != END))
            rank = np.empty(len(mine), np.int64)
            rank[np.lexsort((self.h[mine], -self.n[mine]))] = np.arange(len(mine))
            band = np.minimum(np.floor(np.log2(rank + 1) / 2).astype(int), BANDS - 1)
            if len(mine):
                self.cls[mine] = used + band
                used += int(band.max()) + 1
        self.cls[self.h == END] = used
        self.classes = used + 1
        mass = np.bincount(self.cls, self.n.astype(float), self.classes)
        self.log_in_class = np.log10(self.n / mass[self.cls]) if len(h) else np.zeros(0)
        mass[0] = max(total - mass[1:].sum(), 0)
        self.bias = np.log((mass + 0.5) / (total + 0.5 * self.classes)).astype(np.float32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where it is not among the frequent ones."""
        if not len(self.h):
            return np.full(len(h), -1)
        if not hasattr(self, "begin"):  # where each range of hashes begins; most hold one at most
            self.begin = np.append(0, np.cumsum(np.bincount((self.h >> _RANGE).astype(np.int64), minlength=1 << 20))).astype(np.int32)
        of = (h >> _RANGE).astype(np.int64)
        at = self.begin[of]
        found = self.h[np.minimum(at, len(self.h) - 1)] == h
        out = np.where(found, at, -1)
        rest = np.flatnonzero(~found)
        end = self.begin[of[rest] + 1]
        at = at[rest] + 1
        while True:
            more = at < end
            rest, at, end = rest[more], at[more], end[more]
            if not len(rest):
                return out
            same = self.h[at] == h[rest]
            out[rest[same]] = at[same]
            rest, at, end = rest[~same], at[~same] + 1, end[~same]


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = weights.take(rows[:, 0], axis=0)
    x += bias
    for j in range(1, rows.shape[1]):
        x += weights.take(rows[:, j], axis=0)
    x -= x.max(1, keepdims=True)
    return x


def log_of_class(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each token's class."""
    x = _logits(weights, bias, rows)
    own = x[np.arange(len(y)), y]
    return own - np.log(np.exp(x, out=x).sum(1))


def train_step(weights: np.ndarray, bias: np.ndarray, seen: np.ndarray, rows: np.ndarray, y: np.ndarray) -> None:
    """One gradient update: each row takes its mean gradient, at a rate that falls with how often this task has seen it."""
    g = _logits(weights, bias, rows)
    np.exp(g, out=g)
    g /= g.sum(1, keepdims=True)
    g[np.arange(len(y)), y] -= 1
    for j in range(rows.shape[1]):
        order = np.argsort(rows[:, j].astype(np.uint16), kind="stable")
        row = rows[order, j]
        last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
        at, times = row[last], np.diff(last, prepend=-1).astype(np.float32)
        seen[at] += times
        # differences of running sums: rounding is far below a gradient, and sums over runs take several times as long
        total = np.cumsum(g.take(order, axis=0), axis=0).take(last, axis=0)
        total[1:] -= total[:-1].copy()
        total *= (np.float32(RATE) / np.sqrt(seen[at] * times))[:, None]
        weights[at] -= total


def _count(batches):
    store: dict[int, list] = {}

    def merged():
        for hint, parts in store.items():
            h, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            yield hint, h, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)

    def rows(found):
        for hint, h, n in found:
            for a in range(0, len(h), 1 << 16):
                b = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(h[b])), pa.array(np.full(len(h[b]), hint, np.int32)), pa.array(n[b])], names=["h", "hint", "n"])

    held = 0
    for part in tk.pieces(batches):
        h, off = tokens(part.column("text"))
        of = np.repeat(part.column("hint").to_numpy(zero_copy_only=False), np.diff(off))
        for hint in np.unique(of).tolist():
            x, n = np.unique(h[of == hint], return_counts=True)
            store.setdefault(hint, []).append((x, n))
            held += len(x)
        if held > 1 << 21:
            now = list(merged())
            held = sum(len(h) for _, h, _ in now)
            if held > 1 << 20:
                yield from rows(now)
                now, held = [], 0
            store = {hint: [(h, n)] for hint, h, n in now}
    yield from rows(merged())


def _train(model):
    def run(batches):
        vocabulary, weights = shipped(model)
        weights = weights.copy()
        seen = np.zeros(ROWS, np.float32)
        draw = np.random.default_rng(7)
        for part in tk.pieces(batches):
            h, off = tokens(part.column("text"))
            at = vocabulary.find(h)
            y = np.where(at >= 0, vocabulary.cls[at] if len(vocabulary.cls) else 0, 0)
            rows = features(h, off)
            order = draw.permutation(len(h))
            for a in range(0, len(h), BATCH):
                b = order[a : a + BATCH]
                train_step(weights, vocabulary.bias, seen, rows[b], y[b])
        if seen.any():
            for k in range(0, ROWS, BLOCK):
                s = seen[k : k + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([s.tobytes()], pa.binary()), pa.array([(weights[k : k + BLOCK] * s[:, None]).astype(np.float32).tobytes()], pa.binary())], names=["block", "seen", "weights"])

    return run


def _add_blocks(batches):
    """Sums of each block's parts; a partition holds whole blocks, whose number and size are fixed."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for k, s, w in zip(*(batch.column(i).to_pylist() for i in range(3))):
            now = [np.frombuffer(x, np.float32) for x in (s, w)]
            total[k] = [a + b for a, b in zip(total[k], now)] if k in total else now
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *[pa.array([v[i].tobytes() for v in total.values()], pa.binary()) for i in (0, 1)]], names=["block", "seen", "weights"])


def _pairs(h: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each token and the one before it; words that are not frequent are one as the second of a pair."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[off[:-1]] = _START
    return tk.mix(before * np.uint64(0x9E3779B97F4A7C15) + np.where(at >= 0, h, _TAIL))


def _dealt(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by part, the parts that occur, and where each begins (and the last ends)."""
    part = ((key >> np.uint64(44)) % np.uint64(parts)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    part = part[order]
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return order, part[begin], np.append(begin, len(part))


def _packed(key: np.ndarray) -> np.ndarray:
    """The lower KEY_BYTES of each hash; a part holds about PART_TOKENS pairs, however many parts there are."""
    return np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]


def _unpacked_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64)[:, 0]


def _asked_rows(kind: int, piece: int, names: np.ndarray, begin: np.ndarray, keys, rows, p):
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary())
    fixed = lambda v, t: pa.array(np.full(len(names), v), t)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), fixed(kind, pa.int32()), fixed(piece, pa.int64()), cut(keys), cut(rows), cut(p)], names=["part", "kind", "piece", "keys", "rows", "p"])


def _count_pairs(model, parts: int):
    def run(batches):
        vocabulary = shipped(model)[0]
        none = np.zeros(0, np.uint8)
        held, size = [], 0

        def rows():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            order, names, begin = _dealt(key, parts)
            return _asked_rows(0, 0, names, begin, _packed(key[order]), none, n[order].astype(np.uint32))

        for part in tk.pieces(batches):
            h, off = tokens(part.column("text"))
            held.append(_pairs(h, off, vocabulary.find(h)))
            size += len(h)
            if size > 1 << 21:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    return run


def _answer(batches):
    """Per piece and part, the log10 by which the pairs raise the prior; counts of a part come first, then questions, then scores, which pass."""
    now, found, n = None, [], []
    odds = 10.0 ** (np.arange(1 << 16) / STEPS) / PRIOR
    for batch in batches:
        for part, kind, piece, keys, rows, p in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if part != now:
                now, found, n = part, [], []
            if kind == 0:
                found.append(_unpacked_keys(keys))
                n.append(np.frombuffer(p, np.uint32))
                continue
            if kind == 2:
                yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([piece]), pa.array([b""], pa.binary()), pa.array([p], pa.binary())], names=["kind", "piece", "rows", "gain"])
                continue
            if not len(found):
                continue
            if isinstance(found, list):
                found, place = np.unique(np.concatenate(found), return_inverse=True)
                n = np.bincount(place, np.concatenate(n))
            key = _unpacked_keys(keys)
            rows = np.frombuffer(rows, np.uint16 if len(rows) == 2 * len(key) else np.int32)
            at = np.minimum(np.searchsorted(found, key), len(found) - 1)
            gain = np.log10(1 + np.where(found[at] == key, n[at], 0) * odds[np.frombuffer(p, np.uint16)])
            begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([piece]), pa.array([rows[begin].astype(np.int32).tobytes()], pa.binary()), pa.array([np.add.reduceat(gain, begin).astype(np.float32).tobytes()], pa.binary())], names=["kind", "piece", "rows", "gain"])


def _gains(batches):
    """(_g, pair_gain): sums of the answers by row, as far as a batch holds them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        piece, rows, gain = (batch.column(k).to_pylist() for k in ("piece", "rows", "gain"))
        rows, gain = [np.frombuffer(x, np.int32) for x in rows], [np.frombuffer(x, np.float32) for x in gain]
        row = np.repeat(np.array(piece, np.int64), [len(x) for x in rows]) + np.concatenate(rows)
        row, place = np.unique(row, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.bincount(place, np.concatenate(gain)))], names=["_g", "pair_gain"])


def _unpacked(batches):
    for batch in batches:
        for data in batch.column("gain").to_pylist():
            yield from pa.ipc.open_stream(data)


def _score(model, parts: int):
    """Scores of each row under the prior, and what the pairs are asked for; rows count from their piece's number."""

    def run(batches):
        vocabulary, weights = shipped(model)
        base = np.log10(vocabulary.n + 0.5)
        behind = np.log10(PRIOR / (vocabulary.n + PRIOR))
        piece = TaskContext.get().partitionId() << 40
        for part in tk.pieces(batches):
            h, off = tokens(part.column("text"))
            at = vocabulary.find(h)
            known = at >= 0
            y = np.zeros(len(h), np.int64)
            y[known] = vocabulary.cls[at[known]]
            rows = features(h, off)
            logp = np.empty(len(h))
            for a in range(0, len(h), BATCH):
                b = slice(a, a + BATCH)
                logp[b] = log_of_class(weights, vocabulary.bias, rows[b], y[b]) / np.log(10)
            of_base = np.zeros(len(h))
            of_base[known] = base[at[known]]
            logp[known] += vocabulary.log_in_class[at[known]]
            key = _pairs(h, off, at)
            order, names, begin = _dealt(key, parts)
            rows = np.repeat(np.arange(len(off) - 1, dtype=np.uint16 if len(off) <= 1 << 16 else np.int32), np.diff(off))
            yield _asked_rows(1, piece, names, begin, _packed(key[order]), rows[order], np.minimum(np.rint(-STEPS * logp), 65535).astype(np.uint16)[order])
            # the share that the prior keeps behind the word before; END stands for the start of a text, which is as frequent
            logp[known] += behind[at[known]]
            sums = [np.add.reduceat(x, off[:-1]) for x in (known.astype(np.int64), of_base, logp)]
            rest = np.flatnonzero(~known)
            tail = tk.list_array(tk.signed(h[rest]), np.searchsorted(rest, off))
            number = pa.array(piece + np.arange(part.num_rows, dtype=np.int64))
            out = pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(np.diff(off)), *map(pa.array, sums), tail, number], names=["doc_id", "held_out", "n_tokens", "head_known", "base_head", "model_head", "tail", "_row"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, out.schema) as stream:
                stream.write_batch(out)
            none = pa.array([b""], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([int(tk.mix_int(piece)) % parts], pa.int32()), pa.array([2], pa.int32()), pa.array([piece], pa.int64()), none, none, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "kind", "piece", "keys", "rows", "p"])
            piece += part.num_rows

    return run


def count_words(train: DataFrame) -> DataFrame:
    """(h, c, hint): every distinct training token, its count and the hint that uses it most."""
    counts = train.mapInArrow(_count, _COUNTS)
    per = [F.sum(F.when(F.col("hint") == i, F.col("n")).otherwise(0)) for i in range(HINTS)]
    wide = counts.groupBy("h").agg(F.sum("n").alias("c"), F.array(*per).alias("per"))
    return durable(wide.select("h", "c", (F.array_position("per", F.array_max("per")) - 1).cast("int").alias("hint")), "words")


def frequent(words: DataFrame, most: int = HEAD) -> int:
    """The least count, 2 or more, that at most ``most`` words reach."""
    step = F.floor(F.log(F.col("c").cast("double")) * 50).cast("int")
    levels = words.where("c > 1").groupBy(step.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for level in levels:
        total += level.n
        if total > most:
            break
        least = level.least
    return least if least is not None else 1 << 62


def score_texts(docs: DataFrame, hint: str | None = "lang", head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of (doc_id, text).

    Rows whose crc32 of the id as text leaves 1 modulo 5 are held out; a null id counts as the
    empty text, so it is trained on. Null and empty texts are one end token. Repeated rows are
    trained on and scored once each. ``hint`` names a column with few values (others, null and a
    missing column share one group). Without training rows the model is uniform over its classes.
    Only (doc_id, text, hint) are read.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    value = F.coalesce(F.col(hint).cast("string"), F.lit("")) if hint in docs.columns else F.lit("")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc % 5 == 1).alias("held_out"), (F.floor(crc / 5) % rounds).cast("int").alias("round"), value.alias("hint"))
    groups = [r.hint for r in docs.groupBy("hint").count().orderBy(F.desc("count"), "hint").limit(HINTS - 1).collect()]
    number = F.lit(HINTS - 1)
    for i, g in enumerate(groups):
        number = F.when(F.col("hint") == g, i).otherwise(number)
    docs = docs.withColumn("hint", number.cast("int"))
    train = docs.where(~F.col("held_out"))

    words = count_words(train.select("text", "hint"))
    least = frequent(words, head - 1)
    is_head = (F.col("c") >= least) | (F.col("h") == int(END.view(np.int64)))
    top = words.where(is_head).toArrow()
    whole = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0)).alias("once")).first()
    column = lambda k: top.column(k).to_numpy()
    vocabulary = Vocabulary(column("h").view(np.uint64), column("c"), column("hint"), whole.n)
    unknown = max(0.5, float(whole.once))  # as many unseen words are to be expected as words seen once

    weights = np.zeros((ROWS, vocabulary.classes), np.float32)
    for r in range(rounds if whole.n else 0):
        model = ship(spark, (vocabulary, weights))
        parts = train.where(F.col("round") == r).select("text").mapInArrow(_train(model), _PART)
        added = block_sums(parts, _add_blocks, ROWS // BLOCK).toArrow()
        for k, s, w in zip(*(added.column(i).to_pylist() for i in range(3))):
            s, w = np.frombuffer(s, np.float32), np.frombuffer(w, np.float32).reshape(-1, vocabulary.classes)
            rows = np.flatnonzero(s) + k * BLOCK
            weights[rows] = w[s > 0] / s[s > 0, None]
        model.unpersist()

    model = ship(spark, (vocabulary, weights))
    parts = int(min(MOST_PARTS, whole.n // PART_TOKENS + 8))
    pairs = train.select("text").mapInArrow(_count_pairs(model, parts), _ASKED)
    asked = pairs.union(docs.select("doc_id", "text", "held_out").mapInArrow(_score(model, parts), _ASKED))
    answers = durable(asked.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_answer, _ANSWERS), "answers")
    scored = durable(answers.where("kind = 2").mapInArrow(_unpacked, _SCORES), "scores")
    gains = answers.where("kind = 1").repartition("piece").mapInArrow(_gains, "_g long, pair_gain double").groupBy("_g").agg(F.sum("pair_gain").alias("pair_gain"))
    rare = words.where(~is_head).select(F.col("h").alias("_h"), "c")
    tail_mass = rare.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first().n
    tail = scored.where(F.size("tail") > 0).select("_row", F.explode("tail").alias("h")).join(rare, F.col("h") == F.col("_h"), "left")
    sums = tail.groupBy(F.col("_row").alias("_r")).agg(
        F.count("c").alias("rare_known"), F.count("*").alias("n_tail"),
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("base_tail"), F.sum(F.log10(F.coalesce(F.col("c").cast("double"), F.lit(unknown))) + F.log10(F.lit(PRIOR) / (F.coalesce("c", F.lit(0)) + PRIOR))).alias("model_tail"),
    )
    out = scored.join(sums, F.col("_row") == F.col("_r"), "left").join(gains, F.col("_row") == F.col("_g"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    base_all, tail_all = np.log10(whole.n + 0.5 * (whole.v + 1)), np.log10(tail_mass + unknown)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + zero("rare_known")).cast("long").alias("n_known"), F.lit(whole.n).cast("long").alias("train_tokens"),
        (F.col("base_head") + zero("base_tail") - F.col("n_tokens") * float(base_all)).alias("base_score"),
        (F.col("model_head") + zero("model_tail") + zero("pair_gain") - zero("n_tail") * float(tail_all)).alias("score"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
