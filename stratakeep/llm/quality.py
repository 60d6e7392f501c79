"""Quality rules by weak supervision.

Rules look at one text and vote keep (1), reject (-1) or abstain (0). How often each rule votes
which way on good and on bad texts is not given: expectation-maximisation over the vote patterns
of all documents estimates it, and a text is kept if its posterior probability of being good is
at least one half. Rules that reject together support each other, so each kind of junk is looked at in two
ways or more; one that rejects alone, however often, is learnt to be noisy and overruled by the others.
Only pattern counts leave the executors, at most 3 ** rules rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import durable, table, unused

#: Share of rejections among a rule's votes on bad and on good texts, as believed before any text is seen, and for how many votes that belief stands.
BELIEF, VOTES = (0.3, 0.02), 20.0
SYMBOLS = b"#*$%&|<>"
RULES = ("symbols", "symbol_words", "repeats", "echoes", "dup_lines", "length", "word_length", "shouting", "marks", "sentences")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, pattern int"
_ARROW = pa.schema([("doc_id", pa.int64()), *[(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("pattern", pa.int32())])


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[off[1:]] - run[off[:-1]]


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words covered by a window of ``width`` words that occurs twice or more in the same text."""
    w = tk.window_hashes(hashes, width)
    if len(w) < 2:
        return 0
    order = np.argsort(w)
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    both = np.zeros(len(w), bool)
    both[1:] |= same
    both[:-1] |= same
    return int(tk.covered(order[both], width, len(hashes)).sum())


def duplicate_lines(body: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    lines = [x for x in body.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines)), len(lines)


def _votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One column of votes a rule, in the order of RULES."""
    n, one = m["n_words"], np.maximum(m["n_words"], 1)
    share = m["n_symbols"] / np.maximum(m["word_chars"], 1)
    repeats, dup = m["n_repeat_words"] / one, m["n_dup_lines"] / np.maximum(m["n_lines"], 1)
    mean, upper = m["word_chars"] / one, m["n_upper"] / np.maximum(m["n_letters"], 1)
    marks, stops = m["n_marks"] / one, m["n_stops"] / one
    odd, echoes = m["n_symbol_words"] / one, m["n_echoes"] / one
    rules = (
        (share < 0.01, share > 0.05),
        (odd < 0.02, odd > 0.15),
        (repeats < 0.05, repeats > 0.2),
        (echoes < 0.02, echoes > 0.15),
        (dup < 0.05, (dup > 0.3) & (m["n_dup_lines"] >= 3)),
        (n >= 60, n < 20),
        ((mean > 3) & (mean < 9), (mean < 2.2) | (mean > 14)),
        (upper < 0.2, upper > 0.5),
        (marks < 0.02, marks > 0.15),
        (stops > 0.005, (stops == 0) & (n >= 30)),
    )
    return np.stack([np.where(no, -1, np.where(yes, 1, 0)) for yes, no in rules], 1)


def measure(batches):
    """Arrow batches of (doc_id, text) to metrics, base verdict and vote pattern."""
    for part, m, failed, pattern in _measured(batches, "text"):
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *[pa.array(m[k]) for k in _ARROW.names[1:6]], failed, pattern], schema=_ARROW)


def _annotate(names: list[str]):
    """Arrow batches with ``text`` to the same rows with the base verdict and vote pattern behind, called ``names``."""

    def run(batches):
        for part, _, failed, pattern in _measured(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, failed, pattern], names=[*part.schema.names, *names])

    return run


def _measured(batches, text):
    for part in tk.pieces(batches, text):
        w = tk.words(part.column(text))
        body, off = w.body, w.text_off
        data = body.tobytes()
        n = w.counts
        lines = [duplicate_lines(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        bang = np.zeros(len(body), bool)
        bang[w.ends - 1] = np.isin(body[w.ends - 1], [33, 63])
        odd = np.zeros(len(body), bool)
        odd[w.ends - 1] = _SYMBOL[body[w.ends - 1]]
        echo = np.zeros(len(body), bool)
        again = np.flatnonzero(w.hashes[1:] == w.hashes[:-1]) + 1
        echo[w.starts[again[~np.isin(again, w.off)]]] = True
        stop = np.zeros(len(body), bool)
        stop[w.ends - 1] = body[w.ends - 1] == 46
        m = {
            "n_words": n,
            "word_chars": _per_text(~tk.SPACE[body] & ((body & 0xC0) != 0x80), off),
            "n_symbols": _per_text(_SYMBOL[body], off),
            "n_dup_lines": np.array([x for x, _ in lines], np.int64),
            "n_lines": np.array([x for _, x in lines], np.int64),
            "n_repeat_words": np.array([repeated_words(w.hashes[a:b]) for a, b in zip(w.off[:-1].tolist(), w.off[1:].tolist())], np.int64),
            "n_upper": _per_text(_UPPER[body], off),
            "n_letters": _per_text(_LETTER[body], off),
            "n_symbol_words": _per_text(odd, off),
            "n_echoes": _per_text(echo, off),
            "n_marks": _per_text(bang, off),
            "n_stops": _per_text(stop, off),
        }
        pattern = ((_votes(m) + 1) * 3 ** np.arange(len(RULES))).sum(1)
        failed = (n < 10) | (100 * m["n_repeat_words"] > 20 * n)
        yield part, m, pa.array(failed), pa.array(pattern.astype(np.int32))


def fit(counts: dict[int, int], rules: int = len(RULES), rounds: int = 100) -> dict[int, float]:
    """Posterior probability of being good for each vote pattern, by expectation-maximisation.

    Abstaining says nothing about a text. Starts from BELIEF, that rules are right more often than not,
    which also stands in for some VOTES. That a rule rejects bad texts more often than good ones is all
    that is held; how noisy a rule is comes from how far the other rules agree with it.
    """
    if not counts:
        return {}
    patterns = np.array(sorted(counts))
    n = np.array([counts[int(p)] for p in patterns], float)
    vote = (patterns[:, None] // 3 ** np.arange(rules)) % 3  # 0 reject, 1 abstain, 2 keep
    no, yes = (vote == 0).astype(float), (vote == 2).astype(float)
    reject = np.repeat(np.array(BELIEF)[:, None], rules, 1)  # of the votes cast, on bad and on good texts
    good = 0.85
    posterior = np.zeros(len(n))
    for _ in range(rounds):
        log = no @ np.log(reject).T + yes @ np.log(1 - reject).T + np.log([1 - good, good])
        posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        for y, p in enumerate((1 - posterior, posterior)):
            against, votes = (n * p) @ no, (n * p) @ (no + yes)
            reject[y] = (against + VOTES * BELIEF[y]) / (votes + VOTES)
        reject = np.clip(reject, 1e-6, 0.99)
        reject[1] = np.minimum(reject[1], reject[0])
        good = float(np.clip(((n * posterior).sum() + 0.85 * VOTES) / (n.sum() + VOTES), 0.02, 0.98))
    return dict(zip(patterns.tolist(), posterior.tolist()))


def judge_quality(docs: DataFrame) -> DataFrame:
    """Metrics, ``p_good`` and ``kept`` for each row of (doc_id, text).

    Null and empty texts have no words and fail the base rules; null and repeated ids are rows like any other.
    Repeated rows are judged alike, very long texts whole. Input of no rows gives none. Other columns are not read.
    """
    seen = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, _SCHEMA), "quality")
    posterior = _posterior(seen, "pattern")
    judged = seen.join(F.broadcast(posterior), F.col("pattern") == F.col("p"), "left").drop("p")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def _posterior(seen: DataFrame, pattern: str) -> DataFrame:
    """(p, p_good) of each vote pattern in ``seen``: 3 ** rules rows at most."""
    counts = {r["p"]: r["n"] for r in seen.groupBy(F.col(pattern).alias("p")).agg(F.count("*").alias("n")).collect()}
    return seen.sparkSession.createDataFrame(list(fit(counts).items()), "p int, p_good double")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever they are called; see :func:`judge_quality`."""
    names = unused(docs, "base_failed", "pattern", "p")
    added = [T.StructField(names[0], T.BooleanType()), T.StructField(names[1], T.IntegerType())]
    patterns = docs.select("text").mapInArrow(_annotate(names[:2]), T.StructType([docs.select("text").schema[0], *added])).select(names[1])
    good = _posterior(durable(patterns, "patterns"), names[1]).where("p_good >= 0.5").select(F.col("p").alias(names[2]))
    marked = docs.mapInArrow(_annotate(names[:2]), T.StructType([*docs.schema.fields, *added])).where(~F.col(names[0]))
    return marked.join(F.broadcast(good), F.col(names[1]) == F.col(names[2]), "left_semi").select(*docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
