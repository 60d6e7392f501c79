"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces of each word are only counted, never built. The vocabulary is a
byte trie. Each node has a failure link, the node reached after popping the greedy pieces that any
text which got stuck there must begin with, and the number of pieces popped; a walk follows each
byte once, so even one endless word takes linear time. Words that a task has met before are looked
up by hash in a cache of bounded size.
"""

from __future__ import annotations

import base64
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import ship, shipped, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 1 << 20
UNKNOWN = -1


class Automaton:
    """The trie with failure links and popped-piece counts of a vocabulary of byte strings."""

    def __init__(self, vocabulary: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for token in vocabulary:
            at = 0
            for c in token:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                at = self.next[at][c]
            ends[at] = at != 0
        self.fail, self.popped = [UNKNOWN] * len(self.next), [0] * len(self.next)
        queue = deque((0, c, v) for c, v in self.next[0].items())
        while queue:
            parent, c, v = queue.popleft()
            queue.extend((v, d, x) for d, x in self.next[v].items())
            if ends[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            z, pops = self.fail[parent], self.popped[parent]
            while z != UNKNOWN and c not in self.next[z]:
                pops += self.popped[z]
                z = self.fail[z]
            if z != UNKNOWN:
                self.fail[v], self.popped[v] = self.next[z][c], pops

    def count(self, word: bytes) -> int:
        """Greedy pieces of a word; a word that cannot be cut into pieces whole is one unknown piece."""
        step, fail, popped = self.next, self.fail, self.popped
        u = n = 0
        for c in word:
            while c not in step[u]:
                n += popped[u]
                u = fail[u]
                if u == UNKNOWN:
                    return 1
            u = step[u][c]
        while u:
            n += popped[u]
            u = fail[u]
            if u == UNKNOWN:
                return 1
        return n


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def _count(vocabulary, mark: bytes):
    def run(batches):
        automaton = Automaton(shipped(vocabulary))
        cache: dict[int, int] = {}
        for part in tk.pieces(batches):
            w = tk.words(part.column("text"))
            kinds, first, place = np.unique(w.hashes, return_index=True, return_inverse=True)
            body, starts, ends = w.body.tobytes(), w.starts[first].tolist(), w.ends[first].tolist()
            counts = np.empty(len(kinds), np.int64)
            if len(cache) > CACHE:
                cache.clear()
            for i, (kind, a, b) in enumerate(zip(kinds.tolist(), starts, ends)):
                n = cache.get(kind)
                if n is None:
                    n = cache[kind] = automaton.count(mark + body[a:b])
                counts[i] = n
            run_ = np.zeros(len(w.hashes) + 1, np.int64)
            np.cumsum(counts[place], out=run_[1:])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(w.counts), pa.array(run_[w.off[1:]] - run_[w.off[:-1]])], names=["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, mark: bytes = b" ") -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of (doc_id, text).

    ``vocabulary`` is a rank file, read by the driver. ``mark`` stands before each word, as in
    vocabularies whose pieces carry the space before a word. Null and empty texts have no tokens.
    Repeated rows count once each. Other columns are not read.
    """
    sent = ship(docs.sparkSession, read_vocabulary(vocabulary))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(sent, mark), "doc_id long, n_words long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
