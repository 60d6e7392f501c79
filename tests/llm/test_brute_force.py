"""Sharding, quality rules, the language model and the whole pipeline against plain readings of their definitions."""

import random
import re
import struct
import zlib
from collections import Counter
from math import exp, log, log10

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from stratakeep.llm import language_model as lm
from stratakeep.llm import quality, sharding
from stratakeep.llm import textkit as tk
from stratakeep.llm.common import ship
from stratakeep.llm.queries import QUERIES

from .conftest import ODD_TEXTS, prose, words_of
from .test_table_operators import brute_mix, lcs
from .test_text_operators import components, edited, metrics

SMALL = "/root/testdata/sf0.001"


def chained(*values):
    """The 64-bit hash of a row: each value's hash seeds the next one's, nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=h)
    return h


def brute_shards(docs, shards=16):
    """(doc_id, size, text_crc32, shard, slot) by walking the ring with one row after the other."""
    nodes = sorted((chained("virtual node", s, v) % 65536, s) for s in range(shards) for v in range(256))
    rows = []
    for d, t in docs:
        data = (t or "").encode()
        key = (d, zlib.crc32(data), len(data) + 1)
        rows.append((chained(*key) % 65536, d is not None, key))
    rows.sort(key=lambda r: (r[0], r[1], r[2][0] or 0, *r[2][1:]))  # nulls come first
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    used, out = [0] * shards, []
    for cell, _, (d, crc, size) in rows:
        clockwise = [s for c, s in nodes if c >= cell] + [s for c, s in nodes if c < cell]
        shard = next(s for s in clockwise if used[s] < room[s])
        out.append((d, size, crc, shard, used[shard]))
        used[shard] += 1
    return Counter(out)


def votes(text):
    """What each rule says of a text: keep 1, reject -1, abstain 0."""
    text = text or ""
    w = words_of(text)
    n, chars, symbols, dup, repeats, _ = metrics(text)
    one, lines = max(n, 1), sum(bool(words_of(x)) for x in text.split("\n"))
    letters = re.findall("[A-Za-z]", text)
    ending = lambda marks: sum(x[-1] in marks for x in w) / one
    echoes = sum(a == b for a, b in zip(w, w[1:])) / one
    upper, mean, stops = sum(x < "a" for x in letters) / max(len(letters), 1), chars / one, ending(".")
    share, odd, marks, copies = symbols / max(chars, 1), ending("#*$%&|<>"), ending("!?"), dup / max(lines, 1)
    said = lambda keep, reject: -1 if reject else int(keep)
    return (
        said(share < 0.01, share > 0.05), said(odd < 0.02, odd > 0.15), said(repeats / one < 0.05, repeats / one > 0.2), said(echoes < 0.02, echoes > 0.15),
        said(copies < 0.05, copies > 0.3 and dup >= 3), said(n >= 60, n < 20), said(3 < mean < 9, mean < 2.2 or mean > 14), said(upper < 0.2, upper > 0.5),
        said(marks < 0.02, marks > 0.15), said(stops > 0.005, stops == 0 and n >= 30),
    )


def brute_kept(texts):
    """Which texts are kept: votes weighed by expectation-maximisation, text by text."""
    cast = [votes(t) for t in texts]
    wrong, good, p = {True: [0.02] * 10, False: [0.3] * 10}, 0.85, []
    for _ in range(100):
        p = []
        for v in cast:
            score = {side: sum(log(r if x < 0 else 1 - r) for x, r in zip(v, wrong[side]) if x) for side in wrong}
            p.append(1 / (1 + exp(score[False] + log(1 - good) - score[True] - log(good))))
        for side, belief in ((True, 0.02), (False, 0.3)):
            weight = p if side else [1 - x for x in p]
            for k in range(10):
                no = sum(x for x, v in zip(weight, cast) if v[k] < 0)
                some = sum(x for x, v in zip(weight, cast) if v[k])
                wrong[side][k] = min(max((no + 20 * belief) / (some + 20), 1e-6), 0.99)
        wrong[True] = [min(a, b) for a, b in zip(wrong[True], wrong[False])]
        good = min(max((sum(p) + 17) / (len(p) + 20), 0.02), 0.98)
    return [not metrics(t)[5] and x >= 0.5 for t, x in zip(texts, p)]


def holds_item(text, items):
    w = re.findall("[a-z0-9]+", text.lower())
    for item in items:
        n = len(item)
        if any(w[a] in item and 10 * lcs(item, w[a : a + 2 * n + 8]) >= 7 * n for a in range(len(w))):
            return True
    return False


def corpus(seed):
    """Good prose with near copies and planted items, and junk of all kinds."""
    r = random.Random(seed)

    def good(n):
        return " ".join(f"word{x[1:]}" + ("." if k % 12 == 11 else "") for k, x in enumerate(prose(r, n, 4000).split()))

    items = [[f"item{r.randrange(500)}" for _ in range(n)] for n in (12, 20, 31)]
    texts = [good(r.randrange(70, 160)) for _ in range(110)]
    for k in range(6):
        base = good(120)
        texts += [edited(r, base, r.randrange(0, 9)) for _ in range(5)] + [base] * 2
    for k in range(12):
        passage = list(items[k % 3])
        for _ in range(k // 3):
            passage[r.randrange(len(passage))] = f"other{k}"
        host = good(80).split()
        host[30:30] = passage
        texts.append(" ".join(host))
    junk = [lambda: "### $$$ %%% " * r.randrange(5, 30), lambda: "buy now! " * r.randrange(10, 40), lambda: good(40).upper(), lambda: "\n".join([good(6)] * 9), lambda: " ".join(f"{x}! {x}!" for x in good(30).split())]
    texts += [r.choice(junk)() for _ in range(40)] + [good(r.randrange(5, 25)) for _ in range(15)]
    r.shuffle(texts)
    return [(i, t, r.choice(["a", "b", "b", "c", "c", "c", None])) for i, t in enumerate(texts)], items


def test_shards_equal_a_walk_row_by_row(spark, odd_docs):
    read = lambda df: [(x["doc_id"], x["text"]) for x in df.select("doc_id", "text").collect()]
    got = lambda rows: Counter((x["doc_id"], x["size"], x["text_crc32"], x["shard"], x["slot"]) for x in rows.collect())
    assert got(QUERIES["op1_shard_ring"](spark, SMALL)) == brute_shards(read(spark.read.parquet(f"{SMALL}/documents.parquet")))
    assert got(sharding.shard_documents(odd_docs, 3)) == brute_shards(read(odd_docs), 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_equals_rules_weighed_text_by_text(spark, seed):
    docs = [(i, t) for i, t, _ in corpus(seed)[0]] + [(9000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    got = {x["doc_id"]: x["kept"] for x in quality.judge_quality(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_kept([t for _, t in docs])
    assert got == {d: k for (d, _), k in zip(docs, want)} and 20 < sum(want) < len(docs) - 20


def test_pipeline_equals_its_stages_done_by_hand(spark, tmp_path):
    docs, items = corpus(5)
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [d for d, k in zip(docs, brute_kept([t for _, t, _ in docs])) if k]
    first = {c for _, _, c in components([d[:2] for d in kept], 5, 80)}
    one = [d for d in kept if d[0] in first]
    clean = [d for d in one if not holds_item(d[1], items)]
    taken = brute_mix([(d, s, t) for d, t, s in clean])
    mix = [(d, t) for d, t, _ in clean for _ in range(taken[d] // len(words_of(t)))]
    assert len(docs) > len(kept) > len(one) > len(clean) > 80 and len(mix) != len(clean)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x["doc_id"], x["size"], x["text_crc32"], x["shard"], x["slot"]) for x in got) == brute_shards(mix)


@pytest.mark.parametrize("head", [1 << 18, 60])
def test_scores_equal_those_token_by_token(spark, monkeypatch, head):
    shipped = []
    monkeypatch.setattr(lm, "ship", lambda spark, value: shipped.append(value) or ship(spark, value))
    docs = [(i, t) for i, t, _ in corpus(7)[0]] + [(9000 + i, t) for i, t in enumerate(ODD_TEXTS) if len(t or "") < 500]
    got = {x["doc_id"]: x for x in lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), head=head).collect()}
    vocabulary, weights = shipped[-1]
    at = {int(h): k for k, h in enumerate(vocabulary.h)}
    texts = {d: [int(h) for h in lm.tokens(pa.array([t], pa.string()))[0]] for d, t in docs}
    start, end = int(lm._START), int(lm.END)
    train = [t for d, t in texts.items() if not got[d]["held_out"]]
    count = Counter(x for t in train for x in t)
    pairs = Counter((a, b if b in at else None) for t in train for a, b in zip([start, *t], t))
    rare = {x: c for x, c in count.items() if x not in at}
    unseen = max(0.5, sum(c == 1 for c in count.values()))  # what all words never seen may weigh
    assert bool(rare) == (head == 60 or 1 in count.values())

    def classes(one, two):
        hashed = lambda x, size, first: int(tk.mix_int(x % 2**64)) % size + first
        rows = (hashed(one + 5, 4096, 0), hashed(one * 0x9E3779B97F4A7C15 + two + 76, 8192, 4096), hashed(two + 147, 4096, 12288))
        x = np.exp(vocabulary.bias.astype(float) + sum(weights[r].astype(float) for r in rows))
        return x / x.sum()

    def chance(p, one, token):
        """Of a token behind ``one``, ``None`` for any that is not frequent."""
        prior = p[0] if token is None else p[vocabulary.cls[at[token]]] * 10 ** vocabulary.log_in_class[at[token]]
        n = count[end] if one == start else count[one]
        return (pairs[one, token] + 100 * prior) / (n + 100)

    for d, t in texts.items():
        score = 0.0
        for one, two, x in zip([start, *t], [start, start, *t], t):
            p = classes(one, two)
            score += log10(chance(p, one, x if x in at else None))
            if x not in at:
                score += log10(rare.get(x, unseen) / (sum(rare.values()) + unseen))
        assert got[d]["score"] == pytest.approx(score, abs=3e-4 * len(t) + 1e-3)
    for t in train[:40]:  # what may follow has a chance of one in all
        p = classes(t[0], start)
        assert chance(p, t[0], None) + sum(chance(p, t[0], int(h)) for h in vocabulary.h) == pytest.approx(1, abs=1e-4) or t[0] == end
