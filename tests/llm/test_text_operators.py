"""Near duplicates, substring dedup, token counts, quality metrics against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratakeep.llm import near_duplicates as nd
from stratakeep.llm import quality, substring_dedup, textkit, token_counts

from .conftest import prose, words_of


def shingles(text, width):
    w = words_of(text, lower=True)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(docs, width, percent):
    sets = [shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(docs):
        if not sets[i]:
            out.append((d, 0, d))
            continue
        ids = [x for j, (x, _) in enumerate(docs) if sets[j] and find(j) == find(i) and x is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return Counter(out)


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        k = r.randrange(len(w))
        w[k : k + 1] = r.choice([[], ["new%d" % r.randrange(99)], [w[k], "more"]])
    return " ".join(w)


def similar_docs(seed):
    r, docs = random.Random(seed), []
    for size in (4, 8, 14, 20, 25, 40, 80, 200, 700):
        base = prose(r, size)
        for _ in range(9):
            docs.append(edited(r, base, r.randrange(0, 2 + size // 25)))
    chain = prose(r, 120)
    for _ in range(25):  # each like the one before, the ends unlike each other
        docs.append(chain)
        chain = edited(r, chain, 2)
    return [(i, t) for i, t in enumerate(r.sample(docs, len(docs)))]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    docs = similar_docs(width)
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width, percent)
    assert Counter(map(tuple, got.collect())) == components(docs, width, percent)


def test_near_duplicates_leader_rounds(spark, monkeypatch):
    monkeypatch.setattr(nd, "LEADERS", 1)
    docs = similar_docs(77)
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90)
    assert Counter(map(tuple, got.collect())) == components(docs, 3, 90)


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
def test_linked_sets_share_a_key(percent):
    r = np.random.default_rng(percent)
    for n in [1, 2, 5, 9, 10, 12, 19, 28, 29, 31, 60, 200, 1500]:
        for _ in range(25):
            a = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
            b = a.copy()
            while True:
                c = b[r.random(len(b)) > 1 / len(b)] if r.random() < 0.5 else np.unique(np.append(b, r.integers(0, 1 << 62, 1, dtype=np.uint64)))
                if not len(c) or 100 * len(np.intersect1d(a, c)) < percent * len(np.union1d(a, c)):
                    break
                b = c
            if not np.array_equal(a, b):
                assert len(np.intersect1d(nd.bucket_keys(a, percent), nd.bucket_keys(b, percent)))


def test_near_duplicates_odd_and_empty(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert Counter(map(tuple, nd.near_duplicates(odd_docs, 3, 90).collect())) == components(rows, 3, 90)
    assert nd.near_duplicates(no_docs).collect() == []


def cut(docs, width):
    texts = [words_of(t) for _, t in docs]
    count = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(docs, texts):
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def repeating_docs(seed):
    r = random.Random(seed)
    passage, long = prose(r, 40), prose(r, 120)
    docs = [prose(r, 90) for _ in range(12)]
    for k in range(12):
        w = prose(r, r.randrange(5, 60)).split()
        w[3:3] = r.choice([passage, long, passage + " " + passage, long[: len(long) // 2]]).split()
        docs.append(" ".join(w))
    docs += [passage, passage, "x " * 80, "x " * 36, "x " * 35, "p q r " * 25, prose(r, 34), edited(r, long, 1), edited(r, long, 3), docs[0], docs[1] + " tail"]
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("width", [35, 12])
def test_substring_dedup_equals_brute_force(spark, width):
    docs = repeating_docs(width)
    got = substring_dedup.cut_repeats(spark.createDataFrame(docs, "doc_id long, text string"), width)
    assert Counter(tuple(r)[:4] for r in got.collect()) == cut(docs, width)


def test_substring_dedup_odd_and_empty(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert Counter(map(tuple, substring_dedup.cut_repeats(odd_docs, text=False).collect())) == cut(rows, 35)
    assert substring_dedup.cut_repeats(no_docs).collect() == []


def test_windows_recur_inside_one_block(spark):
    docs = []
    for i, line, fill in ((5065, 13, 2), (10257, 12, 1)):  # the same long line between three fillers, in a cycle of 45 and 39 words
        line = [f"l{i}x{k}" for k in range(line)]
        docs.append((i, " ".join([x for j in range(3) for x in (*line, *(f"f{i}x{j}x{k}" for k in range(fill)))] * 4)))
        h = textkit.words(pa.array([docs[-1][1]])).hashes
        valid = np.arange(len(h)) + 35 <= len(h)
        assert len(np.unique(substring_dedup.window_anchors(h, np.zeros(len(h), int), valid, 35)[valid])) == 1
    got = substring_dedup.cut_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert Counter(tuple(r)[:4] for r in got.collect()) == cut(docs, 35)


def test_symbols_depend_on_their_context_only():
    r = random.Random(5)
    inner = prose(r, 60).split()
    seen = []
    for _ in range(2):
        w = prose(r, 50).split() + inner + prose(r, 50).split()
        t = textkit.words(pa.array([" ".join(w)]))
        level, text, found = substring_dedup.name_runs(t.hashes, np.zeros(len(w), int)), None, set()
        for k in range(8):
            level = substring_dedup.name_pairs(level, k)
            ok = (level.lo >= 50) & (level.hi <= 110)
            found |= {(k, int(s), int(n)) for s, n in zip(level.s[ok], level.name[ok])}
        seen.append(found)
    assert seen[0] == seen[1] and len(seen[0]) > 60


def longest_match(word, vocabulary, longest):
    n = i = 0
    while i < len(word):
        j = min(len(word), i + longest)
        while j > i and word[i:j] not in vocabulary:
            j -= 1
        if j == i:
            return 1
        i, n = j, n + 1
    return n


def test_automaton_equals_longest_match():
    r = random.Random(3)
    for _ in range(40):
        vocabulary = {bytes(r.choices(b"abc", k=r.randrange(1, 6))) for _ in range(r.randrange(2, 25))}
        automaton = token_counts.Automaton(sorted(vocabulary))
        for _ in range(60):
            word = bytes(r.choices(b"abcd" if r.random() < 0.2 else b"abc", k=r.randrange(1, 14)))
            assert automaton.count(word) == longest_match(word, vocabulary, 6)


def test_token_counts(odd_docs, no_docs):
    vocabulary = set(token_counts.read_vocabulary(token_counts.VOCABULARY))
    longest = max(map(len, vocabulary))
    want = Counter((r["doc_id"], len(words_of(r["text"])), sum(longest_match(b" " + w.encode(), vocabulary, longest) for w in words_of(r["text"]))) for r in odd_docs.collect())
    assert Counter(map(tuple, token_counts.count_tokens(odd_docs).collect())) == want
    assert token_counts.count_tokens(no_docs).collect() == []


def metrics(text):
    text = text or ""
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


def test_quality_metrics(odd_docs, no_docs):
    got = quality.judge_quality(odd_docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(map(tuple, got.select(names).collect())) == Counter((r["doc_id"], *metrics(r["text"])) for r in odd_docs.collect())
    assert got.where("kept and base_failed").count() == 0
    assert quality.judge_quality(no_docs).collect() == [] and quality.keep_good(no_docs).collect() == []


def test_quality_agrees_with_labels(spark):
    from stratakeep.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    got = QUERIES["op10_quality_rules"](spark, d)
    labelled = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    right = labelled.where("kept = (quality = 1)").count()
    assert right >= 0.95 * labelled.count()
    assert labelled.where("quality = 1 and not kept").count() == 0
    # a rejection does not decide by itself: texts of ten to twenty words are kept though the length rule rejects them
    assert got.where("kept and n_words < 20").count() > 0


def draw_votes(r, good, on_good, on_bad, abstain=0.1):
    """Vote patterns of texts that rules reject at the given rates."""
    n, rules = len(good), len(on_good)
    vote = np.where(good[:, None], np.where(r.random((n, rules)) < on_good, 0, 2), np.where(r.random((n, rules)) < on_bad, 0, 2))
    vote[r.random(vote.shape) < abstain] = 1
    return (vote * 3 ** np.arange(rules)).sum(1)


def test_expectation_maximisation_recovers_rules():
    r = np.random.default_rng(0)
    good = r.random(20000) < 0.8
    rules = len(quality.RULES)
    pattern = draw_votes(r, good, np.full(rules, 0.001), np.full(rules, 0.35))
    posterior = quality.fit(Counter(pattern.tolist()))
    said = np.array([posterior[p] >= 0.5 for p in pattern.tolist()])
    assert (said == good).mean() > 0.95


@pytest.mark.parametrize("n", [2000, 50000])
def test_a_noisy_rule_is_overruled(n):
    r = np.random.default_rng(1)
    good = r.random(n) < 0.8
    rules = len(quality.RULES)
    on_good = np.full(rules, 0.002)
    on_good[-1] = 0.1
    pattern = draw_votes(r, good, on_good, np.full(rules, 0.35), abstain=0)
    posterior = quality.fit(Counter(pattern.tolist()))
    only = 3**rules - 1 - 2 * 3 ** (rules - 1)  # the last rule rejects, all others keep
    texts = pattern == only
    assert texts.sum() > 0.05 * n and good[texts].mean() > 0.9 and posterior[only] > 0.8
    said = np.array([posterior[p] >= 0.5 for p in pattern.tolist()])
    strict = pattern == 3**rules - 1
    assert said[good].mean() > 0.98 > strict[good].mean() and (said == good).mean() > (strict == good).mean() + 0.03


def test_symbol_words_and_echoes_are_counted():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a a b b% % c", "b", None]})
    (_, m, _, _), = quality._measured(iter([batch]), "text")
    assert m["n_echoes"].tolist() == [1, 0, 0] and m["n_symbol_words"].tolist() == [2, 0, 0]
