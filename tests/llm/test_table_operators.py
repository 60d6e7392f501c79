"""Sharding, mixing, archives, url filters, decontamination, language model, pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratakeep.llm import decontamination as dc
from stratakeep.llm import language_model as lm
from stratakeep.llm import mixing, sharding, url_filter, warc
from stratakeep.llm import textkit as tk
from stratakeep.llm.common import shared_dir

from .conftest import CLASHING, prose, words_of


def test_shards_are_even_and_gapless(spark, odd_docs, no_docs):
    docs = spark.range(1003).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).union(odd_docs.select("doc_id", "text"))
    rows = sharding.shard_documents(docs, 16).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 1019 and len(slots) == 16
    assert {len(x) for x in slots.values()} <= {63, 64} and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert Counter(rows) == Counter(sharding.shard_documents(docs.repartition(5), 16).collect())
    assert sharding.shard_documents(no_docs).collect() == []


def test_a_full_cell_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 40)
    docs = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text")).union(spark.range(500).select("id", F.lit("other")))
    slots = defaultdict(list)
    for r in sharding.shard_documents(docs, 16).collect():
        slots[r["shard"]].append(r["slot"])
    assert {len(x) for x in slots.values()} == {50} and all(sorted(x) == list(range(50)) for x in slots.values())


def test_sizes_and_checksums_are_those_of_the_text(odd_docs):
    import zlib

    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd_docs.collect())
    got = sharding.shard_documents(odd_docs, 16).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want and {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_ring_walk_goes_clockwise_past_full_shards():
    nodes = [(10, 0), (20, 1), (30, 2)]
    assert sharding.walk({5: 4, 25: 2}, nodes, 3) == [(5, 1, 2, 0, 0), (5, 3, 4, 1, 0), (25, 1, 2, 2, 0)]
    assert sharding.walk({}, nodes, 3) == []


def test_overflow_is_limited(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 16).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 17).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.5 * len(a)


def water(sizes, weights=(5, 2, 1), epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in capped)
        free = sum(w[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and left * w[s] / free >= epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in capped else left * w[s] / free for s in sizes}
        capped |= over
        if capped == set(sizes):
            return {s: float(epochs * sizes[s]) for s in sizes}


def test_mixing_meets_targets(spark):
    r = random.Random(4)
    docs = [(i, r.choice(["a", "b", "b", "c", "c", "c", "c", "d", None, "é"]), prose(r, r.randrange(0, 60))) for i in range(1500)]
    docs += [(9000 + i, "tiny", "two words") for i in range(3)] + [(None, "tiny", None), (5, "b", docs[5][2]), (5, "b", docs[5][2])]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    run = lambda x: Counter((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix_sources(mixing.sized(x)).collect())
    got = run(df)
    assert got == run(df.repartition(7)) and sum(got.values()) == len(docs)
    sizes = defaultdict(int)
    for _, s, t in docs:
        sizes[s] += len(words_of(t))
    want, taken = water(sizes), defaultdict(int)
    for (_, s, size, source_size, target, n), times in got.items():
        assert source_size == sizes[s] and target == pytest.approx(want[s], rel=1e-9) and n <= 3 * size and (size == 0 or n % size == 0)
        taken[s] += n * times
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)


def test_mixing_of_nothing(no_docs, odd_docs):
    assert mixing.mix_sources(mixing.sized(no_docs)).collect() == []
    assert mixing.mix_sources(mixing.sized(odd_docs.where("text is null or text = ''"))).where("taken <> 0").count() == 0
    assert mixing.mix_sources(mixing.sized(odd_docs)).count() == odd_docs.count()


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 3000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 900)
    big = "<p>é 漢 " + "x" * 500
    html = [big, None, "", "short", "short", big, big, "\r\n\r\nWARC/1.1\r\n\r\n" * 20, "y" * 99, "y" * 99, "y" * 100, "y" * 100, "z" * 200_000] + [f"page {i} " * 40 for i in range(60)]
    pages = [(i, None if i == 3 else f"http://h/{i}?a\r\nX: y%20" if i == 4 else f"http://h/{i}", t, "extra") for i, t in enumerate(html)]
    pages += [(None, "http://null", "y" * 100, "extra"), (11, "http://again", "y" * 100, "extra")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(4)
    index = warc.write_archives(df, f"{shared_dir(spark)}/warc-test")
    assert index.count() == len(pages) and index.select("file").distinct().count() > 4
    got = warc.read_archives(index).collect()
    want, first = Counter(), {}
    for p, _, t, _ in sorted((x for x in pages if x[0] is not None), key=lambda x: x[0]):
        if len((t or "").encode()) >= 100:
            first.setdefault(t, p)
    for p, u, t, _ in pages:
        one = first.get(t) if first.get(t) != p else None
        want[(p, u, "revisit" if one is not None else "response", one, len((t or "").encode()), None if one is not None else t or "")] += 1
    assert Counter((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"]) for r in got) == want
    assert index.select("record_id").distinct().count() == len(pages)  # repeated and null ids too
    some = warc.fetch_records(index, spark.createDataFrame([(12,), (4,)], "page_id long")).collect()
    assert sorted((r["page_id"], r["payload"]) for r in some) == [(4, "short"), (12, "z" * 200_000)]
    assert warc.read_archives(warc.write_archives(df.limit(0), f"{shared_dir(spark)}/warc-none")).collect() == []


def test_bundles_are_read_by_many_tasks(spark):
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.repeat(F.col("id").cast("string"), 300).alias("html")).repartition(6)
    index = warc.write_archives(pages, f"{shared_dir(spark)}/warc-readers")
    got = warc.read_archives(index)
    assert index.select("file").distinct().count() == got.rdd.getNumPartitions() == 6
    assert sum(n > 0 for n in got.select("page_id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) >= 3
    assert sorted(r["page_id"] for r in got.collect()) == list(range(60))


def test_seek_table_is_read_back(tmp_path):
    writer = warc.BundleWriter(open(tmp_path / "b", "wb"))
    places = [writer.add(bytes([65 + i]) * 200_000) for i in range(5)]
    writer.close()
    reader = warc.BundleReader((tmp_path / "b").as_uri())
    assert [reader.frame(f)[at : at + 1] for f, at in places] == [b"A", b"B", b"C", b"D", b"E"] and len(reader.frames) > 1


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:stop]


URLS = [None, "", "no scheme/en/", "http://A.Example.COM/en/5?x#y", "http://example.com/en/77", "https://x.de.net/de/1", "a://b://c/d", "http://notcom/en/1", "http://com/en/", "http://h?q/en/", "http://É.com/en/é", "x://org/es", "x://org/es/", "x://example.net/de/81", "x://q.example.com/en/7/a//b/"]


def test_url_rules(spark):
    got = url_filter.judge_urls(spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path = split(URLS[r["page_id"]])
        fits = [(len(n), n, v) for n, v in url_filter.RULES if (host == n.split("/", 1)[0] or host.endswith("." + n.split("/", 1)[0])) and path.startswith("/" + n.split("/", 1)[1])]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[1] if fits else None) and (not fits or r["verdict"] == max(fits)[2])
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_templates_generalise_labels(spark):
    rules = (("bad.org/x/1", "block"), ("bad.org/y/1", "allow"))
    urls = [f"http://bad.org/x/{n}/p{n}" for n in list(range(100, 160)) + list(range(200, 210))] + [f"http://bad.org/y/{n}/p" for n in list(range(100, 160)) + [300, 301]] + ["http://good.org/x/200/p"]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).where("rule is null").collect()
    said = {r["path"]: r["verdict"] for r in got if r["host"] == "bad.org"}
    assert {v for p, v in said.items() if p.startswith("/x/")} == {"block"} and {v for p, v in said.items() if p.startswith("/y/")} == {"allow"}
    assert [r["verdict"] for r in got if r["host"] == "good.org"] == ["allow"]


def test_unlabelled_urls_do_not_hide_the_labels_of_their_branch(spark):
    rules = (("bad.org/x/1", "block"), ("bad.org/y/1", "allow"))
    urls = [f"http://bad.org/{b}/{n}/p{n}" for b in "xy" for n in (*range(100, 160), *range(200_000, 202_000))] + ["http://bad.org/z/7/p1"] * 5
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).where("rule is null")
    said = {(r["path"][:3], r["verdict"]) for r in got.select("path", "verdict").distinct().collect()}
    assert said == {("/x/", "block"), ("/y/", "allow"), ("/z/", "allow")} and got.count() == 4005


def test_similar_branches_are_merged_and_depth_has_no_limit(spark):
    deep = "/".join("abcdefghijkl")
    rules = (("g.org/m1", "block"), ("g.org/m2", "block"), ("h.org/" + deep + "/1", "block"), ("h.org/" + deep + "/z", "allow"))
    urls = [f"http://g.org/{m}{k}/{n}" for m in ("m1", "m2") for k in "pqr" for n in range(30)]
    urls += [f"http://h.org/{deep}/{e}/{n}" for e in ("1", "z") for n in range(40) for _ in range(2)] + ["http://h.org/" + "s/" * 3000, "http://h.org/" + deep + "/2/77"]
    rows = list(enumerate(urls)) + [(None, urls[0])] * 2
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert len(got) == len(rows) and {r["template"] for r in got if r["path"].startswith("/m")} == {"/*/{n}"}
    assert [r["verdict"] for r in got if r["path"].endswith("/2/77")] == ["block"]
    assert {r["template"] for r in got if r["path"].startswith("/a/")} == {f"/{deep}/{{n}}/{{n}}", f"/{deep}/z/{{n}}"}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_equals_dynamic_programming():
    r = random.Random(1)
    for _ in range(200):
        a, b = [r.randrange(6) for _ in range(r.randrange(1, 40))], [r.randrange(7) for _ in range(r.randrange(0, 60))]
        masks = defaultdict(int)
        for k, x in enumerate(a):
            masks[x] |= 1 << k
        assert dc.lcs_length(masks, len(a), b) == lcs(a, b)


def test_decontamination_finds_planted_items(spark, odd_docs):
    r = random.Random(8)
    items = [" ".join(f"q{r.randrange(3000)}" for _ in range(r.randrange(14, 70))) for _ in range(12)]
    docs, want = [], set()
    for i in range(200):
        text = prose(r, r.randrange(0, 300)).split()
        if i % 5 == 0:
            item = r.randrange(12)
            passage = items[item].split()
            for _ in range(len(passage) // 10 if i % 10 else 0):
                passage[r.randrange(len(passage))] = "swapped"
            at = r.randrange(len(text) + 1)
            text[at:at] = passage
            want.add((i, item))
        docs.append((i, " ".join(text).upper() if i % 3 else ", ".join(text)))
    benchmark = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "w1 w2")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in dc.contaminated(df, benchmark).collect()} == want
    assert dc.contaminated(odd_docs, benchmark).collect() == [] and dc.contaminated(df.limit(0), benchmark).collect() == []
    assert dc.contaminated(df, benchmark.limit(0)).collect() == []


def test_decontamination_equals_brute_force_in_one_vocabulary(spark):
    r = random.Random(21)
    word = lambda: f"w{min(int(r.paretovariate(0.35)), 4000)}"
    items = [[word() for _ in range(n)] for n in (5, 9, 15, 24, 33, 43, 58, 75, 130, 400)]
    items[4] = [*items[4], "w1", "w1", "w1"] * 2
    docs = []
    for i in range(240):
        text = [word() for _ in range(r.randrange(0, 260))]
        if i % 4:
            passage = list(items[i % 10])
            for _ in range(r.randrange(0, 4 * len(passage) // 10) if i % 4 > 1 else 0):  # up to four tenths changed
                k = r.randrange(len(passage))
                passage[k : k + 1] = r.choice([[], [word()], [passage[k], word(), word()]])
            at = r.randrange(len(text) + 1)
            text[at:at] = passage
        docs.append((i, text))
    want = {}
    for i, text in docs:
        for k, item in enumerate(items):
            masks = defaultdict(int)
            for j, x in enumerate(item):
                masks[x] |= 1 << j
            reach = 2 * len(item) + 8
            share = max((dc.lcs_length(masks, len(item), text[a : a + reach]) for a in range(len(text)) if text[a] in masks), default=0) / len(item)
            if share >= 0.7:
                want[i, k] = share
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    got = dc.contaminated(df, spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")).collect()
    assert len(want) > 120 and {(x["doc_id"], x["item_id"]) for x in got} == set(want)
    assert all(0.7 <= x["lcs"] <= want[x["doc_id"], x["item_id"]] and -1.001 < x["cosine"] < 1.001 for x in got)


def test_latent_retrieval_finds_nearly_all_by_itself(spark):
    r = random.Random(33)
    word = lambda: f"w{min(int(r.paretovariate(0.35)), 4000)}"
    items = [[word() for _ in range(n)] for n in (6, 12, 20, 30, 50, 90)]
    docs = []
    for i in range(150):
        text = [word() for _ in range(r.randrange(0, 260))]
        passage = list(items[i % 6])
        for _ in range(r.randrange(0, 4 * len(passage) // 10) if i % 3 else 0):
            k = r.randrange(len(passage))
            passage[k : k + 1] = r.choice([[], [word()], [passage[k], word(), word()]])
        at = r.randrange(len(text) + 1)
        text[at:at] = passage
        docs.append((i, text))
    want = set()
    for i, text in docs:
        for k, item in enumerate(items):
            reach = 2 * len(item) + 8
            if any(10 * lcs(item, text[a : a + reach]) >= 7 * len(item) for a in range(len(text)) if text[a] in item):
                want.add((i, k))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    got = dc.contaminated(df, spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")).collect()
    assert len(want) >= 150 and {(x["doc_id"], x["item_id"]) for x in got} == want
    assert sum(x["retrieved"] for x in got) >= 0.9 * len(want)
    # without the rows' way through the exact search, too
    idf, latent = dc.directions(df)
    block = dc.Items(list(range(6)), [" ".join(x) for x in items], [None] * 6, idf, latent)
    w = tk.words(pa.array([" ".join(t) for _, t in docs]), mapping=dc._PLAIN)
    alike = {(text, item) for item, text, _, _ in block.alike(w, latent, block.seldom(w))}
    assert {(x["doc_id"], x["item_id"]) for x in got if x["retrieved"]} <= alike and len(alike & want) >= 0.9 * len(want)


def test_what_the_cosine_loses_is_found_exactly(spark):
    r = random.Random(5)
    common = [f"w{k}" for k in range(1, 29)]
    item = [x for k, x in enumerate(common) for x in ([x, f"q{k}"] if k < 12 else [x])]
    diluted = [x for k, x in enumerate(common) for x in (x, f"z{k}")]
    docs = [(i, " ".join(r.choices(common, k=80))) for i in range(100)] + [(500, " ".join(diluted)), (501, " ".join(item))]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((x["doc_id"], x["lcs"], x["retrieved"]) for x in got if x["doc_id"] >= 500) == [(500, 28 / 40, False), (501, 1.0, True)]


def test_answers_decide_weak_matches(spark):
    item = " ".join(f"q{i}" for i in range(30))
    weak = " ".join(f"q{i}" if i % 5 < 3 else f"z{i}" for i in range(30))
    docs = spark.createDataFrame([(1, weak + " the answer is forty two"), (2, weak + " nothing"), *[(i, prose(random.Random(i), 60)) for i in range(3, 60)]], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item, "Forty-two")], "item_id long, text string, answer string")
    assert [(r["doc_id"], r["answer_found"]) for r in dc.contaminated(docs, benchmark).collect()] == [(1, True)]


def test_answer_beside_the_weaker_of_two_weak_matches(spark):
    item = " ".join(f"q{i}" for i in range(40))
    weak = lambda n: " ".join(f"q{i}" if i < n else f"z{i}" for i in range(40))
    text = weak(26) + " " + " ".join(f"y{i}" for i in range(400)) + " " + weak(22) + " forty two"
    docs = spark.createDataFrame([(1, text), *[(i, prose(random.Random(i), 60)) for i in range(3, 60)]], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item, "Forty-two")], "item_id long, text string, answer string")
    assert [(r["doc_id"], r["lcs"], r["answer_found"]) for r in dc.contaminated(docs, benchmark).collect()] == [(1, 22 / 40, True)]


def test_short_items_count_with_their_answer(spark):
    docs = spark.createDataFrame([(1, "well who wrote it then it was ann lee"), (2, "who wrote it"), (3, "wrote who it ann lee")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, "Who wrote it?", "Ann Lee"), (8, "who wrote it", None)], "item_id long, text string, answer string")
    assert [(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, benchmark).collect()] == [(1, 7)]


def corpus(spark, n=400):
    r = random.Random(2)
    rows = []
    for i in range(n):
        tongue = r.choice("ab")
        rows.append((i, " ".join(f"{tongue}{min(int(r.paretovariate(0.7)), 300)}" for _ in range(60)), tongue))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("head", [1 << 18, 40])
def test_language_model_scores(spark, head):
    import zlib
    from math import log10

    docs = corpus(spark)
    rows = [(r["doc_id"], [*words_of(r["text"], lower=True), None]) for r in docs.collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    count = Counter(x for d, t in rows if not held(d) for x in t)
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in lm.score_texts(docs, head=head).collect()}
    for d, t in rows:
        g = got[d]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held(d), len(t), sum(x in count for x in t), n)
        assert g["base_score"] == pytest.approx(sum(log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel=1e-9)
    out = [g for g in got.values() if g["held_out"]]
    assert sum(g["score"] for g in out) > sum(g["base_score"] for g in out) + 0.05 * sum(g["n_tokens"] for g in out)


def test_class_probabilities_sum_to_one():
    r = np.random.default_rng(0)
    weights, bias = r.standard_normal((lm.ROWS, 9)).astype(np.float32), r.standard_normal(9).astype(np.float32)
    rows = lm.features(r.integers(0, 1 << 60, 50, dtype=np.uint64), np.array([0, 20, 20, 50]))
    total = sum(np.exp(lm.log_of_class(weights, bias, rows, np.full(50, c))) for c in range(9))
    assert np.allclose(total, 1, atol=1e-5)
    v = lm.Vocabulary(np.arange(1, 60, dtype=np.uint64), np.arange(2, 61), r.integers(0, 3, 59), 5000)
    mass = np.bincount(v.cls, 10**v.log_in_class)
    assert np.allclose(mass[1:][mass[1:] > 0], 1)


def test_language_model_learns_more_pairs_from_more_texts(spark):
    r = random.Random(6)
    follows = r.sample(range(20000), 20000)  # more contexts than there are rows of hashed weights

    def gain(n):
        rows = []
        for i in range(n):
            w = [r.randrange(20000)]
            while len(w) < 60:
                w.append(follows[w[-1]])
            rows.append((i, " ".join(f"v{x}" for x in w), "a"))
        got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
        return sum(g["score"] - g["base_score"] for g in got) / sum(g["n_tokens"] for g in got)

    few, many = gain(400), gain(4000)
    assert few > 0.1 and many > few + 0.5


def test_language_model_odd_and_empty(odd_docs, no_docs):
    got = lm.score_texts(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in got)
    assert lm.score_texts(no_docs).collect() == []
    assert len(lm.score_texts(odd_docs.drop("lang").where("doc_id = 2")).collect()) == 1


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES][0].startswith("quality") and len(corpus_pipeline.STAGES) == 5
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, d)
    one = stages["n-gram Jaccard join"](spark, kept, d)
    assert kept.columns == one.columns == columns and before > kept.count() > one.count() > 0.5 * before
    good = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").join(docs, "doc_id").where("n_chars > 400")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count()
    assert stages["n-gram Jaccard join"](spark, one, d).count() == one.count()


def test_pipeline_runs_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "some benchmark item of eight or nine words"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    odd_docs.write.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d)
    assert {"doc_id", "shard", "slot"} <= set(out.columns) and out.count() > 0
    given = odd_docs.union(odd_docs.withColumn("text", F.lit("all words of this text are there only once and so it is good enough to be kept by all stages.")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, given, d).collect()
        assert rows and rows[0].__fields__ == odd_docs.columns, name
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING), name
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, d).collect() == []


def brute_mix(docs):
    """(doc_id, taken) by one sorted queue of all documents, as the definition has it."""
    import hashlib
    from math import ceil

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    rows = [(d, s, len(words_of(t)), int(md5(f"queue {d} {md5(t or '')}")[:15], 16)) for d, s, t in docs]
    sizes = defaultdict(int)
    for _, s, n, _ in rows:
        sizes[s] += n
    goal, upto, queue, taken = water(sizes), defaultdict(int), [], Counter()
    for d, s, n, mark in sorted(rows, key=lambda r: (r[3], r[0])):
        upto[s] += n
        if n:
            queue += [((p * sizes[s] + upto[s]) / goal[s], mark, d, s, n) for p in range(min(3, ceil(goal[s] / sizes[s]) + 1))]
    total, budget, seen = 0, sum(sizes.values()), set()
    for finish, _, d, s, n in sorted(queue):
        total += n
        if total <= budget:
            taken[d] += n
        elif s not in seen:
            seen.add(s)
            if goal[s] * (1 - finish) > -n / 2:
                taken[d] += n
    return {d: taken[d] for d, _, _, _ in rows}


def test_mixing_equals_one_sorted_queue(spark):
    r = random.Random(14)
    docs = [(i, r.choice(["a", "b", "b", "c", "c", "c", "d", None]), prose(r, r.randrange(0, 50))) for i in range(900)]
    got = mixing.mix_sources(mixing.sized(spark.createDataFrame(docs, "doc_id long, source string, text string"))).collect()
    assert {x["doc_id"]: x["taken"] for x in got} == brute_mix(docs)


def test_times_follow_from_the_cut_of_the_source(spark):
    r = random.Random(15)
    docs = [(i, r.choice(["a", "b", "b", "c", "c", "c", "c", "d", None]), r.choice([None, "", prose(r, r.randrange(1, 40))]), "own") for i in range(900)]
    df = spark.createDataFrame(docs, "n long, source string, text string, mark string")
    mixed = mixing.mix_sources(mixing.sized(df.withColumnRenamed("n", "doc_id")))
    got = mixing.times_taken(df, "n", mixed, "times").collect()
    want = {x["doc_id"]: x["taken"] // x["size"] for x in mixed.where("taken > 0").collect()}
    assert {x["n"]: x["times"] for x in got} == want and len(got) == len(want) and {x["mark"] for x in got} == {"own"}


def test_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake)


PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
{before}
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
{body}
spark.stop()
"""


def run_program(tmp_path, body, before=""):
    import subprocess
    import sys
    from pathlib import Path

    repo = str(Path(__file__).resolve().parents[2])
    code = PROGRAM.format(repo=repo, before=before, body=body, folder=f"file://{tmp_path}")
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True, cwd=repo).stdout


def test_no_table_is_left_when_the_driver_ends(tmp_path):
    body = "for q in ('op2_ngram_jaccard', 'op5_warc', 'op9_mix_sources'): print(__spark_entry__.queries()[q](spark, '/root/testdata/sf0.001').count())"
    assert len(run_program(tmp_path, body).split()) == 3
    assert [x for x in tmp_path.iterdir() if not x.name.startswith(".") and any(x.rglob("*.*"))] == []


def test_other_queries_load_without_an_optional_package(tmp_path):
    body = "print(sorted({k.partition('_')[0] for k in __spark_entry__.queries()}), len(__spark_entry__.oracle_sql()) >= 50)"
    assert run_program(tmp_path, body, "sys.modules['zstandard'] = None").split("\n")[0] == "['kv'] True"
