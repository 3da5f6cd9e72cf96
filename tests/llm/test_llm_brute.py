"""Operators that SQL can't say, against brute force; learned ones on held-out rows; the pipeline as a whole."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from drivelaws.llm import minhash, queries, suffix, topk
from drivelaws.llm.common import table

SF = "/root/testdata/sf0.001"


def removed(texts, length):
    counts = Counter(b[s:s + length] for b in texts for s in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if counts[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        out.append(bytes(gone))
    return out


def test_suffix_core_against_brute_force():
    rnd = random.Random(5)
    for _ in range(150):
        length, texts = rnd.choice([8, 16, 24]), []
        for _ in range(rnd.randint(1, 8)):
            b = bytes(rnd.choice([97, 98, 0, 255][:rnd.randint(1, 4)]) for _ in range(rnd.randint(length, 90)))
            if texts and rnd.random() < 0.6:
                other = rnd.choice(texts)
                i = rnd.randint(0, len(other))
                b = b[:20] + other[i:i + rnd.randint(0, 60)] + b[20:]
            texts.append(b)
        data, edges = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        span, low, high = suffix.repeats(data, edges, np.arange(len(texts))[:, None], np.zeros(len(texts), np.int64), length)
        got = [bytearray(len(t)) for t in texts]
        for a, b, c in zip(span, low, high):
            got[a][b:c] = b"\1" * (c - b)
        assert [bytes(g) for g in got] == removed(texts, length)


@pytest.mark.parametrize("crowded", [2, 8192])
def test_repeats_against_brute_force(spark, crowded):
    rnd = random.Random(crowded)
    passage = "".join(rnd.choice("abcd ") for _ in range(300))
    texts = ["a" * 260, "ab" * 150, passage, passage, "x" * 205]
    for i in range(60):
        own = "".join(rnd.choice("efghij ") for _ in range(400))
        cut = rnd.randint(0, 300)
        texts.append(own[:rnd.randint(0, 200)] + passage[cut:cut + rnd.randint(100, 300)] + own[200:])
        if i % 7 == 0:
            texts.append(own[:150] + "é" + own[150:])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {r["doc_id"]: r for r in suffix.remove_repeats(docs, crowded=crowded).collect()}
    for i, gone in enumerate(removed([t.encode() for t in texts], 200)):
        kept = bytes(c for c, g in zip(texts[i].encode(), gone) if not g)
        assert (out[i]["n_removed"], bytes(out[i]["kept"])) == (sum(gone), kept), i
        assert out[i]["n_spans"] == sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))


def test_repeats_query(spark):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in table(spark, SF, "documents").collect()]
    out = {r["doc_id"]: r for r in queries.op3_suffix_array_dedup(spark, SF).collect()}
    for (i, b), gone in zip(docs, removed([b for _, b in docs], 200)):
        assert out[i]["n_removed"] == sum(gone)
        assert out[i]["kept_sha256"] == hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()


def test_crowded_buckets_lose_no_link(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = rnd.sample(words, 220)
    texts = []
    for _ in range(90):  # near copies of one text, some far from its first
        t = list(base)
        for _ in range(rnd.randint(0, 9)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{" ".join(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    reach = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((reach[a], reach[b]))
                reach = [low if r == high else r for r in reach]
    for crowded in (3, 200):
        out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, crowded=crowded).collect()}
        assert out == dict(enumerate(reach))


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    universe = rng.integers(0, 2 ** 63, 1500).astype(np.uint64)
    a, b = universe[:1000], universe[250:1250]
    elements, of = np.concatenate([a, b, universe[:1]]), np.repeat([0, 1, 2], [1000, 1000, 1])
    signature = minhash.signatures(elements, of, 3)
    assert not (signature == np.iinfo(np.uint64).max).any()  # even one element fills all places
    assert abs((signature[0] == signature[1]).mean() - 750 / 1250) < 0.12


def test_dual_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 200, (12, 16))
    data = np.floor(centers[rng.integers(0, 12, 3000)] + rng.normal(0, 3, (3000, 16)))
    data[100:400] = data[100]  # equal vectors
    best = topk.dual_search(data[:200], np.arange(200), data, np.arange(3000), np.arange(3000), 7)
    scores = data[:200] @ data.T
    scores[np.arange(200), np.arange(200)] = -np.inf
    for q in range(200):
        order = np.lexsort((np.arange(3000), -scores[q]))[:7]
        assert best.at[q].tolist() == order.tolist()
    data = np.floor(rng.normal(0, 40, (60, 64))[rng.integers(0, 60, 8000)] + rng.normal(0, 1, (8000, 64)))
    rows = np.arange(8000)
    best = topk.dual_search(data[::4], rows[::4], data, rows, rows, 20)
    assert best.met < 0.5 * 2000 * 8000
    scores = data[::4] @ data.T
    scores[np.arange(2000), rows[::4]] = -np.inf
    assert np.array_equal(best.scores, -np.sort(-scores, axis=1)[:, :20])


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op9_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    right, n = out.filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.93


def test_extraction_against_the_article_element(spark):
    import re
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    for r in queries.op10_html_extraction(spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, SF).toPandas(), before.schema)
        assert docs.columns == columns, name
        assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty(), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.filter("piece = 0").count() == docs.count()
    assert packed.count() == corpus_pipeline.run(spark, SF).count()


def test_components_of_a_random_graph(spark):
    from drivelaws.llm.components import components

    rnd = random.Random(7)
    edges = [(rnd.randrange(600), rnd.randrange(600)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(40)]
    reach = list(range(1100))
    for u, v in edges:
        low, high = sorted((reach[u], reach[v]))
        reach = [low if r == high else r for r in reach]
    frame = spark.createDataFrame(edges, "u long, v long").repartition(6)
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    touched = {x for u, v in edges for x in (u, v) if u != v}
    assert got == {x: reach[x] for x in touched}
    assert components(frame.filter("false")).count() == 0
