"""Edges of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivelaws.llm import classifier, html, lm, minhash, mixing, packing, quality, queries, secrets, suffix, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __row string, quality string, __text string"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
SENTENCE = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, SENTENCE, "en", "a", 1, "r", "q", "t"),
        (2, SENTENCE.upper(), "en", "a", 1, None, None, None),
        (2, SENTENCE.upper(), "en", "a", 1, None, None, None),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "", "", ""),
        (None, "one two", "en", "b", 7, "x", "y", "z"),
        (5, LONG, "en", "c", len(LONG), "", "", ""),
        (6, " \t\r\n\x0b\x0c", "fr", "", 6, "", "", ""),
        (7, "é中\U0001f600 " * 70, "zh", "c", 210, "", "", ""),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.filter("false")


def test_quality_edges(docs, none):
    out = quality.repetition(docs)
    assert out.count() == docs.count() and set(out.columns) == set(docs.columns)
    kept = {r["doc_id"]: r["quality"] for r in out.collect()}
    assert kept[3]["n_words"] == 0 and kept[3]["base_failed"] and not kept[3]["kept"]
    assert kept[6]["n_words"] == 0 and kept[1]["kept"] and kept[5]["kept"]
    assert kept[7]["n_repeat_words"] == 70 and not kept[7]["kept"]
    assert quality.repetition(none).count() == 0


def test_mixing_edges(docs, none):
    plan = {(r["doc_id"], i): r for i, r in enumerate(mixing.mix_plan(docs).collect())}
    assert len(plan) == docs.count()
    # sources by code point, null last: '' 1, a 2, b 3, c 1, null 2
    by_id = {k[0]: r for k, r in plan.items()}
    assert by_id[3]["target"] == 0 and by_id[3]["copies"] == 0 and by_id[4]["size"] == 0
    assert by_id[1]["source_size"] == 180 and by_id[1]["target"] == 540.0 and by_id[1]["copies"] == 3
    assert by_id[None]["copies"] == 3
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.filter("doc_id = 1").count() == 3 and mixed.filter("doc_id = 2").count() == 6
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_mix_targets_water_fill(spark):
    sizes = [(f"s{i:02d}", s) for i, s in enumerate([5, 1000, 10, 2000, 7, 900, 1, 400])]
    rows = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    total, weight = sum(s for _, s in sizes), {k: 1 + i % 3 for i, (k, _) in enumerate(sizes)}
    target, open_ = {}, dict(sizes)
    while True:
        share = (total - sum(target.values())) / sum(weight[k] for k in open_)
        above = [k for k, s in open_.items() if share * weight[k] > 3 * s]
        if not above:
            target |= {k: share * weight[k] for k in open_}
            break
        for k in above:
            target[k] = 3.0 * open_.pop(k)
    assert {k: pytest.approx(v) for k, v in target.items()} == {k: r["target"] for k, r in rows.items()}
    assert sum(r["target"] for r in rows.values()) == pytest.approx(total)


def test_packing_edges(docs, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    out = packing.pack_documents(docs, path).collect()
    tokenizer = Tokenizer.from_file(path)
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = b"".join(i.to_bytes(4, "little") for i in ids[start:start + 2048])
            expected.append((r["doc_id"], piece, start, len(part) // 4, zlib.crc32(part)))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["key"], r["piece"], r["start"], r["length"], r["crc"]) for r in out), key=key) == sorted(expected, key=key)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        upto = 0
        for offset, length in sorted(places):
            assert offset == upto
            upto += length
        assert upto <= 2048
    assert len(bins) == -(-sum(r["length"] for r in out) // 2048)
    assert packing.pack_documents(none, path).count() == 0


def test_packing_rounds_meet_in_a_tree(spark):
    lengths = [(i, 0, 0, 100 + (i * 7919) % 1900, i) for i in range(3000)]
    pieces = spark.createDataFrame(lengths, "key long, piece int, start long, length long, crc long")
    out = packing.pack(pieces, items_per_task=2000, fan_in=4).collect()
    assert len(out) == 3000 and len({r["key"] for r in out}) == 3000
    at_once, _ = packing.best_fit(np.array([x[3] for x in lengths]), 2048)
    assert len({r["sequence_id"] for r in out}) <= 1.03 * len(at_once)


def test_secret_edges(spark, none):
    key = "AKIA" + "ABCDEFGHIJ234567"
    token = "Zx9" + "aB3" * 10
    rows = [
        (1, f"password = 'hunter22' and {key}", "en", "a", 0, "", "", ""),
        (2, "API_KEY:short token=abc secret=token: abcdef123", "en", "a", 0, "", "", ""),
        (3, f"\U0001f600é deadbeef{'0' * 16} {token}", "en", "a", 0, "", "", ""),
        (4, "shared " + "Qw8" * 9, "en", "a", 0, "", "", ""), (5, "shared " + "Qw8" * 9, "en", "b", 0, "", "", ""),
        (6, None, None, None, 0, "", "", ""), (7, "", "", "", 0, "", "", ""), (3, "x", "en", None, 0, "", "", ""),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    found = secrets.secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", secrets.listed(F.col("base")).alias("base"),
                                         secrets.listed(F.col("live")).alias("live")).collect()
    got = {(r["doc_id"], r["base"], r["live"]) for r in found}
    assert len(found) == 8
    assert (1, "assign:0:20,access:26:46", "") in got
    assert (2, "assign:0:13", "") not in got and (2, "", "") in got  # values of five and three letters; the fourth sits in a match
    assert (3, "hex:3:27", "token:28:61") in got
    assert (4, "", "") in got and (5, "", "") in got  # two owners share it
    assert (6, "", "") in got and (7, "", "") in got and (3, "", "") in got
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs.filter("n_chars = 0 and source is not null or doc_id = 6")).collect()}
    assert masked[1] == "<secret>' and <secret>" and masked[3] == "\U0001f600é <secret> <secret>" and masked[6] is None
    assert secrets.redact(docs).columns == docs.columns
    assert secrets.secrets(none).count() == 0 and secrets.redact(none).count() == 0


def test_near_duplicate_edges(docs, none):
    out = minhash.near_duplicates(docs).collect()
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert len(out) == docs.count()
    assert {(1, 56, 1, True), (2, 56, 1, False), (3, 0, 3, True), (4, 0, 4, True), (None, 1, None, True), (6, 0, 6, True)} <= got
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "3", "4", "5", "6", "7", "None"]
    twice = docs.filter("doc_id = 2")
    assert minhash.deduplicated(twice).count() == 1
    assert minhash.near_duplicates(none).count() == 0 and minhash.deduplicated(none).count() == 0


def test_repeat_edges(docs, none):
    out = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(docs).collect()}
    size = len(SENTENCE)
    assert {(1, size, 0, 0), (2, size, size, 1), (3, 0, 0, 0), (4, 0, 0, 0), (None, 7, 0, 0), (7, 700, 700, 1)} <= out
    assert suffix.remove_repeats(none).count() == 0


def test_language_model_edges(docs, none, spark):
    target = spark.createDataFrame([(1,), (1,), (99,)], "doc_id long")
    out = {r["doc_id"]: r for r in lm.score(docs, target).collect()}
    assert lm.score(docs, target).count() == docs.count()
    assert out[3]["n_tokens"] == 0 and out[3]["score"] == 0.0
    assert out[1]["score"] < 0 < out[5]["score"]
    assert lm.score(none, target).count() == 0
    assert lm.score(docs, target.filter("false")).count() == docs.count()


def test_language_model_blocks(spark, monkeypatch):
    """Scores don't depend on the blocks; what stands in two documents is known to the models at any size of the corpus."""
    texts = [" ".join(f"w{i * 1000 + j}" for j in range(60)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[7]])], "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(7,), (8,)], "doc_id long")
    whole = {r["doc_id"]: tuple(r) for r in lm.score(docs, target).collect()}
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    assert {r["doc_id"]: tuple(r) for r in lm.score(docs, target).collect()} == whole
    assert whole[7][1:] == whole[300][1:] and whole[7][3] < min(w[3] for i, w in whole.items() if i not in (7, 300))
    p = 0.5 * 2 / 2 + 0.4 * 2 / (301 * 60) + 0.1 / 61
    first = 0.5 * 2 / 301 + 0.4 * 2 / (301 * 60) + 0.1 / 61
    assert abs(whole[7][3] + (59 * np.log(p) + np.log(first)) / 60) < 1e-12


def test_classifier_edges(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (7, 0)], "doc_id long, quality int")
    out = classifier.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert classifier.classify(none, labels).count() == 0
    assert {r["score"] for r in classifier.classify(docs, labels.filter("false")).collect()} == {0.5}


def test_html_edges(spark):
    page = ("<html><body><nav><a href=x>menu</a></nav><div class='cookie-notice'>ok?</div><div class=content12><h1>T &amp; t</h1>"
            "<p>first&nbsp; \n line<br>goes on<p>second <b>bold</b> <a href='>'>link</a><script>var a='<p>no</p>'</script>"
            "<form><p>field</p></form><div class=comments><p>I say</p></div></div><footer>end</footer>")
    rows = [(1, "http://a.b/x", page, "t"), (1, "http://a.b/x", page, "t"), (2, None, None, None), (3, "http://a.b/y", "", ""),
            (4, "http://c.d/", "plain &lt; text <!-- no -->here", ""), (5, "x", "<p", ""), (6, "http://a.b/z", "<article><p>other" + " x" * 50_000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html.extract(pages)
    assert out.count() == 7
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got[1] == "T & t\nfirst line goes on\nsecond bold link"
    assert got[2] == "" and got[3] == "" and len(got[6]) == 5 + 100_000
    assert html.extract(pages.filter("false")).count() == 0


def test_html_votes_overrule_a_page(spark):
    good = "<body><div class=box><p>{}</p></div><div id=main{}><p>" + "story " * 30 + "</p></div></body>"
    odd = "<body><div class=box><p>" + "noise " * 60 + "</p></div><div id=main9><p>tiny</p></div></body>"
    rows = [(i, "http://h/", good.format("x", i)) for i in range(5)] + [(9, "http://h/", odd)]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in out.collect()}[9] == "tiny"


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [0.5, -0.01]), (40, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=3)
    got = sorted((r["query_id"], r["rank"], str(r["vec_id"]), r["score"]) for r in out.collect())
    assert got == [(0, 1, "1", 4096), (0, 2, "2", 4096), (0, 3, "2", 4096), (20, 1, "1", 4096), (20, 2, "2", 4096), (20, 3, "2", 4096),
                   (40, 1, "8", 14 * 4096)]
    assert topk.top_k(vectors.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
