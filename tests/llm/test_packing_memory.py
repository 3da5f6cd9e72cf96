import tracemalloc

import pyarrow as pa
import pytest
from drivelaws.llm import packing
from drivelaws.llm.common import ARROW_BYTES, settle


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_settled_rows_reach_python_in_batches_of_few_bytes(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 1000) as text")
    before = spark.conf.get(ARROW_BYTES)
    seen = settle(texts.mapInArrow(run, "rows long, bytes long"), 1 << 19).collect()
    assert sum(r["rows"] for r in seen) == 3000 and max(r["bytes"] for r in seen) < (1 << 19) + 10_000
    assert spark.conf.get(ARROW_BYTES) == before


def test_a_lower_limit_of_the_session_holds(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('a', 1000) as text")
    spark.conf.set(ARROW_BYTES, str(1 << 18))
    try:
        seen = settle(texts.mapInArrow(run, "bytes long"), 1 << 20).collect()
        assert max(r["bytes"] for r in seen) < (1 << 18) + 10_000
    finally:
        spark.conf.unset(ARROW_BYTES)


def test_packing_takes_texts_in_small_batches(spark, tokenizer, monkeypatch):
    limits = []
    monkeypatch.setattr(packing, "settle", lambda df, batch_bytes=None: limits.append((df.columns, batch_bytes)) or settle(df, batch_bytes))
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert packing.pack_documents(docs, tokenizer).count() == 2
    assert 0 < limits[0][1] <= packing.BATCH_BYTES and "crc" in limits[0][0]


def test_words_of_a_batch_are_no_objects_of_python(tokenizer):
    words = packing.WordIds(tokenizer)
    texts = ["ab cd " * 500] * 400
    words.encode(texts[:1])
    tracemalloc.start()
    try:
        ids = words.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    n = sum(map(len, ids))
    assert n == 400 * 1001 and peak < 60 * n


def test_arrow_splits_as_the_tokenizer_does(tokenizer):
    words = packing.WordIds(tokenizer)
    texts = ["", " ", "\n", "a", " A. \tb,\r\nc ", "x\x0by\x0cz.", "a\x85b\xa0c　D", "<|endoftext|> A <|EndOfText|>\tb. ", "É. é, ß. İ.", "  two  blanks  "]
    for some in (texts, texts[::-1], ["", ""], [" "]):
        assert [ids.tolist() for ids in words.encode(some)] == [
            [*words.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in some]
