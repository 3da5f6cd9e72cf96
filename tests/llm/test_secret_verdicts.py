import time

from pyspark.sql import functions as F

from drivelaws.llm import secrets

SCHEMA = "doc_id long, text string, source string"
HEXES = ["%032x" % (0xC0FFEE * (i + 1) ** 3) for i in range(3)]


def found(spark, rows):
    out = secrets.secrets(spark.createDataFrame(rows, SCHEMA))
    said = out.select("doc_id", *(secrets.listed(F.col(c)).alias(c) for c in ("base", "live", "owned")))
    return {r["doc_id"]: (r["base"], r["live"], r["owned"]) for r in said.collect()}


def test_owner_specific_and_copied_values_of_all_kinds(spark):
    upper, lower = "QWERTYUIOPASDFGHJKLZ12345", "zyxwvutsrqponmlkjihg98765"
    example = "AKIA" + "EXAMPLEEXAMPLE77"
    rows = [(i, f"password=hunter2222 {HEXES[0]} {upper}", "one") for i in range(5)]  # five documents of one owner
    rows += [(10, f"see {example} {HEXES[1]} {lower}", "one"), (11, f"{HEXES[1]} {example} {lower}", "two"), (12, f"{HEXES[2]}", None), (13, HEXES[2], None)]
    got = found(spark, rows)
    base, token = "assign:0:19,hex:20:52", "token:53:78"
    assert all(got[i] == (base, token, f"{base},{token}") for i in range(5))
    assert got[10] == ("access:4:24,hex:25:57", "", "") and got[11] == ("hex:0:32,access:33:53", "", "")
    assert got[12] == ("hex:0:32", "", "hex:0:32")  # a null owner is one owner


def test_what_is_no_candidate(spark):
    """Words, few digits, paths and slugs of one case, and values inside base spans add nothing."""
    rows = [(1, "a" * 40, "a"), (2, "abcdefghijklmnopqrstuvwxyz123", "a"), (3, "some-long-article-about-2024-elections-1234", "a"),
            (4, "1" * 30 + " 2", "a"), (5, "token: Zx9" + "aB3" * 10, "a"), (6, None, "a"), (7, "", None)]
    got = found(spark, rows)
    assert [got[i][1] for i in range(1, 8)] == [""] * 7
    assert got[4][0] == "hex:0:30" and got[5][0] == "assign:0:40"


def test_masks_of_many_and_overlapping_spans(spark):
    """A text with a hundred thousand spans is scanned and masked in linear time; copies of it are masked alike."""
    n = 100_000
    long = " ".join("é%031x" % (i * 2654435761 + 7) for i in range(n))
    rows = [(1, long, "a"), (2, long, "b"), (3, "x password=" + HEXES[0] + "! y", "a"), (4, "no secret", "a"), (5, None, "a")]
    docs = spark.createDataFrame(rows, SCHEMA)
    start = time.time()
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert time.time() - start < 60
    assert got[1] == got[2] == " ".join(["é<secret>"] * n)
    assert got[3] == "x <secret>! y" and got[4] == "no secret" and got[5] is None
    sizes = {r["doc_id"]: r["n_hex"] for r in secrets.secrets(docs).select("doc_id", "n_hex").collect()}
    assert sizes == {1: n, 2: n, 3: 1, 4: 0, 5: 0}
