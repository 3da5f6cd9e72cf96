"""One query per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, html, lexical, lm, minhash, mixing, packing, quality, secrets, simhash, spelling, suffix, topk
from .common import table
from .sql import SQL

__all__ = ["QUERIES", "SQL"]

TOKENIZER = "word_bpe_49k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.repetition(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "quality.*")


@query
def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query
def op7_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.array_sort(F.concat("base", "live"))).alias("spans"), F.size("owned").cast("long").alias("n_live"),
        (F.size(F.concat("base", "live")) - F.size("owned")).cast("long").alias("n_copied"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf, "documents"), tokenizer_path())
    return packed.select(F.col("key").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4


@query
def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").filter(fold() != 2)
    scored = classifier.classify(table(spark, sf, "documents"), labels)
    return scored.select("doc_id", (F.coalesce(fold(), F.lit(0)) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    texts = html.extract(table(spark, sf, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op5_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op4_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query
def op6_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    target = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    scored = lm.score(table(spark, sf, "documents"), target)
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    left = suffix.remove_repeats(table(spark, sf, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=20)


@query
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))
