"""Mixing sources to target weights.

Sizes are summed per source, targets give each source a repetition rate, and a document is taken
floor(rate) times plus one more copy whose hash-seeded coin falls with the rate's fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, null_safe_join, settle, text_of, unclashed

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
SEED = "mix"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(F.col(f"`{text}`")), F.lit(WORD)).cast("long")


def coin(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key only; a null key has its own."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(2 ** 32))


def ranked(keys: DataFrame, key: str) -> DataFrame:
    """``rank`` from 0 by ascending key, null last, without ordering all keys in one task.

    Range partitions are ordered each for itself; only one count per partition meets the others.
    """
    order = F.col(key).asc_nulls_last()
    placed = settle(keys.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    own = placed.withColumn("__own", F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1)
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return own.join(counts, "__part").withColumn("rank", F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """``(source, source_size, target, rate)`` from ``(source, size)``, one row per source.

    Sources take the weights in turn, by code point and null last, and share the sum of all sizes.
    A target ends at ``most`` times its source's size; the excess goes to the others by weight until
    none is above. What is shared is found from sums over sources alone, so no source list is collected.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = settle(ranked(totals, "source").withColumn("weight", weight.cast("long")).drop("rank"))
    share, capped = None, F.lit(False)
    while True:
        total, taken, left = sources.agg(
            F.sum("source_size"), F.sum(F.when(capped, most * F.col("source_size"))),
            F.sum(F.when(~capped, F.col("weight")))).first()
        if not left:
            break
        now = ((total or 0) - (taken or 0)) / left
        if share is not None and now == share:
            break
        share = now
        capped = F.lit(share) * F.col("weight") >= most * F.col("source_size")
    target = F.least(F.lit(share if share is not None else 0.0) * F.col("weight"), (most * F.col("source_size")).cast("double"))
    if share is None or not left:
        target = (most * F.col("source_size")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return settle(sources.select("source", "source_size", target.alias("target"), rate.alias("rate")))


def copies_of(rate: Column, key: Column, seed: str = SEED) -> Column:
    return (F.floor(rate) + F.when(coin(seed, key) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
             weights: Sequence[int] = (1, 2, 3), most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """``(key, size, source_size, target, copies)`` with one row per row of ``docs``.

    A null text has size 0; a null source is a source. A source of size 0 has target 0 and no copies.
    Rows with the same key fall alike. An empty table gives an empty plan.
    """
    sized = settle(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{source}`").alias("source"), word_count(text).alias("size")))
    planned = attach(sized, source_targets(sized, weights, most), ["source"])
    return planned.select(F.col(f"`{key}`"), "size", "source_size", "target", copies_of(F.col("rate"), F.col(f"`{key}`"), seed).alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = (1, 2, 3), most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """The mixed table itself: every row of ``docs`` as often as the mix takes it, with its own columns.

    Null texts have size 0, a null source is a source; rows with the same key fall alike, so do repeated
    rows. Columns may have any names. An empty table gives an empty mix.
    """
    docs, names = unclashed(docs)
    key, text, source = names[key], names[text], names[source]
    sizes = docs.select(F.col(f"`{source}`").alias("source"), word_count(text).alias("size"))
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("size")), weights, most)
    rates = targets.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn("__source", F.col(f"`{source}`"))
    copied = attach(marked, rates, ["__source"])
    times = copies_of(F.col("__rate"), F.col(f"`{key}`"), seed)
    return copied.filter(times > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), times))).select(*columns).toDF(*names)
