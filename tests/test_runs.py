import random

import pytest
from pyspark.sql import functions as F

from drivelaws.operators import runs as R

HAND = ["10", "1010", "11", "1n10", "10110", "2110", "", "0", "110110", "1001100", "101", "10101010", "1101011100110", "111"]


def state_machine(values):
    """The reading rule, one value after the other."""
    out, start, end, opened, closable = [], None, None, False, False
    for i, v in enumerate(values):
        if v == 1.0 and not opened:
            opened, start = True, i
        elif v == 1.0:
            closable, end = True, i
        elif v == 0.0 and closable:
            out.append((start, end, end - start))
            opened = closable = False
    return out


def sequences():
    rng = random.Random(5)
    out = [[{"n": None}.get(c, float(c) if c != "n" else None) for c in text] for text in HAND]
    for _ in range(400):
        out.append([rng.choice([0.0, 1.0, 1.0, None, 2.0, 0.0, 0.0]) for _ in range(rng.randint(1, 60))])
    return out


@pytest.mark.parametrize("piece_rows", [1, 2, 3, 7, 25, 10**6])
def test_equals_state_machine_in_any_pieces(spark, piece_rows):
    cases = sequences()
    rows = [(t, i, v) for t, seq in enumerate(cases) for i, v in enumerate(seq)]
    df = spark.createDataFrame(rows, "trip int, at int, v double")
    got = {}
    for r in R.state_runs(df, "v", ["at"], ["trip"], piece_rows=piece_rows).collect():
        got.setdefault(r.trip, []).append((r.start, r.end, r.duree))
    for t, seq in enumerate(cases):
        assert sorted(got.get(t, [])) == state_machine(seq), seq


def test_pieces_are_even_though_times_are_not(spark):
    """Nine tenths of the rows lie in a thousandth of the time, and a third has one and the same time."""
    times = [(i / 1e4,) for i in range(9000)] + [(float(i),) for i in range(1, 1001)]
    df = spark.createDataFrame(times, "t double").select(F.lit(1).alias("trip"), "t")
    placed, cut = R.in_pieces(df, "t", 1000)
    sizes = [r["count"] for r in placed.groupBy("piece").count().collect()]
    assert cut.count() == 1 and len(sizes) == 10 and max(sizes) <= 1010
    tied, _ = R.in_pieces(df.select("trip", F.when(F.col("t") < 0.3, 0.0).otherwise(F.col("t")).alias("t")), "t", 1000)
    assert tied.groupBy("t").agg(F.count_distinct("piece").alias("n")).filter("n > 1").isEmpty()
    assert R.in_pieces(df, "t", 10_000)[1] is None


def test_times_that_are_null_or_equal(spark):
    """Null times come first; rows of one time go by the next column, across all pieces alike."""
    values = [1.0, 0.0, 1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 1.0]
    rows = [(None if i < 3 else i // 2, i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "t int, i int, v double")
    want = sorted(((r.start, r.end) for r in R.state_runs(df, "v", ["t", "i"]).collect()), key=str)
    assert len(want) == 2
    for piece_rows in (1, 2, 4):
        got = R.state_runs(df, "v", ["t", "i"], piece_rows=piece_rows).collect()
        assert sorted(((r.start, r.end) for r in got), key=str) == want


def test_null_trip_and_no_partition(spark):
    rows = [(None, i, v) for i, v in enumerate([1.0, 1.0, 0.0])] + [("a", i, v) for i, v in enumerate([1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "trip string, at int, v double")
    for piece_rows in (1, 100):
        got = R.state_runs(df, "v", ["at"], ["trip"], piece_rows=piece_rows).collect()
        assert sorted((str(r.trip), r.start, r.end) for r in got) == [("None", 0, 1), ("a", 0, 1)]
    one = R.state_runs(df.filter("trip = 'a'"), "v", ["at"]).collect()
    assert [(r.start, r.end) for r in one] == [(0, 1)]


def test_timestamps_give_seconds(spark):
    df = spark.createDataFrame([(0, 1.0), (5400, 1.0), (9000, 0.0)], "s int, v double").select(
        F.timestamp_seconds("s").alias("ts"), "v")
    assert [r.duree for r in R.state_runs(df, "v", ["ts"]).collect()] == [5400.0]
