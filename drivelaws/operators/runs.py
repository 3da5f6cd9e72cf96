"""State periods of a binary signal.

Reading a signal in order, a period opens at the first 1, needs a second 1 to be closable, and is
closed by the next 0; other values are ignored. So a lone 1 stays open across zeros and joins the
ones that follow, and a last period without a 0 after it is dropped.

Stretches of ones between zeros are the runs. A run of two or more closes what is open; a run of
one closes what is open or else opens. Which of the two depends only on counts of earlier runs.

A trip is read in pieces of bounded size, most trips in one. All a piece needs from the pieces before
it is what they leave open: nothing, a lone 1, or a period that the next 0 closes. A piece is thus
summed up by what it leaves open after each of the three; these summaries, one row per piece, are
composed along the trip, and what a piece finds open enters it as a run in front of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import is_small, settle

PIECE_ROWS = 2_000_000
# Ones that stand for what a piece finds open: nothing, a lone 1, a closable period.
ENTRIES = (0, 1, 2)
RUN = ["trip", "piece", "run"]


def elapsed(kind: T.DataType, start: str, end: str) -> Column:
    """Seconds between timestamps, plain difference of numbers."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.expr(f"timestampdiff(MICROSECOND, `{start}`, `{end}`)") / F.lit(1e6)
    return F.col(f"`{end}`") - F.col(f"`{start}`")


def in_pieces(ticks: DataFrame, time: str, piece_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows with the number of their piece, and the trips that have several (settled; none if there are none).

    Borders are times of the trip at equal ranks, so a piece is even however uneven the times are;
    rows of one time are never parted. Any borders give the same periods.
    """
    sizes = ticks.groupBy("trip").agg(F.count(F.lit(1)).alias("size"))
    long = settle(sizes.filter(F.col("size") > piece_rows))
    largest = long.agg(F.max("size")).first()[0]
    if largest is None:
        return ticks.withColumn("piece", F.lit(0)), None
    pieces = -(-largest // piece_rows)
    known = F.broadcast(long) if is_small(long) else long
    ranks = [i / pieces for i in range(1, pieces)]
    borders = settle(ticks.join(known.select("trip"), "trip", "left_semi").groupBy("trip").agg(
        F.array_distinct(F.percentile_approx(time, ranks, max(10_000, 10 * pieces))).alias("borders")))
    joined = ticks.join(F.broadcast(borders) if is_small(borders) else borders, "trip", "left")
    passed = F.size(F.filter("borders", lambda b: b <= F.col(time)))  # a null time, which comes first, passes none
    return joined.withColumn("piece", F.when(F.col("borders").isNull(), 0).otherwise(passed)).drop("borders"), borders.select("trip")


def runs_of(ticks: DataFrame, order: Sequence[str]) -> DataFrame:
    """``(trip, piece, run, start, end, ones, zeros)``: runs by the zeros before them, and the zeros of the piece.

    What follows the last zero of a piece has a row even if it holds no ones. One shuffle.
    """
    upto = Window.partitionBy("trip", "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = ticks.select(
        "trip", "piece", "on", F.when(F.col("on"), F.col(order[0])).alias("at"), F.count_if(~F.col("on")).over(upto).alias("run"),
        F.count_if(~F.col("on")).over(Window.partitionBy("trip", "piece")).alias("zeros"))
    return counted.filter(F.col("on") | (F.col("run") == F.col("zeros"))).groupBy(*RUN).agg(
        F.min("at").alias("start"), F.max("at").alias("end"), F.count_if("on").alias("ones"), F.max("zeros").alias("zeros"))


def joined_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs that make one period, closed or not, as one row: all up to a run of two or more, lone ones by pairs."""
    before = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    stretched = runs.filter("ones > 0").withColumn("stretch", F.count_if(F.col("ones") > 1).over(before))
    place = F.row_number().over(Window.partitionBy(*keys, "stretch").orderBy("run")) - 1
    return stretched.withColumn("pair", F.floor(place / F.lit(2))).groupBy(*keys, "stretch", "pair").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("ones").alias("ones"),
        F.max("run").alias("run"), F.max("zeros").alias("zeros"), F.min("run").alias("first"))


def carried(runs: DataFrame) -> DataFrame:
    """What each piece of the trips given finds open, as the run ``(trip, piece, run 0, start, end, ones)``."""
    # a piece after each of the three entries; start and end stay null where they are those of the entry
    entered = runs.groupBy("trip", "piece").agg(F.max("zeros").alias("zeros")).withColumn("entry", F.explode(F.array(*map(F.lit, ENTRIES))))
    front = entered.select(*RUN[:2], F.lit(0).cast("long").alias("run"), F.col("entry").cast("long").alias("ones"), "zeros", "entry")
    own = runs.withColumn("entry", F.explode(F.array(*map(F.lit, ENTRIES))))
    keys = ["trip", "piece", "entry"]
    both = own.unionByName(front, allowMissingColumns=True).groupBy(*keys, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("ones").alias("ones"), F.max("zeros").alias("zeros"))
    last = joined_runs(both, keys).groupBy(*keys).agg(F.max(F.struct("run", "first", "start", "end", "ones", "zeros")).alias("last"))
    last = entered.join(last, keys, "left").select(*keys, "last.*")
    # the last period is open if it is a lone 1, or if no zero follows it; it began at the entry if it holds run 0
    open_ones = F.when(F.col("ones") == 1, 1).when((F.col("ones") > 1) & (F.col("run") == F.col("zeros")), 2).otherwise(0)
    heir = (F.col("entry") > 0) & (F.col("first") == 0)
    exits = last.select(*keys, F.struct(
        open_ones.alias("ones"), F.coalesce(heir, F.lit(False)).alias("heir"), "start", "end").alias("exit"))
    wide = exits.groupBy("trip", "piece").agg(*(F.max(F.when(F.col("entry") == e, F.col("exit"))).alias(f"exit{e}") for e in ENTRIES))
    along = wide.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("piece", *(f"exit{e}" for e in ENTRIES)))).alias("pieces"))
    at = runs.schema["start"].dataType.simpleString()
    kind = f"struct<piece:int,ones:int,start:{at},end:{at}>"
    nothing = F.struct(F.lit(None).cast("int").alias("piece"), F.lit(0).alias("ones"), F.lit(None).cast(at).alias("start"), F.lit(None).cast(at).alias("end"))

    def step(found: Column, piece: Column) -> Column:
        state = F.element_at(found, -1)
        done = F.when(state["ones"] == 0, piece["exit0"]).when(state["ones"] == 1, piece["exit1"]).otherwise(piece["exit2"])
        begun = F.when(done["heir"], F.coalesce(state["start"], done["start"])).otherwise(done["start"])
        ended = F.when(done["heir"], F.greatest(state["end"], done["end"])).otherwise(done["end"])
        return F.concat(found, F.array(F.struct(
            (piece["piece"] + 0).alias("piece"), done["ones"].alias("ones"), begun.alias("start"), ended.alias("end")).cast(kind)))

    states = along.select("trip", "pieces", F.aggregate("pieces", F.array(nothing.cast(kind)), step).alias("states"))
    # the state after piece i is what piece i + 1 finds
    found = states.select("trip", F.inline(F.zip_with(
        "pieces", F.slice("states", F.lit(1), F.size("pieces")), lambda p, s: F.struct(
            p["piece"].alias("piece"), s["start"].alias("start"), s["end"].alias("end"), s["ones"].cast("long").alias("ones")))))
    return found.filter("ones > 0").select("trip", "piece", F.lit(0).cast("long").alias("run"), "start", "end", "ones")


def state_runs(df: DataFrame, state: str, order_by: Sequence[str], partition_by: Sequence[str] = (),
               piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``(*partition_by, start, end, duree)``, one row per closed period.

    ``order_by`` starts with the time column, a number, date or timestamp. About ``piece_rows`` rows of a trip are ordered
    at a time, so a trip with a large part of all rows is spread over as many tasks as it has pieces.
    """
    time, by = order_by[0], list(partition_by)
    value = F.col(f"`{state}`").cast("double")
    # one struct key is never null, so plain equi-joins keep the windows' partitioning
    key = F.struct(*(F.col(f"`{k}`") for k in by)) if by else F.struct(F.lit(0).alias("all"))
    order = [f"__o{i}" for i in range(len(order_by))]
    ticks = df.filter(value.isin(0.0, 1.0)).select(
        key.alias("trip"), (value == 1.0).alias("on"), *(F.col(f"`{c}`").alias(o) for c, o in zip(order_by, order)))
    placed, cut = in_pieces(ticks, order[0], piece_rows)
    runs = runs_of(placed, order)
    if cut is not None:
        runs = settle(runs)  # far fewer than the rows; made once, as it is read twice
        entries = carried(runs.join(F.broadcast(cut) if is_small(cut) else cut, "trip", "left_semi"))
        runs = runs.unionByName(entries, allowMissingColumns=True).groupBy(*RUN).agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.sum("ones").alias("ones"), F.max("zeros").alias("zeros"))
        within = Window.partitionBy("trip", "piece")
        runs = runs.withColumn("zeros", F.max("zeros").over(within))
    periods = joined_runs(runs, ["trip", "piece"])
    return periods.filter((F.col("ones") > 1) & (F.col("run") < F.col("zeros"))).select(
        *(F.col("trip")[k].alias(k) for k in by), "start", "end",
        elapsed(df.schema[time].dataType, "start", "end").alias("duree"))
