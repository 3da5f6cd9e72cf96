"""Samples: the positive values of numeric columns, all criteria in one long table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import attach, null_safe, settle

# At most so many values of a group meet in one task; a bracket with more is divided first.
GATHER = 100_000
CELLS = 1024
LARGEST = 1.7976931348623157e308
CUSTOMER_PS = (0.01, 0.5, 0.99)


def positive(df: DataFrame, col: str) -> DataFrame:
    """Rows whose value is a number above 0; NaN, which Spark orders above all numbers, is none."""
    value = F.col(f"`{col}`")
    return df.filter((value > 0.0) & ~F.isnan(value))


def to_sample(df: DataFrame, cols: Sequence[str], group: str | None = None) -> DataFrame:
    """``(criteria, x)`` with one row per value > 0; nulls and NaN are dropped.

    With ``group`` the criterion is the group's text, prefixed by the column when there are several.
    """
    doubles = [F.col(f"`{c}`").cast("double").alias(c) for c in cols]
    keys = [] if group is None else [F.col(f"`{group}`").cast("string").alias("__group")]
    if len(cols) == 1:
        long = df.select(*keys, F.lit(cols[0]).alias("criteria"), doubles[0].alias("x"))
    else:
        long = df.select(*keys, *doubles).unpivot(["__group"] if keys else [], list(cols), "criteria", "x")
    if group is not None:
        name = F.col("__group") if len(cols) == 1 else F.concat_ws("|", "criteria", "__group")
        long = long.select(name.alias("criteria"), "x")
    return positive(long, "x")


def sample_summary(sample: DataFrame) -> DataFrame:
    return sample.groupBy("criteria").agg(
        F.count("x").alias("n"),
        F.min("x").alias("data_min"),
        F.max("x").alias("data_max"),
        F.avg("x").alias("data_mean"),
    )


def moments(sample: DataFrame, ddof: int = 1) -> DataFrame:
    """Mean, standard deviation and variance, NaN skipped."""
    x = F.when(~F.isnan("x"), F.col("x"))
    std, var = (F.stddev_samp, F.var_samp) if ddof else (F.stddev_pop, F.var_pop)
    return sample.groupBy("criteria").agg(F.avg(x).alias("mean"), std(x).alias("std"), var(x).alias("var"))


def _marks(ps: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(p)) for p in ps))


def _ranks(n: Column, ps: Sequence[float]) -> Column:
    """Distinct 0-based ranks that interpolation at ``ps`` reads."""
    def ends(p: Column) -> Column:
        at = (n - F.lit(1)) * p
        return F.array(F.floor(at), F.ceil(at))

    return F.array_distinct(F.flatten(F.transform(_marks(ps), ends)))


def _interpolate(n: Column, value_at: Callable[[Column], Column], ps: Sequence[float]) -> Column:
    """Linear interpolation between order statistics looked up by 0-based rank."""
    def between(p: Column) -> Column:
        at = (n - F.lit(1)) * p
        low, high = value_at(F.floor(at)), value_at(F.ceil(at))
        return low + (high - low) * (at - F.floor(at))

    return F.transform(_marks(ps), between)


def locate(rows: DataFrame, name: str, depth: int, reached: Callable[[Column], Column]) -> DataFrame:
    """Add ``name``: how many of ``2**depth - 1`` ascending cuts a row has reached.

    ``reached(i)`` says whether the row lies past cut i. The binary search is a chain of small
    projections, which stays inside one compiled stage at any number of cuts. Join or group on
    ``name``, don't filter on it: a filter pushed below would unfold the chain.
    """
    rows = rows.withColumn(name, F.lit(0))
    for half in (2 ** k for k in reversed(range(depth))):
        step = F.when(reached(F.col(name) + F.lit(half - 1)), half).otherwise(0)
        rows = rows.withColumn(name, F.col(name) + step)
    return rows


def _inside(rows: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, start, lo, hi, x)``: the rows that lie in a bracket of their group, of which there are few."""
    held = F.collect_list(F.struct("start", "lo", "hi"))
    lists = settle(brackets.groupBy(*by).agg(held.alias("__brackets")))
    hit = F.filter("__brackets", lambda b: (F.col("x") >= b["lo"]) & (F.col("x") <= b["hi"]))
    return attach(rows, lists, by).select(*by, "x", F.inline(hit))


def _divided(rows: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """Brackets cut into equal cells, of which those that hold a wanted rank remain, as tight as their values."""
    # halves, so that the widest range of doubles has a width
    part = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    cell = F.least(F.floor(part * CELLS), F.lit(CELLS - 1))
    counts = _inside(rows, brackets, by).groupBy(*by, "start", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("size"), F.min("x").alias("least"), F.max("x").alias("most"))
    earlier = Window.partitionBy(*by, "start").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    placed = null_safe(counts, brackets.select(*by, "start", "n", "ranks"), [*by, "start"])
    held = F.filter("ranks", lambda r: (r >= F.col("at")) & (r < F.col("at") + F.col("size")))
    return placed.select(*by, "n", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("at").alias("start"), "size",
                         held.alias("ranks")).filter(F.size("ranks") > 0)


def sizes_of(summary: DataFrame) -> DataFrame:
    """What ``percentiles`` needs to know of each criterion's values, from a summary of them."""
    return summary.select("criteria", "n", F.col("data_min").alias("lo"), F.col("data_max").alias("hi"))


def percentiles(rows: DataFrame, ps: Sequence[float] = CUSTOMER_PS, by: Sequence[str] = ("criteria",),
                value: str = "x", gather: int = GATHER, sizes: DataFrame | None = None) -> DataFrame:
    """Exact linearly interpolated percentiles per group as ``(*by, pct array<double>)``.

    A group is one bracket at first. A bracket of more than ``gather`` values is cut into equal cells,
    which are counted with partial sums, and the cells that hold a wanted rank are the next brackets;
    what is left is ordered. ``sizes`` is a settled ``(*by, n, lo, hi)``, if at hand.
    """
    by = list(by)
    x = F.col(f"`{value}`").cast("double")
    rows = rows.filter(x.isNotNull() & ~F.isnan(x)).select(*by, F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST)).alias("x"))
    if sizes is None:
        sizes = settle(rows.groupBy(*by).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))

    def told(c: Column) -> Column:
        return F.when(F.abs(c) >= LARGEST, F.signum(c) * F.lit(float("inf"))).otherwise(c)

    much = (F.col("size") > gather) & (F.col("lo") < F.col("hi"))
    brackets = sizes.filter("n > 0").select(
        *by, "n", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), F.lit(0).cast("long").alias("start"),
        F.col("n").alias("size"), _ranks(F.col("n"), ps).alias("ranks"))
    brackets = brackets.withColumns({c: F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST)) for c in ("lo", "hi")})
    # a large group of equal values is known without its rows, which must not be gathered
    if brackets.filter(F.col("size") > gather).isEmpty():
        ordered = rows.groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("values"))
        return ordered.select(*by, _interpolate(F.size("values"), lambda r: told(F.col("values")[r.cast("int")]), ps).alias("pct"))
    while True:
        brackets = settle(brackets)
        open_ = brackets.filter(much)
        if open_.isEmpty():
            break
        brackets = brackets.filter(~much).unionByName(_divided(rows, open_, by))
    alike = F.col("lo") == F.col("hi")
    known = brackets.filter(alike).select(*by, "n", F.explode("ranks").alias("rank"), F.col("lo").alias("x"))
    few = brackets.filter(~alike)
    ordered = _inside(rows, few, by).groupBy(*by, "start").agg(F.sort_array(F.collect_list("x")).alias("values"))
    picked = null_safe(ordered, few.select(*by, "start", "n", "ranks"), [*by, "start"]).select(
        *by, "n", "start", "values", F.explode("ranks").alias("rank"))
    values = known.unionByName(picked.select(*by, "n", "rank", F.col("values")[(F.col("rank") - F.col("start")).cast("int")].alias("x")))
    found = values.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("values"))
    return found.select(*by, _interpolate(F.col("n"), lambda r: told(F.col("values")[r]), ps).alias("pct"))


def percentile_grid(sample: DataFrame, step: int = 5, grid_from: int = 0, **options) -> DataFrame:
    """Empirical points ``(criteria, p, value)`` at p = grid_from, +step, … below 100 percent."""
    marks = list(range(grid_from, 100, step))
    pct = percentiles(sample, [m / 100 for m in marks], **options)
    points = F.arrays_zip(F.array(*(F.lit(m) for m in marks)).alias("p"), F.col("pct").alias("value"))
    return pct.select("criteria", F.inline(points).alias("p", "value"))


def density_hist(sample: DataFrame, bins: int = 30, summary: DataFrame | None = None) -> DataFrame:
    """Density histogram over [min, max], the last bin closed and empty bins kept."""
    summary = settle(sample_summary(sample)) if summary is None else summary
    bounds = summary.filter("data_max > data_min").select(
        "criteria", "n", "data_min", ((F.col("data_max") - F.col("data_min")) / bins).alias("width"))
    place = F.least(F.floor((F.col("x") - F.col("data_min")) / F.col("width")), F.lit(bins - 1))
    counts = attach(sample, bounds, ["criteria"]).groupBy("criteria", place.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("freq"))
    every = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    freq = F.coalesce("freq", F.lit(0))
    return null_safe(every, counts, ["criteria", "bin"], "left").select(
        "criteria", "bin",
        (F.col("data_min") + F.col("bin") * F.col("width")).alias("bin_start"),
        freq.alias("freq"),
        (freq / (F.col("n") * F.col("width"))).alias("density"),
    )


def ols(points: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """Least squares of y on x per group, null points skipped."""
    return points.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("R2"),
    )
