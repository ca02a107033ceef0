"""Windows over arrivals(id, t, value), t counted from the end of the base data.

Basic windows and epochs are closed on the right: number k holds (k-1)*size < t <= k*size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covey.functions.vectors import pearson_from_sums

AGGREGATES = ("avg", "sum", "first", "last", "max", "min", "count")


def slot(t: Column, size: float) -> Column:
    """Number of the right-closed window that holds t."""
    return F.ceil(t / F.lit(float(size))).cast("long")


def aggregate_by(how: str, t: str = "t", value: str = "value") -> Column:
    """first and last are by time, the smaller (first) or larger (last) value on ties."""
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {how}")
    at = F.struct(t, value)
    return {"avg": lambda: F.avg(value), "sum": lambda: F.sum(value), "max": lambda: F.max(value), "min": lambda: F.min(value), "count": lambda: F.count(F.col(value)).cast("double"), "first": lambda: F.min(at)[value], "last": lambda: F.max(at)[value]}[how]()


def basic_windows(arrivals: DataFrame, size: float, how: str = "sum") -> DataFrame:
    """(id, bw, v)."""
    return arrivals.groupBy("id", slot(F.col("t"), size).alias("bw")).agg(aggregate_by(how).alias("v"))


def filled_windows(windows: DataFrame, first: int, last: int | None = None, how: str = "sum") -> DataFrame:
    """Every basic window of every series from ``first`` to ``last`` (the last with an arrival if not given).

    An empty one is 0 for sums and counts, else carries the last value on.
    """
    if last is None:
        last = windows.agg(F.max("bw")).first()[0] or first - 1
    if last < first:
        return windows.limit(0)
    grid = windows.select("id").distinct().withColumn("bw", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    both = grid.join(windows, ["id", "bw"], "left")
    if how in ("sum", "count"):
        return both.withColumn("v", F.coalesce("v", F.lit(0.0)))
    w = Window.partitionBy("id").orderBy("bw").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("v", F.last("v", ignorenulls=True).over(w))


def sliding(windows: DataFrame, width: int, t: str = "bw") -> DataFrame:
    """(id, t, n, sx, sxx) over the last ``width`` windows of each series."""
    w = Window.partitionBy("id").orderBy(t).rowsBetween(-(width - 1), 0)
    return windows.select("id", t, F.count(F.lit(1)).over(w).alias("n"), F.sum("v").over(w).alias("sx"), F.sum(F.col("v") * F.col("v")).over(w).alias("sxx"))


def sliding_pairs(windows: DataFrame, width: int, t: str = "bw") -> DataFrame:
    """(i, j, t, rho) over full sliding windows, from running sums."""
    a, b = windows.select(t, F.col("id").alias("i"), F.col("v").alias("x")), windows.select(t, F.col("id").alias("j"), F.col("v").alias("y"))
    w = Window.partitionBy("i", "j").orderBy(t).rowsBetween(-(width - 1), 0)
    x, y = F.col("x"), F.col("y")
    sums = a.join(b, t).where("i < j").select("i", "j", t, F.count(F.lit(1)).over(w).alias("n"), F.sum(x).over(w).alias("sx"), F.sum(y).over(w).alias("sy"), F.sum(x * x).over(w).alias("sxx"), F.sum(y * y).over(w).alias("syy"), F.sum(x * y).over(w).alias("sxy"))
    rho = pearson_from_sums(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    return sums.where(F.col("n") == width).select("i", "j", t, rho.alias("rho")).where("rho is not null")


def count_batches(arrivals: DataFrame, size: int, buckets: int = 64) -> DataFrame:
    """Epochs of ``size`` arrivals in the order of t: (id, t, value, epoch).

    Places come from the counts of ranges of t and row numbers within one: no task orders all arrivals.
    """
    span = arrivals.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    at = arrivals.join(F.broadcast(span)).withColumn("bucket", F.least(F.floor(F.coalesce(F.try_divide(F.col("t") - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("int"))
    counts = at.groupBy("bucket").count()
    before = counts.alias("c").join(counts.select(F.col("bucket").alias("lower"), F.col("count").alias("n")), F.col("lower") < F.col("bucket"), "left").groupBy("bucket").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("t", "id", "value"))
    numbered = at.join(F.broadcast(before), "bucket").withColumn("place", place + F.col("before"))
    return numbered.select("id", "t", "value", F.ceil(F.col("place") / size).cast("long").alias("epoch"))


def result_delta(results: DataFrame) -> DataFrame:
    """(epoch, lhs, rhs, change): what entered and what left from one epoch to the next."""
    keys = results.select("epoch", "lhs", "rhs")
    before = keys.withColumn("epoch", F.col("epoch") + 1)
    last = F.broadcast(keys.agg(F.max("epoch").alias("last")))
    entered = keys.join(before, ["epoch", "lhs", "rhs"], "left_anti").withColumn("change", F.lit("entered"))
    left = before.join(last).where("epoch <= last").drop("last").join(keys, ["epoch", "lhs", "rhs"], "left_anti").withColumn("change", F.lit("left"))
    return entered.unionByName(left)


def runtime_regression(runs: DataFrame) -> DataFrame:
    """Simple linear regression of y on x over all rows up to each: (t, slope, intercept, mean), slope 0 without variance.

    A row is an epoch of one run, some thousand at most, so one task orders them.
    """
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    n, sx, sy = F.count(F.lit(1)).over(w), F.sum("x").over(w), F.sum("y").over(w)
    sxx, sxy = F.sum(F.col("x") * F.col("x")).over(w), F.sum(F.col("x") * F.col("y")).over(w)
    s = runs.select("t", n.alias("n"), sx.alias("sx"), sy.alias("sy"), sxx.alias("sxx"), sxy.alias("sxy"))
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(F.abs(spread) > 1e-9, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).otherwise(0.0)
    s = s.withColumn("slope", slope)
    return s.select("t", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"), (F.col("sy") / F.col("n")).alias("mean"))
