"""Preparation of raw observations: ticks(id, ts, v) or points(id, t, v) to series that can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_ticks(raw: DataFrame, date: str = "date", time: str = "time", value: str = "price", form: str = "MM/dd/yyyy HH:mm") -> DataFrame:
    """(id, ts, v) from date and time strings; of equal times of a series one row stays (the smallest value)."""
    ts = F.to_timestamp(F.concat_ws(" ", date, time), form)
    return raw.select("id", ts.alias("ts"), F.col(value).cast("double").alias("v")).groupBy("id", "ts").agg(F.min("v").alias("v"))


def slice_range(ticks: DataFrame, start, end) -> DataFrame:
    """Rows in [start, end], and for each series its first and last value set at the ends where it has none there."""
    inside = ticks.where(F.col("ts").between(F.lit(start), F.lit(end)))
    ends = inside.groupBy("id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.min_by("v", "ts").alias("va"), F.max_by("v", "ts").alias("vb"))
    head = ends.where(F.col("a") > F.lit(start)).select("id", F.lit(start).alias("ts"), F.col("va").alias("v"))
    tail = ends.where(F.col("b") < F.lit(end)).select("id", F.lit(end).alias("ts"), F.col("vb").alias("v"))
    kind = ticks.schema["ts"].dataType
    return inside.select("id", "ts", "v").unionByName(head.withColumn("ts", F.col("ts").cast(kind))).unionByName(tail.withColumn("ts", F.col("ts").cast(kind)))


def resample_mean(ticks: DataFrame, every: str = "1 minute") -> DataFrame:
    """(id, t, v): mean of each interval between a series' first and last; intervals without ticks are null."""
    means = ticks.groupBy("id", F.window("ts", every)["start"].alias("t")).agg(F.avg("v").alias("v"))
    span = means.groupBy("id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = span.select("id", F.explode(F.sequence("a", "b", F.expr(f"interval {every}"))).alias("t"))
    return grid.join(means, ["id", "t"], "left")


def drop_empty_points(points: DataFrame) -> DataFrame:
    """Without the times at which every series is null."""
    some = points.groupBy("t").agg(F.count("v").alias("n")).where("n > 0").select("t")
    return points.join(some, "t", "left_semi")


def last_points(points: DataFrame, number: int) -> DataFrame:
    """The last ``number`` times of the table (times are few: bounded by the span, not by the rows)."""
    times = points.select("t").distinct().orderBy(F.col("t").desc()).limit(number)
    return points.join(F.broadcast(times), "t", "left_semi")


def null_runs(points: DataFrame, first: int | None = None) -> DataFrame:
    """(id, longest): the longest run of nulls of each series, within its first points if asked."""
    w = Window.partitionBy("id").orderBy("t")
    at = points.withColumn("n", F.row_number().over(w))
    at = at.where(F.col("n") <= first) if first else at
    gaps = at.where("v is null").withColumn("g", F.col("n") - F.row_number().over(w))
    runs = gaps.groupBy("id", "g").count().groupBy("id").agg(F.max("count").alias("longest"))
    return points.select("id").distinct().join(runs, "id", "left").select("id", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))


def drop_long_gaps(points: DataFrame, most: int, first: int = 1000) -> DataFrame:
    """Without series that have ``most`` nulls in a row within their first points."""
    return points.join(null_runs(points, first).where(F.col("longest") < most).select("id"), "id", "left_semi")


def interpolate(points: DataFrame, backfill: bool = True) -> DataFrame:
    """Nulls filled on the line between their neighbours by position; trailing ones keep the last value, leading ones take the first."""
    w = Window.partitionBy("id").orderBy("t")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("v").isNotNull(), F.struct(F.col("n"), F.col("v")))
    p = points.withColumn("n", F.row_number().over(w))
    p = p.withColumn("a", F.last(known, ignorenulls=True).over(back)).withColumn("b", F.first(known, ignorenulls=True).over(ahead))
    line = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * F.try_divide(F.col("n") - F.col("a.n"), F.col("b.n") - F.col("a.n"))
    filled = F.coalesce("v", line, F.col("a.v"), F.col("b.v") if backfill else F.lit(None).cast("double"))
    return p.select("id", "t", filled.alias("v"))


def log_returns(points: DataFrame, digits: int = 4, largest: float = 100.0) -> DataFrame:
    """ln(v) - ln(previous v), rounded; values beyond ``largest`` become 0; the first point of a series has none."""
    w = Window.partitionBy("id").orderBy("t")
    r = F.when(F.col("v") > 0, F.ln("v")) - F.when(F.lag("v").over(w) > 0, F.ln(F.lag("v").over(w)))
    out = points.select("id", "t", F.round(r, digits).alias("v")).where("v is not null")
    return out.withColumn("v", F.when(F.abs("v") > largest, 0.0).otherwise(F.col("v")))


def drop_still(points: DataFrame, least_variance: float = 1e-8) -> DataFrame:
    """Without series of a sample variance of at most ``least_variance``."""
    return points.join(points.groupBy("id").agg(F.var_samp("v").alias("s")).where(F.col("s") > least_variance).select("id"), "id", "left_semi")


def outliers_to_zero(points: DataFrame, largest: float) -> DataFrame:
    return points.withColumn("v", F.when(F.abs("v") > largest, 0.0).otherwise(F.col("v")))


def locf_grid(readings: DataFrame, start, end, every: str) -> DataFrame:
    """(id, t, v) on a regular grid: the last reading at or before each grid time; null before the first."""
    grid = readings.select("id").distinct().withColumn("t", F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {every}"))))
    marks = grid.select("id", F.col("t").alias("ts"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("mark"))
    both = readings.select("id", "ts", "v", F.lit(0).alias("mark")).unionByName(marks)
    w = Window.partitionBy("id").orderBy("ts", "mark").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("mark = 1").select("id", F.col("ts").alias("t"), "v")


def regular_sensors(readings: DataFrame, missing=(9999.0, 99999.0, 999999.0), most_gap_days: float = 10, most_faults: int = 20, most_still_days: float = 5) -> DataFrame:
    """Sound readings (id, ts, v) of sound sensors from (id, ts, v, quality).

    A reading of a missing-value code or a quality flag other than 1 is a fault; sensors of too many faults, too long a
    gap, or an unchanged value for too long are dropped.
    """
    fault = F.col("v").isNull() | F.col("v").isin(*missing) | (F.coalesce("quality", F.lit(1)) != 1)
    faults = readings.groupBy("id").agg(F.count_if(fault).alias("f")).where(F.col("f") <= most_faults).select("id")
    good = readings.where(~fault).select("id", "ts", "v").join(faults, "id", "left_semi")
    w = Window.partitionBy("id").orderBy("ts")
    steps = good.withColumn("gap", (F.col("ts").cast("double") - F.lag("ts").over(w).cast("double")) / 86400)
    steps = steps.withColumn("same", F.when(F.col("v") == F.lag("v").over(w), 0).otherwise(1)).withColumn("run", F.sum("same").over(w))
    still = steps.groupBy("id", "run").agg(((F.max("ts").cast("double") - F.min("ts").cast("double")) / 86400).alias("d")).groupBy("id").agg(F.max("d").alias("d"))
    gaps = steps.groupBy("id").agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("g"))
    keep = gaps.join(still, "id").where((F.col("g") <= most_gap_days) & (F.col("d") <= most_still_days)).select("id")
    return good.join(keep, "id", "left_semi")


def minimum_spacing(readings: DataFrame, seconds: int) -> DataFrame:
    """The first reading of every interval of that many seconds of a series."""
    slot = F.floor(F.col("ts").cast("double") / seconds)
    return readings.groupBy("id", slot.alias("slot")).agg(F.min("ts").alias("ts"), F.min_by("v", "ts").alias("v")).drop("slot")


def arrivals(ticks: DataFrame, start, returns: bool = False) -> DataFrame:
    """(id, t, value): minutes since ``start``, later than it; with returns: log-returns of six digits below 100."""
    t = (F.col("ts").cast("double") - F.lit(start).cast("timestamp").cast("double")) / 60
    rows = ticks.select("id", t.alias("t"), F.col("v").alias("value"))
    if returns:
        rows = log_returns(rows.withColumnRenamed("value", "v"), 6, float("inf")).where(F.abs("v") < 100).withColumnRenamed("v", "value")
    return rows.where("t > 0")


def mean_pool(voxels: DataFrame, kernel: int) -> DataFrame:
    """(id, x, y, z, t, v) of blocks of kernel**3 voxels, from (x, y, z, t, v); blocks that never exceed 0 are dropped."""
    b = [F.floor(F.col(c) / kernel).cast("int").alias(c) for c in ("x", "y", "z")]
    pooled = voxels.select(*b, "t", "v").groupBy("x", "y", "z", "t").agg(F.avg("v").alias("v"))
    live = pooled.groupBy("x", "y", "z").agg(F.max("v").alias("m")).where("m > 0").select("x", "y", "z")
    return pooled.join(live, ["x", "y", "z"], "left_semi").select(F.concat_ws("_", "x", "y", "z").alias("id"), "x", "y", "z", "t", "v")


def hash_sample(df: DataFrame, column: str, one_in: int) -> DataFrame:
    """The rows of one in ``one_in`` values of a column."""
    return df.where(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(one_in)) == 0)
