"""Series tables: series(id, name, t, v) in long form, vectors(id, name, x) with one array a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covey.functions import vectors as V
from covey.spec import BINS, LEAST_STD


def dense(observed: DataFrame, times: DataFrame | None = None, fill: float = 0.0) -> DataFrame:
    """Every (id, t) of the grid, with ``fill`` where nothing was observed.

    times: a calendar of t; by default the times at which anything was observed.  A calendar is short (bounded by the
    time span, not by the rows), so the grid is each id with the array of times, exploded in place.
    """
    times = observed.select("t").distinct() if times is None else times
    calendar = times.agg(F.array_sort(F.collect_set("t")).alias("ts"))
    names = observed.groupBy("id").agg(F.min("name").alias("name")) if "name" in observed.columns else observed.select("id").distinct()
    grid = names.join(F.broadcast(calendar)).withColumn("t", F.explode("ts")).drop("ts")
    return grid.join(observed.select("id", "t", "v"), ["id", "t"], "left").withColumn("v", F.coalesce("v", F.lit(fill))).select(*names.columns, "t", "v")


def variance_filter(series: DataFrame, least_std: float = LEAST_STD) -> DataFrame:
    """Series that vary: population std at least ``least_std``, more than one value, no NaN."""
    stats = series.groupBy("id").agg(F.stddev_pop("v").alias("s"), F.max("v").alias("hi"), F.min("v").alias("lo"), F.max(F.isnan("v") | F.col("v").isNull()).alias("odd"))
    good = stats.where((F.col("s") >= least_std) & (F.col("hi") > F.col("lo")) & ~F.col("odd")).select("id")
    return series.join(good, "id", "left_semi")


def varying(vectors: DataFrame, least_std: float = LEAST_STD) -> DataFrame:
    """The same rule on vectors(id, x), in the pass that makes them."""
    x = F.col("x")
    spread = F.aggregate(F.array(V.avg(x)), F.lit(0.0), lambda _, m: V.total(F.transform(x, lambda v: (v - m) * (v - m))))
    sound = ~F.exists(x, lambda v: v.isNull() | F.isnan(v))
    return vectors.where(sound & (F.array_max(x) > F.array_min(x)) & (F.sqrt(spread / F.size(x)) >= least_std))


def to_vectors(series: DataFrame) -> DataFrame:
    """vectors(id[, name], x): values in the order of t.  A group is one series, bounded by its points."""
    name = [F.min("name").alias("name")] if "name" in series.columns else []
    packed = series.groupBy("id").agg(*name, F.array_sort(F.collect_list(F.struct("t", "v"))).alias("tv"))
    return packed.withColumn("x", F.transform("tv", lambda s: s["v"])).drop("tv")


def to_series(vectors: DataFrame) -> DataFrame:
    """The long form of vectors; t is the position from 0."""
    return vectors.select(*[c for c in vectors.columns if c != "x"], F.posexplode("x").alias("t", "v"))


def normalise(vectors: DataFrame, how: str = "l2norm") -> DataFrame:
    """x as it enters a measure: l2norm, znorm, unit, discretise or rank (then l2norm)."""
    forms = {"l2norm": V.l2norm, "znorm": V.znorm, "unit": V.unit, "rank": V.l2norm, "discretise": discretised}
    if how == "rank":  # a column of its own: within the norm's expression ranks would be computed again for every use
        vectors = vectors.withColumn("x", V.ranks(F.col("x")))
    return vectors.withColumn("x", forms[how](F.col("x"))).where("x is not null")


def discretised(x, bins: int = BINS):
    """Equal-width bins 0..bins-1 from the smallest to the largest value."""
    return F.aggregate(F.array(F.struct(F.array_min(x).alias("lo"), F.array_max(x).alias("hi"))), x, lambda _, s: F.transform(x, lambda v: F.least(F.floor((v - s["lo"]) / (s["hi"] - s["lo"]) * bins), F.lit(bins - 1)).cast("double")))


def binned(series: DataFrame, bins: int = BINS) -> DataFrame:
    """(id, t, bin) in the long form."""
    w = Window.partitionBy("id")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return series.select("id", "t", F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int").alias("bin"))


def ranked(series: DataFrame) -> DataFrame:
    """v replaced by its rank in the series, ties with their average."""
    w = Window.partitionBy("id")
    below = F.rank().over(w.orderBy("v")).cast("double")
    return series.withColumn("v", below + (F.count(F.lit(1)).over(Window.partitionBy("id", "v")) - 1) / F.lit(2.0))


def l2norm_long(series: DataFrame) -> DataFrame:
    w = Window.partitionBy("id")
    centred = series.withColumn("v", F.col("v") - F.avg("v").over(w))
    return centred.withColumn("v", F.try_divide("v", F.sqrt(F.sum(F.col("v") * F.col("v")).over(w))))


def znorm_long(series: DataFrame) -> DataFrame:
    w = Window.partitionBy("id")
    return series.withColumn("v", (F.col("v") - F.avg("v").over(w)) / F.sqrt(F.greatest(F.var_pop("v").over(w), F.lit(1e-16))))


def elementwise_average(series: DataFrame) -> DataFrame:
    return series.groupBy("t").agg(F.avg("v").alias("v"))


def numbered(series: DataFrame) -> DataFrame:
    """ids 0, 1, ... in the order of the old ids, without one task ordering rows: places come from counts of ranges."""
    ids = series.select("id").distinct()
    spark = series.sparkSession
    order = spark.createDataFrame(ids.orderBy("id").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])), f"old {ids.schema['id'].dataType.simpleString()}, new bigint")
    rest = [c for c in series.columns if c != "id"]
    return series.join(order, series["id"] == order["old"]).select(F.col("new").cast("int").alias("id"), *rest)
