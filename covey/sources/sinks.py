"""Writers of results, run summaries and epoch reports, as CSV folders."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covey.spec import QuerySpec


def _joined(side: str):
    return F.concat_ws("-", F.transform(side, lambda x: x.cast("string")))


def result_rows(results: DataFrame) -> DataFrame:
    """(lhs, rhs, headers1, headers2, sim, timestamp) as text; names where the results have them."""
    names = lambda c: _joined(c) if c in results.columns else F.lit("")
    stamp = F.col("timestamp").cast("long") if "timestamp" in results.columns else F.unix_micros(F.current_timestamp()) * 1000
    epoch = [F.col("epoch")] if "epoch" in results.columns else []
    return results.select(_joined("lhs").alias("lhs"), _joined("rhs").alias("rhs"), names("lhs_names").alias("headers1"), names("rhs_names").alias("headers2"), F.format_string("%.4f", "sim").alias("sim"), stamp.alias("timestamp"), *epoch)


def static_path(out: str, spec: QuerySpec) -> str:
    return f"{out}/results/{spec.measure.value}/{spec.left}{spec.right}/{spec.query.value}_tau{spec.tau:.2f}.csv"


def stream_path(out: str, spec: QuerySpec, algorithm: str) -> str:
    return f"{out}/results/streaming/{spec.measure.value}/{spec.left}{spec.right}/{algorithm}_tau{spec.tau:.2f}.csv"


def write_results(results: DataFrame, path: str, duration_ns: int | None = None) -> None:
    """One CSV folder; with a duration a closing row ``end`` carries it in place of the timestamp."""
    rows = result_rows(results)
    if duration_ns is not None:
        empty = F.lit("")
        rows = rows.unionByName(rows.sparkSession.range(1).select(F.lit("end").alias("lhs"), empty.alias("rhs"), empty.alias("headers1"), empty.alias("headers2"), empty.alias("sim"), F.lit(duration_ns).cast("long").alias("timestamp")))
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_epoch(results: DataFrame, path: str, epoch: int) -> None:
    """Adds the whole result of an epoch; a batch that is written again replaces nothing, so callers write once an epoch."""
    result_rows(results.withColumn("epoch", F.lit(epoch))).write.mode("append").option("header", True).csv(path)


def append_row(spark: SparkSession, path: str, row: dict) -> None:
    """One row of a run summary or an epoch report."""
    schema = ", ".join(f"`{k}` {'bigint' if isinstance(v, int) and not isinstance(v, bool) else 'double' if isinstance(v, float) else 'string'}" for k, v in row.items())
    values = tuple(v if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row.values())
    spark.createDataFrame([values], schema).coalesce(1).write.mode("append").option("header", True).csv(path)


def run_summary(spec: QuerySpec, **stats) -> dict:
    flat = {k: (v.value if hasattr(v, "value") else v) for k, v in asdict(spec).items() if k != "weights"}
    return {**flat, "weights": spec.weights.kind, **stats}


def write_wide(series: DataFrame, path: str, by: str = "id") -> None:
    """A CSV file whose columns are series and whose rows are times in order.

    The format is one file in the order of time, so one task writes it: for tables of a width that a CSV line can hold.
    """
    wide = series.withColumn("_c", F.col(by).cast("string")).groupBy("t").pivot("_c").agg(F.first("v"))
    wide.coalesce(1).sortWithinPartitions("t").drop("t").write.mode("overwrite").option("header", True).csv(path)


def write_arrivals(arrivals: DataFrame, folder: str) -> None:
    """A folder with one CSV (t, value) a series, called by its name (a slash in it becomes _), from (name, t, value)."""
    spark = arrivals.sparkSession
    named = arrivals.select(F.replace(F.col("name"), F.lit("/"), F.lit("_")).alias("name"), "t", "value").repartition("name").sortWithinPartitions("name", "t", "value")
    named.write.mode("overwrite").partitionBy("name").option("header", True).csv(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in system.globStatus(path(f"{folder}/name=*/part-*")) or []:
        # a folder's name is its value, escaped by Spark where a path can't hold it
        name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(part.getPath().getParent().getName().removeprefix("name="))
        system.rename(part.getPath(), path(folder, f"{name}.csv"))
        system.delete(part.getPath().getParent(), True)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Rows of an array column x as lines of comma-separated numbers."""
    matrix.select(F.concat_ws(",", F.transform("x", lambda v: v.cast("string")))).write.mode("overwrite").text(path)
