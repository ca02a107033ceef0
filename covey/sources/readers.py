"""Readers: wide CSV files, arrival folders, result files, matrices, and series derived from relational tables."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from covey.operators import series as S


def wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """series(id, name, t, v) of a CSV file whose columns are series and whose rows are times in file order.

    A cell that isn't a number is an error; the series' number is the column's place; t is the row's place.
    """
    wide = spark.read.option("header", True).option("inferSchema", False).csv(path)
    names = wide.columns
    # the place of a row in its file: monotonically_increasing_id counts within a partition, so partitions are offset by their counts
    rows = wide.select(F.monotonically_increasing_id().alias("_m"), *[F.col(f"`{c}`").cast("double").alias(f"_{k}") for k, c in enumerate(names)])
    part = F.shiftright("_m", 33).cast("int")
    counts = {r["p"]: r["count"] for r in rows.groupBy(part.alias("p")).count().collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    shift = F.create_map(*[F.lit(x) for p, n in (before or {0: 0}).items() for x in (p, n)])
    rows = rows.withColumn("t", (F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.element_at(shift, part)).cast("int"))
    label = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (k, n)])
    long = rows.select("t", F.posexplode(F.array(*[f"_{k}" for k in range(len(names))])).alias("id", "v"))
    return long.select("id", F.element_at(label, F.col("id")).alias("name"), "t", "v")


def clean_name(name):
    """Names as arrival files spell them: blanks as underscores, no hashes."""
    return F.regexp_replace(F.regexp_replace(name, " ", "_"), "#", "")


_ARRIVAL = StructType([StructField("t", DoubleType()), StructField("value", DoubleType())])


def _from_file(df: DataFrame) -> DataFrame:
    coded = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.csv$", "")
    return df.withColumn("name", F.url_decode(F.replace(coded, F.lit("+"), F.lit("%2B"))))


def arrival_folder(spark: SparkSession, folder: str, most: float | None = None, by_count: bool = False) -> DataFrame:
    """(name, t, value) of a folder with one CSV (t, value) a series; a missing folder is an error.

    most: the largest t, or with by_count the number of arrivals of each series.
    """
    rows = _from_file(spark.read.option("header", True).schema(_ARRIVAL).csv(folder)).select("name", "t", "value")
    if most is None:
        return rows
    if not by_count:
        return rows.where(F.col("t") <= most)
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("t", "value"))).where(F.col("_n") <= most).drop("_n")


def arrival_stream(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """The same as a stream of files."""
    reader = spark.readStream.option("header", True).schema(_ARRIVAL)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return _from_file(reader.csv(folder)).select("name", "t", "value")


def joined_arrivals(base: DataFrame, arrivals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base series and arrivals that have each other, by cleaned name, with ids 0.. in the order of the base's ids."""
    named = base.select("id", clean_name(F.col("name")).alias("name")).distinct()
    with_arrivals = arrivals.select(clean_name(F.col("name")).alias("name"), "t", "value")
    both = named.join(with_arrivals.select("name").distinct(), "name", "left_semi").select("id", "name")
    kept = S.numbered(base.withColumn("name", clean_name(F.col("name"))).join(both.select("id"), "id", "left_semi"))
    ids = kept.select("id", "name").distinct()
    return kept, with_arrivals.join(ids, "name").select("id", "t", "value")


def artificial_arrivals(vectors: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The first ``window`` values of each vector as base, the next ones as arrivals at 0, 1, ..."""
    base = vectors.withColumn("x", F.slice("x", 1, window))
    later = vectors.select("id", F.posexplode(F.slice("x", window + 1, window)).alias("t", "value"))
    return base, later.select("id", F.col("t").cast("double").alias("t"), "value")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """(x ARRAY<DOUBLE>) of a headerless CSV of numbers, a row a line."""
    return spark.read.text(path).select(F.transform(F.split("value", ","), lambda s: F.trim(s).cast("double")).alias("x"))


def result_csv(spark: SparkSession, path: str) -> DataFrame:
    """Results as the CSV sinks write them, without the run's closing row: (lhs, rhs, sim, ..., epoch if there)."""
    rows = spark.read.option("header", True).csv(path).where(F.col("lhs") != "end")
    ids = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(c, "-"), lambda s: s.cast("int")))
    out = rows.withColumns({"lhs": ids("lhs"), "rhs": ids("rhs"), "sim": F.col("sim").cast("double")})
    return out.withColumn("epoch", F.col("epoch").cast("int")) if "epoch" in out.columns else out


# --- weather archives and files -----------------------------------------------------------------------------------------

WEATHER = StructType([
    StructField("id", StringType()), StructField("timestamp", StringType()), *[StructField(c, DoubleType()) for c in ("lat", "lon", "elevation")],
    *[StructField(c, IntegerType()) for c in ("windSpeed", "visibility", "temp", "dew", "slp")],
])


def tar_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(member, columns...) of the CSV members of .tar.gz archives; a task reads an archive member by member."""
    schema = StructType([StructField("member", StringType()), *[StructField(c, StringType()) for c in columns]])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for member in tar:
                        if member.isfile() and member.name.endswith(".csv"):
                            part = pd.read_csv(tar.extractfile(member), dtype=str, usecols=lambda c: c in columns)
                            yield part.reindex(columns=columns).assign(member=member.name)[["member", *columns]]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def weather_file(spark: SparkSession, path: str, attribute: str = "slp", most_sensors: int | None = None, most_rounds: int | None = None) -> DataFrame:
    """series(id, name, t, v), z-normalised, of files of three header lines, then blocks of a sensor's line and its records."""
    names = [f.name for f in WEATHER.fields[1:]]
    place = names.index(attribute)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for frame in frames:
            for content in frame["content"]:
                lines = (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode().splitlines()
                sensors, length = int(lines[0]), int(lines[2])
                for k in range(min(sensors, most_sensors or sensors)):
                    at = 3 + k * (length + 1)
                    values = [float(x.split(",")[place]) for x in lines[at + 1 : at + 1 + min(length, most_rounds or length)]]
                    yield pd.DataFrame({"id": k, "name": lines[at].strip(), "t": range(len(values)), "v": values})

    long = spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "id int, name string, t int, v double")
    return S.znorm_long(long)


# --- series of relational tables -------------------------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table; times without a zone are read as times of the session's zone."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    bare = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(bare) if bare else df


def supplier_months(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue of each supplier by month of shipping, 0 without any."""
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("int").alias("id"), F.date_trunc("month", "l_shipdate").alias("t"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    return S.dense(rows.groupBy("id", "t").agg(F.sum("x").alias("v")))


def user_days(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.col("user_id").cast("int").alias("id"), F.date_trunc("day", "ts").alias("t"), "value")
    return S.dense(rows.groupBy("id", "t").agg(F.sum("value").alias("v")))


def type_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of event values by type (numbered by name) and hour, over every hour from the first to the last."""
    events = table(spark, folder, "events").select("event_type", F.date_trunc("hour", "ts").alias("t"), "value")
    sums = S.numbered(events.groupBy(F.col("event_type").alias("id"), "t").agg(F.sum("value").alias("v"), F.min("event_type").alias("name")))
    hours = events.agg(F.explode(F.sequence(F.min("t"), F.max("t"), F.expr("interval 1 hour"))).alias("t"))
    return S.dense(sums, hours)


def nation_months(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").alias("t"), "o_totalprice")
    nations = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("id"))
    return S.dense(orders.join(nations, "o_custkey").groupBy("id", "t").agg(F.sum("o_totalprice").alias("v")))


def embedding_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").cast("int").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
