"""Mixing sources to target weights by entropy balancing.

The size of a document is its number of words (runs of bytes other than 0x20 and 0x09-0x0D; null: 0).  The sources,
by code point with null last, have the weights in turn, and share ``share`` times all sizes; a source's target stops
at ``cap`` times its size and the excess goes to the others by weight until none is above.

Rates.  Among all document rates in [0, cap] whose tokens meet a source's target, those nearest to 1 in relative
entropy are exponentially tilted: rate = min(cap, exp(l * size / mean size)), with one dual variable l for each
source.  Newton steps on the convex dual find every l at once; a step is a distributed aggregation over the cells
(source, size, number of documents), kept in a bracket by bisection where a step leaves it.

Rounding.  Cells of a source, largest sizes first, get whole numbers of copies such that what is taken so far follows
the target so far, so the error of a source ends below about half its smallest documents.  The copies of a cell are
dealt evenly over hash bins and then over the documents of a bin: no document exceeds ``cap`` copies, and no step
brings a cell's documents together.  All of it is a function of the rows, so reruns agree.

Scale: whole texts are read once and not shuffled; what moves is a row for each document without its text.  Cells are
as many as different sizes, not as rows (a source's cells, which one task rounds, are at most as many as the words of its
longest text), and the dual state has a row for each source and is never collected.

Edge cases: a null text has size 0 and is taken 0 words; an empty table gives an empty result; repeated rows are
documents of their own; a null source is a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from covey.llm.common import Scratch, open_texts, packed, text_bytes, text_key, word_counts

WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2
BINS, MOST_STEPS, TOLERANCE = 256, 80, 1e-9


def _sizes(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, buf = text_bytes(batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(word_counts(buf, off), pa.int64())], ["doc_id", "key", "source", "size"])

    rows = docs.select("doc_id", text_key().alias("key"), F.col("source").cast("string").alias("source"), "text")
    schema = StructType([rows.schema["doc_id"], StructField("key", LongType()), StructField("source", StringType()), StructField("size", LongType())])
    return rows.mapInArrow(count, schema)


def source_targets(spark: SparkSession, cells: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, docs, least, target): what each source's words should come to."""
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    schema = StructType([*totals.schema.fields, StructField("weight", DoubleType())])
    ranked = totals.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], float(weights[x[1] % len(weights)])))
    ranked = spark.createDataFrame(ranked, schema)
    room = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = None, None
    while True:  # sources at their cap leave the division; those that remain get the same level of words a weight
        at = F.lit(False) if level is None else F.col("source_size") * cap <= F.col("weight") * level
        row = ranked.agg(F.count(F.when(at, 1)), F.sum(F.when(at, F.col("source_size") * cap)), F.sum(F.when(~at, F.col("weight")))).first()
        if row[0] == full or not row[2]:
            break
        full, level = row[0], (room - (row[1] or 0)) / row[2]
    target = F.least(F.col("source_size") * float(cap), F.col("weight") * F.lit(float(level or 0)))
    if not (row[2] or level is None):
        target = F.col("source_size") * float(cap)
    return ranked.withColumn("target", target)


def _same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on source, null included."""
    other = b.withColumnRenamed("source", "_source")
    return a.join(other, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def dual_rates(scratch: Scratch, cells: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, l, ...) after Newton steps; ``fixed`` where the rate needs none (target 0 or at the cap)."""
    ratio = F.col("target") / F.col("source_size")
    state = targets.withColumn("mean", F.col("source_size") / F.col("docs")).withColumn("fixed", F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("target") <= 0, F.lit(0.0)).when(ratio >= cap * (1 - 1e-12), F.lit(float(cap))))
    span = F.col("mean") / F.col("least")
    bound = F.when(ratio >= 1, F.lit(float(np.log(cap)))).otherwise(F.log(ratio)) * span
    state = state.withColumn("lo", F.when(F.col("fixed").isNull(), F.least(bound, F.lit(0.0)))).withColumn("hi", F.when(F.col("fixed").isNull(), F.greatest(bound, F.lit(0.0)))).withColumn("l", F.when(F.col("fixed").isNull(), F.lit(0.0)))
    state = scratch.table(state, "dual")
    x = F.col("size") / F.col("mean")
    tilt = F.exp(F.least(F.col("l") * x, F.lit(50.0)))
    exact = lambda v: F.sum(v.cast("decimal(38,12)")).cast("double")  # noqa: E731  the same in any order of rows, so reruns agree
    for _ in range(MOST_STEPS):
        sums = _same(cells, state.where("fixed is null").select("source", "l", "mean")).groupBy("source").agg(
            exact(F.col("docs") * F.col("size") * F.least(tilt, F.lit(float(cap)))).alias("f"),
            exact(F.when(tilt < cap, F.col("docs") * F.col("size") * x * tilt).otherwise(0.0)).alias("g"),
        )
        miss = F.col("f") - F.col("target")
        done = F.abs(miss) <= F.col("target") * TOLERANCE
        lo, hi = F.when(miss < 0, F.col("l")).otherwise(F.col("lo")), F.when(miss > 0, F.col("l")).otherwise(F.col("hi"))
        step = F.col("l") - F.try_divide(miss, F.col("g"))
        new = _same(state, sums, "left").withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_step", step)
        inside = F.col("_step").isNotNull() & (F.col("_step") > F.col("_lo")) & (F.col("_step") < F.col("_hi"))
        new = new.withColumn("_l", F.when(F.col("f").isNull() | done, F.col("l")).when(inside, F.col("_step")).otherwise((F.col("_lo") + F.col("_hi")) / 2))
        new = new.withColumn("left", F.when(F.col("f").isNotNull(), F.abs(miss) / F.col("target")).otherwise(0.0))
        old = state
        state = scratch.table(new.select(*targets.columns, "mean", "fixed", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_l").alias("l"), "left"), "dual")
        scratch.drop(old)
        if (state.agg(F.max("left")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state


def _whole_copies(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies of each cell of one source, largest sizes first, such that the words taken follow the target."""
    cells = cells.sort_values("size", ascending=False)
    wanted, taken, out = 0.0, 0, []
    cap = int(cells["cap"].iloc[0])
    for size, docs, rate in zip(cells["size"], cells["docs"], cells["rate"]):
        wanted += size * docs * rate
        copies = 0 if size == 0 else int(min(cap * docs, max(0, np.ceil((wanted - taken) / size - 0.5))))
        taken += copies * int(size)
        out.append(copies)
    return cells.assign(copies=out)[["source", "size", "docs", "rate", "copies"]]


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, rate, copies, taken) for each row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    binned = _sizes(docs).withColumn("bin", F.pmod(F.xxhash64("doc_id"), F.lit(BINS)).cast("int"))
    sizes = scratch.table(binned, "sizes")
    bins = scratch.table(sizes.groupBy("source", "size", "bin").agg(F.count(F.lit(1)).alias("bin_docs")), "bins")
    cells = scratch.table(bins.groupBy("source", "size").agg(F.sum("bin_docs").alias("docs")), "cells")
    targets = scratch.table(source_targets(spark, cells, weights, share, cap), "targets")
    dual = dual_rates(scratch, cells, targets, cap)
    rate = F.coalesce(F.col("fixed"), F.least(F.exp(F.least(F.col("l") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(cap))))
    rated = _same(cells, dual.select("source", "l", "mean", "fixed")).select("source", "size", "docs", rate.alias("rate"), F.lit(cap).alias("cap"))
    schema = StructType([StructField("source", StringType()), StructField("size", LongType()), StructField("docs", LongType()), StructField("rate", DoubleType()), StructField("copies", LongType())])
    whole = scratch.table(rated.groupBy("source").applyInPandas(_whole_copies, schema), "copies")

    def part(total, upto, of):  # floor(total * upto / of) without overflow
        return F.floor(total.cast("decimal(19,0)") * upto.cast("decimal(19,0)") / of.cast("decimal(19,0)")).cast("long")

    named = whole.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "docs", "rate", "copies")
    ordered = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("bin_docs").over(ordered)
    dealt = bins.join(named, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).withColumn("upto", upto)
    dealt = dealt.select("source", "size", "bin", "bin_docs", "rate", (part(F.col("copies"), F.col("upto"), F.col("docs")) - part(F.col("copies"), F.col("upto") - F.col("bin_docs"), F.col("docs"))).alias("bin_copies"))
    dealt = scratch.table(dealt, "dealt").select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("bin").alias("_b"), "bin_docs", "bin_copies", "rate")
    place = F.row_number().over(Window.partitionBy("source", "size", "bin").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "key")).cast("long")
    rows = sizes.withColumn("place", place).join(dealt, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("bin") == F.col("_b")))
    rows = rows.withColumn("copies", part(F.col("bin_copies"), F.col("place"), F.col("bin_docs")) - part(F.col("bin_copies"), F.col("place") - 1, F.col("bin_docs")))
    out = _same(rows, targets.select("source", "source_size", "target")).select("doc_id", "key", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    return scratch.finish(out, "mix")


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it."""
    plan = mix_sources(docs, **settings).where("copies > 0").groupBy("doc_id", "key", "source").agg(F.sum("copies").alias("_copies")).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("source").alias("_source"), "_copies")
    keyed = docs.withColumn("_k", text_key()).select("text", "_k", F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("_row"))
    rows = packed(keyed, "text", "_k", "_row")
    # equal rows of one id stand in the plan once, with the sum of their copies
    rows = rows.withColumn("_d", F.col("_row.doc_id")).withColumn("_s", F.col("_row.source").cast("string"))
    rows = rows.groupBy("_d", "_k", "_s").agg(F.first(F.struct("_row", "text")).alias("_one"))
    picked = rows.join(plan, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")) & F.col("_s").eqNullSafe(F.col("_source")))
    picked = picked.select("_one.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_n"))

    opened = picked.select("_row", "text").mapInArrow(open_texts, StructType([picked.schema["_row"], StructField("text", StringType())]))
    return opened.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
