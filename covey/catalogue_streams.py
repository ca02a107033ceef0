"""Queries that walk through a stream epoch by epoch, with the SQL of each epoch's static result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.catalogue import _EPOCH_12, _EPOCHS, _shown_epochs, add, rounded, type_windows
from covey.operators.lineage import cut, shared_path
from covey.spec import QuerySpec, QueryType
from covey.streaming import replay, structured

_DAYS = (12, 13, 14, 15)


def walked(spark, d, spec: QuerySpec, strategy: str, epochs=_DAYS, **settings) -> tuple[DataFrame, replay.Replay]:
    """(epoch, lhs, rhs, sim) of a replay of days, and the replay."""
    run = replay.Replay(cut(type_windows(spark, d), "windows"), spec, 240, strategy, **settings)
    out = None
    for e in epochs:
        found = run.step(e, e * 24).select(F.lit(e).alias("epoch"), "lhs", "rhs", "sim")
        out = found if out is None else out.unionByName(found)
    return out, run


_SOME = f"epoch in {_DAYS}"


@add("incremental_pc_1_2", f"with {_EPOCHS} select epoch, lhs, rhs, round(s, 4) + 0.0 sim from ({_EPOCH_12}) where s > 0.05 and {_SOME}")
def incremental_pc_1_2(spark, d):
    return _shown_epochs(walked(spark, d, QuerySpec(left=1, right=2, tau=0.05, max_only=True), "incremental")[0])


@add("incremental_topk", f"with {_EPOCHS} select epoch, lhs, rhs, round(s, 4) + 0.0 sim from (select *, row_number() over (partition by epoch order by s desc, a, b, c) n from ({_EPOCH_12}) where s > 0 and {_SOME}) where n <= 3")
def incremental_topk(spark, d):
    return _shown_epochs(walked(spark, d, QuerySpec(left=1, right=2, query=QueryType.TOPK, k=3, max_only=True), "incremental")[0])


@add("hybrid_pc_1_1", f"with {_EPOCHS} select epoch, i::varchar lhs, j::varchar rhs, round(r, 4) + 0.0 sim from ep where i < j and r > 0.05 and {_SOME}")
def hybrid_pc_1_1(spark, d):
    return _shown_epochs(walked(spark, d, QuerySpec(left=1, right=1, tau=0.05), "hybrid", policy=replay.HybridPolicy(2, 1))[0])


@add("wave_pc_1_1", f"with {_EPOCHS} select case when epoch = 26 then 13 else epoch end epoch, i::varchar lhs, j::varchar rhs, round(r, 4) + 0.0 sim from ep where i < j and r > 0.05 and epoch in (12, 26)")
def wave_pc_1_1(spark, d):
    """From epoch 13 on, time runs twice as fast."""
    return _shown_epochs(walked(spark, d, QuerySpec(left=1, right=1, tau=0.05), "oneshot", (12, 13), boost=(13, 2.0))[0])


@add("epoch_reports", f"with {_EPOCHS}, k as (select unnest({list(_DAYS)}) epoch), r as (select epoch, count(*) n from ep where i < j and r > 0.05 group by 1) select k.epoch, k.epoch * 24 simulated, case when k.epoch = 12 then 'oneshot' else 'incremental' end active, coalesce(r.n, 0) results, (select count(*) from g where v <> 0 and t <= k.epoch * 24 and t > case when k.epoch = 12 then 48 else (k.epoch - 1) * 24 end) arrivals, case when k.epoch = 12 then 0 else 1 end indexed from k left join r using (epoch)")
def epoch_reports(spark, d):
    """The report of each epoch, written as rows and read back; durations and the index's own numbers vary, so only whether it holds anything is shown."""
    from covey.sources import sinks as W

    _, run = walked(spark, d, QuerySpec(left=1, right=1, tau=0.05), "incremental")
    path = f"{shared_path(spark, 'reports')}/report.csv"
    for row in run.reports:
        W.append_row(spark, path, row)
    rows = spark.read.option("header", True).csv(path)
    whole = lambda c: F.col(c).cast("long")
    return rows.select(whole("epoch").alias("epoch"), whole("simulatedTime").alias("simulated"), F.col("activeAlgorithm").alias("active"), whole("nResults").alias("results"), whole("nArrivals").alias("arrivals"), F.when((whole("nIndexedDCCs") > 0) & (F.col("avgIndexedDCCSize").cast("double") >= 1), 1).otherwise(0).alias("indexed"))


@add("run_averages", f"with {_EPOCHS}, k as (select unnest([13, 14, 15]) epoch), r as (select epoch, count(*) n from ep where i < j and r > 0.05 group by 1) select round(avg(coalesce(r.n, 0)), 6) + 0.0 avg_results, count(*) epochs from k left join r using (epoch)")
def run_averages(spark, d):
    """Averages over the epochs behind a warm-up of the first."""
    _, run = walked(spark, d, QuerySpec(left=1, right=1, tau=0.05), "oneshot")
    reports = spark.createDataFrame([(r["epoch"], r["duration"], r["nResults"]) for r in run.reports], "epoch int, duration double, nResults long")
    return replay.run_averages(reports, 12).select(rounded("avg_results", 6).alias("avg_results"), "epochs")


@add("watermarked_windows", "with m as (select max(ts) - interval 1 microsecond - interval 2 hour w from events), e as (select event_type id, ts, value from events), b as (select id, to_timestamp(ceil(epoch_us(ts) / 3600000000.0) * 3600) t, sum(value) v from e group by 1, 2) select id, epoch(t)::bigint t, round(v, 4) + 0.0 v from b, m where epoch_us(t) <= epoch_us(w)")
def watermarked_windows(spark, d):
    """Basic windows of a stream of files that the watermark has closed."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    closed = structured.basic_window_stream(events.select("event_id", F.col("event_type").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "value"))
    out, state = shared_path(spark, "closed-windows"), shared_path(spark, "stream-state")
    query = closed.writeStream.outputMode("append").format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(closed.schema).parquet(out).select("id", F.unix_seconds("t").alias("t"), rounded("v").alias("v"))

