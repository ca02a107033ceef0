import datetime as dt

import pytest
from pyspark.sql import functions as F

from covey.spec import Measure, QuerySpec, QueryType
from covey.streaming import replay, structured
from covey.streaming import windows as W


@pytest.fixture(scope="module")
def arrivals(spark):
    rows = [(1, 0.5, 1.0), (1, 10.0, 2.0), (1, 10.0, 3.0), (1, 10.5, 5.0), (2, 20.0, 7.0), (2, 35.0, 1.0)]
    return spark.createDataFrame(rows, "id int, t double, value double")


@pytest.mark.parametrize("how, want", [("sum", 6.0), ("avg", 2.0), ("min", 1.0), ("max", 3.0), ("count", 3.0), ("first", 1.0), ("last", 3.0)])
def test_basic_windows_are_closed_on_the_right(arrivals, how, want):
    got = {(r["id"], r["bw"]): r["v"] for r in W.basic_windows(arrivals, 10.0, how).collect()}
    assert got[1, 1] == want and (2, 2) in got and (2, 4) in got and (1, 2) in got


def test_empty_windows(arrivals):
    zero = {(r["id"], r["bw"]): r["v"] for r in W.filled_windows(W.basic_windows(arrivals, 10.0), 1, 4).collect()}
    carried = {(r["id"], r["bw"]): r["v"] for r in W.filled_windows(W.basic_windows(arrivals, 10.0, "last"), 1, 4, "last").collect()}
    assert zero[1, 3] == 0.0 and carried[1, 3] == 5.0 and carried[2, 3] == 7.0 and carried[2, 1] is None


def test_count_batches(arrivals):
    got = [r["epoch"] for r in W.count_batches(arrivals, 2).orderBy("t", "value").collect()]
    assert got == [1, 1, 2, 2, 3, 3]


def _windows(spark, series=4, length=30):
    return spark.createDataFrame([(i, t, float((i * 7 + t * t * (i + 1)) % 11)) for i in range(series) for t in range(1, length + 1)], "id int, bw long, v double")


def test_epochs_equal_the_static_query(spark):
    w = _windows(spark)
    pairs = W.sliding_pairs(w, 10).select(F.col("bw").cast("int").alias("epoch"), "i", "j", "rho")
    spec = QuerySpec(left=1, right=2, tau=0.1)
    every = {(r["epoch"], tuple(r["lhs"]), tuple(r["rhs"])): r["sim"] for r in replay.epoch_results(pairs, spec).collect()}
    walk = replay.Replay(w, spec, 10)
    for e in (10, 20, 30):
        now = {(e, tuple(r["lhs"]), tuple(r["rhs"])): r["sim"] for r in walk.step(e, e).collect()}
        want = {k: v for k, v in every.items() if k[0] == e}
        assert now.keys() == want.keys() and all(abs(now[k] - want[k]) < 1e-6 for k in now)


def test_strategies_agree(spark):
    w, spec = _windows(spark), QuerySpec(left=1, right=1, tau=0.0)
    runs = {s: replay.Replay(w, spec, 10, s, replay.HybridPolicy(2, 1)) for s in ("oneshot", "incremental", "hybrid")}
    for e in (10, 11, 12, 14):
        sets = [{(tuple(r["lhs"]), tuple(r["rhs"]), round(r["sim"], 6)) for r in run.step(e, e).collect()} for run in runs.values()]
        assert sets[0] == sets[1] == sets[2]
    assert [r["activeAlgorithm"] for r in runs["incremental"].reports] == ["oneshot", "incremental", "incremental", "incremental"]


def test_other_measures_cannot_stream():
    with pytest.raises(ValueError):
        replay.checked(QuerySpec(Measure.MULTIPOLE, 3, 0))


def test_regression(spark):
    runs = spark.createDataFrame([(1, 1.0, 3.0), (2, 2.0, 5.0), (3, 3.0, 7.0)], "t int, x double, y double")
    last = W.runtime_regression(runs).orderBy("t").collect()
    assert last[0]["slope"] == 0.0 and abs(last[2]["slope"] - 2) < 1e-9 and abs(last[2]["intercept"] - 1) < 1e-9
    r = replay.RunTimes()
    for x, y in ((1, 3), (2, 5), (3, 7)):
        r.add(x, y)
    assert abs(r.predict(10) - 21) < 1e-9


def test_delta(spark):
    res = spark.createDataFrame([(1, [1], [2]), (2, [1], [2]), (2, [3], [4]), (3, [3], [4])], "epoch int, lhs array<int>, rhs array<int>")
    got = {(r["epoch"], r["lhs"][0], r["change"]) for r in W.result_delta(res).collect()}
    assert got == {(1, 1, "entered"), (2, 3, "entered"), (3, 1, "left")}


def test_structured_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, i, start + dt.timedelta(minutes=17 * k + i), float((k * (i + 2)) % 9)) for k in range(120) for i in range(3)]
    spark.createDataFrame(rows, "event_id long, id int, ts timestamp, value double").withColumn("event_id", F.col("event_id") * 3 + F.col("id")).repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = structured.basic_window_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    out = []
    query = structured.run_stream(stream, QuerySpec(left=1, right=1, tau=-1.0), str(tmp_path / "table"), 24 * 3600, lambda df, n: out.append((n, df.collect())), str(tmp_path / "state"))
    query.awaitTermination()
    closed = {(r["id"], r["t"]): r["v"] for r in spark.read.parquet(str(tmp_path / "table")).collect()}
    slot = F.from_unixtime(F.ceil(F.unix_micros("ts") / 3600e6) * 3600).cast("timestamp")
    want = {(r["id"], r["t"]): r["v"] for r in batch.groupBy("id", slot.alias("t")).agg(F.sum("value").alias("v")).collect()}
    assert closed and all(abs(want[k] - v) < 1e-9 for k, v in closed.items())
    assert out and len(out[-1][1]) == 3


def test_incremental_work_follows_the_changes(spark):
    """Two of twelve series change: the pairs and sets that are computed are those that hold one of them."""
    rows = [(i, t, float((i * 7 + t * t * (i + 1)) % 11)) for i in range(12) for t in range(1, 21)] + [(i, t, 3.0 * i if i in (2, 5) else 0.0) for i in range(12) for t in (21, 22)]
    rows = [(i, t, v if t > 2 or i in (2, 5) else 0.0) for i, t, v in rows]  # what leaves the window is zero too
    w, spec = spark.createDataFrame(rows, "id int, bw long, v double"), QuerySpec(left=1, right=2, tau=0.3)
    for query in (spec, QuerySpec(left=1, right=2, query=QueryType.TOPK, k=7), QuerySpec(left=1, right=2, tau=0.1, min_jump=0.05), QuerySpec(Measure.EUCLIDEAN, 2, 2, tau=0.5)):
        one, more = replay.Replay(w, query, 20, "oneshot"), replay.Replay(w, query, 20, "incremental")
        for e in (20, 22):
            sets = [{(tuple(r["lhs"]), tuple(r["rhs"]), round(r["sim"], 6)) for r in run.step(e, e).collect()} for run in (one, more)]
            assert sets[0] == sets[1] and sets[0]
    walk = replay.Replay(w, spec, 20, "incremental")
    walk.step(20, 20)
    changed = walk.changed(22)
    assert {r["id"] for r in changed.collect()} == {2, 5}
    before = {(r["i"], r["j"]): r["rho"] for r in walk.pairs.collect()}
    after = {(r["i"], r["j"]): r["rho"] for r in walk.updated_pairs(22, changed).collect()}
    assert before.keys() == after.keys() == {(i, j) for i in range(12) for j in range(i + 1, 12)}
    assert all(before[k] == after[k] for k in before if not {2, 5} & set(k))
    walk.step(22, 22)
    sets = walk.index.evaluate(walk.pairs, changed, 0.3)[-1][2].collect()
    every = walk.index.evaluate(walk.pairs, None, 0.3)[-1][2].count()
    assert sets and all({2, 5} & {r["l1"], r["r1"], r["r2"]} for r in sets) and len(sets) < every
    report = walk.reports[-1]
    assert report["nChanged"] == 2 and report["nArrivals"] == 4 and report["nIndexedDCCs"] > 0 and report["avgIndexedDCCSize"] >= 1
