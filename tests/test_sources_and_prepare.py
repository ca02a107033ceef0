import datetime as dt
import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from covey.operators import prepare as R
from covey.sources import readers, sinks
from covey.spec import QuerySpec


def test_wide_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text("a b,#c\n1.5,2\n3,4\n5,6\n")
    s = readers.wide_csv(spark, str(tmp_path / "w.csv"))
    assert sorted((r["id"], r["name"], r["t"], r["v"]) for r in s.collect()) == [(0, "a b", 0, 1.5), (0, "a b", 1, 3.0), (0, "a b", 2, 5.0), (1, "#c", 0, 2.0), (1, "#c", 1, 4.0), (1, "#c", 2, 6.0)]
    (tmp_path / "bad.csv").write_text("a\nx\n")
    with pytest.raises(Exception):
        readers.wide_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_arrivals(spark, tmp_path):
    folder = tmp_path / "arrivals"
    folder.mkdir()
    (folder / "a_b.csv").write_text("t,value\n1,10\n2,20\n9,90\n")
    (folder / "zz.csv").write_text("t,value\n1,5\n")
    got = readers.arrival_folder(spark, str(folder), most=2)
    assert sorted((r["name"], r["t"]) for r in got.collect()) == [("a_b", 1.0), ("a_b", 2.0), ("zz", 1.0)]
    assert readers.arrival_folder(spark, str(folder), most=1, by_count=True).count() == 2
    base = spark.createDataFrame([(3, "a b", 0, 1.0), (4, "other", 0, 1.0)], "id int, name string, t int, v double")
    kept, arrived = readers.joined_arrivals(base, got)
    assert [(r["id"], r["name"]) for r in kept.select("id", "name").distinct().collect()] == [(0, "a_b")] and arrived.count() == 2
    with pytest.raises(Exception):
        readers.arrival_folder(spark, str(tmp_path / "none")).collect()


def test_artificial_arrivals(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0])], "id int, x array<double>")
    base, later = readers.artificial_arrivals(v, 2)
    assert base.first()["x"] == [1.0, 2.0] and [(r["t"], r["value"]) for r in later.orderBy("t").collect()] == [(0.0, 3.0), (1.0, 4.0)]


def test_results_round_trip(spark, tmp_path):
    res = spark.createDataFrame([([1], [2, 3], 0.51239, ["a"], ["b", "c"])], "lhs array<int>, rhs array<int>, sim double, lhs_names array<string>, rhs_names array<string>")
    path = sinks.static_path(str(tmp_path), QuerySpec(left=1, right=2, tau=0.4))
    assert path.endswith("results/pearson_correlation/12/threshold_tau0.40.csv")
    sinks.write_results(res, path, duration_ns=12)
    row = readers.result_csv(spark, path).collect()
    assert len(row) == 1 and (row[0]["lhs"], row[0]["rhs"], row[0]["sim"], row[0]["headers2"]) == ([1], [2, 3], 0.5124, "b-c")
    out = sinks.stream_path(str(tmp_path), QuerySpec(tau=0.4), "oneshot")
    for epoch in (0, 1):
        sinks.append_epoch(res, out, epoch)
    assert sorted(r["epoch"] for r in readers.result_csv(spark, out).collect()) == [0, 1]
    sinks.append_row(spark, str(tmp_path / "runs"), sinks.run_summary(QuerySpec(), duration=1.5, results=3))
    assert spark.read.option("header", True).csv(str(tmp_path / "runs")).first()["results"] == "3"


def test_matrix_and_text(spark, tmp_path):
    m = spark.createDataFrame([([1.0, 2.5],)], "x array<double>")
    sinks.write_matrix(m, str(tmp_path / "m"))
    assert readers.matrix_csv(spark, str(tmp_path / "m")).first()["x"] == [1.0, 2.5]
    assert readers.text_lines(spark, str(tmp_path / "m")).first()["value"] == "1.0,2.5"


def test_weather(spark, tmp_path):
    with tarfile.open(tmp_path / "y.tar.gz", "w:gz") as tar:
        data = b"STATION,DATE,SLP\ns1,2020,10132,1\n"
        info = tarfile.TarInfo("2020/s1.csv")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    assert readers.tar_csv(spark, str(tmp_path / "y.tar.gz"), ["STATION", "DATE"]).count() == 1
    records = "\n".join(f"{k},0,0,0,0,0,{k},0,{k * 2}" for k in range(3))
    (tmp_path / "w.gz").write_bytes(gzip.compress(f"1\n10\n3\nsensor\n{records}\n".encode()))
    v = [r["v"] for r in readers.weather_file(spark, str(tmp_path / "w.gz"), "slp").orderBy("t").collect()]
    assert abs(sum(v)) < 1e-9 and v[0] < v[1] < v[2]


T0 = dt.datetime(2024, 1, 1)


def minutes(*values):
    return [("s", T0 + dt.timedelta(minutes=m), v) for m, v in values]


def test_ticks_and_slices(spark):
    raw = spark.createDataFrame([("s", "01/02/2024", "09:30", 5.0), ("s", "01/02/2024", "09:30", 4.0)], "id string, date string, time string, price double")
    assert [(r["ts"], r["v"]) for r in R.parse_ticks(raw).collect()] == [(dt.datetime(2024, 1, 2, 9, 30), 4.0)]
    t = spark.createDataFrame(minutes((5, 1.0), (10, 2.0), (50, 9.0)), "id string, ts timestamp, v double")
    got = {(r["ts"].minute, r["v"]) for r in R.slice_range(t, T0, T0 + dt.timedelta(minutes=20)).collect()}
    assert got == {(0, 1.0), (5, 1.0), (10, 2.0), (20, 2.0)}


def test_resample_interpolate_returns(spark):
    t = spark.createDataFrame(minutes((0, 1.0), (0.5, 3.0), (3, 5.0)), "id string, ts timestamp, v double")
    r = R.resample_mean(t).orderBy("t")
    assert [x["v"] for x in r.collect()] == [2.0, None, None, 5.0]
    assert [x["v"] for x in R.interpolate(r).orderBy("t").collect()] == [2.0, 3.0, 4.0, 5.0]
    assert R.null_runs(r).first()["longest"] == 2 and R.drop_long_gaps(r, 2).count() == 0 and R.drop_long_gaps(r, 3).count() == 4
    assert R.drop_empty_points(r).count() == 2 and R.last_points(r, 1).count() == 1
    head = spark.createDataFrame([("s", 1, None), ("s", 2, 4.0), ("s", 3, None)], "id string, t int, v double")
    assert [x["v"] for x in R.interpolate(head).orderBy("t").collect()] == [4.0, 4.0, 4.0]
    p = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 2.718281828), ("s", 3, 0.0), ("s", 4, 1.0)], "id string, t int, v double")
    assert [(x["t"], x["v"]) for x in R.log_returns(p).orderBy("t").collect()] == [(2, 1.0)]
    assert R.outliers_to_zero(p, 2.0).where("v = 0").count() == 2 and R.drop_still(p.where("t = 1")).count() == 0


def test_grids_sensors_pools(spark):
    t = spark.createDataFrame(minutes((0, 1.0), (90, 2.0)), "id string, ts timestamp, v double")
    grid = [r["v"] for r in R.locf_grid(t, "2023-12-31 23:00:00", "2024-01-01 02:00:00", "1 hour").orderBy("t").collect()]
    assert grid == [None, 1.0, 1.0, 2.0]
    days = [("ok", T0 + dt.timedelta(days=k), float(k), 1) for k in range(5)] + [("gap", T0, 1.0, 1), ("gap", T0 + dt.timedelta(days=20), 2.0, 1)] + [("still", T0 + dt.timedelta(days=k), 3.0, 1) for k in range(8)] + [("ok", T0 + dt.timedelta(days=6), 9999.0, 1)]
    s = spark.createDataFrame(days, "id string, ts timestamp, v double, quality int")
    assert {r["id"] for r in R.regular_sensors(s).collect()} == {"ok"} and R.regular_sensors(s).count() == 5
    assert R.regular_sensors(s, most_faults=0).where("id = 'ok'").count() == 0
    assert R.minimum_spacing(t, 7200).count() == 1
    assert [r["t"] for r in R.arrivals(t, T0).collect()] == [90.0] and R.arrivals(t, T0, returns=True).count() == 1
    vox = spark.createDataFrame([(0, 0, 0, 0, 2.0), (1, 1, 1, 0, 4.0), (2, 0, 0, 0, -1.0)], "x int, y int, z int, t int, v double")
    assert [(r["id"], r["v"]) for r in R.mean_pool(vox, 2).collect()] == [("0_0_0", 3.0)]
    assert 0 < R.hash_sample(spark.range(200), "id", 4).count() < 100
    assert F is not None
