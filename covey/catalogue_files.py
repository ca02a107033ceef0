"""Queries over files that the engine writes and reads back, with the SQL of what they must hold."""

from __future__ import annotations

import io
import tarfile

import pyarrow as pa
from pyspark.sql import functions as F

from covey.catalogue import _ARRIVALS, NATIONS, PAIRS, TYPES, _epoch_pairs, add, rounded, type_arrivals
from covey.operators.lineage import shared_path
from covey.plans import sqltext
from covey.plans.query import run_query
from covey.sources import readers as X
from covey.sources import sinks as W
from covey.spec import Measure, QuerySpec
from covey.streaming import replay

_PLACES = "pl as (select t, row_number() over (order by t) - 1 k from times)"


@add("wide_csv", f"with {NATIONS}, {_PLACES} select id::varchar \"name\", k::int t, round(v, 6) + 0.0 v from g0 join pl using (t)")
def wide_csv(spark, d):
    """Series as columns of a CSV file, and back."""
    path = shared_path(spark, "wide-csv")
    W.write_wide(X.nation_months(spark, d), path)
    return X.wide_csv(spark, path).select("name", "t", rounded("v", 6).alias("v"))


@add("wide_csv_filtered", f"with {TYPES}, n as (select event_type \"name\", row_number() over (order by event_type) - 1 id from (select distinct event_type from events)) select n.name, count(*) n, round(sum(v), 4) + 0.0 s from g join n using (id) group by 1")
def wide_csv_filtered(spark, d):
    from covey.operators.series import variance_filter

    path = shared_path(spark, "wide-csv")
    W.write_wide(X.type_hours(spark, d), path, by="name")
    return variance_filter(X.wide_csv(spark, path)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("v")).alias("s"))


def _arrival_files(spark, d) -> str:
    path = shared_path(spark, "arrivals")
    names = X.table(spark, d, "events").select("event_type").distinct()
    from covey.operators.series import numbered

    ids = numbered(names.select(F.col("event_type").alias("id"), F.col("event_type").alias("name")))
    W.write_arrivals(type_arrivals(spark, d).join(ids, "id").select(F.concat(F.lit("#"), "name", F.lit(" x")).alias("name"), "t", "value"), path)
    return path


_NAMED = f"{_ARRIVALS}, n as (select event_type \"name\", row_number() over (order by event_type) - 1 id from (select distinct event_type from events)), f as (select '#' || name || ' x' \"name\", n.id id, t, value from a join n on n.id = a.id where t > 0)"


@add("arrival_folder", f"with {_NAMED} select name, round(t, 3) + 0.0 t, round(value, 6) + 0.0 \"value\" from f where t <= 20000")
def arrival_folder(spark, d):
    return X.arrival_folder(spark, _arrival_files(spark, d), 20000.0).select("name", rounded("t", 3).alias("t"), rounded("value", 6).alias("value"))


@add("arrival_folder_by_count", f"with {_NAMED} select name, round(t, 3) + 0.0 t, round(value, 6) + 0.0 \"value\" from (select *, row_number() over (partition by name order by t, value) k from f) where k <= 40")
def arrival_folder_by_count(spark, d):
    return X.arrival_folder(spark, _arrival_files(spark, d), 40, by_count=True).select("name", rounded("t", 3).alias("t"), rounded("value", 6).alias("value"))


@add("joined_arrivals", f"with {_NAMED}, b as (select id, row_number() over (order by id) - 1 k from n where id <> 1) select b.k::int id, count(*) n, round(sum(value), 4) + 0.0 s from b join f using (id) group by 1")
def joined_arrivals(spark, d):
    """All base series but one meet their arrivals by cleaned name."""
    base = X.type_hours(spark, d).where("id <> 1").withColumn("name", F.concat("name", F.lit(" x")))
    _, arrivals = X.joined_arrivals(base, X.arrival_folder(spark, _arrival_files(spark, d)))
    return arrivals.groupBy("id").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value")).alias("s"))


@add("matrix_csv", "select vec_id::int id, len(embedding)::int n, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) + 0.0 s from embeddings")
def matrix_csv(spark, d):
    path = shared_path(spark, "matrix")
    v = X.embedding_vectors(spark, d)
    W.write_matrix(v.select(F.concat(F.array(F.col("id").cast("double")), "x").alias("x")), path)
    m, rest = X.matrix_csv(spark, path), F.slice("x", 2, 1 << 30)
    return m.select(F.col("x")[0].cast("int").alias("id"), F.size(rest).alias("n"), rounded(F.aggregate(rest, F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@add("text_lines", "select o_orderpriority line, count(*) n from orders group by 1")
def text_lines(spark, d):
    path = shared_path(spark, "lines")
    X.table(spark, d, "orders").select("o_orderpriority").write.text(path)
    return X.text_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


_STATIC = QuerySpec(left=1, right=2, tau=0.27, max_only=True)


@add("static_results_csv", sqltext.query(_STATIC, NATIONS + PAIRS))
def static_results_csv(spark, d):
    """Results written with the run's closing row, at the path of the query, and read back."""
    path = W.static_path(shared_path(spark, "out"), _STATIC)
    W.write_results(run_query(X.nation_months(spark, d), _STATIC), path, 12345)
    found = X.result_csv(spark, path)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "-")
    return found.select(ids("lhs").alias("lhs"), ids("rhs").alias("rhs"), rounded("sim").alias("sim"))


from covey.catalogue import _EPOCHS  # noqa: E402

_STREAM = QuerySpec(left=1, right=1, tau=0.05)


@add("stream_results_csv", f"with {_EPOCHS} select epoch, i::varchar lhs, j::varchar rhs, round(r, 4) + 0.0 sim from ep where i < j and r > 0.05 and epoch between 12 and 14")
def stream_results_csv(spark, d):
    """Three epochs appended to one file of results and read back."""
    path = W.stream_path(shared_path(spark, "out"), _STREAM, "oneshot")
    found = replay.epoch_results(_epoch_pairs(spark, d).where("epoch between 12 and 14"), _STREAM).persist()
    for epoch in (12, 13, 14):
        W.append_epoch(found.where(F.col("epoch") == epoch).drop("epoch"), path, epoch)
    found.unpersist()
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "-")
    return X.result_csv(spark, path).select("epoch", ids("lhs").alias("lhs"), ids("rhs").alias("rhs"), rounded("sim").alias("sim"))


@add("run_summaries", "select * from (values ('pearson_correlation', 1, 2, 'threshold', 0.27::double, 241, 1.5::double), ('multipole', 3, 0, 'topk', 0.0, 50, 2.5)) q(measure, \"left\", \"right\", query, tau, nresults, seconds)")
def run_summaries(spark, d):
    """Two runs' summaries appended to one file and read back."""
    path = f"{shared_path(spark, 'out')}/runs_oneshot.csv"
    from covey.spec import QueryType

    W.append_row(spark, path, W.run_summary(_STATIC, nresults=241, seconds=1.5))
    W.append_row(spark, path, W.run_summary(QuerySpec(Measure.MULTIPOLE, 3, 0, QueryType.TOPK, k=50), nresults=50, seconds=2.5))
    rows = spark.read.option("header", True).csv(path)
    return rows.select("measure", F.col("left").cast("int").alias("left"), F.col("right").cast("int").alias("right"), "query", F.col("tau").cast("double").alias("tau"), F.col("nresults").cast("int").alias("nresults"), F.col("seconds").cast("double").alias("seconds"))


# --- weather archives and files -----------------------------------------------------------------------------------------


def write_archives(nations, folder: str) -> None:
    """A .tar.gz for each region with a CSV for each nation, by the tasks that hold them."""
    def write(part):
        from pyarrow import fs

        rows = part.to_pandas().sort_values("n_nationkey")
        region = int(rows["n_regionkey"].iloc[0])
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for key, name in zip(rows["n_nationkey"], rows["n_name"]):
                data = f'STATION,NAME,EXTRA\n{key},"{name}",x\n{key + 100},"{name}, second",y\n'.encode()
                info = tarfile.TarInfo(f"{region}/{key}.csv")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{region}.tar.gz", compression=None) as f:
            f.write(out.getvalue())
        return pa.table({"region": [region]})

    nations.groupBy("n_regionkey").applyInArrow(write, "region long").count()


@add("weather_archives", "select n_regionkey || '/' || n_nationkey || '.csv' member, n_nationkey::varchar station, n_name \"name\" from nation union all select n_regionkey || '/' || n_nationkey || '.csv', (n_nationkey + 100)::varchar, n_name || ', second' from nation")
def weather_archives(spark, d):
    folder = shared_path(spark, "archives")
    write_archives(X.table(spark, d, "nation"), folder)
    return X.tar_csv(spark, f"{folder}/*.tar.gz", ["STATION", "NAME"]).select("member", F.col("STATION").alias("station"), F.col("NAME").alias("name"))


@add("weather_file", f"with {NATIONS}, {_PLACES} select id, 'nation ' || id \"name\", k::int t, round((v - avg(v) over w) / stddev_pop(v) over w, 6) + 0.0 v from g0 join pl using (t) where id < 20 window w as (partition by id)")
def weather_file(spark, d):
    """Series as a weather file: three header lines, then a line for a sensor and its records."""
    s = X.nation_months(spark, d).where("id < 20")
    shape = s.agg(F.countDistinct("id").alias("n"), F.countDistinct("t").alias("m"))
    head = shape.select(F.lit(-1).alias("id"), F.posexplode(F.array(F.col("n").cast("string"), F.lit("10"), F.col("m").cast("string"))).alias("k", "line")).withColumn("t", F.lit(None).cast("timestamp"))
    names = s.select("id").distinct().select("id", F.lit(0).alias("k"), F.concat(F.lit("nation "), F.col("id").cast("string")).alias("line"), F.lit(None).cast("timestamp").alias("t"))
    records = s.select("id", F.lit(1).alias("k"), F.concat_ws(",", *["t" if c == "timestamp" else F.col("v").cast("string") if c == "slp" else F.lit("0") for c in [f.name for f in X.WEATHER.fields[1:]]]).alias("line"), "t")
    path = shared_path(spark, "weather")
    lines = head.select("id", "k", "line", "t").unionByName(names).unionByName(records)
    lines.coalesce(1).sortWithinPartitions("id", "k", F.col("t").asc_nulls_first()).select("line").write.text(path)
    return X.weather_file(spark, f"{path}/part-*", "slp").select(F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("id"), "name", "t", rounded("v", 6).alias("v"))


# --- scans and fetched files ----------------------------------------------------------------------------------------------


@add("scan_voxels", "select (c_custkey % 7)::int x, (c_custkey // 7 % 5)::int y, (c_custkey // 35 % 3)::int z, 0 t, round(sum(c_acctbal), 6) + 0.0 v from customer group by 1, 2, 3")
def scan_voxels(spark, d):
    """A volume of customers' balances as a NIfTI scan, and back."""
    from covey.sources.scans import nifti_voxels, pack_nifti

    folder = shared_path(spark, "scans")
    c = F.col("c_custkey")
    cells = X.table(spark, d, "customer").groupBy((c % 7).alias("x"), (F.floor(c / 7) % 5).alias("y"), (F.floor(c / 35) % 3).alias("z")).agg(F.sum("c_acctbal").alias("v"))

    def write(part):  # 105 cells
        import numpy as np
        from pyarrow import fs

        volume = np.zeros((7, 5, 3, 1))
        volume[np.asarray(part["x"]), np.asarray(part["y"]), np.asarray(part["z"]), 0] = np.asarray(part["v"])
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/customers.nii", compression=None) as f:
            f.write(pack_nifti(volume))
        return pa.table({"n": [part.num_rows]})

    cells.groupBy(F.lit(1).alias("all")).applyInArrow(write, "n long").collect()
    return nifti_voxels(spark, f"{folder}/*.nii").select("x", "y", "z", "t", rounded("v", 6).alias("v")).where("v <> 0")


@add("fetched_files", "select n_name || '.txt.gz' \"file\", false first, true again, n_name line from nation where n_nationkey < 5")
def fetched_files(spark, d):
    """Files fetched from addresses (of this machine here), and found there the second time."""
    from covey.sources.scans import fetched

    source, folder = shared_path(spark, "fetch-from"), shared_path(spark, "fetch-to")

    def write(part):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(source)
        system.create_dir(root, recursive=True)
        for name in part["n_name"].to_pylist():
            with system.open_output_stream(f"{root}/{name}.txt", compression=None) as f:
                f.write(name.encode())
        return pa.table({"address": [f"{source}/{name}.txt" for name in part["n_name"].to_pylist()]})

    from covey.operators.lineage import cut

    addresses = cut(X.table(spark, d, "nation").where("n_nationkey < 5").groupBy("n_nationkey").applyInArrow(write, "address string"), "addresses")
    first, again = (cut(fetched(addresses, folder), "fetched") for _ in range(2))
    lines = spark.read.text(f"{folder}/*.gz").select(F.col("value").alias("line"), F.concat("value", F.lit(".txt.gz")).alias("file"))
    rows = first.join(again.select("address", F.col("cached").alias("again")), "address").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("cached").alias("first"), "again")
    return rows.join(lines, "file").select("file", "first", "again", "line")
