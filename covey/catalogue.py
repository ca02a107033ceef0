"""The engine's queries over the test tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covey.functions import vectors as V
from covey.operators import candidates as K
from covey.operators import clustering as C
from covey.operators import measures as M
from covey.operators import pairs as P
from covey.operators import prepare as R
from covey.operators import series as S
from covey.operators.lineage import cut
from covey.plans import sqltext
from covey.plans.query import run_query, with_names
from covey.sources import readers as X
from covey.spec import Measure, QuerySpec, QueryType, Strategy, Weights
from covey.streaming import replay, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(x: Column | str, digits: int = 4) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = " ".join(sql.split())
        return f

    return keep


# --- series as SQL ----------------------------------------------------------------------------------------------------


def _grid(obs: str, times: str = "select distinct t from obs") -> str:
    return f"obs as ({obs}), times as ({times}), g0 as (select s.id, m.t, coalesce(o.v, 0) v from (select distinct id from obs) s cross join times m left join obs o on o.id = s.id and o.t = m.t), g as (select * from g0 where id in (select id from g0 group by id having stddev_pop(v) >= 1e-3 and max(v) > min(v)))"


SUPPLIERS = _grid("select l_suppkey::int id, date_trunc('month', l_shipdate) t, sum(l_extendedprice * (1 - l_discount)) v from lineitem group by 1, 2")
USERS = _grid("select user_id::int id, date_trunc('day', ts) t, sum(value) v from events group by 1, 2")
NATIONS = _grid("select c_nationkey id, date_trunc('month', o_orderdate) t, sum(o_totalprice) v from orders join customer on c_custkey = o_custkey group by 1, 2")
TYPES = _grid(
    "select k id, date_trunc('hour', ts) t, sum(value) v from events join (select event_type, row_number() over (order by event_type) - 1 k from (select distinct event_type from events)) using (event_type) group by 1, 2",
    "select unnest(generate_series(min(t), max(t), interval 1 hour)) t from obs",
)
EMBEDDED = "g as (select vec_id::int id, unnest(generate_series(1, len(embedding))) t, unnest(embedding)::double v from embeddings)"
PAIRS = ", p as (select a.id i, b.id j, corr(a.v, b.v) r from g a join g b on a.t = b.t and a.id <> b.id group by 1, 2)"
RANKED = ", k as (select id, t, rank() over (partition by id order by v) + (count(*) over (partition by id, v) - 1) / 2.0 v from g), p as (select a.id i, b.id j, corr(a.v, b.v) r from k a join k b on a.t = b.t and a.id <> b.id group by 1, 2)"
UNIT = ", c as (select id, t, v - avg(v) over (partition by id) v from g), u as (select id, t, v / sqrt(sum(v * v) over (partition by id)) v from c)"
BINNED = ", e as (select id, t, least(floor((v - min(v) over (partition by id)) / (max(v) over (partition by id) - min(v) over (partition by id)) * 10), 9)::int bin, count(*) over (partition by id) m from g)"
ENTROPY = ", h as (select id, -sum(n / m * ln(n / m)) h from (select id, bin, count(*)::double n, max(m) m from e group by 1, 2) group by id)"
HOURLY = {"supplier": SUPPLIERS, "user": USERS, "nation": NATIONS, "type": TYPES}
SERIES = {"supplier": X.supplier_months, "user": X.user_days, "nation": X.nation_months, "type": X.type_hours}


def _of(name: str) -> Query:
    return SERIES[name]


# --- series and vectors -----------------------------------------------------------------------------------------------


@add("scan_series_long", f"with {SUPPLIERS} select id, t, round(v, 4) + 0.0 v from g0")
def scan_series_long(spark, d):
    return X.supplier_months(spark, d).select("id", "t", rounded("v", 4).alias("v"))


@add("variance_filter", f"with {USERS} select distinct id from g")
def variance_filter(spark, d):
    return S.variance_filter(X.user_days(spark, d)).select("id").distinct()


@add("l2norm", f"with {NATIONS}{UNIT} select id, t, round(v, 6) + 0.0 v from u")
def l2norm(spark, d):
    return S.l2norm_long(S.variance_filter(X.nation_months(spark, d))).select("id", "t", rounded("v", 6).alias("v"))


@add("znorm", f"with {NATIONS} select id, t, round((v - avg(v) over w) / stddev_pop(v) over w, 6) + 0.0 v from g window w as (partition by id)")
def znorm(spark, d):
    return S.znorm_long(S.variance_filter(X.nation_months(spark, d))).select("id", "t", rounded("v", 6).alias("v"))


@add("rank_series", f"with {NATIONS} select id, t, (rank() over (partition by id order by v) + (count(*) over (partition by id, v) - 1) / 2.0)::double v from g")
def rank_series(spark, d):
    return S.ranked(S.variance_filter(X.nation_months(spark, d))).select("id", "t", "v")


@add("discretise", f"with {NATIONS}{BINNED} select id, bin, count(*) n from e group by 1, 2")
def discretise(spark, d):
    return S.binned(S.variance_filter(X.nation_months(spark, d))).groupBy("id", "bin").agg(F.count(F.lit(1)).alias("n"))


@add("elementwise_average", f"with {SUPPLIERS} select t, round(avg(v), 2) + 0.0 v from g group by t")
def elementwise_average(spark, d):
    return S.elementwise_average(S.variance_filter(X.supplier_months(spark, d))).select("t", rounded("v", 2).alias("v"))


@add("vector_stats", f"with {EMBEDDED} select id, round(avg(v), 6) + 0.0 a, round(var_pop(v), 6) + 0.0 s2, round(min(v), 6) + 0.0 lo, round(max(v), 6) + 0.0 hi, round(sqrt(sum(v * v)), 6) + 0.0 n2, round(avg(abs(v - m)), 6) + 0.0 md from (select *, avg(v) over (partition by id) m from g) group by id")
def vector_stats(spark, d):
    x = F.col("x")
    return X.embedding_vectors(spark, d).select("id", *[rounded(f(x), 6).alias(n) for n, f in (("a", V.avg), ("s2", V.var), ("lo", V.minimum), ("hi", V.maximum), ("n2", V.l2), ("md", V.mad))])


@add("vector_argsort", "select vec_id::int id, list_position(embedding, list_min(embedding)) - 1 lowest, list_position(embedding, list_max(embedding)) - 1 highest from embeddings")
def vector_argsort(spark, d):
    order = X.embedding_vectors(spark, d).withColumn("o", V.argsort(F.col("x")))
    return order.select("id", F.get("o", 0).cast("long").alias("lowest"), F.element_at("o", -1).cast("long").alias("highest"))


# --- pairs ------------------------------------------------------------------------------------------------------------


def _vectors(series: DataFrame, how: str = "l2norm") -> DataFrame:
    """Normalised vectors, computed once: kernels count them and read them on both sides."""
    return cut(S.normalise(S.varying(S.to_vectors(series)), how), "vectors")


def _nation_vectors(spark, d, how="l2norm"):
    return _vectors(X.nation_months(spark, d), how)


@add("pearson_pairs_supp_month", f"with {SUPPLIERS}{PAIRS} select i, j, round(r, 4) + 0.0 rho from p where i < j")
def pearson_pairs_supp_month(spark, d):
    return P.correlations(_vectors(X.supplier_months(spark, d))).select("i", "j", rounded("rho").alias("rho"))


@add("pearson_pairs_emb", f"with {EMBEDDED}{PAIRS.replace('a.id <> b.id', 'a.id < b.id')} select i, j, round(r, 4) + 0.0 rho from p")
def pearson_pairs_emb(spark, d):
    return P.correlations(cut(S.normalise(X.embedding_vectors(spark, d)), "vectors")).select("i", "j", rounded("rho").alias("rho"))


@add("pearson_pairs_block", f"with {NATIONS}{PAIRS} select i, j, round(r, 4) + 0.0 rho from p where i < j")
def pearson_pairs_block(spark, d):
    return P.correlations(_nation_vectors(spark, d), "block").select("i", "j", rounded("rho").alias("rho"))


@add("pearson_pairs_long", f"with {NATIONS}{PAIRS} select i, j, round(r, 4) + 0.0 rho from p where i < j")
def pearson_pairs_long(spark, d):
    return P.long_correlations(S.variance_filter(X.nation_months(spark, d))).select("i", "j", rounded("rho").alias("rho"))


@add("spearman_pairs", f"with {NATIONS}{RANKED} select i, j, round(r, 4) + 0.0 rho from p where i < j")
def spearman_pairs(spark, d):
    return P.correlations(_nation_vectors(spark, d, "rank")).select("i", "j", rounded("rho").alias("rho"))


_DISTANCES = {
    "angle_pairs": (V.angle, "acos(least(greatest(sum(a.v * b.v), -1), 1))"),
    "euclid_pairs": (V.euclidean, "sqrt(sum((a.v - b.v) * (a.v - b.v)))"),
    "manhattan_pairs": (V.l1, "sum(abs(a.v - b.v))"),
    "chebyshev_pairs": (V.chebyshev, "max(abs(a.v - b.v))"),
    "minkowski_pairs": (lambda a, b: V.minkowski(a, b, 3.0), "pow(sum(pow(abs(a.v - b.v), 3)), 1/3.0)"),
}
for _name, (_f, _sql) in _DISTANCES.items():
    add(_name, f"with {NATIONS}{UNIT} select a.id i, b.id j, round({_sql}, 4) + 0.0 d from u a join u b on a.t = b.t and a.id < b.id group by 1, 2")(
        lambda spark, d, f=_f: P.distances(_nation_vectors(spark, d), f).select("i", "j", rounded("d").alias("d"))
    )


@add("pair_relations", f"with {NATIONS}{PAIRS}, n as (select count(distinct t) m from g) select i, j, round(sqrt(2 * m * (1 - r)), 4) + 0.0 d, round(1 / (1 + sqrt(greatest(2 - 2 * r, 0))), 4) + 0.0 es from p, n where i < j")
def pair_relations(spark, d):
    v = _nation_vectors(spark, d)
    rho, m = F.col("rho"), F.size(F.col("x"))
    points = F.broadcast(v.agg(F.max(m).alias("m")))
    spec = QuerySpec(Measure.EUCLIDEAN)
    return P.correlations(v).join(points).select("i", "j", rounded(V.euclidean_from_correlation(rho, F.col("m"))).alias("d"), rounded(M.dist_to_sim(spec.measure, M.sim_to_dist(Measure.PEARSON, rho))).alias("es"))


@add("entropy_1", f"with {NATIONS}{BINNED}{ENTROPY} select id, round(h, 4) + 0.0 h from h")
def entropy_1(spark, d):
    s = S.variance_filter(X.nation_months(spark, d))
    return P.entropies(S.binned(s), s.select("t").distinct().count()).select("id", rounded("h").alias("h"))


_JOINT = ", j2 as (select i, j, -sum(n / m * ln(n / m)) h from (select a.id i, b.id j, a.bin x, b.bin y, count(*)::double n, max(a.m) m from e a join e b on a.t = b.t and a.id < b.id group by 1, 2, 3, 4) group by 1, 2)"


@add("mutual_information", f"with {NATIONS}{BINNED}{ENTROPY}{_JOINT} select i, j, round(a.h + b.h - j2.h, 4) + 0.0 mi from j2 join h a on a.id = i join h b on b.id = j")
def mutual_information(spark, d):
    s = S.variance_filter(X.nation_months(spark, d))
    return P.mutual_information(S.binned(s), s.select("t").distinct().count()).select("i", "j", rounded("mi").alias("mi"))


# --- set queries ------------------------------------------------------------------------------------------------------


def shown(results: DataFrame) -> DataFrame:
    """Sides as text and sim to 4 digits, halves away from zero: in generated code, since results may be very many."""
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), "-")
    shifted = F.floor(F.abs("sim") * 1e4 + 0.5) / 1e4
    return results.select(ids("lhs").alias("lhs"), ids("rhs").alias("rhs"), F.when(F.isnan("sim"), F.col("sim")).when(F.col("sim") < 0, 0.0 - shifted).otherwise(shifted).alias("sim"))


def set_query(name: str, data: str, spec: QuerySpec, sql_spec: QuerySpec | None = None, pairs: str = PAIRS) -> None:
    text = sqltext.query(sql_spec or spec, HOURLY[data] + pairs) if sql_spec is not False else None
    add(name, text)(lambda spark, d: shown(run_query(_of(data)(spark, d), spec)))


_T, _TOP = QueryType.THRESHOLD, QueryType.TOPK
_only = {"max_only": True}
set_query("pc_1_1", "supplier", QuerySpec(left=1, right=1, tau=0.3))
set_query("pc_1_2", "supplier", QuerySpec(left=1, right=2, tau=0.4, **_only))
set_query("pc_2_1", "nation", QuerySpec(left=2, right=1, tau=0.25, **_only))
set_query("pc_2_2", "nation", QuerySpec(left=2, right=2, tau=0.3, **_only))
set_query("pc_1_3", "nation", QuerySpec(left=1, right=3, tau=0.3, **_only))
set_query("pc_1_2_sum_weights", "supplier", QuerySpec(left=1, right=2, tau=0.4, weights=Weights("sum"), **_only))
set_query("pc_1_2_custom_weights", "nation", QuerySpec(left=1, right=2, tau=0.25, weights=Weights.parse("custom(2)(1-3)"), **_only))
set_query("es_1_1", "nation", QuerySpec(Measure.EUCLIDEAN, 1, 1, tau=0.44))
set_query("es_1_2", "nation", QuerySpec(Measure.EUCLIDEAN, 1, 2, tau=0.47, **_only))
set_query("es_2_2", "nation", QuerySpec(Measure.EUCLIDEAN, 2, 2, tau=0.52, **_only))
set_query("climb_1_2", "supplier", QuerySpec(left=1, right=2, tau=0.38))
set_query("climb_2_2", "nation", QuerySpec(left=2, right=2, tau=0.32))
set_query("pc_1_2_minjump", "supplier", QuerySpec(left=1, right=2, tau=0.35, min_jump=0.05, **_only))
set_query("pc_1_2_irreducible", "supplier", QuerySpec(left=1, right=2, tau=0.36, irreducible=True, **_only))
set_query("pc_2_2_irreducible", "nation", QuerySpec(left=2, right=2, tau=0.3, irreducible=True, **_only))
set_query("pc_1_2_irreducible_allpairs", "nation", QuerySpec(left=1, right=2, tau=0.2, irreducible=True, subset_scope="all_pairs", **_only))
set_query("topk_pc_1_2", "nation", QuerySpec(left=1, right=2, query=_TOP, k=50))
set_query("topk_es_1_2", "nation", QuerySpec(Measure.EUCLIDEAN, 1, 2, query=_TOP, k=50))
set_query("topk_mp_3", "nation", QuerySpec(Measure.MULTIPOLE, 3, 0, query=_TOP, k=50))
set_query("progressive_pc_1_2", "nation", QuerySpec(left=1, right=2, query=QueryType.PROGRESSIVE, k=40, tau=0.2))
set_query("mp_2", "supplier", QuerySpec(Measure.MULTIPOLE, 2, 0, tau=0.25))
set_query("mp_3", "nation", QuerySpec(Measure.MULTIPOLE, 3, 0, tau=0.3, **_only))
set_query("mp_4", "nation", QuerySpec(Measure.MULTIPOLE, 4, 0, tau=0.45, **_only))
set_query("spearman_1_2", "nation", QuerySpec(Measure.SPEARMAN, 1, 2, tau=0.25, **_only), pairs=RANKED)
_pruned = QuerySpec(left=1, right=2, tau=0.25, max_only=True)
set_query("pruned_pc_1_2", "nation", replace(_pruned, strategy=Strategy.PRUNED), _pruned)
set_query("tiled_pc_1_2", "supplier", QuerySpec(left=1, right=2, tau=0.4, strategy=Strategy.TILED), QuerySpec(left=1, right=2, tau=0.4))
set_query("vector_pc_1_2", "nation", replace(_pruned, strategy=Strategy.VECTOR), _pruned)

_VECTOR_SQL = "with {ctes}{unit}, l as (select id, list(v order by t) x from u group by id), s as (select a.id i, b.id j, c.id k, list_transform(list_zip(a.x, b.x, c.x), lambda z: abs(z[1] - (z[2] + z[3]) / 2)) y from l a join l b on a.id <> b.id join l c on b.id < c.id and c.id <> a.id) select i::varchar lhs, j || '-' || k rhs, round(1 / (1 + {agg}(y)), 4) + 0.0 sim from s where 1 / (1 + {agg}(y)) > {tau}"
for _name, _measure, _agg, _tau in (("manhattan_1_2", Measure.MANHATTAN, "list_sum", 0.125), ("chebyshev_1_2", Measure.CHEBYSHEV, "list_max", 0.74)):
    _spec = QuerySpec(_measure, 1, 2, tau=_tau, max_only=True)
    add(_name, _VECTOR_SQL.format(ctes=NATIONS, unit=UNIT, agg=_agg, tau=_tau))(lambda spark, d, spec=_spec: shown(run_query(X.nation_months(spark, d), spec)))

_TC3 = ", j3 as (select i, j, k, -sum(n / m * ln(n / m)) h from (select a.id i, b.id j, c.id k, a.bin x, b.bin y, c.bin z, count(*)::double n, max(a.m) m from e a join e b on a.t = b.t and a.id < b.id join e c on c.t = b.t and b.id < c.id group by 1, 2, 3, 4, 5, 6) group by 1, 2, 3)"
_TC2_ROWS = ", t2 as (select i, j, a.h + b.h - j2.h s from j2 join h a on a.id = i join h b on b.id = j)"
_TC3_ROWS = ", t3 as (select i, j, k, a.h + b.h + c.h - j3.h s from j3 join h a on a.id = i join h b on b.id = j join h c on c.id = k)"


@add("tc_2", f"with {NATIONS}{BINNED}{ENTROPY}{_JOINT}{_TC2_ROWS} select i || '-' || j lhs, '' rhs, round(s, 4) + 0.0 sim from t2 where s > 0.5")
def tc_2(spark, d):
    return shown(run_query(X.nation_months(spark, d), QuerySpec(Measure.TOTAL_CORRELATION, 2, 0, tau=0.5)))


@add("tc_3", f"with {NATIONS}{BINNED}{ENTROPY}{_TC3}{_TC3_ROWS} select i || '-' || j || '-' || k lhs, '' rhs, round(s, 4) + 0.0 sim from (select * from t3 where s > 0 order by s desc, i, j, k limit 60)")
def tc_3(spark, d):
    return shown(run_query(X.nation_months(spark, d), QuerySpec(Measure.TOTAL_CORRELATION, 3, 0, query=_TOP, k=60, max_only=True)))


@add("tc_3_irreducible", f"with {NATIONS}{BINNED}{ENTROPY}{_JOINT}{_TC2_ROWS}{_TC3}{_TC3_ROWS} select t3.i || '-' || t3.j || '-' || t3.k lhs, '' rhs, round(t3.s, 4) + 0.0 sim from t3 join t2 x on x.i = t3.i and x.j = t3.j join t2 y on y.i = t3.i and y.j = t3.k join t2 z on z.i = t3.j and z.j = t3.k where t3.s > 1.9 and greatest(x.s, y.s, z.s) <= 1.9")
def tc_3_irreducible(spark, d):
    return shown(run_query(X.nation_months(spark, d), QuerySpec(Measure.TOTAL_CORRELATION, 3, 0, tau=1.9, max_only=True)))


@add("names_of_results", f"with {TYPES}{PAIRS}, n as (select event_type name, row_number() over (order by event_type) - 1 id from (select distinct event_type from events)) select i::int l, j::int r, a.name lname, b.name rname, round(r, 4) + 0.0 sim from p join n a on a.id = i join n b on b.id = j where i < j and r > -1")
def names_of_results(spark, d):
    s = X.type_hours(spark, d)
    found = with_names(run_query(s, QuerySpec(left=1, right=1, tau=-1.0)), s.select("id", "name").distinct())
    return found.select(F.col("lhs")[0].alias("l"), F.col("rhs")[0].alias("r"), F.col("lhs_names")[0].alias("lname"), F.col("rhs_names")[0].alias("rname"), rounded("sim").alias("sim"))


@add("subsets_of_results")
def subsets_of_results(spark, d):
    found = run_query(X.nation_months(spark, d), QuerySpec(left=1, right=3, tau=0.35, max_only=True))
    return K.canonical(found).select(F.concat_ws("-", F.transform("lhs", lambda x: x.cast("string"))).alias("lhs"), F.explode(K.subsets(F.col("rhs"))).alias("r")).select("lhs", F.array_join(F.transform("r", lambda x: x.cast("string")), "-").alias("rhs"))


@add("cluster_hierarchy")
def cluster_hierarchy(spark, d):
    return C.hierarchy(_nation_vectors(spark, d)).select("id", "level", "cluster", rounded("radius").alias("radius"), "size")


@add("cluster_extrema", f"with {NATIONS}{PAIRS} select i % 3 c1, j % 3 c2, round(min(r), 4) + 0.0 lo, round(max(r), 4) + 0.0 hi from p group by 1, 2")
def cluster_extrema(spark, d):
    v = _nation_vectors(spark, d)
    of = v.select("id", (F.col("id") % 3).alias("cluster"))
    return C.extrema(P.symmetric(P.correlations(v)), of, of).select("c1", "c2", rounded("lo").alias("lo"), rounded("hi").alias("hi"))


# --- streaming semantics ------------------------------------------------------------------------------------------------

START = "2024-01-01"
_ARRIVALS = f"a as (select k id, epoch(ts - timestamp '{START}') / 60.0 t, value, ts from events join (select event_type, row_number() over (order by event_type) - 1 k from (select distinct event_type from events)) using (event_type))"
HOUR = 60.0


def type_arrivals(spark, d) -> DataFrame:
    events = X.table(spark, d, "events").select(F.col("event_type").alias("id"), "ts", F.col("value").alias("v"))
    return R.arrivals(S.numbered(events), START).withColumn("id", F.col("id").cast("int"))


_AGG_SQL = {"sum": "sum(value)", "avg": "avg(value)", "min": "min(value)", "max": "max(value)", "count": "count(value)::double", "first": "min(struct_pack(t := t, v := value)).v", "last": "max(struct_pack(t := t, v := value)).v"}
for _how, _agg in _AGG_SQL.items():
    add(f"basic_window_{_how}", f"with {_ARRIVALS} select id::int id, ceil(t / 60.0)::bigint bw, round({_agg}, 8) + 0.0 v from a where t > 0 group by 1, 2")(
        lambda spark, d, how=_how: windows.basic_windows(type_arrivals(spark, d), HOUR, how).select("id", "bw", rounded("v", 8).alias("v"))
    )

_FILLED = f"{_ARRIVALS}, bw as (select id, ceil(t / 60.0)::bigint bw, sum(value) v from a where t > 0 group by 1, 2), g as (select s.id, k.bw t, coalesce(bw.v, 0) v from (select distinct id from bw) s cross join (select unnest(generate_series(1, (select max(bw) from bw))) bw) k left join bw on bw.id = s.id and bw.bw = k.bw)"


def type_windows(spark, d) -> DataFrame:
    return windows.filled_windows(windows.basic_windows(type_arrivals(spark, d), HOUR), 1)


@add("sliding_window_sum", f"with {_FILLED} select id::int id, t bw, count(*) over w n, round(sum(v) over w, 3) + 0.0 sx from g window w as (partition by id order by t rows between 239 preceding and current row)")
def sliding_window_sum(spark, d):
    return windows.sliding(type_windows(spark, d), 240).select("id", "bw", "n", rounded("sx", 3).alias("sx"))


_SLIDING = f"{_FILLED}, s as (select a.id i, b.id j, a.t t, sum(a.v) over w sx, sum(b.v) over w sy, sum(a.v * a.v) over w sxx, sum(b.v * b.v) over w syy, sum(a.v * b.v) over w sxy, count(*) over w n from g a join g b on a.t = b.t and a.id < b.id window w as (partition by a.id, b.id order by a.t rows between 239 preceding and current row)), sp as (select i, j, t, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) r from s where n = 240)"


@add("sliding_pearson", f"with {_SLIDING} select i::int i, j::int j, t, round(r, 4) + 0.0 rho from sp")
def sliding_pearson(spark, d):
    return windows.sliding_pairs(type_windows(spark, d), 240).select("i", "j", F.col("bw").alias("t"), rounded("rho").alias("rho"))


def _epoch_pairs(spark, d, every: int = 24) -> DataFrame:
    """Pairs at the end of each day from the first full window on."""
    pairs = windows.sliding_pairs(type_windows(spark, d), 240)
    return pairs.where(F.col("bw") % every == 0).select((F.col("bw") / every).cast("int").alias("epoch"), "i", "j", "rho")


_EPOCHS = f"{_SLIDING}, ep as (select (t // 24)::int epoch, i, j, r from sp where t % 24 = 0 union all select (t // 24)::int, j, i, r from sp where t % 24 = 0)"


def _shown_epochs(results: DataFrame) -> DataFrame:
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "-")
    return results.select("epoch", ids("lhs").alias("lhs"), ids("rhs").alias("rhs"), rounded("sim").alias("sim"))


@add("epoch_results_pc_1_1", f"with {_EPOCHS} select epoch, i::varchar lhs, j::varchar rhs, round(r, 4) + 0.0 sim from ep where i < j and r > 0.05")
def epoch_results_pc_1_1(spark, d):
    return _shown_epochs(replay.epoch_results(_epoch_pairs(spark, d), QuerySpec(left=1, right=1, tau=0.05)))


_EPOCH_12 = "select x.epoch, x.i::varchar lhs, x.j || '-' || y.j rhs, (x.r + y.r) / sqrt(2 + 2 * z.r) s, x.i a, x.j b, y.j c from ep x join ep y on x.epoch = y.epoch and x.i = y.i and x.j < y.j join ep z on z.epoch = x.epoch and z.i = x.j and z.j = y.j"


@add("epoch_results_pc_1_2", f"with {_EPOCHS} select epoch, lhs, rhs, round(s, 4) + 0.0 sim from ({_EPOCH_12}) where s > 0.08")
def epoch_results_pc_1_2(spark, d):
    return _shown_epochs(replay.epoch_results(_epoch_pairs(spark, d), QuerySpec(left=1, right=2, tau=0.08, max_only=True)))


@add("epoch_topk", f"with {_EPOCHS} select epoch, lhs, rhs, round(s, 4) + 0.0 sim from (select *, row_number() over (partition by epoch order by s desc, a, b, c) n from ({_EPOCH_12}) where s > 0) where n <= 3")
def epoch_topk(spark, d):
    return _shown_epochs(replay.epoch_results(_epoch_pairs(spark, d), QuerySpec(left=1, right=2, query=_TOP, k=3, max_only=True)))


@add("result_delta", f"with {_EPOCHS}, q as (select epoch, i, j from ep where i < j and r > 0.05), m as (select max(epoch) m from q) select epoch, i::varchar lhs, j::varchar rhs, 'entered' change from q where not exists (select 1 from q p where p.epoch + 1 = q.epoch and p.i = q.i and p.j = q.j) union all select epoch + 1, i::varchar, j::varchar, 'left' from q, m where epoch + 1 <= m and not exists (select 1 from q n where n.epoch = q.epoch + 1 and n.i = q.i and n.j = q.j)")
def result_delta(spark, d):
    delta = windows.result_delta(replay.epoch_results(_epoch_pairs(spark, d), QuerySpec(left=1, right=1, tau=0.05)))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "-")
    return delta.select("epoch", ids("lhs").alias("lhs"), ids("rhs").alias("rhs"), "change")


@add("count_batches", f"with {_ARRIVALS}, n as (select id, t, value, row_number() over (order by t, id, value) k from a where t > 0) select ceil(k / 500.0)::bigint epoch, id::int id, count(*) n, round(sum(value), 2) + 0.0 v from n group by 1, 2")
def count_batches(spark, d):
    batches = windows.count_batches(type_arrivals(spark, d), 500)
    return batches.groupBy("epoch", "id").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("v"))


@add("runtime_regression", f"with {_FILLED}, r as (select t, sum(v) y, count(*) filter (v > 0) x from g group by t), w as (select t, count(*) over o n, sum(x) over o sx, sum(y) over o sy, sum(x * x) over o sxx, sum(x * y) over o sxy from r window o as (order by t)), k as (select *, case when abs(n * sxx - sx * sx) > 1e-9 then (n * sxy - sx * sy) / (n * sxx - sx * sx) else 0 end b from w) select t, round(b, 3) + 0.0 slope, round((sy - b * sx) / n, 3) + 0.0 icept from k")
def runtime_regression(spark, d):
    runs = type_windows(spark, d).groupBy(F.col("bw").alias("t")).agg(F.sum("v").alias("y"), F.count_if(F.col("v") > 0).cast("double").alias("x"))
    return windows.runtime_regression(runs).select("t", rounded("slope", 3).alias("slope"), rounded("intercept", 3).alias("icept"))


# --- preparation ----------------------------------------------------------------------------------------------------------

_TICKS = "tk as (select event_type id, ts, avg(value) v from events group by 1, 2)"
_RESAMPLED = f"{_TICKS}, o as (select id, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') t, avg(v) v from tk group by 1, 2), sp as (select id, unnest(generate_series(min(t), max(t), interval 6 hour)) t from o group by id), rs as (select sp.id, sp.t, case when hour(sp.t) = 6 and day(sp.t) % 4 = 0 then null else o.v end v from sp left join o using (id, t))"


def ticks(spark, d) -> DataFrame:
    return X.table(spark, d, "events").groupBy(F.col("event_type").alias("id"), "ts").agg(F.avg("value").alias("v"))


def resampled(spark, d) -> DataFrame:
    """Means of six hours, with some made null so that gaps exist at every size."""
    r = R.resample_mean(ticks(spark, d), "6 hours")
    return r.withColumn("v", F.when((F.hour("t") == 6) & (F.day("t") % 4 == 0), None).otherwise(F.col("v")))


@add("resample_mean", f"with {_RESAMPLED} select id, t, round(v, 8) + 0.0 v from rs")
def resample_mean(spark, d):
    return resampled(spark, d).select("id", "t", rounded("v", 8).alias("v"))


@add("drop_null_points", f"with {_RESAMPLED} select id, t, round(v, 8) + 0.0 v from rs where t in (select t from rs group by t having count(v) > 0)")
def drop_null_points(spark, d):
    return R.drop_empty_points(resampled(spark, d)).select("id", "t", rounded("v", 8).alias("v"))


@add("last_points", f"with {_RESAMPLED} select id, t, round(v, 8) + 0.0 v from rs where t in (select distinct t from rs order by t desc limit 20)")
def last_points(spark, d):
    return R.last_points(resampled(spark, d), 20).select("id", "t", rounded("v", 8).alias("v"))


@add("null_run_filter", f"with {_RESAMPLED}, n as (select id, v, row_number() over (partition by id order by t) k from rs), z as (select id, k - row_number() over (partition by id order by k) g from n where v is null), l as (select id, max(c) m from (select id, g, count(*) c from z group by 1, 2) group by id) select distinct rs.id, coalesce(m, 0) longest from rs left join l using (id)")
def null_run_filter(spark, d):
    return R.null_runs(resampled(spark, d))


_FILLS = "select id, t, n, v, last_value(case when v is not null then n end ignore nulls) over b na, last_value(v ignore nulls) over b va, first_value(case when v is not null then n end ignore nulls) over f nb, first_value(v ignore nulls) over f vb from (select *, row_number() over (partition by id order by t) n from rs) window b as (partition by id order by t rows between unbounded preceding and current row), f as (partition by id order by t rows between current row and unbounded following)"


@add("linear_interpolate", f"with {_RESAMPLED}, x as ({_FILLS}) select id, t, round(coalesce(v, va + (vb - va) * (n - na) / (nb - na), va, vb), 8) + 0.0 v from x")
def linear_interpolate(spark, d):
    return R.interpolate(resampled(spark, d)).select("id", "t", rounded("v", 8).alias("v"))


@add("log_return", f"with {_RESAMPLED}, y as (select id, t, abs(v) + 1 v from rs where v is not null), q as (select id, t, round(ln(v) - ln(lag(v) over (partition by id order by t)), 4) + 0.0 v from y) select * from q where v is not null")
def log_return(spark, d):
    points_ = resampled(spark, d).where("v is not null").withColumn("v", F.abs("v") + 1)
    return R.log_returns(points_).select("id", "t", rounded("v").alias("v"))


@add("outlier_to_zero", f"with {_RESAMPLED} select id, t, case when abs(v) > 40 then 0 else round(v, 8) + 0.0 end v from rs")
def outlier_to_zero(spark, d):
    return R.outliers_to_zero(resampled(spark, d), 40.0).select("id", "t", rounded("v", 8).alias("v"))


@add("locf_grid", f"with {_TICKS}, s as (select distinct id from tk), k as (select id, unnest(generate_series(timestamp '2024-01-02', timestamp '2024-01-28', interval 8 hour)) t from s) select k.id, k.t, round(tk.v, 4) + 0.0 v from k asof left join tk on k.id = tk.id and k.t >= tk.ts")
def locf_grid(spark, d):
    return R.locf_grid(ticks(spark, d), "2024-01-02", "2024-01-28", "8 hours").select("id", "t", rounded("v").alias("v"))


@add("make_arrivals", f"with {_TICKS} select id, round(epoch(ts - timestamp '2024-01-05') / 60.0, 3) + 0.0 t, round(v, 4) + 0.0 \"value\" from tk where ts > timestamp '2024-01-05'")
def make_arrivals(spark, d):
    return R.arrivals(ticks(spark, d), "2024-01-05").select("id", rounded("t", 3).alias("t"), rounded("value").alias("value"))


@add("mean_pool", "with x as (select c_custkey % 8 x, c_custkey // 8 % 8 y, c_custkey // 64 % 8 z, 0 t, c_acctbal v from customer), q as (select x // 2 x, y // 2 y, z // 2 z, t, avg(v) v from x group by 1, 2, 3, 4) select x::int x, y::int y, z::int z, t, round(v, 8) + 0.0 v from q where v > 0")
def mean_pool(spark, d):
    c = X.table(spark, d, "customer")
    place = lambda n: F.floor(F.col("c_custkey") / n).cast("long") % 8
    voxels = c.select(place(1).alias("x"), place(8).alias("y"), place(64).alias("z"), F.lit(0).alias("t"), F.col("c_acctbal").alias("v"))
    return R.mean_pool(voxels, 2).select("x", "y", "z", "t", rounded("v", 8).alias("v"))


@add("hash_sample")
def hash_sample(spark, d):
    return R.hash_sample(X.table(spark, d, "supplier"), "s_name", 4).select("s_suppkey", "s_name")


@add("artificial_arrivals", "select vec_id::int id, i - 32.0 t, round(v, 4) + 0.0 \"value\" from (select vec_id, unnest(generate_series(0, len(embedding) - 1)) i, unnest(embedding)::double v from embeddings) where i >= 32 and i < 64")
def artificial_arrivals(spark, d):
    return X.artificial_arrivals(X.embedding_vectors(spark, d), 32)[1].select("id", "t", rounded("value").alias("value"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred most similar (1 | 1) and (1 | 2) sets of suppliers by monthly revenue."""
    return shown(run_query(X.supplier_months(spark, folder), QuerySpec(left=1, right=2, query=_TOP, k=100)))


