"""Queries that exercise vector functions, set helpers, bounds and preparation rules, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from covey.catalogue import BINNED, ENTROPY, NATIONS, PAIRS, QUERIES, SQL, UNIT, _nation_vectors, add, rounded, set_query, ticks
from covey.functions import vectors as V
from covey.operators import candidates as K
from covey.operators import clustering as C
from covey.operators import measures as M
from covey.operators import pairs as P
from covey.operators import prepare as R
from covey.operators import series as S
from covey.plans import pruned, sqltext
from covey.plans.query import run_query
from covey.sources import readers as X
from covey.spec import Measure, QuerySpec, QueryType, Strategy, Weights

_E = "e as (select vec_id::int id, list_transform(embedding, lambda x: x::double) x from embeddings)"


def _vectors(spark, d):
    return X.embedding_vectors(spark, d)


@add("vector_arithmetic", f"with {_E} select id, round(list_sum(list_transform(x, lambda v: log2(abs(v) + 1))), 6) + 0.0 lg, round(list_sum(list_transform(list_zip(x, list_reverse(x)), lambda z: (z[1] - z[2]) * z[1])), 6) + 0.0 df, round(list_sum(list_transform(x, lambda v: v + 2.5)), 6) + 0.0 sa, round(list_sum(list_transform(x, lambda v: abs(v / 4))), 6) + 0.0 dv from e")
def vector_arithmetic(spark, d):
    x = F.col("x")
    back = F.reverse(x)
    out = {"lg": V.total(F.transform(x, lambda v: V.log2(F.abs(v) + 1))), "df": V.dot(V.sub(x, back), x), "sa": V.total(V.sadd(x, 2.5)), "dv": V.total(F.transform(V.div(x, 4.0), F.abs))}
    return _vectors(spark, d).select("id", *[rounded(c, 6).alias(n) for n, c in out.items()])


@add("vector_transpose", f"with {_E} select id, k::int k, round(x[k], 8) + 0.0 a, round(2 * x[k], 8) + 0.0 b, round(x[k] + 1, 8) + 0.0 c from (select id, x, unnest(generate_series(1, len(x))) k from e)")
def vector_transpose(spark, d):
    x = F.col("x")
    rows = _vectors(spark, d).select("id", F.posexplode(V.transpose(F.array(x, V.scale(x, 2.0), V.sadd(x, 1.0)))).alias("k", "row"))
    return rows.select("id", (F.col("k") + 1).alias("k"), *[rounded(F.col("row")[n], 8).alias(c) for n, c in enumerate("abc")])


@add("matrix_vector", f"with {_E} select id, round(list_dot_product(x, x), 6) + 0.0 a, round(list_dot_product(x, list_reverse(x)), 6) + 0.0 b, round(list_sum(x), 6) + 0.0 c from e")
def matrix_vector(spark, d):
    x = F.col("x")
    product = V.matrix_vector(x, F.array(x, F.reverse(x), F.transform(x, lambda v: F.lit(1.0))))
    return _vectors(spark, d).withColumn("y", product).select("id", *[rounded(F.col("y")[n], 6).alias(c) for n, c in enumerate("abc")])


_STD = "z as (select id, list_transform(x, lambda v: (v - list_avg(x)) / list_stddev_pop(x)) x from e), l as (select id, list_transform(x, lambda v: v / sqrt(len(x))) x from z)"


@add("vector_angles", f"with {_E}, {_STD} select e.id, round(acos(list_dot_product(e.x, list_reverse(e.x)) / list_dot_product(e.x, e.x)), 6) + 0.0 f, round(acos(list_dot_product(l.x, list_reverse(l.x))), 6) + 0.0 u, round(acos(list_dot_product(z.x, list_reverse(z.x)) / len(z.x)), 6) + 0.0 z, round(acos(list_dot_product(z.x, list_reverse(z.x)) / len(z.x)) - case when list_dot_product(z.x, list_reverse(z.x)) <= 0 then pi() / 2 else 0 end, 6) + 0.0 o from e join z using (id) join l using (id)")
def vector_angles(spark, d):
    v = _vectors(spark, d).select("id", "x", V.l2norm(F.col("x")).alias("u"), V.znorm(F.col("x")).alias("z"))
    v = v.select("*", *[F.reverse(c).alias(f"{c}_r") for c in "xuz"])
    c = F.col
    return v.select("id", rounded(V.angle_full(c("x"), c("x_r")), 6).alias("f"), rounded(V.l2_normalised_angle(c("u"), c("u_r")), 6).alias("u"), rounded(V.z_normalised_angle(c("z"), c("z_r")), 6).alias("z"), rounded(V.angle_over_normalised(c("z"), c("z_r")), 6).alias("o"))


@add("temperatures", "select c_custkey, round((c_acctbal - 32) * 5 / 9, 6) + 0.0 c, round((c_acctbal - 32) * 5 / 9 + 273.15, 6) + 0.0 k from customer")
def temperatures(spark, d):
    celsius = V.fahrenheit_to_celsius(F.col("c_acctbal"))
    return X.table(spark, d, "customer").select("c_custkey", rounded(celsius, 6).alias("c"), rounded(V.celsius_to_kelvin(celsius), 6).alias("k"))


@add("vector_helpers", f"with {_E} select id, len(x) * 2 n, round(list_avg(x), 6) + 0.0 a, round(list_dot_product(x, list_reverse(x)) / len(x) - list_avg(x) * list_avg(x), 6) + 0.0 cv, round(1 - 9.0 / (2 * len(x)), 6) + 0.0 r from e")
def vector_helpers(spark, d):
    x = F.col("x")
    joined = V.concat(x, F.reverse(x))
    return _vectors(spark, d).select("id", F.size(joined).cast("long").alias("n"), rounded(V.avg(joined), 6).alias("a"), rounded(V.covariance(x, F.reverse(x)), 6).alias("cv"), rounded(V.correlation_from_euclidean(F.lit(3.0), F.size(x)), 6).alias("r"))


@add("correlations_of_sums", f"with {NATIONS}{PAIRS} select a.j::int j, round((a.r + b.r) / sqrt(2 + 2 * c.r), 4) + 0.0 r12, round((a.r + b.r + e.r + f.r) / sqrt((2 + 2 * g1.r) * (2 + 2 * c.r)), 4) + 0.0 r22 from p a join p b on a.i = 0 and b.i = 0 and b.j = a.j + 1 join p c on c.i = a.j and c.j = b.j join p e on e.i = 1 and e.j = a.j join p f on f.i = 1 and f.j = b.j join p g1 on g1.i = 0 and g1.j = 1 where a.j > 1")
def correlations_of_sums(spark, d):
    """Series 0, and the sum of 0 and 1, against the sum of two neighbours."""
    p = P.symmetric(P.correlations(_nation_vectors(spark, d)))
    of = lambda i, name: p.where(F.col("i") == i).select("j", F.col("rho").alias(name))
    near = p.where("j = i + 1").select(F.col("i").alias("j"), F.col("rho").alias("c"))
    step = lambda i, name: of(i, name).withColumn("j", F.col("j") - 1)
    rows = of(0, "a").join(step(0, "b"), "j").join(near, "j").join(of(1, "e"), "j").join(step(1, "f"), "j").where("j > 1").join(p.where("i = 0 and j = 1").select(F.col("rho").alias("g")))
    c = F.col
    return rows.select("j", rounded(V.correlation_of_one_with_two(c("a"), c("b"), c("c"))).alias("r12"), rounded(V.correlation_of_two_with_two(c("a"), c("b"), c("e"), c("f"), c("g"), c("c"))).alias("r22"))


# --- candidates -----------------------------------------------------------------------------------------------------------

set_query("climb_custom_weights", "nation", QuerySpec(left=2, right=2, tau=0.3, weights=Weights.parse("custom(2-1)(1-3)")))
set_query("topk_custom_weights", "nation", QuerySpec(left=1, right=2, query=QueryType.TOPK, k=30, weights=Weights.parse("custom(1)(1-2)")))
set_query("topk_seeded", "supplier", QuerySpec(left=1, right=2, query=QueryType.TOPK, k=20))
set_query("pruned_topk", "nation", QuerySpec(left=1, right=2, query=QueryType.TOPK, k=40, strategy=Strategy.PRUNED), QuerySpec(left=1, right=2, query=QueryType.TOPK, k=40))
set_query("pruned_mp_3", "nation", QuerySpec(Measure.MULTIPOLE, 3, 0, tau=0.33, strategy=Strategy.PRUNED), QuerySpec(Measure.MULTIPOLE, 3, 0, tau=0.33))
set_query("pruned_es_1_2", "nation", QuerySpec(Measure.EUCLIDEAN, 1, 2, tau=0.48, strategy=Strategy.PRUNED, max_only=True), QuerySpec(Measure.EUCLIDEAN, 1, 2, tau=0.48, max_only=True))


@add("pruned_progressive", f"with {NATIONS}{PAIRS}, q as ({sqltext.pattern(QuerySpec(left=1, right=2, tau=0.2), 1, 2)}) select 30::bigint n, 30::bigint found from (select count(*) c from q) where c >= 30")
def pruned_progressive(spark, d):
    """Any thirty sets that pass, from bounds shrunk by half first: how many, and how many of them the full query has."""
    from covey.operators.lineage import cut

    spec = QuerySpec(left=1, right=2, tau=0.2, query=QueryType.PROGRESSIVE, k=30, strategy=Strategy.PRUNED, max_only=True, shrink=0.5)
    some = cut(run_query(X.nation_months(spark, d), spec), "some")
    every = run_query(X.nation_months(spark, d), QuerySpec(left=1, right=2, tau=0.2, max_only=True)).select("lhs", "rhs")
    found = some.join(every, ["lhs", "rhs"], "left_semi").agg(F.count(F.lit(1)).alias("found"))
    return some.agg(F.count(F.lit(1)).alias("n")).join(found)


@add("pruned_tc_3", SQL["tc_3_irreducible"])
def pruned_tc_3(spark, d):
    from covey.catalogue import shown

    return shown(run_query(X.nation_months(spark, d), QuerySpec(Measure.TOTAL_CORRELATION, 3, 0, tau=1.9, max_only=True, strategy=Strategy.PRUNED)))


def _shown_ids(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "-")


_SETS = QuerySpec(left=1, right=3, tau=0.35, max_only=True)
_FOUND = f"with {NATIONS + PAIRS}, q as ({sqltext.pattern(_SETS, 1, 3)}), w as (select lhs, list_transform(string_split(rhs, '-'), lambda x: x::int) r from q)"
SQL["subsets_of_results"] = f"{_FOUND} select lhs, unnest([r[2] || '-' || r[3], r[1] || '-' || r[3], r[1] || '-' || r[2]]) rhs from w"


@add("set_helpers", f"{_FOUND} select lhs, array_to_string(r, '-') rhs, array_to_string(list_append(r, 99), '-') more, array_to_string(list_filter(r, lambda x: x <> r[1]), '-') less, array_to_string(r, '-') mirrored, list_contains(r, 3) has3 from w")
def set_helpers(spark, d):
    found = K.canonical(run_query(X.nation_months(spark, d), _SETS))
    mirrored = K.mirror(found).select(F.col("lhs").alias("m_l"), F.col("rhs").alias("m_r"))
    both = found.join(mirrored, (found["lhs"] == mirrored["m_r"]) & (found["rhs"] == mirrored["m_l"]))
    return both.select(_shown_ids("lhs").alias("lhs"), _shown_ids("rhs").alias("rhs"), _shown_ids(K.expand(F.col("rhs"), 99)).alias("more"), _shown_ids(K.reduce(F.col("rhs"), F.col("rhs")[0])).alias("less"), _shown_ids("m_l").alias("mirrored"), F.array_contains("rhs", 3).alias("has3"))


@add("normalised_queries", "select * from (values ('threshold', 1, 2, 0, 0.5, false), ('topk', 1, 2, 100, 0.0, false), ('topk_negative', 1, 2, 7, -0.5, false), ('custom', 1, 2, 0, 0.5, false), ('one_sided', 5, 0, 0, 0.5, false), ('negative_jump', 1, 2, 0, 0.5, true)) q(name, \"left\", \"right\", k, tau, irreducible)")
def normalised_queries(spark, d):
    specs = {
        "threshold": QuerySpec(tau=0.5, k=9), "topk": QuerySpec(query=QueryType.TOPK, tau=0.5, irreducible=True, min_jump=0.2), "topk_negative": QuerySpec(query=QueryType.TOPK, tau=-0.5, k=7),
        "custom": QuerySpec(tau=0.5, min_jump=0.2, weights=Weights.parse("custom(2)(1-3)")), "one_sided": QuerySpec(Measure.MULTIPOLE, 3, 2, tau=0.5), "negative_jump": QuerySpec(tau=0.5, min_jump=-1.0),
    }
    rows = [(n, q.left, q.right, q.k, q.tau, q.irreducible) for n, q in ((n, s.normalised()) for n, s in specs.items())]
    return spark.createDataFrame(rows, "name string, left int, right int, k int, tau double, irreducible boolean")


@add("streaming_measures", "select * from (values ('pearson_correlation', true), ('euclidean_similarity', true), ('multipole', false), ('total_correlation', false), ('spearman_correlation', false), ('manhattan_similarity', false), ('chebyshev_similarity', false)) q(measure, streams)")
def streaming_measures(spark, d):
    return spark.createDataFrame([(m.value, m.streams) for m in Measure], "measure string, streams boolean")


# --- clusters and bounds ----------------------------------------------------------------------------------------------------


@add("cluster_value_bounds", f"with {NATIONS}{BINNED}{ENTROPY} select (id % 3)::int cluster, round(min(h), 4) + 0.0 lo, round(max(h), 4) + 0.0 hi from h group by 1")
def cluster_value_bounds(spark, d):
    s = S.variance_filter(X.nation_months(spark, d))
    h = P.entropies(S.binned(s), s.select("t").distinct().count())
    of = s.select("id").distinct().withColumn("cluster", F.col("id") % 3)
    return C.value_bounds(of, h).select("cluster", rounded("lo").alias("lo"), rounded("hi").alias("hi"))


_CENTERS = f"{NATIONS}{UNIT}, k as (select id % 3 c, t, avg(v) v from u group by 1, 2), kn as (select c, t, v / sqrt(sum(v * v) over (partition by c)) v from k), rr as (select c, max(acos(least(greatest(s, -1), 1))) r from (select u.id, c, sum(u.v * kn.v) s from u join kn on kn.c = u.id % 3 and kn.t = u.t group by 1, 2) group by c), cc as (select a.c c1, b.c c2, sum(a.v * b.v) s from kn a join kn b on a.t = b.t group by 1, 2)"


@add("cluster_theoretical_bounds", f"with {_CENTERS} select c1::int c1, c2::int c2, round(cos(least(acos(least(greatest(s, -1), 1)) + x.r + y.r, pi())), 4) + 0.0 lo, round(cos(greatest(acos(least(greatest(s, -1), 1)) - x.r - y.r, 0)), 4) + 0.0 hi, 0::bigint broken from cc join rr x on x.c = c1 join rr y on y.c = c2 where c1 < c2")
def cluster_theoretical_bounds(spark, d):
    """Bounds from the clusters' centers and radii, and how many pairs of members break them."""
    v = _nation_vectors(spark, d)
    of = v.select("id", (F.col("id") % 3).alias("cluster"))
    radius = C.geometric_radius(v.select("id", "x"), of)
    center = of.join(v.select("id", "x"), "id").select("cluster", F.posexplode("x").alias("t", "v")).groupBy("cluster", "t").agg(F.avg("v").alias("v"))
    center = center.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("tv")).select("cluster", V.unit(F.transform("tv", lambda s: s["v"])).alias("x")).join(radius, "cluster")
    a, b = (center.select(F.col("cluster").alias(f"c{k}"), F.col("x").alias(f"x{k}"), F.col("radius").alias(f"r{k}")) for k in (1, 2))
    lo, hi = C.theoretical_bounds(V.dot(F.col("x1"), F.col("x2")), F.col("r1"), F.col("r2"))
    bounds = a.join(b, F.col("c1") < F.col("c2")).select("c1", "c2", lo.alias("lo"), hi.alias("hi"))
    p = P.symmetric(P.correlations(v)).select((F.col("i") % 3).alias("c1"), (F.col("j") % 3).alias("c2"), "rho").join(bounds, ["c1", "c2"])
    return p.groupBy("c1", "c2").agg(rounded(F.max("lo")).alias("lo"), rounded(F.max("hi")).alias("hi"), F.count_if((F.col("rho") < F.col("lo") - 1e-9) | (F.col("rho") > F.col("hi") + 1e-9)).alias("broken"))


def _bounded_sets(spark, d, spec: QuerySpec, left: int, right: int):
    """How many sets of members leave the bounds of their combination of clusters (id modulo 4)."""
    import itertools

    v = _nation_vectors(spark, d)
    of = v.select("id", (F.col("id") % 4).alias("cluster"))
    both = P.symmetric(P.correlations(v))
    names = M.slots(left, right)
    sets = K.candidates(both.where("i < j"), spec, left, right).withColumn("sim", M.similarity(spec, names[:left], names[left:], M.pair_column))
    ext = C.extrema(both, of, of)
    for x, y in itertools.combinations(names, 2):
        sets = sets.join(ext.select(F.col("c1").alias("_a"), F.col("c2").alias("_b"), F.col("lo").alias(f"lo_{x}_{y}"), F.col("hi").alias(f"hi_{x}_{y}")), (F.col(x) % 4 == F.col("_a")) & (F.col(y) % 4 == F.col("_b"))).drop("_a", "_b")
    at = lambda tag: lambda x, y: F.col(f"{tag}_{x}_{y}" if names.index(x) < names.index(y) else f"{tag}_{y}_{x}")
    lo, hi = pruned.set_bounds(spec, left, right, at("lo"), at("hi"))
    outside = (F.col("sim") < lo - 1e-9) | (F.col("sim") > hi + 1e-9)
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("broken"))


for _name, _spec, _l, _r, _n in (("bounds_pc_1_2", QuerySpec(), 1, 2, "n * (n - 1) * (n - 2) / 2"), ("bounds_es_1_2", QuerySpec(Measure.EUCLIDEAN), 1, 2, "n * (n - 1) * (n - 2) / 2"), ("bounds_mp_3", QuerySpec(Measure.MULTIPOLE, 3, 0), 3, 0, "n * (n - 1) * (n - 2) / 6")):
    add(_name, f"with {NATIONS} select ({_n})::bigint n, 0::bigint broken from (select count(distinct id) n from g)")(lambda spark, d, a=(_spec, _l, _r): _bounded_sets(spark, d, *a))


@add("cluster_tree_rules", f"with {NATIONS} select count(distinct id) series, count(distinct id) alone, 0::bigint torn, 0::bigint wrong_size, 0::bigint wrong_radius, 0::bigint growing from g")
def cluster_tree_rules(spark, d):
    """What a hierarchy must keep: all series end alone, children lie in their parent, sizes and radii are those of the members."""
    v = _nation_vectors(spark, d)
    tree = C.hierarchy(v.select("id", "x"))
    from covey.operators.lineage import cut

    tree = cut(tree, "tree")
    up = tree.select("id", (F.col("level") + 1).alias("level"), F.col("cluster").alias("above"), F.col("radius").alias("r_above"))
    torn = tree.join(up, ["id", "level"]).agg(F.count_if(F.col("parent") != F.col("above")).alias("torn"), F.count_if((F.col("level") > 1) & (F.col("size") > 1) & (F.col("radius") > 2 * F.col("r_above") + 1e-9)).alias("growing"))
    counted = tree.groupBy("level", "cluster").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).agg(F.count_if(F.col("n") != F.col("size")).alias("wrong_size"))
    angle = V.angle(F.col("x"), F.col("y"))
    far = tree.where("level > 0").join(v.select("id", "x"), "id").join(v.select(F.col("id").alias("medoid"), F.col("x").alias("y")), "medoid").groupBy("level", "cluster").agg(F.max(angle).alias("far"), F.max("radius").alias("radius"))
    wrong = far.agg(F.count_if((F.abs(F.col("far") - F.col("radius")) > 1e-6)).alias("wrong_radius"))
    ends = tree.groupBy("id").agg(F.min("size").alias("least")).agg(F.count(F.lit(1)).alias("series"), F.count_if(F.col("least") == 1).alias("alone"))
    return ends.join(torn).join(counted).join(wrong).select("series", "alone", "torn", "wrong_size", "wrong_radius", "growing")


# --- preparation ------------------------------------------------------------------------------------------------------------


@add("parse_ticks", "select event_type id, date_trunc('minute', ts) ts, round(min(value), 6) + 0.0 v from events group by 1, 2")
def parse_ticks(spark, d):
    e = X.table(spark, d, "events")
    raw = e.select(F.col("event_type").alias("id"), F.date_format("ts", "MM/dd/yyyy").alias("date"), F.date_format("ts", "HH:mm").alias("time"), F.col("value").cast("string").alias("price"))
    return R.parse_ticks(raw).select("id", "ts", rounded("v", 6).alias("v"))


_TICKS = "tk as (select event_type id, ts, avg(value) v from events group by 1, 2)"


@add("slice_range", f"with {_TICKS}, i as (select * from tk where ts between timestamp '2024-01-05' and timestamp '2024-01-20'), b as (select id, min(ts) a, max(ts) b, arg_min(v, ts) va, arg_max(v, ts) vb from i group by id), u as (select * from i union all select id, timestamp '2024-01-05', va from b where a > timestamp '2024-01-05' union all select id, timestamp '2024-01-20', vb from b where b < timestamp '2024-01-20') select id, ts, round(v, 6) + 0.0 v from u")
def slice_range(spark, d):
    a, b = (F.to_timestamp(F.lit(x)) for x in ("2024-01-05", "2024-01-20"))
    return R.slice_range(ticks(spark, d), a, b).select("id", "ts", rounded("v", 6).alias("v"))


_READINGS = "rd as (select user_id % 40 id, ts, case when event_id % 50 = 7 then 9999.0 else round(value / 20) end v, case when event_id % 97 = 5 and user_id % 40 < 3 then 2 else 1 end q, event_id from events), r1 as (select id, ts, min(v) v, max(q) q from rd group by 1, 2)"
_SOUND = "fl as (select id from r1 group by id having count(*) filter (where v is null or v in (9999, 99999, 999999) or q <> 1) <= {faults}), gd as (select r1.id, ts, v from r1 join fl using (id) where not (v in (9999, 99999, 999999) or q <> 1)), st as (select *, (epoch(ts) - epoch(lag(ts) over w)) / 86400 gap, case when v = lag(v) over w then 0 else 1 end ch from gd window w as (partition by id order by ts)), rn as (select *, sum(ch) over (partition by id order by ts rows unbounded preceding) run from st), kp as (select id from (select id, max(gap) g from rn group by id) join (select id, max(d) d from (select id, run, (epoch(max(ts)) - epoch(min(ts))) / 86400 d from rn group by 1, 2) group by id) using (id) where coalesce(g, 0) <= {gap} and d <= {still})"


def _readings(spark, d):
    e = X.table(spark, d, "events")
    v = F.when(F.col("event_id") % 50 == 7, 9999.0).otherwise(F.round(F.col("value") / 20))
    quality = F.when((F.col("event_id") % 97 == 5) & (F.col("user_id") % 40 < 3), 2).otherwise(1)
    rows = e.select((F.col("user_id") % 40).alias("id"), "ts", v.alias("v"), quality.alias("quality"))
    return rows.groupBy("id", "ts").agg(F.min("v").alias("v"), F.max("quality").alias("quality"))


@add("regular_sensors", f"with {_READINGS}, {_SOUND.format(faults=6, gap=1.2, still=1.0)} select gd.id, ts, v from gd join kp using (id)")
def regular_sensors(spark, d):
    return R.regular_sensors(_readings(spark, d), most_gap_days=1.2, most_faults=6, most_still_days=1.0)


@add("minimum_spacing", f"with {_READINGS} select id, min(ts) ts, arg_min(v, ts) v from r1 group by id, floor(epoch(ts) / 7200)")
def minimum_spacing(spark, d):
    return R.minimum_spacing(_readings(spark, d), 7200)


@add("arrival_returns", "with tk as (select event_type id, ts, abs(avg(value)) + 1 v from events group by 1, 2), q as (select id, (epoch(ts) - epoch(timestamp '2024-01-05')) / 60 t, round(ln(v) - ln(lag(v) over (partition by id order by ts)), 6) v from tk) select id, round(t, 3) + 0.0 t, round(v, 6) + 0.0 \"value\" from q where v is not null and abs(v) < 100 and t > 0")
def arrival_returns(spark, d):
    t = ticks(spark, d).withColumn("v", F.abs("v") + 1)
    return R.arrivals(t, "2024-01-05", returns=True).select("id", rounded("t", 3).alias("t"), rounded("value", 6).alias("value"))


@add("drop_long_gaps", "with o as (select event_type id, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') t, avg(value) v from events group by 1, 2), sp as (select id, unnest(generate_series(min(t), max(t), interval 6 hour)) t from o group by id), rs as (select sp.id, sp.t, case when ascii(sp.id) % 2 = 0 and hour(sp.t) in (6, 12) then null else o.v end v from sp left join o using (id, t)), n as (select *, row_number() over (partition by id order by t) k from rs), z as (select id, k - row_number() over (partition by id order by k) g from n where v is null and k <= 1000), l as (select id, max(c) m from (select id, g, count(*) c from z group by 1, 2) group by id) select rs.id, rs.t, round(rs.v, 8) + 0.0 v from rs left join l using (id) where coalesce(m, 0) < 2")
def drop_long_gaps(spark, d):
    r = R.resample_mean(X.table(spark, d, "events").select(F.col("event_type").alias("id"), "ts", F.col("value").alias("v")), "6 hours")
    r = r.withColumn("v", F.when((F.ascii("id") % 2 == 0) & F.hour("t").isin(6, 12), None).otherwise(F.col("v")))
    return R.drop_long_gaps(r, 2).select("id", "t", rounded("v", 8).alias("v"))


_CRC = "list_reduce(list_concat([4294967295::ubigint], list_transform(range(1, length(s_name) + 1), lambda k: ascii(s_name[k])::ubigint)), lambda x, y: list_reduce(list_concat([xor(x, y)], list_transform(range(8), lambda z: 0::ubigint)), lambda c, w: case when (c & 1::ubigint) = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end))"
SQL["hash_sample"] = f"select s_suppkey, s_name from (select *, xor({_CRC}, 4294967295::ubigint) h from supplier) where h % 4 = 0"

assert set(SQL) <= set(QUERIES)
