import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from covey.operators import clustering as C
from covey.operators import measures as M
from covey.operators import pairs as P
from covey.operators import series as S
from covey.operators.candidates import candidates, canonical, pack, subsets
from covey.plans.query import run_query
from covey.spec import Measure, QuerySpec, QueryType, Strategy, Weights


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8, 40))
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    x[2] = z[0] + z[1]  # correlates with the sum of two others
    x[5] = x[4]  # a duplicate
    x[7] = -x[6]  # a negated one
    return x


@pytest.fixture(scope="module")
def series(spark, data):
    rows = [(i, t, float(v)) for i, row in enumerate(data) for t, v in enumerate(row)] + [(99, t, 1.0) for t in range(40)]
    return spark.createDataFrame(rows, "id int, t int, v double").persist()


def brute(data, measure, left, right, tau, wl=None, wr=None):
    """(lhs, rhs) -> similarity, from the vectors themselves."""
    u = data - data.mean(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = {}
    for ls in itertools.combinations(range(len(u)), left):
        for rs in itertools.combinations([k for k in range(len(u)) if k not in ls], right):
            if left == right and ls[0] > rs[0]:
                continue
            a, b = u[list(ls)].mean(0), u[list(rs)].mean(0)
            if measure is Measure.PEARSON:
                s = a @ b / np.sqrt(max(a @ a, 1e-7) * max(b @ b, 1e-7))
            else:
                s = 1 / (1 + np.linalg.norm(a - b))
            if s > tau:
                out[ls, rs] = s
    return out


def found(df):
    return {(tuple(r["lhs"]), tuple(r["rhs"])): r["sim"] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize("measure", [Measure.PEARSON, Measure.EUCLIDEAN])
@pytest.mark.parametrize("pattern", [(1, 1), (1, 2), (2, 1), (2, 2)])
def test_threshold_against_vectors(data, series, measure, pattern):
    tau = 0.3 if measure is Measure.PEARSON else 0.501
    same(found(run_query(series, QuerySpec(measure, *pattern, tau=tau, max_only=True))), brute(data, measure, *pattern, tau))


@pytest.mark.parametrize("strategy", [Strategy.PRUNED, Strategy.TILED, Strategy.VECTOR])
def test_strategies_agree(data, series, strategy):
    spec = QuerySpec(left=1, right=2, tau=0.35, strategy=strategy)
    same(found(run_query(series, spec)), brute(data, Measure.PEARSON, 1, 1, 0.35) | brute(data, Measure.PEARSON, 1, 2, 0.35))


def test_jump_and_irreducible(data, series):
    one = brute(data, Measure.PEARSON, 1, 1, -2)
    pair = lambda i, j: one[(min(i, j),), (max(i, j),)]
    all_12 = brute(data, Measure.PEARSON, 1, 2, 0.3)
    most = {k: max(pair(k[0][0], k[1][0]), pair(k[0][0], k[1][1])) for k in all_12}
    same(found(run_query(series, QuerySpec(left=1, right=2, tau=0.3, min_jump=0.1, max_only=True))), {k: v for k, v in all_12.items() if v > most[k] + 0.1})
    same(found(run_query(series, QuerySpec(left=1, right=2, tau=0.3, irreducible=True, max_only=True))), {k: v for k, v in all_12.items() if most[k] <= 0.3})
    assert ((2,), (0, 1)) in all_12 and all_12[(2,), (0, 1)] > 0.999


def test_topk_is_a_prefix(series):
    five = run_query(series, QuerySpec(left=1, right=2, query=QueryType.TOPK, k=5)).collect()
    ten = run_query(series, QuerySpec(left=1, right=2, query=QueryType.TOPK, k=10)).collect()
    assert ten[:5] == five and len(ten) == 10
    assert len(run_query(series, QuerySpec(left=1, right=1, query=QueryType.PROGRESSIVE, k=1000, tau=0.9)).collect()) == 1


def test_multipole_against_eigenvalues(data, series):
    r = np.corrcoef(data)
    for size in (2, 3, 4):
        got = found(run_query(series, QuerySpec(Measure.MULTIPOLE, size, 0, tau=0.4, max_only=True)))
        want = {(s, ()): min(1.0, 1 - np.linalg.eigvalsh(r[np.ix_(s, s)])[0]) for s in itertools.combinations(range(8), size)}
        same(got, {k: v for k, v in want.items() if v > 0.4})


def test_total_correlation(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    rows = [(i, t, float(v)) for i, x in enumerate((a, b, a ^ b)) for t, v in enumerate(x)]
    s = spark.createDataFrame(rows, "id int, t int, v double")
    got = found(run_query(s, QuerySpec(Measure.TOTAL_CORRELATION, 3, 0, tau=0.3)))
    assert got.keys() == {((0, 1, 2), ())} and abs(got[(0, 1, 2), ()] - np.log(2)) < 0.01
    assert all(abs(r["mi"]) < 0.01 for r in P.mutual_information(S.binned(s), 4000).collect())


def test_bins_of_negative_series(spark):
    s = spark.createDataFrame([(k, t, float(v)) for k, x in enumerate((range(10), range(-100, 0, 10))) for t, v in enumerate(x)], "id int, t int, v double")
    assert {(r["id"], r["bin"]) for r in S.binned(s).collect()} == {(k, b) for k in (0, 1) for b in range(10)}
    assert all(abs(r["h"] - np.log(10)) < 1e-9 for r in P.entropies(S.binned(s), 10).collect())


def test_kernels_agree(series):
    v = S.normalise(S.to_vectors(S.variance_filter(series)))
    tables = [{(r["i"], r["j"]): r["rho"] for r in P.correlations(v, k).collect()} for k in ("hof", "long", "block")]
    assert tables[0].keys() == tables[1].keys() == tables[2].keys() and len(tables[0]) == 28
    assert all(abs(tables[0][k] - t[k]) < 1e-9 for t in tables[1:] for k in tables[0])


def test_manhattan_and_chebyshev(data, series):
    u = data - data.mean(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for measure, norm in ((Measure.MANHATTAN, lambda d: np.abs(d).sum()), (Measure.CHEBYSHEV, lambda d: np.abs(d).max())):
        got = found(run_query(series, QuerySpec(measure, 1, 1, tau=0.0)))
        assert len(got) == 28 and all(abs(s - 1 / (1 + norm(u[i] - u[j]))) < 1e-9 for ((i,), (j,)), s in got.items())


def test_custom_weights_order_the_right_side(data, series):
    u = data - data.mean(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    spec = QuerySpec(left=1, right=2, tau=-2.0, weights=Weights.parse("custom(1)(1-3)"), max_only=True)
    rows = run_query(series, spec).count()
    assert rows == 8 * 7 * 6


def test_variance_filter_and_names(spark, series):
    assert {r["id"] for r in S.variance_filter(series).select("id").distinct().collect()} == set(range(8))
    nan = series.unionByName(spark.createDataFrame([(50, 0, float("nan")), (50, 1, 2.0)], "id int, t int, v double"))
    assert 50 not in {r["id"] for r in S.variance_filter(nan).select("id").distinct().collect()}
    assert sorted(r["id"] for r in S.numbered(series.where("id > 3")).select("id").distinct().collect()) == [0, 1, 2, 3, 4]


def test_set_helpers(spark):
    df = spark.createDataFrame([([3, 1], [2, 0], 0.5)], "lhs array<int>, rhs array<int>, sim double")
    assert canonical(df).first()[:2] == ([0, 2], [1, 3])
    assert df.select(subsets(F.col("lhs"))).first()[0] == [[1], [3]]
    pairs = spark.createDataFrame([(i, j, 0.1) for i, j in itertools.combinations(range(5), 2)], "i int, j int, rho double")
    for left, right, number in ((1, 1, 10), (1, 2, 30), (2, 2, 15), (3, 0, 10)):
        spec = QuerySpec(Measure.MULTIPOLE if not right else Measure.PEARSON, left, right)
        sets = pack(candidates(pairs, spec, left, right), left, right).collect()
        assert len(sets) == len({(tuple(r[0]), tuple(r[1])) for r in sets}) == number


def test_clusters_and_bounds(spark, series, data):
    v = S.normalise(S.to_vectors(S.variance_filter(series)))
    tree = C.hierarchy(v).collect()
    deepest = {}
    for r in tree:
        if r["level"] >= deepest.get(r["id"], (-1, 0))[0]:
            deepest[r["id"]] = (r["level"], r["size"])
    assert all(size == 1 for _, size in deepest.values())
    of = v.select("id", (F.col("id") % 2).alias("cluster"))
    r = np.corrcoef(data)
    for row in C.extrema(P.symmetric(P.correlations(v)), of, of).collect():
        block = [r[i, j] for i in range(8) for j in range(8) if i != j and i % 2 == row["c1"] and j % 2 == row["c2"]]
        assert abs(row["lo"] - min(block)) < 1e-9 and abs(row["hi"] - max(block)) < 1e-9
    m = np.corrcoef(data[:3])
    lo, hi = C.multipole_bounds(m - 0.05 * (1 - np.eye(3)), m + 0.05 * (1 - np.eye(3)))
    exact = 1 - np.linalg.eigvalsh(m)[0]
    assert lo <= exact <= hi
    h, pair = np.array([1.0, 0.8]), np.array([[0.0, 1.5], [1.5, 0.0]])
    lo, hi = C.total_correlation_bounds(h, h, pair, pair)
    assert lo <= 0.3 + 1e-12 and hi >= 0.3 - 1e-12
    near, far = (spark.range(1).select(x.alias("x")).first()["x"] for x in C.theoretical_bounds(F.lit(0.5), F.lit(0.1), F.lit(0.2)))
    assert near < 0.5 < far


def test_distances_and_similarities(spark):
    for measure in (Measure.PEARSON, Measure.EUCLIDEAN):
        back = spark.range(1).select(M.dist_to_sim(measure, M.sim_to_dist(measure, F.lit(0.6))).alias("x")).first()["x"]
        assert abs(back - 0.6) < 1e-9
