import numpy as np
import pytest

from covey.llm import ann, embedding_dedup as e
from covey.llm.common import Scratch
from covey.llm.components import connected_components


def test_bounds_are_rigorous():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 40)) * rng.lognormal(0, 3, (300, 1))
    q = e.Quantised(x)
    exact = q.unit @ q.unit.T
    approx = (q.q.astype(float) @ q.q.astype(float).T) * q.scale[:, None] * q.scale[None, :]
    assert (np.abs(exact - approx) <= q.error[:, None] + (1 + q.error)[:, None] * q.error[None, :]).all()
    for t in (0.1, 0.3):
        assert (e.possible(q, q, t) | (exact < t)).all()


def links(x, t=0.9):
    ok = np.array([v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x])
    out = np.zeros((len(x), len(x)), bool)
    for i in np.flatnonzero(ok):
        for j in np.flatnonzero(ok):
            if i != j and len(x[i]) == len(x[j]):
                a, b = np.array(x[i], float), np.array(x[j], float)
                out[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= t
    return out


@pytest.mark.parametrize("tiles", [1, 3])
def test_links_and_components(spark, tiles):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16)).astype(np.float32)
    x = [list(map(float, v)) for v in base]
    x += [list(map(float, base[k % 4] + rng.normal(size=16).astype(np.float32) * s)) for k in range(40) for s in (0.05, 0.35)]
    x += [x[0], x[0], [0.0] * 16, None, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [], [1.0, 0.0], [2.0, 0.0], [v * 3 for v in x[1]]]
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, x int")
    x = [None if r["embedding"] is None else r["embedding"] for r in df.orderBy("vec_id").collect()]
    link = links(x)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[link[i]]]) for i in range(len(x))])
    got = {r["vec_id"]: r for r in e.link_vectors(df, tiles=tiles).collect()}
    assert len(got) == len(x)
    for k in range(len(x)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (link[k].sum(), label[k], label[k] == k)


def test_repeated_rows_and_empty(spark):
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in e.link_vectors(twice).collect()) == [(0, 0), (1, 1), (1, 1)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert e.link_vectors(none).count() == 0
    from pyspark.sql import functions as F

    assert ann.nearest_neighbours(none, F.col("vec_id") % 50 == 0).count() == 0


def test_rows_of_one_id_with_different_vectors_stay_apart(spark):
    """Links are between vectors: an id's two vectors have links and components of their own, named by the smallest id."""
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01]), (0, [0.0, 0.0, 1.0]), (0, [0.0, 1.0, 0.02])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in e.link_vectors(df).collect())
    assert got == [(0, 0, 0, True), (0, 2, 0, True), (1, 1, 1, True), (1, 2, 0, False), (2, 1, 1, False), (3, 2, 0, False)]


def test_components_of_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(30)] + [(100, 200 + k) for k in range(20)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(path, "a long, b long"), Scratch(spark, "c")).collect()}
    assert all(got[k] == 0 for k in range(31)) and all(got[200 + k] == 100 for k in range(20))


def exact(ids, x, every, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = u @ u[q]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[q]][:k]
        out[ids[q]] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_and_order(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = exact(ids, x, ann.EVERY)
    got: dict = {}
    for r in ann.op7_ann(spark, small).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert all(s == sorted(s, key=lambda p: (-p[1], p[0])) for s in got.values())


def offline(x, every, k=5):
    """(lists, recall, share of the table compared with a query) of the index without Spark."""
    u, n = ann.unit(x), len(x)
    some = u[np.random.default_rng(0).permutation(n)[: max(4096, ann.A_LIST_SAMPLE * ann.number_of_lists(n))]]
    index = ann.Index(ann.balanced_centroids(some, ann.number_of_lists(n))).calibrated(some, k)
    row, at, home = index.lists_of(u)
    index.size = np.bincount(at[at == home], minlength=len(index.c))
    q = np.arange(0, n, every)
    r, lists, limit = index.search(u[q], 4 * k)
    s = u[q] @ u.T
    s[np.arange(len(q)), q] = -np.inf
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    hits = compared = 0
    for i in range(len(q)):
        found: set = set()
        outside = ann.apart(u[q[i] : q[i] + 1], index.c)[0] > limit[i]
        for a in lists[r == i]:
            here = at == a
            found.update(row[here & ((home == a) | outside[home])])
            compared += (here & ((home == a) | outside[home])).sum()
        hits += len(found & set(near[i]))
    return len(index.c), hits / len(q) / k, compared / len(q) / n


@pytest.mark.parametrize("clusters, spread, least_lists", [(300, 0.4, 100), (60, 0.7, 100), (30, 0.4, 50), (20, 0.5, 30), (12, 0.5, 20)])
def test_recall_and_share_compared(clusters, spread, least_lists):
    rng = np.random.default_rng(clusters)
    n = 4 * least_lists * least_lists // clusters
    x = rng.normal(size=(clusters, 24)).repeat(n, axis=0)
    lists, recall, share = offline(x + rng.normal(size=x.shape) * spread, len(x) // 100)
    assert lists >= least_lists and recall >= 0.9 and share < 1 / 3


def test_unstructured_vectors_cost_no_more_than_all(spark):
    x = np.random.default_rng(2).normal(size=(3000, 48))
    _, recall, share = offline(x, 50)
    assert recall >= 0.9 and share <= 1


def test_two_dimensions_ids_and_large_components(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 2.0]), (1, [1e200, 2e200]), (2, [2.0, 1.0]), (3, [1.0, 2.0, 3.0]), (50, [1e-200, 1e-200, 0.0]), (4, [5.0, 5.0, 0.0]), (4, [0.0, 0.0, 1.0]), (None, [1.0, 2.0]), (0, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    # of the two vectors of vec_id 4 the smaller bytes count: (0, 0, 1)
    want = [(0, 1, 1, 1.0), (0, 2, 2, 0.8), (50, 1, 3, 3 / np.sqrt(28)), (50, 2, 4, 0.0)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_many_lists(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(size=(40, 24)).repeat(60, axis=0) + rng.normal(size=(2400, 24)) * 0.4, np.tile(rng.normal(size=24), (700, 1))]
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    got: dict = {}
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = exact(ids, x, 50)
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    copies = [q for q in want if q >= 2400]
    assert all([got[q][k][0] for k in range(1, 6)] == [v for v, _ in want[q]] for q in copies)  # ties to smaller ids


def test_fewer_candidates_than_asked(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest_neighbours(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
