import numpy as np
import pytest
from pyspark.sql import functions as F

from covey.functions import vectors as V

A, B = np.array([3.0, 1.0, 4.0, 1.0, 5.0]), np.array([2.0, 7.0, 1.0, 8.0, 2.0])


def value(spark, column):
    return spark.createDataFrame([(A.tolist(), B.tolist())], "a array<double>, b array<double>").select(column.alias("x")).first()["x"]


a, b = (lambda: F.col("a")), (lambda: F.col("b"))

CASES = {
    "add": (lambda: V.add(a(), b()), A + B), "sub": (lambda: V.sub(a(), b()), A - B), "scale": (lambda: V.scale(a(), 2.0), A * 2), "sadd": (lambda: V.sadd(a(), 2.0), A + 2), "div": (lambda: V.div(a(), 2.0), A / 2),
    "avg": (lambda: V.avg(a()), A.mean()), "var": (lambda: V.var(a()), A.var()), "std": (lambda: V.std(a()), A.std()), "min": (lambda: V.minimum(a()), 1.0), "max": (lambda: V.maximum(a()), 5.0),
    "mad": (lambda: V.mad(a()), np.abs(A - A.mean()).mean()), "dot": (lambda: V.dot(a(), b()), A @ B), "l2": (lambda: V.l2(a()), np.linalg.norm(A)), "l1": (lambda: V.l1(a(), b()), np.abs(A - B).sum()),
    "euclidean": (lambda: V.euclidean(a(), b()), np.linalg.norm(A - B)), "minkowski": (lambda: V.minkowski(a(), b(), 3.0), (np.abs(A - B) ** 3).sum() ** (1 / 3)), "chebyshev": (lambda: V.chebyshev(a(), b()), np.abs(A - B).max()),
    "argsort": (lambda: V.argsort(a()), np.argsort(A, kind="stable")), "ranks": (lambda: V.ranks(a()), [3, 1.5, 4, 1.5, 5]), "znorm": (lambda: V.znorm(a()), (A - A.mean()) / A.std()),
    "l2norm": (lambda: V.l2norm(a()), (A - A.mean()) / np.linalg.norm(A - A.mean())), "pearson": (lambda: V.pearson(a(), b()), np.corrcoef(A, B)[0, 1]), "covariance": (lambda: V.covariance(a(), b()), np.cov(A, B, bias=True)[0, 1]),
    "angle_full": (lambda: V.angle_full(a(), b()), np.arccos(A @ B / np.linalg.norm(A) / np.linalg.norm(B))), "concat": (lambda: V.concat(a(), b()), np.r_[A, B]), "matrix_vector": (lambda: V.matrix_vector(a(), F.array(a(), b())), [A @ A, A @ B]),
    "angle": (lambda: V.angle(V.l2norm(a()), V.l2norm(b())), np.arccos(np.corrcoef(A, B)[0, 1])), "z_angle": (lambda: V.z_normalised_angle(V.znorm(a()), V.znorm(b())), np.arccos(np.corrcoef(A, B)[0, 1])),
    "celsius": (lambda: V.fahrenheit_to_celsius(F.lit(212.0)), 100.0), "kelvin": (lambda: V.celsius_to_kelvin(F.lit(0.0)), 273.15), "log2": (lambda: V.log2(F.lit(8.0)), 3.0),
}


@pytest.mark.parametrize("name", CASES)
def test_against_numpy(spark, name):
    column, want = CASES[name]
    assert np.allclose(np.asarray(value(spark, column()), float), np.asarray(want, float), atol=1e-9)


def test_transpose_and_relations(spark):
    assert value(spark, V.transpose(F.array(a(), b()))) == [[x, y] for x, y in zip(A, B)]
    d = value(spark, V.euclidean(V.znorm(a()), V.znorm(b())))
    assert np.isclose(value(spark, V.correlation_from_euclidean(F.lit(d), 5)), np.corrcoef(A, B)[0, 1])
    assert np.isclose(value(spark, V.euclidean_from_correlation(F.lit(np.corrcoef(A, B)[0, 1]), 5)), d)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4, 50))
    r = np.corrcoef(x)
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    one_two = value(spark, V.correlation_of_one_with_two(F.lit(r[0, 1]), F.lit(r[0, 2]), F.lit(r[1, 2])))
    two_two = value(spark, V.correlation_of_two_with_two(*(F.lit(float(v)) for v in (r[0, 2], r[0, 3], r[1, 2], r[1, 3], r[0, 1], r[2, 3]))))
    assert np.isclose(one_two, np.corrcoef(z[0], z[1] + z[2])[0, 1]) and np.isclose(two_two, np.corrcoef(z[0] + z[1], z[2] + z[3])[0, 1])


def test_constant_and_empty(spark):
    df = spark.createDataFrame([([2.0, 2.0],), ([],)], "v array<double>")
    rows = df.select(V.l2norm(F.col("v")).alias("n"), V.avg(F.col("v")).alias("m"), V.pearson(F.col("v"), F.col("v")).alias("r")).collect()
    assert rows[0]["n"] is None and rows[0]["r"] == 0.0 and rows[1]["m"] is None
