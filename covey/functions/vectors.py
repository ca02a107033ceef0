"""Vector functions on ARRAY<DOUBLE> columns.  Empty arrays give null where a mean or a norm has no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def log2(x: Column) -> Column:
    return F.log2(x)


def bound(x: Column, lo: float, hi: float) -> Column:
    """Clamped; null stays null, which least and greatest alone would skip."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(v: Column, s) -> Column:
    return F.transform(v, lambda x: x * s)


def sadd(v: Column, s) -> Column:
    return F.transform(v, lambda x: x + s)


def div(v: Column, s) -> Column:
    return F.transform(v, lambda x: F.try_divide(x, F.lit(s) if not isinstance(s, Column) else s))


def total(v: Column) -> Column:
    return _total(v)


def avg(v: Column) -> Column:
    return F.try_divide(_total(v), F.size(v))


def var(v: Column) -> Column:
    """Population variance, mean of squares less squared mean, not below 0."""
    return F.greatest(F.try_divide(_total(F.transform(v, lambda x: x * x)), F.size(v)) - F.pow(avg(v), 2), F.lit(0.0))


def std(v: Column) -> Column:
    return F.sqrt(var(v))


def minimum(v: Column) -> Column:
    return F.array_min(v)


def maximum(v: Column) -> Column:
    return F.array_max(v)


def mad(v: Column) -> Column:
    """Mean absolute deviation from the mean."""
    return F.aggregate(F.array(avg(v)), F.lit(None).cast("double"), lambda _, m: F.try_divide(_total(F.transform(v, lambda x: F.abs(x - m))), F.size(v)))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def l2(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l1(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def euclidean_squared(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(euclidean_squared(a, b))


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(_total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def matrix_vector(v: Column, m: Column) -> Column:
    """m: ARRAY<ARRAY<DOUBLE>> by rows; one dot product a row."""
    return F.transform(m, lambda row: dot(v, row))


def transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(m[0])), lambda k: F.transform(m, lambda row: F.element_at(row, k)))


def argsort(v: Column) -> Column:
    """Positions (from 0) in the order of their values, ties by position."""
    pairs = F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def ranks(v: Column) -> Column:
    """Ranks from 1, ties with their average."""
    def rank(x):
        below = F.size(F.filter(v, lambda y: y < x))
        same = F.size(F.filter(v, lambda y: y == x))
        return below + (same + F.lit(1)) / F.lit(2.0)

    return F.transform(v, rank)


def znorm(v: Column) -> Column:
    """(x - mean) / std with the variance kept at 1e-16 or more."""
    with_stats = F.array(F.struct(avg(v).alias("m"), F.sqrt(F.greatest(var(v), F.lit(1e-16))).alias("s")))
    return F.aggregate(with_stats, v, lambda _, t: F.transform(v, lambda x: (x - t["m"]) / t["s"]))


def l2norm(v: Column) -> Column:
    """Mean taken off, length 1; null for a constant series."""
    centred = F.aggregate(F.array(avg(v)), v, lambda _, m: F.transform(v, lambda x: x - m))
    return F.aggregate(F.array(l2(centred)), centred, lambda c, n: F.when(n > 0, F.transform(c, lambda x: x / n)))


def unit(v: Column) -> Column:
    return F.aggregate(F.array(l2(v)), v, lambda _, n: F.when(n > 0, F.transform(v, lambda x: x / n)))


def angle(a: Column, b: Column) -> Column:
    """Between unit vectors."""
    return F.acos(bound(dot(a, b), -1.0, 1.0))


def angle_full(a: Column, b: Column) -> Column:
    return F.acos(bound(F.try_divide(dot(a, b), l2(a) * l2(b)), -1.0, 1.0))


def l2_normalised_angle(a: Column, b: Column) -> Column:
    return angle(a, b)


def z_normalised_angle(a: Column, b: Column) -> Column:
    """Between z-normalised vectors, whose length is the root of their number of points."""
    return F.acos(bound(F.try_divide(dot(a, b), F.size(a)), -1.0, 1.0))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; 0 where one is constant."""
    n = F.size(a)
    cov = F.try_divide(dot(a, b), n) - avg(a) * avg(b)
    return F.coalesce(bound(F.try_divide(cov, std(a) * std(b)), -1.0, 1.0), F.lit(0.0))


def pearson_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from running sums; null where one side has no variance."""
    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when(spread > 0, bound((n * sxy - sx * sy) / F.sqrt(spread), -1.0, 1.0))


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def covariance(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.size(a)) - avg(a) * avg(b)


# --- relations between measures, and unit conversions ---------------------------------------------------------------


def correlation_from_euclidean(d: Column, points) -> Column:
    """Of z-normalised vectors of that many points."""
    return 1 - d * d / (2 * points)


def euclidean_from_correlation(r: Column, points) -> Column:
    return F.sqrt(2 * points * (1 - r))


def correlation_of_one_with_two(r12: Column, r13: Column, r23: Column) -> Column:
    """Of series 1 with the sum of 2 and 3."""
    return F.try_divide(r12 + r13, F.sqrt(2 + 2 * r23))


def correlation_of_two_with_two(r13: Column, r14: Column, r23: Column, r24: Column, r12: Column, r34: Column) -> Column:
    """Of the sum of 1 and 2 with the sum of 3 and 4."""
    return F.try_divide(r13 + r14 + r23 + r24, F.sqrt((2 + 2 * r12) * (2 + 2 * r34)))


def angle_over_normalised(a: Column, b: Column) -> Column:
    """Angle of z-normalised vectors; what is a right angle or more is taken back by one."""
    x = z_normalised_angle(a, b)
    return F.when(x >= F.lit(3.141592653589793 / 2), x - F.lit(3.141592653589793 / 2)).otherwise(x)


def fahrenheit_to_celsius(x: Column) -> Column:
    return (x - 32) * 5 / 9


def celsius_to_kelvin(x: Column) -> Column:
    return x + 273.15
