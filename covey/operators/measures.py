"""Similarity of sets of series as expressions over pair correlations.

A set pattern has slots l1, l2, ... and r1, r2, ...; ``pair(x, y)`` gives the column with the correlation of two slots.
For weights w and correlations rho: d(S) = sum w^2 + 2 sum w w' rho within S, n = sum w w' rho across the sides.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from covey.functions.vectors import bound
from covey.spec import DENOMINATOR_FLOOR, Measure, QuerySpec

Pair = Callable[[str, str], Column]


def slots(left: int, right: int) -> list[str]:
    return [f"l{k}" for k in range(1, left + 1)] + [f"r{k}" for k in range(1, right + 1)]


def pair_name(x: str, y: str) -> str:
    return "p_" + "_".join(sorted((x, y)))


def pair_column(x: str, y: str) -> Column:
    return F.col(pair_name(x, y))


def _sum(terms: Sequence[Column | float]) -> Column:
    out: Column | float = 0.0
    for t in terms:
        out = t + out
    return out if isinstance(out, Column) else F.lit(out)


def own_square(side: Sequence[str], weights: Sequence[float], pair: Pair) -> Column:
    return _sum([F.lit(sum(w * w for w in weights)), *(2 * weights[a] * weights[b] * pair(side[a], side[b]) for a, b in itertools.combinations(range(len(side)), 2))])


def cross(left: Sequence[str], wl: Sequence[float], right: Sequence[str], wr: Sequence[float], pair: Pair) -> Column:
    return _sum([u * w * pair(x, y) for x, u in zip(left, wl) for y, w in zip(right, wr)])


def pearson(left, wl, right, wr, pair: Pair) -> Column:
    d = [F.greatest(own_square(s, w, pair), F.lit(DENOMINATOR_FLOOR)) for s, w in ((left, wl), (right, wr))]
    return bound(cross(left, wl, right, wr, pair) / F.sqrt(d[0] * d[1]), -1.0, 1.0)


def euclidean(left, wl, right, wr, pair: Pair, length_squared: Column | float = 1.0) -> Column:
    """1 / (1 + distance of the weighted sums) of vectors with that squared length."""
    square = own_square(left, wl, pair) + own_square(right, wr, pair) - 2 * cross(left, wl, right, wr, pair)
    return 1 / (1 + F.sqrt(F.greatest(square * length_squared, F.lit(0.0))))


@pandas_udf(DoubleType())
def _least_eigenvalue_gap(flat: pd.Series) -> pd.Series:
    """1 - smallest eigenvalue of correlation matrices, from their upper triangles in row order."""
    if not len(flat):
        return pd.Series([], dtype=float)
    r = np.stack(flat.to_numpy())
    p = int((1 + np.sqrt(1 + 8 * r.shape[1])) / 2)
    m = np.tile(np.eye(p), (len(r), 1, 1))
    i, j = np.triu_indices(p, 1)
    m[:, i, j] = m[:, j, i] = r
    return pd.Series(np.clip(1 - np.linalg.eigvalsh(m)[:, 0], -1, 1))


def multipole(side: Sequence[str], pair: Pair) -> Column:
    """1 - smallest eigenvalue of the set's correlation matrix; closed forms for two and three series."""
    if len(side) == 2:
        return F.abs(pair(*side))
    if len(side) == 3:
        a, b, c = (pair(x, y) for x, y in itertools.combinations(side, 2))
        q = a * a + b * b + c * c
        # a cubic with three real roots: the smallest eigenvalue by the cosine of a third of an angle
        third = F.acos(bound(F.try_divide(a * b * c, F.pow(q / 3, F.lit(1.5))), -1.0, 1.0)) / 3
        return F.coalesce(bound(-2 * F.sqrt(q / 3) * F.cos(third + F.lit(2 * np.pi / 3)), -1.0, 1.0), F.lit(0.0))
    return _least_eigenvalue_gap(F.array(*(pair(x, y) for x, y in itertools.combinations(side, 2))))


def similarity(spec: QuerySpec, left: Sequence[str], right: Sequence[str], pair: Pair, length_squared: Column | float = 1.0) -> Column:
    wl, wr = spec.weights.of("left", len(left)), spec.weights.of("right", len(right))
    if spec.measure in (Measure.PEARSON, Measure.SPEARMAN):
        return pearson(left, wl, right, wr, pair)
    if spec.measure is Measure.EUCLIDEAN:
        return euclidean(left, wl, right, wr, pair, length_squared)
    if spec.measure is Measure.MULTIPOLE:
        return multipole(list(left) + list(right), pair)
    raise ValueError(f"{spec.measure.value} isn't a function of pair correlations")


def pair_similarity(spec: QuerySpec, rho: Column, length_squared: Column | float = 1.0) -> Column:
    """Of two single series."""
    return similarity(spec, ["x", "y"], [], lambda *_: rho) if spec.measure is Measure.MULTIPOLE else similarity(spec, ["x"], ["y"], lambda *_: rho, length_squared)


def proper_subsets(spec: QuerySpec, left: int, right: int) -> list[tuple[list[str], list[str]]]:
    """Slots of every smaller set that keeps both sides (one-sided: two series)."""
    names_l, names_r = slots(left, 0), slots(left, right)[left:]
    out = []
    if not right:
        return [(list(s), []) for n in range(2, left) for s in itertools.combinations(names_l, n)]
    for a in range(1, left + 1):
        for b in range(1, right + 1):
            if (a, b) != (left, right):
                out += [(list(x), list(y)) for x in itertools.combinations(names_l, a) for y in itertools.combinations(names_r, b)]
    return out


def subset_max(spec: QuerySpec, left: int, right: int, pair: Pair, length_squared: Column | float = 1.0) -> Column | None:
    """Largest similarity of a proper subset; with scope all_pairs also of two series of one side."""
    found = [similarity(spec, x, y, pair, length_squared) for x, y in proper_subsets(spec, left, right)]
    if spec.subset_scope == "all_pairs" and right:
        names = slots(left, right)
        found += [pair_similarity(spec, pair(x, y), length_squared) for side in (names[:left], names[left:]) for x, y in itertools.combinations(side, 2)]
    return None if not found else found[0] if len(found) == 1 else F.greatest(*found)


# --- scalar relations of the measures ------------------------------------------------------------------------------


def sim_to_dist(measure: Measure, sim: Column, length_squared: Column | float = 1.0) -> Column:
    """The distance that clustering uses: the angle of the correlation behind a pair's similarity."""
    if measure in (Measure.PEARSON, Measure.SPEARMAN, Measure.MULTIPOLE):
        return F.acos(bound(sim, -1.0, 1.0))
    if measure is Measure.EUCLIDEAN:
        d = 1 / sim - 1
        return F.acos(bound(1 - d * d / (2 * length_squared), -1.0, 1.0))
    return 1 / sim - 1


def dist_to_sim(measure: Measure, dist: Column, length_squared: Column | float = 1.0) -> Column:
    if measure in (Measure.PEARSON, Measure.SPEARMAN, Measure.MULTIPOLE):
        return F.cos(dist)
    if measure is Measure.EUCLIDEAN:
        return 1 / (1 + F.sqrt(F.greatest(2 * length_squared * (1 - F.cos(dist)), F.lit(0.0))))
    return 1 / (1 + dist)
