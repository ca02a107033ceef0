"""Branch and bound over combinations of clusters, a round of DataFrame operations a level.

A combination names a cluster for each slot.  Its bounds follow from the extreme correlations between the clusters'
members.  A combination whose upper bound doesn't pass the threshold is dropped with all it stands for; the others are
split into their clusters' children, all slots at once, until every cluster is one series and bounds are exact.  The
number of rounds is the number of levels.  Results equal those of the exhaustive plan.
"""

from __future__ import annotations

import itertools
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from covey.operators import clustering as C
from covey.operators import measures as M
from covey.operators.candidates import ordering, pack
from covey.operators.lineage import cut
from covey.operators.pairs import entropy_of_counts, symmetric
from covey.spec import Measure, QuerySpec


@pandas_udf(ArrayType(DoubleType()))
def _eigen_bounds(lo: pd.Series, hi: pd.Series) -> pd.Series:
    """Multipole bounds of matrices whose upper triangles, in row order, lie between lo and hi."""
    return pd.Series([list(C.multipole_bounds(*(_matrix(v) for v in pair))) for pair in zip(lo, hi)])


def _matrix(upper) -> np.ndarray:
    p = int((1 + np.sqrt(1 + 8 * len(upper))) / 2)
    out = np.eye(p)
    out[np.triu_indices(p, 1)] = upper
    return out + out.T - np.eye(p)


@pandas_udf(DoubleType())
def _entropy_bound(h_lo: pd.Series, h_hi: pd.Series, pair_lo: pd.Series, pair_hi: pd.Series) -> pd.Series:
    """Upper bounds of total correlation from bounds of single and of pairs' joint entropies."""
    return pd.Series([C.total_correlation_bounds(np.array(a), np.array(b), _matrix(c), _matrix(e))[1] for a, b, c, e in zip(h_lo, h_hi, pair_lo, pair_hi)])


def set_bounds(spec: QuerySpec, left: int, right: int, lo, hi, length_squared: float = 1.0) -> tuple[Column, Column]:
    """Bounds of a combination; lo(x, y), hi(x, y): bounds of the correlation between two slots' clusters."""
    names = M.slots(left, right)
    wl, wr = spec.weights.of("left", left), spec.weights.of("right", right)
    if spec.measure is Measure.MULTIPOLE:
        # |1 - smallest eigenvalue| of a correlation matrix is at most the largest row sum of absolute correlations
        most = {frozenset(p): F.greatest(F.abs(lo(*p)), F.abs(hi(*p))) for p in itertools.combinations(names, 2)}
        rows = [sum((most[frozenset((x, y))] for y in names if y != x), F.lit(0.0)) for x in names]
        upper = F.least(rows[0] if len(rows) == 1 else F.greatest(*rows), F.lit(1.0))
        if len(names) < 3:
            return F.lit(0.0), upper
        eigen = _eigen_bounds(F.array(*(lo(*p) for p in itertools.combinations(names, 2))), F.array(*(hi(*p) for p in itertools.combinations(names, 2))))
        return F.greatest(eigen[0], F.lit(0.0)), F.least(eigen[1], upper)
    parts = []
    for pair in (lo, hi):
        parts.append((M.cross(names[:left], wl, names[left:], wr, pair), M.own_square(names[:left], wl, pair), M.own_square(names[left:], wr, pair)))
    n, dl, dr = zip(*parts)
    return C.pearson_bounds(n, dl, dr) if spec.measure is not Measure.EUCLIDEAN else C.euclidean_bounds(n, dl, dr, length_squared)


def _levels(tree: DataFrame) -> tuple[DataFrame, int]:
    """(id, level, cluster) at every level; a series that is alone keeps its cluster further down."""
    deepest = tree.agg(F.max("level")).first()[0] or 0
    own = tree.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("level", "cluster"))).alias("path"))
    steps = own.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(deepest)), lambda k: F.element_at("path", F.least(k + 1, F.size("path")))["cluster"])).alias("level", "cluster"))
    return steps, deepest


def survivors(both: DataFrame, steps: DataFrame, deepest: int, names: list[str], upper, least: float, singles: DataFrame | None = None) -> DataFrame:
    """(slots...: series) of the combinations whose upper bound passes at every level.

    both: symmetric values (i, j, rho) of pairs; upper(at): the bound's column, at("lo" or "hi")(x, y) the extreme value of
    two slots' clusters; singles: values (id, h) of series, whose extremes are columns h_lo_x and h_hi_x.
    """
    alive: DataFrame | None = None
    for level in range(deepest + 1):
        here = steps.where(F.col("level") == level).select("id", "cluster")
        ext = cut(C.extrema(both, here, here).select("c1", "c2", "lo", "hi"), "extrema")
        if alive is None:
            alive = here.select("cluster").distinct().select(*[F.col("cluster").alias(s) for s in names])  # the root alone
        else:
            above = steps.where(F.col("level") == level - 1).select("id", F.col("cluster").alias("up"))
            down = above.join(here, "id").select("up", "cluster").distinct()
            for s in names:
                alive = alive.join(down.select(F.col("up").alias(s), F.col("cluster").alias(f"_{s}")), s).drop(s).withColumnRenamed(f"_{s}", s)
        for x, y in itertools.combinations(names, 2):
            alive = alive.join(ext.select(F.col("c1").alias(x), F.col("c2").alias(y), F.col("lo").alias(f"lo_{x}_{y}"), F.col("hi").alias(f"hi_{x}_{y}")), [x, y])
        if singles is not None:
            own = C.value_bounds(here, singles)
            for s in names:
                alive = alive.join(own.select(F.col("cluster").alias(s), F.col("lo").alias(f"h_lo_{s}"), F.col("hi").alias(f"h_hi_{s}")), s)
        at = lambda tag: lambda x, y: F.col(f"{tag}_{x}_{y}" if names.index(x) < names.index(y) else f"{tag}_{y}_{x}")
        # a margin for rounding: sets at the threshold itself are judged exactly at the end
        alive = cut(alive.where(upper(at) >= least - 1e-9).select(*names), "alive")
        if not alive.limit(1).count():
            break
    alone = steps.where(F.col("level") == deepest).select("id", "cluster")
    for s in names:
        alive = alive.join(alone.select(F.col("cluster").alias(s), F.col("id").alias(f"_{s}")), s).drop(s).withColumnRenamed(f"_{s}", s)
    return alive


def pattern(pairs: DataFrame, steps: DataFrame, deepest: int, spec: QuerySpec, left: int, right: int, least: float, length_squared: float = 1.0) -> DataFrame:
    names = M.slots(left, right)
    both = symmetric(pairs)
    def upper(at) -> Column:
        lo, hi = set_bounds(spec, left, right, at("lo"), at("hi"), length_squared)
        return hi if spec.shrink == 1 else lo + (hi - lo) * spec.shrink

    alive = survivors(both, steps, deepest, names, upper, least)
    for x, y in ordering(spec, left, right):
        alive = alive.where(F.col(x) < F.col(y))
    for x, y in itertools.combinations(names, 2):
        alive = alive.join(both.select(F.col("i").alias(x), F.col("j").alias(y), F.col("rho").alias(M.pair_name(x, y))), [x, y])
    return alive


def joint_entropies_of(binned: DataFrame, sets: DataFrame, size: int, points: int) -> DataFrame:
    """(s1..sp, h) of the listed sets alone."""
    ids = [f"s{k}" for k in range(1, size + 1)]
    out = sets.join(binned.select(F.col("id").alias("s1"), "t", F.col("bin").alias("b1")), "s1")
    for k in range(2, size + 1):
        out = out.join(binned.select(F.col("id").alias(f"s{k}"), "t", F.col("bin").alias(f"b{k}")), [f"s{k}", "t"])
    return out.groupBy(*ids, *[f"b{k}" for k in range(1, size + 1)]).agg(F.count(F.lit(1)).alias("n")).groupBy(*ids).agg(entropy_of_counts(points))


def entropy_sets(vectors: DataFrame, one: DataFrame, two: DataFrame, size: int, least: float) -> DataFrame:
    """(s1..sp), ids ascending, of the sets whose total correlation may pass; one (id, h), two (s1, s2, h)."""
    names = [f"s{k}" for k in range(1, size + 1)]
    steps, deepest = _levels(C.hierarchy(vectors))
    both = symmetric(two.select(F.col("s1").alias("i"), F.col("s2").alias("j"), F.col("h").alias("rho")))
    # a series with itself has its own entropy: clusters of one series must not lose their bound
    both = both.unionByName(one.select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("h").alias("rho")))

    def upper(at):
        pairs = list(itertools.combinations(names, 2))
        return _entropy_bound(F.array(*[F.col(f"h_lo_{s}") for s in names]), F.array(*[F.col(f"h_hi_{s}") for s in names]), F.array(*[at("lo")(*p) for p in pairs]), F.array(*[at("hi")(*p) for p in pairs]))

    alive = survivors(cut(both, "pairs"), cut(steps, "steps"), deepest, names, upper, least, cut(one, "entropies"))
    for a, b in zip(names, names[1:]):
        alive = alive.where(F.col(a) < F.col(b))
    return alive


def run(vectors: DataFrame, pairs: DataFrame, spec: QuerySpec, length_squared: float = 1.0) -> DataFrame:
    """A top-k query is pruned by the k-th best of the sets that grow from the best pairs, found beforehand."""
    from covey.plans.query import constrained, seed

    if not spec.measure.from_pairs:
        raise ValueError("pruning needs a measure of pair correlations")
    pairs = cut(pairs, "pairs")
    steps, deepest = _levels(C.hierarchy(vectors))
    steps = cut(steps, "steps")
    least = seed(pairs, spec, length_squared)
    least = spec.tau if least is None else max(spec.tau, least)

    def passed(spec: QuerySpec) -> DataFrame:
        out = None
        for left, right in spec.patterns():
            found = _results(left, right, spec)
            out = found if out is None else out.unionByName(found)
        return out

    def _results(left: int, right: int, spec: QuerySpec) -> DataFrame:
        names = M.slots(left, right)
        found = pattern(pairs, steps, deepest, spec, left, right, least, length_squared).withColumn("sim", M.similarity(spec, names[:left], names[left:], M.pair_column, length_squared))
        sub = M.subset_max(spec, left, right, M.pair_column, length_squared) if spec.irreducible or spec.min_jump > 0 else None
        return pack(constrained(found, spec, left, right, sub), left, right, "sim")

    if spec.shrink < 1:
        # any k will do: combinations that only just might pass are postponed, and looked at if the others don't give k
        first = cut(passed(spec), "first")
        if first.count() >= spec.k:
            return first
    return passed(replace(spec, shrink=1.0))
