"""Queries that compare aggregated series themselves: measures without a pair form, and the cross-check of those with one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covey.functions import vectors as V
from covey.operators import measures as M
from covey.operators.candidates import candidates, pack
from covey.operators.pairs import distances
from covey.spec import DENOMINATOR_FLOOR, Measure, QuerySpec


def combined(columns: list[Column], weights) -> Column:
    """Weighted sum of arrays."""
    out = V.scale(columns[0], float(weights[0]))
    for c, w in zip(columns[1:], weights[1:]):
        out = V.add(out, V.scale(c, float(w)))
    return out


def vector_similarity(spec: QuerySpec, left: list[Column], right: list[Column]) -> Column:
    a = combined(left, spec.weights.of("left", len(left)))
    b = combined(right, spec.weights.of("right", len(right)))
    if spec.measure in (Measure.PEARSON, Measure.SPEARMAN):
        floor = lambda v: F.greatest(V.dot(v, v), F.lit(DENOMINATOR_FLOOR))
        return V.bound(V.dot(a, b) / F.sqrt(floor(a) * floor(b)), -1.0, 1.0)
    if spec.measure is Measure.EUCLIDEAN:
        d = V.euclidean(a, b)
        return 1 / (1 + (d * F.sqrt(F.size(a)) if spec.scale == "znorm" else d))
    if spec.measure is Measure.MANHATTAN:
        return 1 / (1 + V.l1(a, b))
    if spec.measure is Measure.CHEBYSHEV:
        return 1 / (1 + V.chebyshev(a, b))
    raise ValueError(f"{spec.measure.value} doesn't compare two vectors")


def run(vectors: DataFrame, spec: QuerySpec) -> DataFrame:
    pairs = distances(vectors, lambda a, b: F.lit(0.0), "rho")
    out = None
    for left, right in spec.patterns():
        names = M.slots(left, right)
        sets = candidates(pairs, spec, left, right).select(*names)
        for s in names:
            sets = sets.join(vectors.select(F.col("id").alias(s), F.col("x").alias(f"x_{s}")), s)
        x = lambda s: F.col(f"x_{s}")
        sets = sets.withColumn("sim", vector_similarity(spec, [x(s) for s in names[:left]], [x(s) for s in names[left:]]))
        kept = sets.where(F.col("sim") > spec.tau)
        if left + right > 2 and (spec.irreducible or spec.min_jump > 0):
            subs = [vector_similarity(spec, [x(s) for s in a], [x(s) for s in b]) for a, b in M.proper_subsets(spec, left, right)]
            sub = subs[0] if len(subs) == 1 else F.greatest(*subs)
            kept = kept.where(F.col("sim") > sub + spec.min_jump) if spec.min_jump > 0 else kept
            kept = kept.where(sub <= spec.tau) if spec.irreducible else kept
        kept = pack(kept, left, right, "sim")
        out = kept if out is None else out.unionByName(kept)
    return out
