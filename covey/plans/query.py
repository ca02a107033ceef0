"""Runs a query: series -> normalised vectors -> pairs -> candidates by pattern -> constraints -> results.

Results: (lhs, rhs, sim), sides as sorted arrays of ids.  Vectors and pairs are each computed once and written, since
every pattern and join reads them again; what follows is lazy but for a lower bound of the k best (``seed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covey.operators import measures as M
from covey.operators import pairs as P
from covey.operators import series as S
from covey.operators.candidates import candidates, pack
from covey.operators.lineage import cut
from covey.plans import pruned, tiled, vectorwise
from covey.spec import Measure, QuerySpec, QueryType, Strategy


TILED_FROM = 300  # series from which joins of three are more work than tiles
SEED_FROM = 20_000  # pairs from which a bound of the k best is worth a pass of its own
TIED = 12  # digits to which total correlations are told apart: equal ones differ by the rounding of their logarithms


def prepared(series: DataFrame, spec: QuerySpec) -> DataFrame:
    """vectors(id, x) as the measure needs them."""
    how = "rank" if spec.measure is Measure.SPEARMAN else "l2norm"
    return S.normalise(S.varying(S.to_vectors(series)).select("id", "x"), how)


def points(spec: QuerySpec, vectors: DataFrame) -> float:
    """Squared length of the vectors that a Euclidean query compares."""
    if spec.measure is Measure.EUCLIDEAN and spec.scale == "znorm":
        return float(vectors.agg(F.max(F.size("x"))).first()[0] or 1)
    return 1.0


def constrained(found: DataFrame, spec: QuerySpec, left: int, right: int, sub: Column | None) -> DataFrame:
    """Rows (.., sim) that pass the threshold, the jump over subsets, and irreducibility."""
    sim, tau = F.col("sim"), F.lit(spec.tau)
    if sub is None or left + right <= 2:
        return found.where(sim > tau)
    if spec.min_jump > 0:
        found = found.where(sim > F.greatest(tau, sub + spec.min_jump))
    else:
        found = found.where(sim > tau)
    return found.where(sub <= tau) if spec.irreducible else found


def pattern_results(pairs: DataFrame, spec: QuerySpec, left: int, right: int, length_squared: float = 1.0, least: float | None = None) -> DataFrame:
    """(lhs, rhs, sim) of one pattern from pairs; least: a known lower bound of what matters."""
    crossing = None
    if spec.irreducible and left + right > 2:
        # every pair across the sides is a subset: it must not pass the threshold itself
        crossing = M.pair_similarity(spec, F.col("rho"), length_squared) <= spec.tau
    names = M.slots(left, right)
    found = candidates(pairs, spec, left, right, crossing)
    found = found.withColumn("sim", M.similarity(spec, names[:left], names[left:], M.pair_column, length_squared))
    sub = M.subset_max(spec, left, right, M.pair_column, length_squared) if spec.irreducible or spec.min_jump > 0 else None
    found = constrained(found, spec, left, right, sub)
    if least is not None:
        found = found.where(F.col("sim") >= least)
    return pack(found, left, right, "sim")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ranked(results: DataFrame) -> list[Column]:
    return [F.col("sim").desc(), (F.size("lhs") + F.size("rhs")).asc(), F.col("lhs").asc(), F.col("rhs").asc()]


def finished(results: DataFrame, spec: QuerySpec) -> DataFrame:
    if spec.query is QueryType.THRESHOLD:
        return results
    return results.orderBy(*ranked(results)).limit(spec.k)


def seed(pairs: DataFrame, spec: QuerySpec, length_squared: float = 1.0) -> float | None:
    """A lower bound of the k-th best similarity: the k-th best among the smallest pattern and what its best sets grow to.

    Every pattern of the climb adds one series to the sets found so far; those are real sets of the query, so none below
    the k-th best of them is in the answer.
    """
    chain = spec.patterns()
    if spec.query is not QueryType.TOPK or len(chain) < 2:
        return None
    best = finished(pattern_results(pairs, spec, *chain[0], length_squared), spec)
    for left, right in chain[1:]:
        # the pairs among the series of the best sets so far: at most k * size of them
        ids = best.select(F.explode(F.concat("lhs", "rhs")).alias("id")).distinct()
        few = pairs.join(ids.withColumnRenamed("id", "i"), "i", "left_semi").join(ids.withColumnRenamed("id", "j"), "j", "left_semi")
        best = cut(finished(best.unionByName(pattern_results(few, spec, left, right, length_squared)), spec), "seed")
    first = best.agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("s")).first()
    return first["s"] if first["n"] >= spec.k else None


def run_on_pairs(pairs: DataFrame, spec: QuerySpec, length_squared: float = 1.0) -> DataFrame:
    spec = spec.normalised()
    chain = spec.patterns()
    least = seed(pairs, spec, length_squared) if spec.query is QueryType.TOPK and pairs.count() > SEED_FROM else None
    return finished(union_all([pattern_results(pairs, spec, a, b, length_squared, least) for a, b in chain]), spec)


def total_correlation(series: DataFrame, spec: QuerySpec) -> DataFrame:
    """Sum of entropies less joint entropy, for each size of the climb; subsets come from the smaller sizes' tables.

    Sets whose counts give the same value are tied exactly, and a top-k query takes them in the order of their ids.
    Pruned: joint entropies of the full size only of sets that cluster bounds let pass.
    """
    series = S.variance_filter(series)
    length = series.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    binned = cut(S.binned(series), "binned")
    one = P.entropies(binned, length)
    tables: dict[int, DataFrame] = {}
    for size in range(2, spec.left + 1):
        if spec.strategy is Strategy.PRUNED and size == spec.left and size > 2:
            sets = pruned.entropy_sets(cut(prepared(series, spec), "vectors"), one, P.joint_entropies(binned, 2, length), size, spec.tau)
            t = pruned.joint_entropies_of(binned, cut(sets, "sets"), size, length)
        else:
            t = P.joint_entropies(binned, size, length)
        total = None
        for k in range(1, size + 1):
            t = t.join(one.select(F.col("id").alias(f"s{k}"), F.col("h").alias(f"h{k}")), f"s{k}")
            total = F.col(f"h{k}") if total is None else total + F.col(f"h{k}")
        tables[size] = t.select(*[f"s{k}" for k in range(1, size + 1)], F.round(total - F.col("h"), TIED).alias("sim"))
    out = []
    for size, _ in spec.patterns():
        t, subs = tables[size], []
        if size > 2 and (spec.irreducible or spec.min_jump > 0):
            for x, _ in M.proper_subsets(spec, size, 0):
                ids = [f"s{s[1:]}" for s in x]
                name = "m_" + "_".join(ids)
                small = tables[len(ids)]
                small = small.select(*[F.col(f"s{k + 1}").alias(i) for k, i in enumerate(ids)], F.col("sim").alias(name))
                t = t.join(small, ids)
                subs.append(F.col(name))
        t = constrained(t, spec, size, 0, (subs[0] if len(subs) == 1 else F.greatest(*subs)) if subs else None)
        out.append(t.select(F.array(*[f"s{k}" for k in range(1, size + 1)]).alias("lhs"), F.array().cast(f"array<{t.schema['s1'].dataType.simpleString()}>").alias("rhs"), "sim"))
    return finished(union_all(out), spec)


def run_query(series: DataFrame, spec: QuerySpec, kernel: str | None = None) -> DataFrame:
    """(lhs, rhs, sim) of ``spec`` over series(id, t, v)."""
    spec = spec.normalised()
    if spec.measure is Measure.TOTAL_CORRELATION:
        return total_correlation(series, spec)
    if spec.measure in (Measure.MANHATTAN, Measure.CHEBYSHEV) or spec.strategy is Strategy.VECTOR:
        return finished(vectorwise.run(cut(prepared(series, spec), "vectors"), spec), spec)
    vectors = cut(prepared(series, spec), "vectors")
    length = points(spec, vectors)
    if spec.strategy is Strategy.TILED or (spec.strategy is Strategy.AUTO and tiled.suits(spec) and vectors.count() > TILED_FROM):
        return finished(tiled.run(vectors, spec), spec)
    pairs = cut(P.correlations(vectors, kernel), "pairs")
    if spec.strategy is Strategy.PRUNED:
        return finished(pruned.run(vectors, pairs, spec, length), spec)
    return run_on_pairs(pairs, spec, length)


def with_names(results: DataFrame, names: DataFrame) -> DataFrame:
    """Adds lhs_names and rhs_names, in the order of the ids, from names(id, name)."""
    keyed = results.withColumn("_row", F.struct("lhs", "rhs"))
    for side in ("lhs", "rhs"):
        looked = results.select(F.struct("lhs", "rhs").alias("_row"), F.posexplode(side).alias("pos", "id")).join(names.select("id", "name"), "id")
        looked = looked.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias(f"{side}_names"))
        keyed = keyed.join(looked, "_row", "left").withColumn(f"{side}_names", F.coalesce(f"{side}_names", F.array().cast("array<string>")))
    return keyed.drop("_row")
