"""Hierarchical leader clustering of series, and bounds between clusters.

Levels are built breadth first.  Leaders of a cluster are chosen in one small group, on at most SAMPLE of its members;
every member then goes to its nearest leader where it stands, so no task ever holds a whole cluster.  Everything is
seeded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covey.functions.vectors import bound
from covey.operators.lineage import cut
from covey.operators.pairs import stacked
from covey.spec import DENOMINATOR_FLOOR

MOST_CHILDREN, RETRIES, SHRINK, LEVELS, SAMPLE = 10, 50, 0.8, 20, 2048
FIRST_SHARE = 0.81


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def leaders(x: np.ndarray, epsilon: float, most: int, order: np.ndarray) -> np.ndarray:
    """Places of the leaders: in the given order, a point that no leader has within epsilon opens a cluster."""
    found: list[int] = []
    for p in order:
        if not found or (len(found) < most and angles(x[p : p + 1], x[found]).min() >= epsilon):
            found.append(int(p))
    return np.array(found)


def best_leaders(x: np.ndarray, epsilon: float, most: int = MOST_CHILDREN, retries: int = RETRIES, seed: int = 0) -> np.ndarray:
    """Of several random orders, the leaders of the smallest sum of radius over size."""
    rng = np.random.default_rng(seed)
    best, score = None, np.inf
    for _ in range(retries):
        lead = leaders(x, epsilon, most, rng.permutation(len(x)))
        d = angles(x, x[lead])
        of = d.argmin(axis=1)
        near = d[np.arange(len(x)), of]
        s = sum(near[of == k].max(initial=0.0) / max(1, (of == k).sum()) for k in range(len(lead)))
        if s < score:
            best, score = lead, s
    return best


def _leader_rows(epsilon_first: float, seed: int):
    """One row for each cluster: its leaders' ids and vectors, chosen on the sample that the group is."""
    def run(part):
        ids, x = np.asarray(part["id"]), stacked(part)
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        epsilon = epsilon_first if part["level"][0].as_py() == 0 else SHRINK * part["radius"][0].as_py()
        lead = best_leaders(x, epsilon, seed=seed)
        return pa.table({"cluster": part["cluster"][:1], "medoids": pa.array([ids[lead]]), "leaders": pa.array([x[lead].ravel()])})

    return run


def _nearest_rows(batches):
    """(id, parent, level, medoid, angle, was) of members (id, cluster, level, size, x, medoids, leaders)."""
    for batch in batches:
        cluster = np.asarray(batch.column("cluster"))
        x = stacked(pa.table({"x": batch.column("x")}))
        medoid, angle = np.zeros(len(cluster), np.asarray(batch.column("id")).dtype), np.zeros(len(cluster))
        for c in np.unique(cluster):
            at = np.flatnonzero(cluster == c)
            lead = np.array(batch.column("leaders")[at[0]].as_py()).reshape(-1, x.shape[1])
            d = angles(x[at], lead)
            of = d.argmin(axis=1)
            medoid[at], angle[at] = np.array(batch.column("medoids")[at[0]].as_py())[of], d[np.arange(len(at)), of]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), batch.column("level"), pa.array(medoid, batch.column("id").type), pa.array(angle), batch.column("size")], ["id", "parent", "level", "medoid", "angle", "was"])


def hierarchy(vectors: DataFrame, epsilon: float = float(np.arccos(FIRST_SHARE)), levels: int = LEVELS, seed: int = 0) -> DataFrame:
    """(id, cluster, parent, level, radius, medoid, size): every series' clusters from the root (level 0) down to itself.

    The number of levels is small; a level is a join of the members with their clusters' few leaders and an aggregation.
    A cluster that its leaders don't split (equal series), or that is left behind ``levels``, is split into its members.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    n = vectors.count()
    root = vectors.select("id", F.lit(None).cast("string").alias("parent"), F.lit("r").alias("cluster"), F.lit(0).alias("level"), F.lit(float(np.pi)).alias("radius"), F.lit(None).cast(kind).alias("medoid"), F.lit(n).cast("long").alias("size"))
    out, at = [root], root
    for level in range(levels + 1):
        todo = at.where("size > 1").select("id", "cluster", "level", "radius", "size").join(vectors.select("id", "x"), "id")
        if level == levels:
            down = todo.select("id", F.col("cluster").alias("parent"), (F.col("level") + 1).alias("level"), F.col("id").alias("medoid"), F.lit(0.0).alias("angle"), F.col("size").alias("was"))
        else:
            spread = Window.partitionBy("cluster").orderBy(F.xxhash64("id"), "id")
            sample = todo.withColumn("_n", F.row_number().over(spread)).where(F.col("_n") <= SAMPLE)
            chosen = sample.groupBy("cluster").applyInArrow(_leader_rows(epsilon, seed), f"cluster string, medoids array<{kind}>, leaders array<double>")
            near = todo.join(chosen, "cluster").select("id", "cluster", (F.col("level") + 1).alias("level"), "size", "x", "medoids", "leaders")
            down = near.mapInArrow(_nearest_rows, f"id {kind}, parent string, level int, medoid {kind}, angle double, was long")
        down = cut(down, "nearest")
        if not down.limit(1).count():
            break
        sizes = down.groupBy("parent", "medoid").agg(F.count(F.lit(1)).alias("size"), F.max("angle").alias("radius"))
        down = down.join(sizes, ["parent", "medoid"])
        alone = F.col("size") == F.col("was")
        own = F.when(alone, F.col("id")).otherwise(F.col("medoid"))
        down = down.select("id", "parent", F.concat_ws(".", "parent", own.cast("string")).alias("cluster"), "level", F.when(alone, 0.0).otherwise(F.col("radius")).alias("radius"), own.alias("medoid"), F.when(alone, F.lit(1).cast("long")).otherwise(F.col("size")).alias("size"))
        at = cut(down, "level")
        out.append(at)
    result = out[0]
    for f in out[1:]:
        result = result.unionByName(f)
    return result


def geometric_radius(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, radius): largest angle of a member to the mean direction of its cluster."""
    long = members.select("id", "cluster").join(vectors, "id").select("id", "cluster", F.posexplode("x").alias("t", "v"))
    center = long.groupBy("cluster", "t").agg(F.avg("v").alias("c"))
    norm = center.groupBy("cluster").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    dots = long.join(center, ["cluster", "t"]).groupBy("cluster", "id").agg(F.sum(F.col("v") * F.col("c")).alias("d"))
    angle = F.acos(bound(F.try_divide("d", "n"), -1.0, 1.0))
    return dots.join(norm, "cluster").groupBy("cluster").agg(F.max(angle).alias("radius"))


def value_bounds(members: DataFrame, values: DataFrame) -> DataFrame:
    """(cluster, lo, hi) of a value of each member (entropy, norm), values(id, h)."""
    return members.join(values, "id").groupBy("cluster").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))


def extrema(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(c1, c2, lo, hi, lo_pair, hi_pair) of the correlations between members of two clusters.

    pairs: symmetric (i, j, rho); a, b: (id, cluster) of the clusters on either side.
    """
    joined = pairs.join(a.select(F.col("id").alias("i"), F.col("cluster").alias("c1")), "i").join(b.select(F.col("id").alias("j"), F.col("cluster").alias("c2")), "j")
    at = F.struct("i", "j")
    return joined.groupBy("c1", "c2").agg(F.min("rho").alias("lo"), F.max("rho").alias("hi"), F.min_by(at, "rho").alias("lo_pair"), F.max_by(at, "rho").alias("hi_pair"))


def theoretical_bounds(center: Column, r1: Column, r2: Column) -> tuple[Column, Column]:
    """Correlation bounds from the centers' correlation and the radii (angles)."""
    angle = F.acos(bound(center, -1.0, 1.0))
    pi = F.lit(float(np.pi))
    return F.cos(F.least(angle + r1 + r2, pi)), F.cos(F.greatest(angle - r1 - r2, F.lit(0.0)))


def pearson_bounds(n: tuple[Column, Column], dl: tuple[Column, Column], dr: tuple[Column, Column]) -> tuple[Column, Column]:
    """Bounds of n / sqrt(dl dr) from bounds of its parts: a positive numerator is smallest over the largest denominator."""
    small = F.sqrt(F.greatest(dl[0], F.lit(DENOMINATOR_FLOOR)) * F.greatest(dr[0], F.lit(DENOMINATOR_FLOOR)))
    large = F.sqrt(F.greatest(dl[1], F.lit(DENOMINATOR_FLOOR)) * F.greatest(dr[1], F.lit(DENOMINATOR_FLOOR)))
    lo = F.when(n[0] >= 0, n[0] / large).otherwise(n[0] / small)
    hi = F.when(n[1] >= 0, n[1] / small).otherwise(n[1] / large)
    return bound(lo, -1.0, 1.0), bound(hi, -1.0, 1.0)


def euclidean_bounds(n: tuple[Column, Column], dl: tuple[Column, Column], dr: tuple[Column, Column], length_squared: float = 1.0) -> tuple[Column, Column]:
    """Bounds of 1 / (1 + sqrt(dl + dr - 2 n)), which falls with the distance."""
    far = F.sqrt(F.greatest((dl[1] + dr[1] - 2 * n[0]) * length_squared, F.lit(0.0)))
    near = F.sqrt(F.greatest((dl[0] + dr[0] - 2 * n[1]) * length_squared, F.lit(0.0)))
    return 1 / (1 + far), 1 / (1 + near)


def multipole_bounds(lo: np.ndarray, hi: np.ndarray) -> tuple[float, float]:
    """From element-wise bounds of a correlation matrix: the middle's smallest eigenvalue, give or take half the slack's spectral norm."""
    mid, slack = (lo + hi) / 2, (hi - lo) / 2
    least, width = np.linalg.eigvalsh(mid)[0], np.linalg.norm(slack, 2)
    return float(np.clip(1 - (least + width), -1, 1)), float(np.clip(1 - (least - width), -1, 1))


def total_correlation_bounds(h_lo: np.ndarray, h_hi: np.ndarray, pair_lo: np.ndarray, pair_hi: np.ndarray) -> tuple[float, float]:
    """From bounds of single entropies and of pairs' joint entropies.

    The joint entropy is at least that of its largest pair or single, and at most what a chain of conditional
    entropies H(k | some earlier one) adds up to, taken greedily.
    """
    p = len(h_lo)
    off = ~np.eye(p, dtype=bool)
    joint_lo = max(h_lo.max(), pair_lo[off].max() if p > 1 else 0.0)
    used, left = [int(np.argmin(h_hi))], set(range(p))
    left.discard(used[0])
    joint_hi = h_hi[used[0]]
    while left:
        cost = {k: min([h_hi[k], *(pair_hi[k, u] - h_lo[u] for u in used)]) for k in left}
        k = min(cost, key=cost.get)
        joint_hi += max(0.0, cost[k])
        used.append(k)
        left.discard(k)
    return float(max(0.0, h_lo.sum() - joint_hi)), float(h_hi.sum() - joint_lo)
