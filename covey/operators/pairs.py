"""Pairwise tables: pairs(i, j, rho) over i < j, other distances, and entropies.

Three kernels give the same correlations: ``hof`` (array functions in codegen), ``long`` (join on t and sums) and
``block`` (numpy tiles by mapInPandas over pairs of blocks).  The default follows the amount of work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covey.functions import vectors as V
from covey.operators import series as S

HOF_WORK = 1e6  # products up to which the array kernel is used
BLOCK = 512  # series on one side of a tile of products
SENT = 32 << 20  # bytes of vectors in a block: a task holds two blocks and one tile of products
JOIN_BLOCK = 64  # series on one side of a block of the pair join
UNITS = 1 << 52  # terms of an entropy are summed as whole numbers of this part


def numbered_blocks(n: int, size: int, tasks: int) -> int:
    """Blocks of n series: of at most ``size``, and enough for their pairs to keep ``tasks`` cores busy."""
    return max(1, math.ceil(n / size), min(math.ceil(n / 16), math.ceil(math.sqrt(2 * tasks))))


def sendable(points: int) -> int:
    """Vectors of that many points in a block of ``SENT`` bytes, so that every vector is sent to few tasks."""
    return max(BLOCK, SENT // (8 * points + 32))


def cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def _pair_join(vectors: DataFrame) -> DataFrame:
    """All pairs i < j by pairs of blocks, as many as the series need: an equi-join and not a product."""
    m = numbered_blocks(vectors.count(), JOIN_BLOCK, cores(vectors))
    own = F.pmod(F.hash("id"), F.lit(m))
    to = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = vectors.select(F.col("id").alias("i"), F.col("x").alias("a"), own.alias("bi"), to.alias("bj"))
    right = vectors.select(F.col("id").alias("j"), F.col("x").alias("b"), own.alias("bj"), to.alias("bi"))
    return left.join(right, ["bi", "bj"]).where("i < j")


def distances(vectors: DataFrame, by, name: str = "d") -> DataFrame:
    """(i, j, name) with ``by(a, b)`` of every pair's arrays."""
    return _pair_join(vectors).select("i", "j", by(F.col("a"), F.col("b")).alias(name))


def correlations(vectors: DataFrame, kernel: str | None = None) -> DataFrame:
    """pairs(i, j, rho), i < j, of normalised vectors (see ``series.normalise``)."""
    if kernel is None:
        size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("m")).first()
        kernel = "hof" if (size["n"] or 0) ** 2 / 2 * (size["m"] or 0) <= HOF_WORK else "block"
    if kernel == "hof":
        return distances(vectors, lambda a, b: V.bound(V.dot(a, b), -1.0, 1.0), "rho")
    if kernel == "block":
        return _block_correlations(vectors)
    if kernel == "long":
        return long_correlations(S.to_series(vectors))
    raise ValueError(f"unknown kernel: {kernel}")


def long_correlations(series: DataFrame) -> DataFrame:
    """From running sums, of raw or normalised series; pairs of constant series are left out."""
    a, b = series.select("t", F.col("id").alias("i"), F.col("v").alias("x")), series.select("t", F.col("id").alias("j"), F.col("v").alias("y"))
    sums = a.join(b, "t").where("i < j").groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy")
    )
    rho = V.pearson_from_sums(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    return sums.select("i", "j", rho.alias("rho")).where("rho is not null")


def stacked(table: pa.Table, column: str = "x") -> np.ndarray:
    """The arrays of a column as the rows of a matrix."""
    lists = table[column].combine_chunks()
    return np.asarray(lists.flatten()).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlations of the rows of two blocks; those of equal series are 1 wherever they stand in a block."""
    r = np.clip(a @ b.T, -1, 1)
    r[r > 1 - 1e-14] = 1.0
    return r


def _block_correlations(vectors: DataFrame, least: float = -2.0, k: int = 0) -> DataFrame:
    """Tiles of two blocks; the number of blocks follows the bytes of the vectors and the cores.

    Pairs leave a task tile by tile: all with rho >= least, or of those the k best of the task, ties by ids.
    """
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("m")).first()
    m = numbered_blocks(size["n"], sendable(size["m"] or 0), 4 * cores(vectors))
    placed = vectors.select("id", "x", F.pmod(F.hash("id"), F.lit(m)).alias("own"))
    sent = placed.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("bi", F.least("own", "to")).withColumn("bj", F.greatest("own", "to")).drop("to")

    def tiles_of(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bi, bj = pa.Table.from_batches(list(batches)), key[0].as_py(), key[1].as_py()
        own, ids, x = np.asarray(part["own"]), np.asarray(part["id"]), stacked(part)
        a, b = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        batch = lambda i, j, rho: pa.RecordBatch.from_pydict({"i": i, "j": j, "rho": rho})
        best, bar = [], least
        for s in range(0, len(a), BLOCK):
            for t in range(s if bi == bj else 0, len(b), BLOCK):
                p_at, q_at = a[s : s + BLOCK], b[t : t + BLOCK]
                r = products(x[p_at], x[q_at])
                wanted = r >= bar
                if bi == bj and s == t:
                    wanted &= np.tri(*r.shape, -1, dtype=bool)
                p, q = np.nonzero(wanted)
                i, j = ids[p_at[p]], ids[q_at[q]]
                i, j, rho = np.minimum(i, j), np.maximum(i, j), r[p, q]
                if not k:
                    yield batch(i, j, rho)
                    continue
                best.append((i, j, rho))
                i, j, rho = (np.concatenate(v) for v in zip(*best))
                first = np.lexsort((j, i, -rho))[:k]
                best = [(i[first], j[first], rho[first])]
                if len(first) == k:
                    bar = max(least, rho[first[-1]])
        yield from (batch(*v) for v in best)

    kind = vectors.schema["id"].dataType.simpleString()
    tiles = sent.repartition(m * (m + 1) // 2, "bi", "bj").groupBy("bi", "bj")
    return tiles.applyInArrow(tiles_of, f"i {kind}, j {kind}, rho double")


def symmetric(pairs: DataFrame, value: str = "rho") -> DataFrame:
    """(i, j, value) both ways."""
    return pairs.select("i", "j", value).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), value))


def entropy_of_counts(points: int | Column) -> Column:
    """Entropy of the counts n of a group: the same double for the same counts, in whatever order they are added."""
    p = F.col("n") / points
    return (-F.sum(F.rint(p * F.log(p) * UNITS).cast("long")) / F.lit(float(UNITS))).alias("h")


def entropies(binned: DataFrame, points: int | Column) -> DataFrame:
    """(id, h): natural-log entropy of each series' bins."""
    return binned.groupBy("id", "bin").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(entropy_of_counts(points))


def joint_entropies(binned: DataFrame, size: int, points: int | Column) -> DataFrame:
    """(s1..sp, h): joint entropy of every set of ``size`` series, ids ascending."""
    out = binned.select(F.col("id").alias("s1"), "t", F.col("bin").alias("b1"))
    for k in range(2, size + 1):
        other = binned.select(F.col("id").alias(f"s{k}"), "t", F.col("bin").alias(f"b{k}"))
        out = out.join(other, "t").where(F.col(f"s{k - 1}") < F.col(f"s{k}"))
    ids, bins = [f"s{k}" for k in range(1, size + 1)], [f"b{k}" for k in range(1, size + 1)]
    return out.groupBy(*ids, *bins).agg(F.count(F.lit(1)).alias("n")).groupBy(*ids).agg(entropy_of_counts(points))


def mutual_information(binned: DataFrame, points: int | Column) -> DataFrame:
    """(i, j, mi): H(i) + H(j) - H(i, j)."""
    one = entropies(binned, points)
    both = joint_entropies(binned, 2, points).withColumnRenamed("s1", "i").withColumnRenamed("s2", "j")
    left, right = one.select(F.col("id").alias("i"), F.col("h").alias("hi")), one.select(F.col("id").alias("j"), F.col("h").alias("hj"))
    return both.join(left, "i").join(right, "j").select("i", "j", (F.col("hi") + F.col("hj") - F.col("h")).alias("mi"))
