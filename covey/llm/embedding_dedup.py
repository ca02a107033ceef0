"""Embedding near-dedup: all pairs by quantised tile products with rigorous error bounds.

Unit vectors u are quantised to int8 with a scale s of their own, and e = |u - s q| is computed.  For any two,
|cos - s s' q.q'| <= e + (1 + e) e', so a pair whose quantised product stays below threshold by that bound and a margin
for rounding can't be a link.  Only the pairs that are left are computed again, in double precision from the vectors
as they are.  A tile of products of int8 values is exact in single precision (|q.q'| < 2**24 up to 1040 dimensions;
larger ones are summed in slices), so the product runs as a matrix multiplication.

Rows of one vec_id and equal vectors are one row from the start, with a multiplicity and a key of its own: rows of one
vec_id with different vectors stay apart.  A pair of tiles returns, for each vector, how many it
links with, and the edges of a spanning forest of the links between the tiles: as many rows as the tiles have at most,
however many links a group of near copies has.  The forests connect the same vectors as all links.

Scale: all pairs of n vectors take n*n/2 products; they are spread over TILES*(TILES+1)/2 tasks or more, as many as
keep a tile within TILE rows, and each vector is sent to as many tasks as there are tiles.  No task holds more than two tiles and
a strip of products.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing, neither do vectors
of different dimensions with each other; rows without vec_id have no links and no component; repeated rows are vectors
of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from covey.llm.common import Scratch
from covey.llm.components import Forest, connected_components
from covey.llm.vectors import directed, lengths, matrix

THRESHOLD = 0.9
TILE, TILES, STRIP = 8192, 12, 1024
MARGIN = 1e-9


class Quantised:
    """int8 vectors with scales and error bounds."""

    def __init__(self, x: np.ndarray):
        self.unit = x / lengths(x)[:, None]
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.q = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        self.error = np.sqrt(((self.unit - self.scale[:, None] * self.q) ** 2).sum(axis=1)) + 1e-12


def possible(a: Quantised, b: Quantised, threshold: float) -> np.ndarray:
    """Pairs whose cosine may reach the threshold, as a matrix of flags."""
    total = np.zeros((len(a.q), len(b.q)))
    for k in range(0, a.q.shape[1], 1024):
        total += a.q[:, k : k + 1024].astype(np.float32) @ b.q[:, k : k + 1024].astype(np.float32).T
    bound = a.error[:, None] + (1 + a.error)[:, None] * b.error[None, :] + MARGIN
    return total * a.scale[:, None] * b.scale[None, :] >= threshold - bound


def tile_links(left: np.ndarray, right: np.ndarray | None, times_left: np.ndarray, times_right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts of linked vectors (by multiplicity) of left then right, and the root of each; right None: left with itself."""
    a = Quantised(left)
    b = a if right is None else Quantised(right)
    shift = 0 if right is None else len(left)
    times_b = times_left if right is None else times_right
    count = np.zeros(len(left) + (0 if right is None else len(right)), np.int64)
    forest = Forest(len(count))
    raw_b = left if right is None else right
    norm_a, norm_b = np.sqrt((left * left).sum(axis=1)), np.sqrt((raw_b * raw_b).sum(axis=1))
    for lo in range(0, len(left), STRIP):
        hi = min(lo + STRIP, len(left))
        part = Quantised.__new__(Quantised)
        part.scale, part.q, part.error = a.scale[lo:hi], a.q[lo:hi], a.error[lo:hi]
        flags = possible(part, b, threshold)
        if right is None:
            flags[np.arange(hi - lo), np.arange(lo, hi)] = False
        rows, cols = np.flatnonzero(flags.any(axis=1)), np.flatnonzero(flags.any(axis=0))
        if not len(rows):
            continue
        # in double precision, for the rows and columns that have a possible pair
        with np.errstate(over="ignore", invalid="ignore"):
            exact = (left[lo:hi][rows] @ raw_b[cols].T) / (norm_a[lo:hi][rows][:, None] * norm_b[cols][None, :])
        odd = ~np.isfinite(exact)
        if odd.any():  # components near the ends of the range
            exact[odd] = (a.unit[lo:hi][rows] @ b.unit[cols].T)[odd]
        link = flags[np.ix_(rows, cols)] & (exact >= threshold)
        count[lo:hi][rows] += link @ times_b[cols]
        if right is not None:
            count[shift:][cols] += link.T @ times_left[lo:hi][rows]
        i, j = np.nonzero(link)
        forest.add(rows[i] + lo, cols[j] + shift)
    return count, forest.root


def _tile_task(threshold: float):
    def run(key, table):
        dim, i, j = (k.as_py() for k in key)
        side = np.asarray(table["tile"].combine_chunks())
        ids, times, x = np.asarray(table["key"].combine_chunks()), np.asarray(table["times"].combine_chunks()), matrix(table["x"], dim)
        order = np.r_[np.flatnonzero(side == i), np.flatnonzero(side == j) if i != j else np.zeros(0, np.int64)]
        n = int((side == i).sum())
        ids, times, x = ids[order], times[order], x[order]
        count, root = tile_links(x[:n], None if i == j else x[n:], times[:n], times[n:], threshold)
        at = np.flatnonzero((count > 0) | (root != np.arange(len(root))))
        return pa.table({"key": pa.array(ids[at]), "links": pa.array(count[at]), "other": pa.array(ids[root[at]])})

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, tiles: int = TILES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    found = scratch.table(directed(vectors), "directed")
    one = found.groupBy("dim", "x").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("times"))
    one = scratch.table(one.withColumn("key", F.monotonically_increasing_id()), "different")  # written once: keys stay
    schema = StructType([StructField("key", LongType()), StructField("links", LongType()), StructField("other", LongType())])
    # vectors of all dimensions go through one plan: a tile holds vectors of one dimension
    sizes = one.groupBy("dim").agg(F.greatest(F.lit(tiles), F.ceil(F.count(F.lit(1)) / tile)).cast("int").alias("m"))
    placed = one.join(scratch.table(sizes, "sizes"), "dim").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("m")).cast("int"))
    sent = placed.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    sent = sent.select("dim", "key", "times", "x", "tile", F.least("tile", "to").alias("i"), F.greatest("tile", "to").alias("j"))
    most = one.agg(F.count(F.lit(1))).first()[0]
    m = max(tiles, math.ceil(most / tile))
    tiled = sent.repartition(max(m * (m + 1) // 2, 1), "dim", "i", "j").groupBy("dim", "i", "j")
    links = scratch.table(tiled.applyInArrow(_tile_task(threshold), schema), "tile-links")
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    labels = connected_components(links.select(F.col("key").alias("a"), F.col("other").alias("b")), scratch).withColumnRenamed("node", "key")
    # a component's name is its smallest vec_id
    named = labels.join(one.select("key", "vec_id"), "key").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = labels.join(scratch.table(named, "names"), "component").select("key", "component_id")
    heads = one.select("dim", "x", "key", "vec_id", "times").join(counts, "key", "left").join(named, "key", "left")
    heads = scratch.table(heads.select("dim", "x", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")), "heads")
    linked = scratch.table(found.join(heads, ["dim", "x"]).select("vec_id", "n_links", "component_id"), "linked")
    # rows without a direction are those that `directed` left out: judged again by its rule in one expression
    e = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & e.isNotNull() & F.exists(e, lambda v: v != 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rest = vectors.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(rest)
    return scratch.finish(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "linked-vectors")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return link_vectors(vectors)


ORACLE_SQL = """
with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_sum(list_transform(embedding, lambda x: abs(x::double))) > 0),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
c(a, b) as (select vec_id, vec_id from embeddings union select c.a, l.b from c join l on c.b = l.a),
m as (select a, min(b) component_id from c group by a),
n as (select a, count(*) n_links from l group by a)
select vec_id, coalesce(n_links, 0)::bigint n_links, component_id, vec_id = component_id kept from embeddings join m on m.a = vec_id left join n on n.a = vec_id
"""
