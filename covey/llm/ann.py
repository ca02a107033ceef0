"""Approximate nearest neighbours by cosine over balanced posting lists.

Index.  Centroids come from balanced k-means (sizes enter the assignment as prices) on a sample of the vectors, of
max(SAMPLE, A_LIST_SAMPLE a list) at most about, a documented bound; every row is then indexed.  There are about
sqrt(n) / 2 lists of n different vectors of a dimension, so both the centroids held in memory and what a query reads
grow with the square root of the table.  A vector stands in the list of its nearest centroid, its home, and near a
border in up to COPIES lists whose centroids are at most (1 + close) times as far, but not behind a centroid that is
nearer to that one than the vector is (such a list would be read together with it anyway).

Search.  Centroids have a graph of their nearest neighbours, held in memory.  Queries walk it best first, many at once,
and keep the lists whose centroids are at most (1 + wide) times as far as the nearest; they take further ones until
those hold enough vectors for a full answer.  ``close`` and ``wide`` are measured on the sample: of a few values of
close, each with the wide that reaches RECALL of the sample's own neighbours, the pair that compares the fewest
vectors.  Neighbours within a sample are farther than those in the table, so this errs towards reading more.  A vector
that stands in several lists of a query is compared once, in its home if the query reads that.  Candidates are compared
by exact cosine in double precision on the original vectors.

Scale: equal vectors are one, with the k + 1 smallest vec_ids they have (no more can be among k nearest), and equal
queries are searched once; so copies cost nothing, however many.  Lists are cut into cells of about CELL vectors and the
queries of a list into blocks, so a cluster that holds a third of all vectors is searched by as many tasks as it has
cells; each cell returns at most k + 1 rows a query.  Neither vectors nor queries are collected, but for the sample.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
vec_id; vectors of different dimensions don't meet; of rows of one vec_id the smallest vector by dimension and bytes
counts; ties go to the smaller vec_id; an empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from covey.llm.common import Scratch
from covey.llm.vectors import cosines, directed, lengths, matrix

SAMPLE, A_LIST_SAMPLE, CELL, BLOCK = 16_384, 16, 2048, 4096
COPIES, DEGREE, PATIENCE = 4, 16, 8
CLOSE, RECALL, CALIBRATION = (0.01, 0.03, 0.06, 0.1, 0.2), 0.98, 512
K, EVERY = 5, 50


def unit(x: np.ndarray) -> np.ndarray:
    return x / lengths(x)[:, None]


def number_of_lists(n: int) -> int:
    return max(1, math.ceil(math.sqrt(n) / 2))


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of balanced clusters of unit vectors."""
    rng = np.random.default_rng(5)
    c, price = x[rng.choice(len(x), k, replace=False)].copy(), np.zeros(k)
    for _ in range(rounds):
        of = np.zeros(len(x), np.int64)
        for _ in range(3):
            for lo in range(0, len(x), 4096):
                of[lo : lo + 4096] = np.argmax(x[lo : lo + 4096] @ c.T - price, axis=1)
            price += 0.05 * (np.bincount(of, minlength=k) * k / len(x) - 1)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        norm = np.sqrt((total * total).sum(axis=1))
        c[norm > 1e-9] = total[norm > 1e-9] / norm[norm > 1e-9][:, None]
    return c


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * a @ b.T, 0))


class Index:
    """Centroids and their graph; ``calibrated`` sets close and wide, ``size`` is how many vectors have each list as home."""

    def __init__(self, centroids: np.ndarray, close: float = 0.1, wide: float = 0.3):
        self.c, self.close, self.wide = centroids, close, wide
        k = len(centroids)
        self.size = np.ones(k, np.int64)
        links: list[set] = [{(a + 1) % k, (a - 1) % k} - {a} for a in range(k)]  # along a ring: every centroid can be reached
        for lo in range(0, k, 1024):
            d = apart(centroids[lo : lo + 1024], centroids)
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            for a, row in enumerate(np.argsort(d, axis=1, kind="stable")[:, : min(DEGREE, k - 1)]):
                for b in map(int, row):  # both ways
                    links[lo + a].add(b)
                    links[b].add(lo + a)
        most = max(map(len, links), default=0)
        self.links = np.array([[*sorted(s), *[a] * (most - len(s))] for a, s in enumerate(links)], np.int64).reshape(k, most)
        self.entries = np.arange(0, k, max(1, int(math.sqrt(k))))

    def lists_of(self, x: np.ndarray, close: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, home) of every list that unit vectors stand in."""
        close, out = self.close if close is None else close, []
        for lo in range(0, len(x), 2048):
            d = apart(x[lo : lo + 2048], self.c)
            order = np.argsort(d, axis=1, kind="stable")[:, :COPIES]
            dist = np.take_along_axis(d, order, axis=1)
            keep = dist <= dist[:, :1] * (1 + close)
            for j in range(1, order.shape[1]):
                for i in range(j):
                    between = np.sqrt(((self.c[order[:, j]] - self.c[order[:, i]]) ** 2).sum(axis=1))
                    keep[:, j] &= ~(keep[:, i] & (between < dist[:, j]))
            keep[:, 0] = True
            row, col = np.nonzero(keep)
            out.append((lo + row, order[row, col], order[row, 0]))
        return tuple(np.concatenate(v) for v in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))

    def calibrated(self, sample: np.ndarray, k: int) -> Index:
        """Measures close and wide on unit vectors."""
        n = len(sample)
        if n < 2 or len(self.c) < 2:
            return self
        at = np.unique(np.linspace(0, n - 1, min(n, CALIBRATION)).astype(np.int64))
        s = sample[at] @ sample.T
        s[np.arange(len(at)), at] = -np.inf
        k = min(k, n - 1)
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        d = apart(sample[at], self.c)
        ratio = d / np.maximum(d.min(axis=1, keepdims=True), 1e-9)
        best = None
        for close in CLOSE:
            row, where, _ = self.lists_of(sample, close)
            first = np.searchsorted(row, np.arange(n + 1))
            reach = np.array([ratio[q, where[first[v] : first[v + 1]]].min() for q in range(len(at)) for v in near[q]])
            wide = float(np.quantile(reach, RECALL))
            work = (np.bincount(where, minlength=len(self.c)) * (ratio <= wide)).sum() / len(at)
            if best is None or work < best[0]:
                best = (work, close, wide - 1)
        self.close, self.wide = best[1], best[2]
        return self

    def search(self, q: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list) of the lists to read for unit vectors, and each row's limit: what it reads is not farther."""
        rows, lists, limits = [], [], []
        for lo in range(0, len(q), 512):
            found = self._walk(q[lo : lo + 512], wanted)
            reach = np.where(np.isfinite(found), found, np.inf)
            limit = reach.min(axis=1) * (1 + self.wide)
            short = np.flatnonzero(((reach <= limit[:, None]) * self.size).sum(axis=1) < wanted)
            for r in short:  # further lists, nearest first, until they hold enough
                order = np.argsort(reach[r], kind="stable")
                held = np.cumsum(self.size[order])
                upto = min(int(np.searchsorted(held, wanted)), int(np.isfinite(reach[r]).sum()) - 1)
                limit[r] = max(limit[r], reach[r, order[upto]])
            r, a = np.nonzero(reach <= limit[:, None])
            rows.append(lo + r)
            lists.append(a)
            limits.append(limit)
        return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, lists, limits))

    def _walk(self, q: np.ndarray, wanted: int) -> np.ndarray:
        """Distances to the centroids that the walk meets, infinite for others."""
        n, k = len(q), len(self.c)
        seen, left = np.full((n, k), np.inf), np.full((n, k), np.inf)
        seen[:, self.entries] = left[:, self.entries] = apart(q, self.c[self.entries])
        late, held, live = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        while len(live):
            a = np.argmin(left[live], axis=1)
            d = left[live, a]
            # beyond the ratio the walk goes on through a few more centroids, in case one leads back
            beyond = d > seen[live].min(axis=1) * (1 + self.wide)
            late[live] = np.where(beyond, late[live] + 1, 0)
            on = np.isfinite(d) & ~((late[live] > PATIENCE) & (held[live] >= wanted))
            live, a = live[on], a[on]
            held[live] += self.size[a]
            left[live, a] = np.inf
            near = self.links[a]
            new = np.isinf(seen[live[:, None], near])
            dot = np.einsum("rd,rnd->rn", q[live], self.c[near])
            r, j = np.nonzero(new)
            d = np.sqrt(np.maximum(2 - 2 * dot[r, j], 0))
            seen[live[r], near[r, j]] = d
            left[live[r], near[r, j]] = d
        return seen


def best_of(queries: np.ndarray, x: np.ndarray, first: np.ndarray, homes: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, vector's row, score) of each query's k nearest vectors, ties to the smaller first vec_id.

    homes: (query rows, vector rows) that are compared with each other.
    """
    out: list[tuple] = []
    u, v = unit(queries), unit(x)
    for some, those in homes:
        for lo in range(0, len(some) if len(those) else 0, 256):
            rows = some[lo : lo + 256]
            s = u[rows] @ v[those].T
            m = min(k, s.shape[1])
            bound = np.partition(s, -m, axis=1)[:, -m]
            row, col = np.nonzero(s >= bound[:, None] - 1e-9)  # equal vectors may differ in the last bits here
            out.append((rows[row], those[col], cosines(queries[rows[row]], x[those[col]])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, col, score = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((first[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], col[top], score[top]


def build_indexes(different: DataFrame, k: int, sample: int = SAMPLE) -> dict[int, Index]:
    """An index for each dimension, from a sample that grows with the number of lists."""
    counts = {r["dim"]: r["n"] for r in different.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(1 << 24)
    for dim, n in counts.items():
        wanted = max(sample, A_LIST_SAMPLE * number_of_lists(n))
        share = F.when(F.col("dim") == dim, F.lit(math.ceil(min(1.0, wanted / n) * (1 << 24)))).otherwise(share) if wanted < n else share
    taken = different.where(F.pmod(F.xxhash64(F.lit(3), "x"), F.lit(1 << 24)) < share).select("dim", "x").toArrow()
    out = {}
    for dim, n in counts.items():
        rows = taken["x"].filter(pc.equal(taken["dim"], dim))
        u = unit(matrix(rows.take(pc.array_sort_indices(rows)), dim))
        number = min(number_of_lists(n), max(1, len(u)))
        out[dim] = Index(balanced_centroids(u, number) if number > 1 else np.eye(1, dim)).calibrated(u, k)
    return out


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = K, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row of ``vectors`` for which ``queries`` holds.

    queries: a condition on vec_id.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = directed(vectors).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct("dim", "x")).alias("one"))
    rows = scratch.table(rows.select("vec_id", "one.*"), "directed")
    place = F.row_number().over(Window.partitionBy("dim", "x").orderBy("vec_id"))
    different = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("dim", "x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    different = scratch.table(different.withColumn("vector", F.monotonically_increasing_id()), "different")  # written once: numbers stay
    indexes = build_indexes(different, k, sample)
    if not indexes:
        return scratch.finish(spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), "neighbours")
    shared = spark.sparkContext.broadcast(indexes)

    def by_dim(batch: pa.RecordBatch, indexes: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, Index]]:
        dims = np.asarray(batch.column(0))
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            yield int(dim), at, matrix(batch.column(1).take(pa.array(at)), int(dim)), indexes[int(dim)]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, x, index in by_dim(batch, shared.value):
                row, where, home = index.lists_of(unit(x))
                part = batch.take(pa.array(at[row]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(where.astype(np.int32)), pa.array(home.astype(np.int32))], ["dim", "x", "ids", "list", "home"])

    head = [StructField("dim", IntegerType()), StructField("x", BinaryType())]
    at_list = StructField("list", IntegerType())
    postings = different.select("dim", "x", "ids").mapInArrow(post, StructType([*head, StructField("ids", ArrayType(LongType())), at_list, StructField("home", IntegerType())]))
    postings = scratch.table(postings, "postings")
    sizes = scratch.table(postings.groupBy("dim", "list").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("list") == F.col("home")).alias("own")), "sizes")
    for r in sizes.collect():  # one row a list
        indexes[r["dim"]].size[r["list"]] = r["own"]
    filled = spark.sparkContext.broadcast(indexes)

    # equal queries are one: the vector's number stands for them
    asked = scratch.table(rows.where(queries).join(different.select("dim", "x", "vector"), ["dim", "x"]).select(F.col("vec_id").alias("query_id"), "vector"), "asked")
    wanted = different.join(asked.select("vector").distinct(), "vector").select("dim", "x", "vector")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, x, index in by_dim(batch, filled.value):
                row, where, limit = index.search(unit(x), 4 * k)
                part = batch.take(pa.array(at[row]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(where.astype(np.int32)), pa.array(limit[row])], ["dim", "x", "vector", "list", "limit"])

    probes = scratch.table(wanted.mapInArrow(probe, StructType([*head, StructField("vector", LongType()), at_list, StructField("limit", DoubleType())])), "probes")
    loads = probes.groupBy("dim", "list").agg(F.count(F.lit(1)).alias("q")).join(sizes, ["dim", "list"])
    loads = scratch.table(loads.select("dim", "list", F.ceil(F.col("n") / CELL).cast("int").alias("cells"), F.ceil(F.col("q") / BLOCK).cast("int").alias("blocks")), "loads")
    spread = lambda c, to: F.pmod(F.xxhash64("x"), F.col(c)).cast("int").alias(to)
    every = lambda c, to: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(to)
    held = postings.join(loads, ["dim", "list"]).select("dim", "list", spread("cells", "cell"), every("blocks", "block"), "x", "ids", "home")
    want = probes.join(loads, ["dim", "list"]).select("dim", "list", spread("blocks", "block"), every("cells", "cell"), "x", "vector", "limit")

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        dim, at = key[0].as_py(), key[1].as_py()
        ids = left["ids"].combine_chunks() if left.num_rows else None
        row = col = np.zeros(0, np.int64)
        score = np.zeros(0)
        if left.num_rows and right.num_rows:
            x, q = matrix(left["x"], dim), matrix(right["x"], dim)
            home, limit = np.asarray(left["home"].combine_chunks()), np.asarray(right["limit"].combine_chunks())
            first = np.asarray(ids.flatten())[np.asarray(ids.offsets)[:-1] - ids.offsets[0].as_py()]
            centroids, every_query = filled.value[dim].c, np.arange(len(q))
            homes = [(every_query, np.flatnonzero(home == at))]
            for h in np.unique(home[home != at]):  # copies: for queries that don't read their home
                outside = apart(unit(q), centroids[h : h + 1])[:, 0] > limit
                homes.append((np.flatnonzero(outside), np.flatnonzero(home == h)))
            row, col, score = best_of(q, x, first, homes, k + 1)
        of = right["vector"].combine_chunks().take(pa.array(row)) if right.num_rows else pa.array([], pa.int64())
        return pa.table({"vector": of, "score": pa.array(score, pa.float64()), "ids": ids.take(pa.array(col)) if ids is not None else pa.array([], pa.list_(pa.int64()))})

    key = ["dim", "list", "cell", "block"]
    found = held.groupBy(*key).cogroup(want.groupBy(*key)).applyInArrow(compare, StructType([StructField("vector", LongType()), StructField("score", DoubleType()), StructField("ids", ArrayType(LongType()))]))
    # a vector whose home a query doesn't read may meet it in two other lists
    found = found.groupBy("vector", F.col("ids")[0].alias("first")).agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    nearest = F.row_number().over(Window.partitionBy("vector").orderBy(F.col("score").desc(), "first"))
    found = found.withColumn("place", nearest).where(F.col("place") <= k + 1).select("vector", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy(F.col("score").desc(), "vec_id"))
    found = scratch.table(found.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    out = asked.join(found, "vector").where("query_id <> vec_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return scratch.finish(out.select("query_id", "rank", "vec_id", "score"), "neighbours")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_neighbours(vectors, F.col("vec_id") % EVERY == 0)
