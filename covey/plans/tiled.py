"""Pattern (1, 2) by numpy tiles: exact, for many series.

A task gets three blocks of vectors, multiplies them into correlation tiles and keeps the triples (i | j, k) that pass, or
of those the k best.  Blocks are cut by bytes, so a vector is sent to few tasks; tiles within a task stay small, and bounds
by row and column leave out most of a tile.  Equal vectors are one until their results are written, and results leave a
task batch by batch: its memory is bounded by the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.operators import measures as M
from covey.operators.lineage import cut
from covey.operators.pairs import _block_correlations, cores, products, sendable, stacked
from covey.spec import DENOMINATOR_FLOOR, Measure, QuerySpec, QueryType

BLOCK = 512  # vectors on one side of a tile
ROWS = 1 << 17  # rows of a batch that leaves a task
COPIES = 1024  # equal vectors that stand as one
SPREAD = 64 << 20  # bytes of vectors that may be sent to spread results over more tasks than the cores need


def suits(spec: QuerySpec) -> bool:
    w = spec.weights.of("right", 2) if (spec.left, spec.right) == (1, 2) else (0, 1)
    return spec.measure in (Measure.PEARSON, Measure.SPEARMAN) and w[0] == w[1] and spec.subset_scope == "cross"


def _expanded(found, ids: np.ndarray, first: np.ndarray, size: np.ndarray, spots: int) -> Iterator[tuple]:
    """(i, j, k, sim) of every series behind triples of distinct vectors (places, sim), at most ``spots`` at a time."""
    i, j, k, sim = found
    many = size[i] * size[j] * size[k]
    ends = np.cumsum(many)
    for start in range(0, int(ends[-1]) if len(ends) else 0, spots):
        stop = min(start + spots, int(ends[-1]))
        at = slice(np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right") + 1)
        before = ends[at] - many[at]
        times = np.minimum(ends[at], stop) - np.maximum(before, start)
        row = np.repeat(np.arange(at.start, at.stop, dtype=np.int32), times)
        # the place among a triple's own rows: below COPIES ** 3, so 32 bits hold it, and those are divided faster
        rest = (np.arange(start, stop) - np.repeat(before, times)).astype(np.int32)
        rest, r = _shares(rest, size, k, at, times)
        p, q = _shares(rest, size, j, at, times)
        a, b, c = (ids[np.repeat(first[v[at]], times) + n] for v, n in ((i, p), (j, q), (k, r)))
        # copies of one vector on the right side: each two of them once
        real = (a != b) & (a != c)
        alike = j[at] == k[at]
        if alike.any():
            real &= ~np.repeat(alike, times) | (b < c)
        low, high = np.minimum(b, c), np.maximum(b, c)
        sims = sim[row]
        if real.all():
            yield a, low, high, sims
        else:
            yield a[real], low[real], high[real], sims[real]


def _shares(rest: np.ndarray, size: np.ndarray, of: np.ndarray, at: slice, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rest divided by the number of copies of each row's vector, and what is left; one divisor for all is far cheaper."""
    own = size[of[at]]
    by = np.int32(own[0]) if (own == own[0]).all() else np.repeat(own.astype(np.int32), times)
    whole = rest // by
    return whole, rest - whole * by


def _tile(spec: QuerySpec, least: float):
    u, w = spec.weights.of("left", 1)[0], spec.weights.of("right", 2)
    if w[0] != w[1]:
        raise ValueError("tiles need equal weights on the right side")
    over, d_left = u * w[0], max(u * u, DENOMINATOR_FLOOR)
    most = 0 if spec.query is QueryType.THRESHOLD else spec.k

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, (a, b, c) = pa.Table.from_batches(list(batches)), (v.as_py() for v in key)
        own, x = np.asarray(part["own"]), stacked(part)
        lists = part["ids"].combine_chunks()
        ids, size = np.asarray(lists.flatten()), np.asarray(lists.value_lengths()).astype(np.int64)
        first = np.cumsum(size) - size
        at = {v: np.flatnonzero(own == v) for v in {a, b, c}}
        best, bar = (ids[:0],) * 3 + (np.zeros(0),), least
        waiting, held = [], 0

        def released() -> Iterator[pa.RecordBatch]:
            """What waits, as batches; with k the best so far take it in and raise the bar."""
            nonlocal best, bar, waiting, held
            for rows in _expanded(tuple(np.concatenate(v) for v in zip(*waiting)), ids, first, size, ROWS) if waiting else ():
                if not most:
                    yield pa.RecordBatch.from_pydict(dict(zip(("i", "j", "k", "sim"), rows)))
                    continue
                rows = tuple(np.concatenate(v) for v in zip(best, rows))
                kept = np.lexsort((rows[2], rows[1], rows[0], -rows[3]))[:most]
                best = tuple(v[kept] for v in rows)
                if len(kept) == most:
                    bar = max(bar, best[3][-1])
            waiting, held = [], 0

        for s in range(0, len(at[b]), BLOCK):
            for t in range(s if b == c else 0, len(at[c]), BLOCK):
                js, ks = at[b][s : s + BLOCK], at[c][t : t + BLOCK]
                d_right = np.maximum(w[0] ** 2 + w[1] ** 2 + 2 * w[0] * w[1] * products(x[js], x[ks]), DENOMINATOR_FLOOR)
                root = np.sqrt(d_left * d_right)
                # the sum of correlations that a set needs, and a row's or column's least need; of two j = k only with copies
                floor = max(spec.tau, bar) - 1e-12
                need = floor * root / over if over > 0 else np.full(root.shape, -np.inf if floor < 0 else np.inf)
                if b == c and s == t:
                    need[np.tri(*need.shape, -1, dtype=bool)] = np.inf
                    need[np.diag(size[js] < 2)] = np.inf
                by_row, by_column = need.min(1), need.min(0)
                for o in range(0, len(at[a]), BLOCK):
                    left = at[a][o : o + BLOCK]
                    ij, ik = products(x[left], x[js]), products(x[left], x[ks])
                    alone = (size[left] < 2)[:, None]  # a series is no set with itself
                    ij[alone & (left[:, None] == js[None, :])] = -np.inf
                    ik[alone & (left[:, None] == ks[None, :])] = -np.inf
                    rows = ij + ik.max(1)[:, None] > by_row[None, :]
                    columns = ik + ij.max(1)[:, None] > by_column[None, :]
                    if spec.irreducible:
                        rows &= ij <= spec.tau
                        columns &= ik <= spec.tau
                    if spec.min_jump > 0:  # no similarity is above 1
                        rows &= ij < 1 - spec.min_jump + 1e-12
                        columns &= ik < 1 - spec.min_jump + 1e-12
                    for r in np.flatnonzero(rows.any(1) & columns.any(1)):
                        jn, kn = np.flatnonzero(rows[r]), np.flatnonzero(columns[r])
                        p, q = np.nonzero(ij[r, jn][:, None] + ik[r, kn][None, :] > need[jn[:, None], kn[None, :]])
                        if not len(p):
                            continue
                        p, q = jn[p], kn[q]
                        x_j, x_k = ij[r, p], ik[r, q]
                        sim = np.clip(over * (x_j + x_k) / root[p, q], -1, 1)
                        pick = (sim > spec.tau) & (sim >= bar)
                        high = np.maximum(x_j, x_k)
                        if spec.min_jump > 0:
                            pick &= sim > high + spec.min_jump
                        if spec.irreducible:
                            pick &= high <= spec.tau
                        p, q, sim = p[pick], q[pick], sim[pick]
                        waiting.append((np.full(len(p), left[r]), js[p], ks[q], sim))
                        held += len(p)
                        if held >= ROWS:
                            yield from released()
                if most:
                    yield from released()
        yield from released()
        if most:
            yield pa.RecordBatch.from_pydict(dict(zip(("i", "j", "k", "sim"), best)))

    return run


def triples(vectors: DataFrame, spec: QuerySpec, least: float = -2.0) -> DataFrame:
    """Tiles (a; b <= c) of three blocks; a distinct vector is sent once to each tile in which its block stands."""
    same = vectors.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    starts = F.sequence(F.lit(0), F.size("ids") - 1, F.lit(COPIES))
    distinct = cut(same.select("x", F.explode(F.transform(starts, lambda s: F.slice("ids", s + 1, COPIES))).alias("ids")), "distinct")
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("m")).first()
    n, most = size["n"], sendable(size["m"] or 0)
    blocks = lambda tasks: min(math.ceil(n / 32), math.ceil((tasks * cores(vectors)) ** (1 / 3)))
    m = max(1, math.ceil(n / most), blocks(4))
    # few of the tiles hold most of the results: many small ones end together; each vector is sent 1.5 * m * m times
    while m < blocks(32) and 1.5 * (m + 1) ** 2 * n * (8 * (size["m"] or 0) + 32) <= SPREAD:
        m += 1
    placed = distinct.select("ids", "x", F.pmod(F.hash(F.get("ids", 0)), F.lit(m)).alias("own"))
    every = F.sequence(F.lit(0), F.lit(m - 1))
    tile = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    # as the left block: with all pairs of blocks; as a right one: with any other block left and any block beside it
    as_left = F.flatten(F.transform(every, lambda b: F.transform(F.sequence(b, F.lit(m - 1)), lambda c: tile(F.col("own"), b, c))))
    others = F.filter(every, lambda a: a != F.col("own"))
    as_right = F.flatten(F.transform(others, lambda a: F.transform(every, lambda q: tile(a, F.least("own", q), F.greatest("own", q)))))
    sent = placed.withColumn("at", F.explode(F.concat(as_left, as_right))).select("ids", "x", "own", "at.*")
    kind = vectors.schema["id"].dataType.simpleString()
    tiles = sent.repartition(m * m * (m + 1) // 2, "a", "b", "c").groupBy("a", "b", "c")
    out = tiles.applyInArrow(_tile(spec, least), f"i {kind}, j {kind}, k {kind}, sim double")
    return out.select(F.array("i").alias("lhs"), F.array("j", "k").alias("rhs"), "sim")


def pairs(vectors: DataFrame, spec: QuerySpec) -> DataFrame:
    """Pattern (1, 1): the pairs that pass; for the k best, those of each task."""
    u, w = spec.weights.of("left", 1)[0], spec.weights.of("right", 1)[0]
    scale = u * w / math.sqrt(max(u * u, DENOMINATOR_FLOOR) * max(w * w, DENOMINATOR_FLOOR))
    least = spec.tau / scale - 1e-12 if scale > 0 else -2.0
    found = _block_correlations(vectors, least, spec.k if spec.query is not QueryType.THRESHOLD and scale > 0 else 0)
    sim = M.similarity(spec, ["x"], ["y"], lambda *_: F.col("rho"))
    ways = [("i", "j")] if u == w else [("i", "j"), ("j", "i")]
    way = F.explode(F.array(*[F.struct(F.array(x).alias("lhs"), F.array(y).alias("rhs")) for x, y in ways])).alias("way")
    return found.select(way, sim.alias("sim")).where(F.col("sim") > spec.tau).select("way.*", "sim")


def run(vectors: DataFrame, spec: QuerySpec) -> DataFrame:
    if spec.measure not in (Measure.PEARSON, Measure.SPEARMAN) or (spec.left, spec.right) != (1, 2):
        raise ValueError("tiles are for correlations of one series with two")
    if (1, 1) not in spec.patterns():
        return triples(vectors, spec)
    small = pairs(vectors, spec)
    if spec.query is QueryType.THRESHOLD:
        return small.unionByName(triples(vectors, spec))
    from covey.plans.query import finished, ranked

    # the k best pairs, grown among their own series, are sets of the query: none below the k-th best of them is in the answer
    small = cut(finished(small, spec), "seed")
    few = vectors.join(small.select(F.explode(F.concat("lhs", "rhs")).alias("id")).distinct(), "id", "left_semi")
    grown = cut(small.unionByName(triples(few, spec)).orderBy(*ranked(small)).limit(spec.k), "seed")
    first = grown.agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("s")).first()
    return small.unionByName(triples(vectors, spec, first["s"] - 1e-12 if first["n"] >= spec.k else -2.0))
