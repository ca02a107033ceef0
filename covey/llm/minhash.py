"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are runs of SHINGLE words (runs of bytes other than 0x20 and 0x09-0x0D, ASCII letters folded); a shorter
text is one shingle.  A shingle's weight is its count in the text times its inverse document frequency.

Document frequencies.  Every document of the corpus is counted, in a table of CELLS hashed cells.  What other shingles
bring to a cell is in proportion to the corpus like the frequencies themselves, and its typical amount (the median
cell) is taken off; so one size of table tells shares of documents from LEAST on apart, alike at every size of corpus.
idf is the logarithm of the inverse share, on a scale from 1 (every document has the shingle) to 2 (LEAST of them or
fewer): 1 + ln(share) / ln(LEAST).  LEAST and the offset are what keeps large groups of near copies together: there the
edits are rare and what the copies share is frequent.  Of the pairs with a plain similarity of 0.8 or more in a table
with one large group of near copies, 99.9 % stay at 0.8 by these weights; LEAST = 0.01 would keep 55 %, and the plain
logarithm of the inverse share 30 %.

Signatures.  A sample of a weighted set is its element of the smallest a = c * exp(-r * (t - beta + 1)) with
t = floor(ln(w) / r + beta), r and c from Gamma(2, 1) and beta uniform, all from the element and the sample's number;
(element, t) of two sets agree with the probability of their weighted Jaccard similarity.  Weights enter on a grid of
eighths of an octave and elements by a code, so that a sample of rare elements costs a table lookup each.  BANDS bands of ROWS samples each make candidates.

Verification is exact weighted Jaccard similarity over whole texts, >= THRESHOLD.  Copies of one word sequence are one
class from the start.  In a bucket of a band each class is verified against the bucket's smallest.  Members that this
leaves in another component than the smallest are then compared with every member, by tiles: the intersections of two
blocks of weighted sets are one matrix product over the shingles that occur twice in them, and a tile returns the edges
of a spanning forest of its links, never its pairs.  So no component loses a link between texts of a bucket, a bucket
of thousands of near copies costs one verification each and a product for those that failed, and no pairs are listed:
n members of which f are apart are sent n * ceil(f / TILE_ROWS) + f * ceil(n / TILE_ROWS) times.

Scale: texts are scanned once for frequencies and once for signatures; frequencies are summed in blocks of cells over
two levels and reach the driver as one table of fixed size.  Texts move only for classes with candidates, packed.
Hot buckets and hot classes are joined from written tables, where AQE splits them.

Edge cases: texts that are null or have no words are never linked; repeated rows of one doc_id get one class; rows
with a null doc_id have no class and stay out of links; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from covey.llm.common import Grams, Scratch, blocks, bounded_partitions, mix, open_texts, packed, text_bytes, text_key, trimmed, unpack, word_hashes
from covey.llm.components import Forest, connected_components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 5
CELLS, CELL_BLOCK = 1 << 17, 1 << 12
LEAST = 0.05
STEPS_AN_OCTAVE = 8
CODES = 1 << 14
TILE_ROWS = 512


_ROW_BITS = np.uint64(16)


def shingle_rows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the different shingles of each row, in order; and two hashes of each row's words."""
    h, first = word_hashes(buf, off, fold=True)
    grams = Grams(h)
    length = np.diff(first)
    number = np.where(length == 0, 0, np.maximum(length - SHINGLE + 1, 1))
    row = np.repeat(np.arange(len(length)), number)
    start = np.repeat(first[:-1] - np.r_[0, np.cumsum(number)[:-1]], number) + np.arange(number.sum())
    s = grams.of(start, np.minimum(start + SHINGLE, first[1:][row]), salt=5)
    # (row, shingle) sorts as one 64-bit key; the shingle keeps 48 bits
    key = np.sort((row.astype(np.uint64) << (np.uint64(64) - _ROW_BITS)) | (s >> _ROW_BITS))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(key)])
    key = key[new]
    return (key >> (np.uint64(64) - _ROW_BITS)).astype(np.int64), key << _ROW_BITS, count, grams.of(first[:-1], first[1:], salt=6), grams.of(first[:-1], first[1:], salt=7)


def cell_of(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - int(CELLS).bit_length() + 1)).astype(np.int64)


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's document counts by cell, in blocks; one more block has the number of documents with words."""
    cells, docs = np.zeros(CELLS, np.int64), 0
    for batch in batches:
        off, buf = text_bytes(batch.column(0))
        for i, j in blocks(off, 1 << 20):
            row, shingle, *_ = shingle_rows(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            cells += np.bincount(cell_of(shingle), minlength=CELLS)
            docs += len(np.unique(row))
    lane = TaskContext.get().partitionId() % 64
    rows = [*cells.reshape(-1, CELL_BLOCK), np.array([docs])]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), lane, np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["block", "lane", "counts"])


def _add_up(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v, np.int64) for v in table["counts"].to_pylist())
    return pa.table({"block": table["block"][:1], "lane": table["lane"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency by cell, from every document of ``docs``."""
    schema = StructType([StructField("block", IntegerType()), StructField("lane", IntegerType()), StructField("counts", BinaryType())])
    parts = docs.select("text").mapInArrow(trimmed(_count_cells), schema)
    total = parts.groupBy("block", "lane").applyInArrow(_add_up, schema).groupBy("block").applyInArrow(_add_up, schema)
    found = {r["block"]: np.frombuffer(bytes(r["counts"]), np.int64) for r in total.select("block", "counts").collect()}
    if not found:
        return np.ones(CELLS)
    number = CELLS // CELL_BLOCK
    share = np.concatenate([found[b] for b in range(number)]) / max(1, int(found[number][0]))
    typical = float(np.median(share))
    return inverse_frequency((share - typical) / max(1 - typical, 1e-9))


def inverse_frequency(share: np.ndarray) -> np.ndarray:
    return 1 + np.log(np.clip(share, LEAST, 1)) / np.log(LEAST)


class Sampler:
    """Tables of the random variables of every sample, by a code of the element."""

    made: dict = {}

    def __init__(self, bands: int, rows: int):
        k = bands * rows
        rng = np.random.default_rng(977)
        uniform = lambda: np.maximum(rng.random((k, CODES)), 1e-12)
        self.r = (-np.log(uniform()) - np.log(uniform())).astype(np.float32)
        self.log_c = np.log(-np.log(uniform()) - np.log(uniform())).astype(np.float32)
        self.beta = uniform().astype(np.float32)
        self.odd = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.join = rng.integers(0, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bands, self.rows = bands, rows
        self.rare = self.level(np.array([2.0]))[0]
        every = np.arange(CODES)
        self.table = np.stack([self.key(s, every, np.full(CODES, self.rare)) for s in range(k)])

    @classmethod
    def of(cls, bands: int, rows: int) -> Sampler:
        if (bands, rows) not in cls.made:
            cls.made[bands, rows] = cls(bands, rows)
        return cls.made[bands, rows]

    @staticmethod
    def level(weight: np.ndarray) -> np.ndarray:
        return np.rint(np.log2(weight) * STEPS_AN_OCTAVE).astype(np.int64)

    def key(self, s: int, code: np.ndarray, level: np.ndarray) -> np.ndarray:
        """a as the upper half of a 64-bit key; positive floats sort like their bits."""
        r = self.r[s][code]
        t = np.floor(level.astype(np.float32) * np.float32(np.log(2) / STEPS_AN_OCTAVE) / r + self.beta[s][code])
        a = np.exp(np.clip(self.log_c[s][code] - r * (t - self.beta[s][code] + 1), -80, 80)).astype(np.float32)
        return a.view(np.uint32).astype(np.uint64) << np.uint64(32)

    def band_hashes(self, first: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(rows that have shingles) x bands; first: where each such row's shingles start."""
        level = self.level(weight)
        other = np.flatnonzero(level != self.rare)
        out = np.zeros((len(first), self.bands), np.uint64)
        low = np.uint64(0xFFFFFFFF)
        for s in range(self.bands * self.rows):
            x = shingle * self.odd[s]
            code = (x >> np.uint64(50)).astype(np.int64)
            key = self.table[s][code]
            if len(other):
                key[other] = self.key(s, code[other], level[other])
            key |= (x >> np.uint64(16)) & low
            out[:, s // self.rows] += np.minimum.reduceat(key, first) * self.join[s // self.rows, s % self.rows]
        return mix(out) ^ mix(np.arange(self.bands, dtype=np.uint64) + np.uint64(1))


def signatures(docs: DataFrame, idf, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, h1, h2, bands) of the rows of ``docs`` that have words and a doc_id; idf: a broadcast table."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler.of(bands, rows)
        for batch in batches:
            off, buf = text_bytes(batch.column(1))
            for i, j in blocks(off, 1 << 19):
                row, shingle, count, h1, h2 = shingle_rows(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                if not len(row):
                    continue
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                found = sampler.band_hashes(first, shingle, count * idf.value[cell_of(shingle)]).view(np.int64)
                at = row[first]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * bands + 1, bands, dtype=np.int32)), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(at)), pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), lists], ["doc_id", "h1", "h2", "bands"])

    schema = StructType([docs.schema["doc_id"], StructField("h1", LongType()), StructField("h2", LongType()), StructField("bands", ArrayType(LongType()))])
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(trimmed(sign), schema)


def weighted_sets(texts: list[bytes], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shingles in order, weights) of each text."""
    out: list = []
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    for i, j in blocks(off, 1 << 20):
        row, shingle, count, *_ = shingle_rows(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        weight, edge = count * idf[cell_of(shingle)], np.searchsorted(row, np.arange(j - i + 1))
        out += [(shingle[a:b], weight[a:b]) for a, b in zip(edge[:-1], edge[1:])]
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if len(a[0]) < len(b[0]):
        a, b = b, a
    if not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    common = np.minimum(a[1][at[same]], b[1][same]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b, sim) for the pairs (a, b); texts (doc_id, text packed)."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}
        for batch in batches:
            a = batch.column(0).to_pylist()
            new: dict = {}
            for k, x in enumerate(a):
                if x not in last and x not in new:
                    new[x] = batch.column(2)[k].as_py()
            sets = dict(zip(new, weighted_sets(unpack(list(new.values())), idf.value)))
            here = set(a)
            last = {x: v for x, v in last.items() if x in here} | sets
            mine = weighted_sets(unpack(batch.column(3).to_pylist()), idf.value)
            sims = [weighted_jaccard(last[x], m) for x, m in zip(a, mine)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    of_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = of_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(trimmed(check), StructType([both.schema["a"], both.schema["b"], StructField("sim", DoubleType())]))


def tile_forest(left: list[tuple], right: list[tuple], threshold: float) -> list[tuple[int, int]]:
    """Edges between places of left, then right, that connect what the links between left and right connect.

    left, right: (shingles, weights, counts).  A shingle that occurs n times counts as n elements, so that the sum of
    the smaller weights is a product of zeros and ones.
    """
    sets = [*left, *right]
    size = [len(s[0]) for s in sets]
    row = np.repeat(np.arange(len(sets)), size)
    shingle, weight, count = (np.concatenate([s[k] for s in sets]) for k in range(3))
    times = np.repeat(np.arange(len(shingle)), count)
    nth = np.arange(len(times)) - np.repeat(np.cumsum(count) - count, count)
    element = mix(shingle[times]) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    row, single = row[times], (weight / count)[times]
    _, column, seen = np.unique(element, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    row, column, single = row[shared], column[shared], single[shared]
    order = np.argsort(column, kind="stable")
    row, column, single = row[order], column[order], single[order]
    new = np.cumsum(np.r_[False, column[1:] != column[:-1]])
    common = np.zeros((len(left), len(right)))
    for lo in range(0, int(new[-1]) + 1 if len(new) else 0, 4096):
        a, b = np.searchsorted(new, (lo, lo + 4096))
        one = np.zeros((len(sets), 4096))
        one[row[a:b], new[a:b] - lo] = 1.0
        of = np.zeros(4096)
        of[new[a:b] - lo] = single[a:b]
        common += (one[: len(left)] * of) @ one[len(left) :].T
    total = np.array([s[1].sum() for s in sets])
    link = common >= threshold * (total[: len(left), None] + total[None, len(left) :] - common) - 1e-9
    link &= (total[: len(left)] > 0)[:, None] & (total[len(left) :] > 0)[None, :]
    forest = Forest(len(sets))
    i, j = np.nonzero(link)
    forest.add(i, j + len(left))
    return [(k, int(r)) for k, r in enumerate(forest.root) if r != k]


def _counted_sets(texts: list[bytes], idf: np.ndarray) -> list[tuple]:
    return [(s, w, np.rint(w / idf[cell_of(s)]).astype(np.int64)) for s, w in weighted_sets(texts, idf)]


def _tile_rows(idf, threshold: float):
    """Edges (a, b) of each tile; rows come sorted by (bucket, block_f, block_a), a tile's rows together."""
    def edges(tile: list[tuple]) -> list[tuple]:
        # texts stay packed until their part of the tile is due; parts are small where texts are long
        f, a = [t for t in tile if t[1]], [t for t in tile if not t[1]]
        step = 128 if sum(len(t[2]) for t in tile) < 2 << 20 else 16
        found = []
        for x in range(0, len(f), step):
            left = _counted_sets(unpack([t[2] for t in f[x : x + step]]), idf.value)
            for y in range(0, len(a), step):
                right = _counted_sets(unpack([t[2] for t in a[y : y + step]]), idf.value)
                names = [t[0] for t in (*f[x : x + step], *a[y : y + step])]
                found += [(names[p], names[q]) for p, q in tile_forest(left, right, threshold) if names[p] != names[q]]
        return list(dict.fromkeys(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile, found, kind = None, [], [], pa.int64()
        for batch in batches:
            kind = batch.column(3).type
            for bucket, f, a, head, left, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, f, a) != now:
                    found += edges(tile)
                    now, tile = (bucket, f, a), []
                tile.append((head, left, text))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([y for _, y in found], kind)], ["a", "b"])
            found = []
        if tile:
            found = edges(tile)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([y for _, y in found], kind)], ["a", "b"])

    return run


def _rest_of_buckets(members: DataFrame, links: DataFrame, texts: DataFrame, idf, threshold: float, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) between members of a bucket of which one isn't in the component of the bucket's center; None: none left."""
    labels = connected_components(links.select("a", "b"), scratch)
    own = members.join(labels.select(F.col("node").alias("head"), F.col("component").alias("of_head")), "head", "left")
    own = own.join(labels.select(F.col("node").alias("center"), F.col("component").alias("of_center")), "center", "left")
    apart = F.coalesce("of_head", "head") != F.coalesce("of_center", "center")
    own = scratch.table(own.select("bucket", "head", apart.alias("apart")), "own")
    todo = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("apart").alias("f")).where("n > 2 and f > 0")
    parts = lambda c: F.ceil(F.col(c) / TILE_ROWS).cast("int")
    todo = scratch.table(todo.select("bucket", parts("n").alias("blocks"), parts("f").alias("apart_blocks")), "todo")
    if not todo.limit(1).count():
        return None
    # apart members stand in blocks of their own: what is sent grows with them, not with the bucket's square
    rows = own.join(todo, "bucket")
    block = lambda c: F.pmod(F.xxhash64("head"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.where("apart").select("bucket", block("apart_blocks").alias("f"), every("blocks").alias("a"), "head", F.lit(True).alias("left"))
    right = rows.select("bucket", every("apart_blocks").alias("f"), block("blocks").alias("a"), "head", F.lit(False).alias("left"))
    tiles = scratch.table(left.unionByName(right), "tiles")
    tiles = tiles.join(texts.select(F.col("doc_id").alias("head"), "text"), "head").select("bucket", "f", "a", "head", "left", "text")
    n = bounded_partitions(tiles.sparkSession)
    tiles = tiles.repartition(n, "bucket", "f", "a").sortWithinPartitions("bucket", "f", "a")
    kind = tiles.schema["head"].dataType
    return scratch.table(tiles.mapInArrow(trimmed(_tile_rows(idf, threshold)), StructType([StructField("a", kind), StructField("b", kind)])), "rest")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, kept) for each row of ``docs`` (doc_id, text); class_id is the smallest doc_id of the class."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    idf = spark.sparkContext.broadcast(document_frequencies(docs))
    signed = scratch.table(signatures(docs, idf, bands, rows), "signed")
    classes = scratch.table(signed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "bands")).alias("one")).select("h1", "h2", F.col("one.doc_id").alias("head"), "one.bands"), "classes")
    placed = classes.select("head", F.explode("bands").alias("bucket"))
    buckets = scratch.table(placed.groupBy("bucket").agg(F.min("head").alias("center"), F.max("head").alias("last")).where("center <> last").select("bucket", "center"), "buckets")
    members = scratch.table(placed.join(buckets, "bucket"), "members")
    stars = scratch.table(members.where("head <> center").select(F.col("center").alias("a"), F.col("head").alias("b")).distinct(), "stars")
    wanted = stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id"))).distinct()
    # the same way at every size: whole texts are dealt by doc_id to meet those that are wanted
    texts = packed(docs.where("doc_id is not null"), "text", "doc_id").join(wanted.hint("merge"), "doc_id")
    texts = scratch.table(texts.select("doc_id", "text").distinct(), "texts")
    links = scratch.table(verified(stars, texts, idf).where(F.col("sim") >= threshold).select("a", "b"), "links")
    rest = _rest_of_buckets(members, links, texts, idf, threshold, scratch)
    links = links if rest is None else links.unionByName(rest)
    labels = connected_components(links, scratch)
    heads = classes.select("h1", "h2", "head").join(labels.withColumnRenamed("node", "head"), "head", "left").select("h1", "h2", F.coalesce("component", "head").alias("class_id"))
    heads = scratch.table(heads, "heads")
    of = scratch.table(signed.select("doc_id", "h1", "h2").join(heads, ["h1", "h2"]).select("doc_id", "class_id"), "of")
    bare = docs.select("doc_id", "text").where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]")).select("doc_id", F.col("doc_id").alias("class_id"))
    out = of.unionByName(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
    out = scratch.finish(out, "classes-of")
    idf.unpersist()
    return out


def deduplicate(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the text of its smallest doc_id stays, once.

    Rows with a null doc_id, and texts without words, stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "deduplicate")
    of = near_duplicates(docs.select("doc_id", "text"), **settings)
    heads = of.where(F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    rows = packed(docs.where("doc_id is not null").select("text", F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("_row"), text_key().alias("_key"), F.col("doc_id").alias("_doc")), "text", "_row", "_key", "_doc")
    rows = rows.join(heads, F.col("_doc") == F.col("_id")).dropDuplicates(["_doc", "_key"]).select("_row", "text")
    opened = rows.mapInArrow(open_texts, StructType([rows.schema["_row"], StructField("text", StringType())]))
    opened = opened.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    return scratch.finish(opened.unionByName(docs.where("doc_id is null")), "deduplicated")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
