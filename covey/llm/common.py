"""What the llm operators share: scratch tables in the cluster's shared folder and vectorised text kernels.

The kernels work on the bytes of a whole Arrow batch at once.  A word is a maximal run of bytes other than
0x20 and 0x09-0x0D; its hash is a polynomial over a random byte table, modulo 2**64, mixed afterwards.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Only a local session may name none (a temporary one)."""
    where = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="covey-shared-"))
    return "file://" + _LOCAL[0].name


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables that cut lineage: they survive lost executors, unlike cached or locally checkpointed rows.

    ``table`` writes and rereads; ``drop`` removes what later steps no longer read; ``keep`` marks the table that
    the returned DataFrame reads, which stays until the interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._covey_scratch = (self, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            delete_path(self.spark, frame._covey_scratch[1])

    def finish(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Writes the result to a folder of its own and removes every other table of this scratch space."""
        final = Scratch(self.spark, name)
        out = final.table(df, name)
        delete_path(self.spark, self.root)
        _KEPT.append(final.root)
        return out


_KEPT: list[str] = []


@atexit.register
def _remove_kept() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in _KEPT:
            delete_path(spark, path)


def clear_kept(spark: SparkSession) -> None:
    """Removes the results of earlier calls; DataFrames that read them can't be used any more."""
    while _KEPT:
        delete_path(spark, _KEPT.pop())


def _trimmer():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def trimmed(run):
    """A function of batches that gives its freed memory back at the end: workers stay, and several stand beside each other."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trimmer()(0)

    return wrapped


def with_output(df: DataFrame, wanted: list[str]) -> list[str]:
    """The input's columns that an output of these names leaves in place."""
    return [c for c in df.columns if c not in wanted]


def bounded_partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- text kernels -------------------------------------------------------------------------------------------------

WS = np.zeros(256, bool)
WS[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, GRAM_BASE = 0x9E3779B97F4A7C15, 0xA24BAED4963EE407
PIECE = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16, 0 if have is None else 2 * len(have)), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n or column.buffers()[1] is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], buf[off[0] : off[-1]]


def blocks(off: np.ndarray, most: int = 4 << 20, rows: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows with about ``most`` bytes; a row of more is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1))
        yield i, j
        i = j


def _pieces(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that end between words."""
    p, n = 0, len(buf)
    while p < n:
        q = p + PIECE
        while q < n:
            space = np.flatnonzero(WS[buf[p:q]])
            row = int(off[np.searchsorted(off, q, "right") - 1])
            cut = max(p + int(space[-1]) + 1 if len(space) else p, row)
            if cut > p:
                q = cut
                break
            q += q - p
        q = min(q, n)
        yield p, q
        p = q


def spans(buf: np.ndarray, off: np.ndarray, p: int, q: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, relative to p, of the runs of bytes for which ``inside``; runs stop at row ends."""
    w = inside[buf[p:q]]
    edge = off[np.searchsorted(off, p) : np.searchsorted(off, q)] - p
    first, last = np.empty(q - p, bool), np.empty(q - p, bool)
    first[0], last[-1] = True, True
    np.logical_not(w[:-1], out=first[1:])
    np.logical_not(w[1:], out=last[:-1])
    first[edge] = True
    last[edge[edge > 0] - 1] = True
    return np.flatnonzero(w & first), np.flatnonzero(w & last) + 1


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end]; codes are 64-bit values of a piece of bytes."""
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes * powers(BASE, len(codes)), out=total[1:])
    return mix((total[end] - total[start]) * powers(inverse(BASE), len(codes) + 1)[start])


def word_hashes(buf: np.ndarray, off: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and for each row the index of its first word (one more at the end).  fold: ASCII case."""
    code = BYTE_CODE[LOWER] if fold else BYTE_CODE
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for p, q in _pieces(buf, off):
        s, e = spans(buf, off, p, q, ~WS)
        hashes.append(span_hashes(code[buf[p:q]], s, e))
        starts.append(s + p)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off)


def word_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    starts = [np.zeros(0, np.int64)]
    for p, q in _pieces(buf, off):
        starts.append(spans(buf, off, p, q, ~WS)[0] + p)
    return np.diff(np.searchsorted(np.concatenate(starts), off))


class Grams:
    """Hashes of any run of consecutive words, from prefix sums."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        self.total = np.empty(self.n + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(h * powers(GRAM_BASE, self.n), out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * powers(inverse(GRAM_BASE), self.n + 1)[start], salt)

    def all(self, k: int, salt: int = 0) -> np.ndarray:
        """Of every k words, also those that cross rows."""
        m = max(0, self.n + 1 - k)
        return mix((self.total[k:] - self.total[:m]) * powers(inverse(GRAM_BASE), m), salt) if m else np.zeros(0, np.uint64)


def minus_text(df: DataFrame, text: str = "text") -> list[str]:
    return [c for c in df.columns if c != text]


def packed(df: DataFrame, text: str, *others: str) -> DataFrame:
    """``text`` as Zstandard frames, so that a shuffle of whole texts moves about two fifths of the bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            i = batch.schema.get_field_index(text)
            column = batch.column(i).cast(pa.binary())
            small = pa.array([None if v is None else press.compress(v) for v in column.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([small if j == i else batch.column(j) for j in range(batch.num_columns)], batch.schema.names)

    rows = df.select(text, *others)
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([StructField(f.name, BinaryType(), True) if f.name == text else f for f in rows.schema.fields])
    return rows.mapInArrow(trimmed(pack), schema)


def unpack(values: list) -> list[bytes]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return [b"" if v is None else press.decompress(v) for v in values]


def open_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of any column and packed texts, with the texts unpacked."""
    for batch in batches:
        values = batch.column(1).to_pylist()
        texts = pa.array([None if v is None else t for v, t in zip(values, unpack(values))], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], [batch.schema.names[0], "text"])


def text_key(text: str = "text"):
    """Tells rows of one id but different texts apart: 64 bits of two unlike hashes (a null text is 0)."""
    wide = F.xxhash64(F.col(text)).bitwiseXOR(F.shiftleft(F.crc32(F.col(text).cast("binary")), 31))
    return F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(wide)
