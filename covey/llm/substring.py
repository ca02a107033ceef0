"""Substring dedup by seed and extend over winnowed anchors.

Words are runs of bytes other than 0x20 and 0x09-0x0D.  A window is ``window`` consecutive words of one document; a
word goes when a window that covers it has the same words as a window that starts anywhere else.

Seeds.  Winnowing with seeds of SEED words and windows of ``window - SEED + 1`` seeds gives each window the seed of
the smallest hash in it (the rightmost on ties) as its anchor.  The choice depends on the window's words alone, so
two equal windows have equal anchors at the same offset, and no repeat of ``window`` words can be missed.

Extend.  The windows that one anchor stands for are a run of starts; their union is the anchor's context.  Anchors
are joined on the seed.  Where contexts are equal, the match extends both ways over all of it and every window in it
repeats.  Where the contexts of a seed differ, one occurrence of each different context is extended window by window
over its text, and windows found in two contexts repeat.  Runs that touch merge into maximal repeats.

Scale: seeds are counted with partial aggregation (a copied passage costs a row for each task and key); joins back to
the occurrences have both sides read from written tables, so AQE can split hot seeds; a passage that thousands of
documents share is extended once for each different context, never for each pair.

Edge cases: a null text has no words; documents below ``window`` words lose nothing; repeated rows are documents of
their own (all their windows repeat); rows with a null doc_id are treated like others; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from covey.llm.common import Grams, Scratch, blocks, packed, text_bytes, text_key, trimmed, unpack, word_hashes

WINDOW = 35
SEED = 8


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of every ``width`` values, the rightmost on ties, by doubling."""
    pos = np.arange(len(values), dtype=np.int64)
    have = 1
    while have < width:
        step = min(have, width - have)
        a, b = values[:-step], values[step:]
        right = b <= a
        values, pos = np.where(right, b, a), np.where(right, pos[step:], pos[:-step])
        have += step
    return pos


def anchors_of(h: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(row, first window's start, windows, anchor) of each run of windows with one anchor; positions count all words."""
    n, grams = len(h), Grams(h)
    length = np.diff(first)
    start = np.zeros(max(0, n - window + 1), bool)
    row_of = np.repeat(np.arange(len(length)), length)
    if len(start):
        start = row_of[: len(start)] == row_of[window - 1 :]
    where = np.flatnonzero(start)
    if not len(where):
        none = np.zeros(0, np.int64)
        return none, none, none, none, grams
    anchor = sliding_argmin(grams.all(seed, salt=1), window - seed + 1)[where]
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return row_of[where[new]], where[new], np.diff(np.r_[new, len(where)]), anchor[new], grams


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        off, buf = text_bytes(batch.column(2))
        for i, j in blocks(off):
            o = off[i : j + 1] - off[i]
            h, first = word_hashes(buf[off[i] : off[j]], o)
            row, start, n, anchor, grams = anchors_of(h, first, window, seed)
            if not len(row):
                continue
            context = grams.of(start, start + n + window - 1, salt=2) ^ (n.astype(np.uint64) << np.uint64(32)) ^ (anchor - start).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams.of(anchor, anchor + seed, salt=3).view(np.int64)), pa.array(context.view(np.int64)), batch.column(0).slice(i, j - i).take(pa.array(row)), batch.column(1).slice(i, j - i).take(pa.array(row)), pa.array((start - first[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["seed", "context", "doc_id", "key", "start", "n"],
            )


def _window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of the anchors that are listed with a text."""
    for batch in batches:
        texts, lists = unpack(batch.column(2).to_pylist()), batch.column(3).to_pylist()
        out: list[list] = [[], [], [], [], [], []]
        for k, (text, items) in enumerate(zip(texts, lists)):
            h, _ = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            grams = Grams(h)
            start = np.array([x["start"] for x in items], np.int64)
            n = np.array([x["n"] for x in items], np.int64)
            at = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            out[0].append(np.repeat(np.array([x["seed"] for x in items], np.int64), n))
            out[1].append(grams.of(at, at + window, salt=4).view(np.int64))
            out[2].append(np.full(len(at), k))
            out[3].append(at)
            out[4].append(np.repeat(np.array([x["single"] for x in items], bool), n))
        if not out[0]:
            continue
        seed, gram, row, at, single = (np.concatenate(x) for x in out[:5])
        row = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(gram), batch.column(0).take(row), batch.column(1).take(row), pa.array(at.astype(np.int32)), pa.array(single)], ["seed", "gram", "doc_id", "key", "start", "single"])


def merged_runs(runs: list[dict], window: int) -> list[tuple[int, int]]:
    """Word ranges that the runs of windows cover, as maximal ranges that neither touch nor overlap."""
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["start"] + x["n"] + window - 1) for x in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept_rows(batches: Iterator[pa.RecordBatch], window: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, total, removed, kept, ranges = batch.column(0), [], [], [], []
        for text, runs in zip(unpack(batch.column(1).to_pylist()), batch.column(2).to_pylist()):
            words = text.split()
            cut = merged_runs(runs or [], window)
            total.append(len(words))
            removed.append(sum(b - a for a, b in cut))
            ends = [0, *(x for r in cut for x in r), len(words)]
            kept.append(b" ".join(w for a, b in zip(ends[::2], ends[1::2]) for w in words[a:b]))
            ranges.append([{"start": a, "end": b} for a, b in cut])
        yield pa.RecordBatch.from_arrays([rows, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(ranges, schema.field(4).type)], schema=pa.schema([pa.field("_row", rows.type), *list(schema)[1:]]))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n_words, n_removed, kept_text and repeats (word ranges removed).

    Input columns named like one of these four are replaced.
    """
    if window < seed:
        raise ValueError("window must be at least the seed's length")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    id_type = docs.schema["doc_id"].dataType
    added = ["n_words", "n_removed", "kept_text", "repeats"]
    keyed = docs.select("doc_id", text_key().alias("key"), "text")
    run = [StructField("doc_id", id_type), StructField("key", LongType()), StructField("start", IntegerType()), StructField("n", IntegerType())]
    anchors = keyed.mapInArrow(trimmed(lambda b: _anchor_rows(b, window, seed)), StructType([StructField("seed", LongType()), StructField("context", LongType()), *run]))

    seeds = scratch.table(anchors.groupBy("seed").agg(F.count(F.lit(1)).alias("c"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("c > 1").select("seed", (F.col("lo") != F.col("hi")).alias("mixed")), "seeds")
    shared = scratch.table(anchors.join(seeds, "seed"), "shared")
    whole = shared.where("not mixed").select("doc_id", "key", "start", "n")

    contexts = scratch.table(
        shared.where("mixed").groupBy("seed", "context").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "key", "start", "n")).alias("one")).select("seed", "context", (F.col("c") == 1).alias("single"), "one.*"), "contexts"
    )
    again = shared.where("mixed").join(contexts.where("not single").select("seed", "context"), ["seed", "context"]).select("doc_id", "key", "start", "n")

    texts = packed(keyed, "text", "doc_id", "key").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "text")
    lists = contexts.groupBy("doc_id", "key").agg(F.collect_list(F.struct("seed", "start", "n", "single")).alias("items"))
    # copies of a row would repeat its windows: one row stands for equal texts of an id
    read = lists.join(texts, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("key") == F.col("_key")))
    windows = read.select("doc_id", "key", "text", "items").mapInArrow(
        trimmed(lambda b: _window_rows(b, window)), StructType([StructField("seed", LongType()), StructField("gram", LongType()), *run[:3], StructField("single", BooleanType())])
    )
    windows = scratch.table(windows, "windows")
    # a window of a context repeats if another context of the seed has it; copies of the row itself share their place
    grams = scratch.table(windows.groupBy("seed", "gram").agg(F.min(F.struct("doc_id", "key", "start")).alias("lo"), F.max(F.struct("doc_id", "key", "start")).alias("hi")).where("lo <> hi or (lo.doc_id is null) <> (hi.doc_id is null)").select("seed", "gram"), "grams")
    edges = windows.where("single").join(grams, ["seed", "gram"]).select("doc_id", "key", "start", F.lit(1).alias("n"))

    runs = whole.unionByName(again).unionByName(edges).groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    carried = [F.col(c) for c in docs.columns if c not in ("text", *added)]
    rows = packed(docs.select("text", F.struct(*carried).alias("_row"), F.col("doc_id").alias("_id"), text_key().alias("_key"), F.col("text").isNull().alias("_null")), "text", "_row", "_id", "_key", "_null")
    joined = rows.join(runs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("_row", "text", "runs")
    schema = StructType([
        joined.schema["_row"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("_kept", BinaryType()),
        StructField("repeats", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))),
    ])
    arrow = to_arrow_schema(schema)
    out = joined.mapInArrow(trimmed(lambda b: _kept_rows(b, window, arrow)), schema)
    out = out.select("_row.*", "n_words", "n_removed", F.col("_kept").cast(StringType()).alias("kept_text"), "repeats")
    return scratch.finish(out, "substring-kept")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
