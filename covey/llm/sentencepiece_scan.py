"""SentencePiece encoding and decoding with a max-plus parallel scan over giant documents.

Documents of up to GIANT characters are encoded in place.  Larger ones are split into chunks of CHUNK characters with a
little context, dealt out over all tasks:

1. each chunk yields the transfer matrix between the states at its two ends (see ``piecelattice``),
2. the matrices of FAN neighbouring chunks are multiplied, then those of FAN such groups, until a document has one,
3. back down, each group whose end states are known fixes the states between its members,
4. each chunk is backtraced on its own between its two states, and the ids are put together in order.

Both ways give exactly the ids of the library's own encoder, for models that merge pieces and for unigram models, of
which the scores decide (of paths with equal scores, as in a long run of one character, any may come).  Decoding turns ids back into the text.

Scale: only giant documents are shuffled.  A task holds one batch of texts; steps 2 and 3 see FAN matrices of some
hundred entries at once, however long the document, in as many rounds as the logarithm of its chunks.  The model is read
on the driver, from a path that is a parameter, and broadcast (a few megabytes); each worker opens it once.

Edge cases: a null or empty text has no ids and decodes to the empty text; repeated rows each get their row; an empty
table gives an empty result.  Text has no surrogates, so every character has its UTF-8 bytes as fallback.  The space
mark U+2581 in a text is a space to the library, and decodes as one: round_trip is false there.  Other columns of the
input are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from covey.llm.common import Scratch, bounded_partitions, text_key, trimmed
from covey.llm.piecelattice import MARK, NEVER, Chunk, Pieces, multiply

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
GIANT, CHUNK, FAN = 1 << 15, 1 << 13, 64


def shared_model(spark: SparkSession, model_file: str):
    with open(model_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def id_lists(parts: list[bytes]) -> pa.Array:
    off = np.r_[0, np.cumsum([len(p) // 4 for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _encode_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    pieces = Pieces.of(model.value)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = pc.fill_null(part.column(0), "")
            ids = id_lists([pieces.encode(t) for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns[1:], ids, pc.equal(pieces.decode(ids), texts)], [*part.schema.names[1:], "token_ids", "round_trip"])


def _split_rows(batches: Iterator[pa.RecordBatch], model, size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, chunk, chunks, lo, hi, text) of each chunk; text has the context, lo and hi point into it."""
    around = 2 * Pieces.of(model.value).longest
    for batch in batches:
        for k, text in enumerate(batch.column(0).to_pylist()):
            marked = MARK + text.replace(" ", MARK)
            number = -(-len(marked) // size)
            rows = []
            for c in range(number):
                a, b = c * size, min(len(marked), (c + 1) * size)
                lo = max(0, a - around)
                rows.append((c, number, a - lo, b - lo, marked[lo : b + around]))
            where = pa.array(np.full(number, k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(where), batch.column(2).take(where), *(pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())))],
                ["doc_id", "key", "chunk", "chunks", "lo", "hi", "text"],
            )


def _chunk(pieces: Pieces, row: dict) -> Chunk:
    return Chunk(pieces, row["text"], row["lo"], row["hi"], row["chunk"] == 0, row["chunk"] == row["chunks"] - 1)


def _matrix_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    pieces = Pieces.of(model.value)
    for batch in batches:
        found = [_chunk(pieces, r).matrix() for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *packed_matrices(found)], ["doc_id", "key", "chunk", "states", "matrix"])
    pieces.forget()


def packed_matrices(found: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([m.shape[0] for m in found], pa.int32()), pa.array([m.astype(np.float64).tobytes() for m in found], pa.binary())]


def matrices_of(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(m, np.float64).reshape(n, -1) for m, n in zip(table["matrix"].to_pylist(), table["states"].to_pylist())]


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Max-plus product of neighbours, in pairs: the order of the factors counts, their grouping doesn't."""
    while len(matrices) > 1:
        matrices = [multiply(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def states_between(matrices: list[np.ndarray], before: int, after: int) -> list[int]:
    """The states behind each factor on the best way from state ``before`` of the first to ``after`` of the last."""
    upto = [matrices[0][before]]
    for m in matrices[1:]:
        upto.append((upto[-1][:, None] + m).max(axis=0))
    out = [after] * len(matrices)
    for k in range(len(matrices) - 1, 0, -1):
        way = upto[k - 1] + matrices[k][:, out[k]]
        out[k - 1] = int(np.argmax(way))
        if way[out[k - 1]] == NEVER:
            raise ValueError("no path through the pieces of a document")
    return out


def _product_rows(table: pa.Table) -> pa.Table:
    """One row for a group of neighbours: chunk becomes the group's number."""
    table = table.sort_by("chunk")
    one = table.slice(0, 1)
    states, matrix = packed_matrices([product(matrices_of(table))])
    return pa.table({"doc_id": one["doc_id"], "key": one["key"], "chunk": one["group"], "states": states, "matrix": matrix})


def _state_rows(table: pa.Table) -> pa.Table:
    """(doc_id, key, chunk, before, after) of the members of a group, from the group's own before and after (-1: the best)."""
    table = table.sort_by("chunk")
    matrices = matrices_of(table)
    first, last = table["before"][0].as_py(), table["after"][0].as_py()
    if last < 0:
        last = int(np.argmax(product(matrices)[first]))
    after = states_between(matrices, first, last)
    return pa.table({"doc_id": table["doc_id"], "key": table["key"], "chunk": table["chunk"], "before": pa.array([first, *after[:-1]], pa.int32()), "after": pa.array(after, pa.int32())})


def _matching(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """Joins on columns of which those of doc_id may be null."""
    other = b.select(*[F.col(c).alias(f"_{c}") if c in columns else F.col(c) for c in b.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return a.join(other, on).drop(*[f"_{c}" for c in columns])


def chosen_states(matrices: DataFrame, scratch: Scratch, fan: int = FAN) -> DataFrame:
    """(doc_id, key, chunk, before, after): the states at each chunk's ends on its document's best path."""
    schema = matrices.schema
    levels = [matrices]
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) >= fan:
        grouped = levels[-1].withColumn("group", F.floor(F.col("chunk") / fan)).groupBy("doc_id", "key", "group")
        levels.append(scratch.table(grouped.applyInArrow(_product_rows, schema), "products"))
    states = StructType([*schema.fields[:3], StructField("before", IntegerType()), StructField("after", IntegerType())])
    top = levels[-1].withColumns({"before": F.lit(0), "after": F.lit(-1)})
    found = scratch.table(top.groupBy("doc_id", "key").applyInArrow(_state_rows, states), "states")
    for level in levels[-2::-1]:
        members = _matching(level.withColumn("group", F.floor(F.col("chunk") / fan)), found.withColumnRenamed("chunk", "group"), "doc_id", "key", "group")
        found = scratch.table(members.groupBy("doc_id", "key", "group").applyInArrow(_state_rows, states), "states")
    return found


def _trace_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    pieces = Pieces.of(model.value)
    for batch in batches:
        rows = batch.to_pylist()
        ids = [_chunk(pieces, r).ids(r["before"], r["after"]) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("chunk"), id_lists(ids)], ["doc_id", "key", "chunk", "ids"])
    pieces.forget()


def decode_rows(rows: DataFrame, model_file: str = MODEL_FILE, ids: str = "token_ids", to: str = "text") -> DataFrame:
    """``rows`` with the text of its ids; a column named ``to`` is replaced."""
    model = shared_model(rows.sparkSession, model_file)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces.decode(batch.column(0))], [*batch.schema.names, to])

    kept = rows.select(ids, *[c for c in rows.columns if c not in (ids, to)])
    return kept.mapInArrow(decode, StructType([*kept.schema.fields, StructField(to, StringType())]))


def encode_documents(docs: DataFrame, model_file: str = MODEL_FILE, giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(doc_id, token_ids, round_trip) for each row of ``docs`` (doc_id, text); round_trip: the ids decode to the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sentencepiece")
    model = shared_model(spark, model_file)
    id_field = docs.schema["doc_id"]
    added = [StructField("token_ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())]
    long = F.coalesce(F.length("text"), F.lit(0)) > giant
    small = docs.where(~long).select("text", "doc_id").mapInArrow(trimmed(lambda b: _encode_rows(b, model)), StructType([id_field, *added]))
    head = [StructField("doc_id", id_field.dataType), StructField("key", LongType()), StructField("chunk", LongType())]
    large = docs.where(long).select("text", "doc_id", text_key().alias("key"))
    parts = large.dropDuplicates(["doc_id", "key"]).mapInArrow(trimmed(lambda b: _split_rows(b, model, chunk)), StructType([*head, StructField("chunks", LongType()), StructField("lo", IntegerType()), StructField("hi", IntegerType()), StructField("text", StringType())]))
    parts = scratch.table(parts.repartition(bounded_partitions(spark), "doc_id", "key", "chunk"), "chunks")
    matrices = parts.mapInArrow(trimmed(lambda b: _matrix_rows(b, model)), StructType([*head, StructField("states", IntegerType()), StructField("matrix", BinaryType())]))
    ready = _matching(parts, chosen_states(scratch.table(matrices, "matrices"), scratch, fan), "doc_id", "key", "chunk")
    traced = ready.mapInArrow(trimmed(lambda b: _trace_rows(b, model)), StructType([*head, StructField("ids", ArrayType(IntegerType()))]))
    whole = traced.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("all")).select("doc_id", "key", F.flatten("all.ids").alias("token_ids"))
    joined = _matching(large, whole, "doc_id", "key").select("doc_id", "token_ids", F.col("text").alias("original"))
    checked = decode_rows(joined, model_file).select("doc_id", "token_ids", (F.col("text") == F.col("original")).alias("round_trip"))
    return small.unionByName(scratch.finish(checked, "giant-documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs).select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip", "token_ids")
