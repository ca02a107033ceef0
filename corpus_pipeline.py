"""A training corpus from raw documents: five stages, each written and read again before the next.

Rejected documents go, one document of each near-duplicate class stays, repeated passages are cut, sources are mixed to
their target weights (rows repeat as often as the mix takes them), and texts become token ids.

Edge cases.  Null and empty texts are scored like texts without words, are no near duplicates, lose nothing, have size 0
and so aren't taken by the mix.  Rows with a null doc_id stay apart from near-dedup; repeated rows of one doc_id and text
become one there.  Columns beside doc_id, text and source go along untouched, whatever their names (n_chars follows the
text).  Without labels of both classes no row scores high enough to go.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covey.llm.common import Scratch
from covey.llm.minhash import deduplicate
from covey.llm.mixing import mixed_rows
from covey.llm.sentencepiece_scan import encode_documents
from covey.llm.substring import dedup_substrings
from covey.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(docs, labels).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = dedup_substrings(docs)
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs.select("doc_id", "text")).select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip", "token_ids")


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeats), ("source_mixing", mix), ("sentencepiece", encode)]
ORACLE_SQL = None  # model scores, weighted samples and piece merges aren't expressible; tests hold every stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return scratch.finish(stage(spark, docs, sf_dir), name)
