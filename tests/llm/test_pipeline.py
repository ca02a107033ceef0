import re

import sentencepiece

import corpus_pipeline
from covey.llm import toxicity
from covey.llm.common import Scratch, text_bytes
from covey.llm.minhash import THRESHOLD
from covey.llm.sentencepiece_scan import MODEL_FILE
from test_minhash import weighted_brute
from test_mixing import waterfill
from test_substring import brute

import pyarrow as pa

LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)


def test_stages_against_brute_force(spark, small):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.table(stage(spark, docs, small), name)
        steps[name] = (docs.collect(), out.collect())
        if name != "sentencepiece":
            assert out.columns == docs.columns
        docs = out

    # each text scored on its own by the model that the labels give
    before, after = steps["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{small}/documents.parquet"), labels)
    bad = set()
    for r in before:
        off, buf = text_bytes(pa.array([r["text"]], pa.string()))
        if model.score(toxicity.Pass(buf, off))[0] >= toxicity.THRESHOLD:
            bad.add(r["doc_id"])
    assert bad and {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - bad

    # all pairs by weighted similarity
    before, after = steps["minhash_near_dedup"]
    root = {r["doc_id"]: r["doc_id"] for r in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    close = 0
    for i, j, sim in weighted_brute([r["text"] for r in before]):
        close += abs(sim - THRESHOLD) < 0.02
        if sim >= THRESHOLD:
            a, b = find(before[i]["doc_id"]), find(before[j]["doc_id"])
            root[max(a, b)] = min(a, b)
    differ = {d for d in root if find(d) == d} ^ {r["doc_id"] for r in after}
    assert len(differ) <= close  # pairs at the threshold itself, where hashed document frequencies may decide

    before, after = steps["substring_dedup"]
    want = {d: k for d, _, _, k in brute([(r["doc_id"], r["text"]) for r in before], 35)}
    assert {r["doc_id"]: r["text"] for r in after} == want and all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = steps["source_mixing"]
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in before}
    sizes: dict = {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words[r["doc_id"]]
    taken = dict.fromkeys(sizes, 0)
    copies: dict = {}
    for r in after:
        taken[r["source"]] += words[r["doc_id"]]
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 2 and {tuple(r) for r in after} <= {tuple(r) for r in before}
    for s, t in waterfill(sizes).items():
        assert abs(taken[s] - t) <= 0.01 * t + 50

    before, after = steps["sentencepiece"]
    want = sorted((r["doc_id"], LIB.encode(r["text"])) for r in before)
    assert sorted((r["doc_id"], r["token_ids"]) for r in after) == want and all(r["n_tokens"] == len(r["token_ids"]) for r in after)
    assert sorted((r["doc_id"], r["token_ids"]) for r in corpus_pipeline.run(spark, small).collect()) == want


def test_nulls_repeated_rows_extra_columns_and_empty_tables(spark, prose, tmp_path):
    base = prose(60)
    rows = [(1, base, "s1"), (1, base, "s1"), (2, base.upper(), "s1"), (None, base, None), (None, None, None), (3, None, "s2"), (4, "", "s2"), (5, prose(30) + " " + prose(9000), "s3"), (6, prose(40), "s2"), (7, prose(40), None)]
    columns = "doc_id long, text string, source string, n_chars long, kept boolean, score string, text_b string, copies int, class_id long, key int"
    docs = spark.createDataFrame([(d, t, s, len(t or ""), None, "x", "y", 5, 0, 1) for d, t, s in rows], columns)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, 0), (None, 1), (5, 1), (5, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["round_trip"] for r in got) and {r["doc_id"] for r in got} <= {None, 1, 3, 4, 5, 6, 7}  # 2 is a copy of 1
    assert 5 in {r["doc_id"] for r in got} and sum(r["doc_id"] == 1 for r in got) <= 2
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
