import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from covey.llm import common

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab \t\n\x0b\x1c\xa0é😀"), max_size=30)), max_size=8))
def test_words_are_the_runs_between_ascii_white_space(texts):
    off, buf = common.text_bytes(pa.array(texts, pa.string()))
    want = [WORDS.findall(t or "") for t in texts]
    h, first = common.word_hashes(buf, off)
    assert list(np.diff(first)) == [len(w) for w in want] == list(common.word_counts(buf, off))
    flat = [w for ws in want for w in ws]
    assert len({x: 0 for x in h.tolist()}) == len(set(flat))
    grams = common.Grams(h)
    if len(flat) >= 2:
        assert grams.all(2)[0] == grams.of(np.array([0]), np.array([2]))[0]


def test_pieces_do_not_change_hashes(monkeypatch, prose):
    texts = [prose(300), "x" * 500, "", prose(40)]
    off, buf = common.text_bytes(pa.array(texts).slice(0))
    whole = common.word_hashes(buf, off)[0]
    monkeypatch.setattr(common, "PIECE", 64)
    assert (common.word_hashes(buf, off)[0] == whole).all()


def test_scratch_and_packing(spark, prose):
    df = spark.createDataFrame([(1, prose(50)), (2, None), (3, "")], "doc_id long, text string")
    back = common.packed(df, "text", "doc_id").select("doc_id", "text").collect()
    assert [common.unpack([bytes(r["text"])] if r["text"] is not None else [None])[0] for r in sorted(back)] == [r["text"].encode() if r["text"] else b"" for r in df.orderBy("doc_id").collect()]
    s = common.Scratch(spark, "t")
    assert s.table(df.where("doc_id > 5"), "none").count() == 0
    assert s.finish(df).count() == 3
