import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from covey.llm import sentencepiece_scan as m
from covey.llm.piecelattice import MARK, Chunk, Pieces, multiply

with open(m.MODEL_FILE, "rb") as _f:
    MODEL = _f.read()
LIB = sentencepiece.SentencePieceProcessor(model_file=m.MODEL_FILE)
ODD = ["", " ", "  ", "a", " a", "a ", "a  b   c", "\n\n a\t", "é ﬁ 漢字仮名 😀👍🏽", "\x00\x01", "▁x ▁", "<s></s><unk>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 300, "日本語" * 50, "ab" * 100 + " " + "1234567890" * 9, "the the  the", "\u2028 \xa0x"]


def test_cached_words_equal_the_library(prose):
    p = Pieces.of(MODEL)
    for t in [*ODD, prose(300), "Don't  stop; it's 3.14% of http://a.b/c?d=e"]:
        ids = np.frombuffer(p.encode(t), np.int32).tolist()
        assert ids == LIB.encode(t) and p.decode(pa.array([ids, None], pa.list_(pa.int32()))).to_pylist() == [t.replace(MARK, " "), ""]


def test_walked_words_equal_the_library(prose):
    for model in (MODEL, unigram_model()):
        p = Pieces.of(model)
        for t in [*ODD[1:], *prose(200).split()]:
            assert np.frombuffer(p.word(MARK + t.replace(" ", MARK))[0], np.int32).tolist() == p.lib.encode(t)


def test_decoding_equals_the_library():
    p, rng = Pieces.of(MODEL), np.random.default_rng(1)
    lists = [[], [1, 300, 2], [p.bytes[0xE9]], [p.bytes[65], p.bytes[0xC3], p.bytes[0xA9]], *(rng.integers(3, len(LIB), n).tolist() for n in range(1, 60))]
    assert p.decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == LIB.decode(lists)


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(at, value):
    if isinstance(value, int):
        return number(at << 3) + number(value)
    if isinstance(value, float):
        return number(at << 3 | 5) + struct.pack("<f", value)
    return number(at << 3 | 2) + number(len(value)) + value


def unigram_model() -> bytes:
    """A model of scored pieces, written by hand: the best path is often not the one of the longest pieces."""
    rng, pieces = random.Random(4), {MARK: -3.0}
    for c in "abcdefghijklmnoprstuvxyz":
        pieces[c] = -4.0 - rng.random()
        pieces[MARK + c] = -4.5 - rng.random()
    for _ in range(1500):
        w = "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))[rng.randint(0, 1) :]
        pieces[rng.choice(["", MARK]) + w] = -5.0 - 6 * rng.random()
    pieces["xx"], pieces["xxx"] = -6.0, -6.5
    rows = [(b"<unk>", 0.0, 2), (b"<s>", 0.0, 3), (b"</s>", 0.0, 3), *((f"<0x{b:02X}>".encode(), 0.0, 6) for b in range(256)), *((w.encode(), s, 1) for w, s in pieces.items())]
    out = b"".join(field(1, field(1, w) + field(2, s) + field(3, kind)) for w, s, kind in rows)
    out += field(2, field(3, 1) + field(35, 1) + field(40, 0) + field(41, 1) + field(42, 2) + field(43, (1 << 64) - 1))
    return out + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


@pytest.mark.parametrize("size, fan", [(7, 2), (40, 3), (150, 64)])
def test_unigram_chunks_equal_the_library(spark, prose, tmp_path, size, fan):
    (tmp_path / "u.model").write_bytes(unigram_model())
    lib = sentencepiece.SentencePieceProcessor(model_proto=unigram_model())
    texts = [prose(90), "x" * 333, "日本語" * 30, "xab" * 90 + "  " + prose(9), prose(20) + " " * 70 + prose(20), prose(3).replace(" ", "") * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in m.encode_documents(docs, str(tmp_path / "u.model"), giant=50, chunk=size, fan=fan).collect()}
    for k, t in enumerate(texts):
        assert out[k]["token_ids"] == lib.encode(t) and out[k]["round_trip"]


@pytest.mark.parametrize("size, fan", [(7, 3), (40, 4), (150, 64)])
def test_chunks_equal_the_library(spark, prose, size, fan):
    texts = [prose(60), "x" * 333, "日本語テキスト" * 20, "aab" * 90 + "  " + prose(9), "é😀" * 60, " " * 100 + "end", prose(20) + " " * 70 + prose(20), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in m.encode_documents(docs, giant=50, chunk=size, fan=fan).collect()}
    assert len(out) == len(texts)
    for k, t in enumerate(texts):
        assert out[k]["token_ids"] == LIB.encode(t or "") and out[k]["round_trip"]


def test_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.5, -np.inf, rng.random((4, 4))) for _ in range(3))
    assert np.allclose(multiply(multiply(a, b), c), multiply(a, multiply(b, c)), equal_nan=True)
    assert np.allclose(m.product([a, b, c]), multiply(multiply(a, b), c))


def test_transfer_of_a_split_equals_the_whole(prose):
    p, text = Pieces.of(MODEL), MARK + (prose(6) + "xxxxyyyyzzzz").replace(" ", MARK)
    n = len(text)
    whole = Chunk(p, text, 0, n, True, True).matrix().max(axis=0)
    for cut in (3, 11, n // 2, n - 2):
        one, two = Chunk(p, text, 0, cut, True, False), Chunk(p, text, cut, n, False, True)
        assert np.array_equal(multiply(one.matrix().max(axis=0, keepdims=True), two.matrix())[0], whole)


def test_repeated_rows_empty_and_decode(spark, prose):
    t = prose(80)
    docs = spark.createDataFrame([(1, t, 0), (1, t, 0), (None, t, 0), (2, None, 0)], "doc_id long, text string, token_ids int")
    rows = m.encode_documents(docs, giant=100, chunk=50)
    assert rows.count() == 4 and rows.where("round_trip").count() == 4
    back = m.decode_rows(rows).collect()
    assert sorted(r["text"] for r in back) == ["", t, t, t]
    assert m.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
