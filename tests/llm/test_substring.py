import hashlib
import re
from collections import Counter

import pytest

from covey.llm.substring import dedup_substrings, op2_substring_dedup, sliding_argmin


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        cut = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                cut[i : i + window] = [True] * window
        out.append((doc, len(w), sum(cut), " ".join(x for x, c in zip(w, cut) if not c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, seed", [(35, 8), (12, 5)])
def test_against_brute_force(spark, prose, window, seed):
    shared, other = prose(60), prose(window)
    base = prose(200)
    edited = base.split()
    edited[70], edited[140] = "changed", "altered"
    rows = [
        (1, f"{prose(30)} {shared}  {prose(20)}"), (2, f"{shared}\n{prose(50)}"), (3, base), (4, " ".join(edited)), (5, base), (6, None), (7, ""), (8, other), (9, f"{other} {prose(3)} {other}"), (10, prose(window - 1)),
        (11, "same " * 200), (12, f"{prose(9)} {shared[:150]}"), (None, base), (13, prose(4000) + " " + shared), (14, f"é😀 {shared.replace(' ', chr(9))}"), (8, other), (15, "a\xa0b " * 40),
    ]
    docs = spark.createDataFrame([(d, t, "en", 5, "clash") for d, t in rows], "doc_id long, text string, lang string, start int, kept_text string")
    out = dedup_substrings(docs, window, seed)
    assert out.columns == ["doc_id", "lang", "start", "n_words", "n_removed", "kept_text", "repeats"]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()), key=str)
    assert got == brute(rows, window)


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = [(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in brute(rows, 35)]
    assert sorted(map(tuple, op2_substring_dedup(spark, small).collect())) == sorted(want)


def test_argmin_takes_the_rightmost():
    import numpy as np

    v = np.array([3, 1, 1, 2, 0, 5], np.uint64)
    for width in (1, 2, 3, 5):
        assert list(sliding_argmin(v, width)) == [i + width - 1 - int(np.argmin(v[i : i + width][::-1])) for i in range(len(v) - width + 1)]
