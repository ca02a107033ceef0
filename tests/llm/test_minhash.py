import numpy as np
import pytest

from covey.llm import minhash as m


def shingles(text):
    w = (text or "").lower().split()
    return [] if not w else [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]


@pytest.fixture(scope="module")
def corpus(prose):
    base = prose(300)
    rows = [(k, prose(120)) for k in range(40)]
    for k in range(12):  # near copies of one text
        w = base.split()
        w[10 + 20 * k] = f"edit{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200, rows[3][1]), (201, rows[3][1].upper()), (202, None), (203, ""), (204, "one two"), (205, "one  two"), (206, prose(3000)), (207, "\n\t ")]
    half = rows[5][1].split()
    rows.append((208, " ".join(half[:60]) + " " + prose(60)))  # far below the threshold
    return rows


def test_classes(spark, corpus):
    docs = spark.createDataFrame([(d, t, 1) for d, t in corpus], "doc_id long, text string, bands int")
    of = {r["doc_id"]: r["class_id"] for r in m.near_duplicates(docs).collect()}
    assert len(of) == len(corpus)
    assert all(of[100 + k] == 100 for k in range(12))
    assert of[200] == of[201] == of[3] == 3 and of[205] == of[204] == 204
    assert all(of[d] == d for d in (202, 203, 206, 207, 208, 5))
    kept = {r["doc_id"] for r in m.deduplicate(docs).collect()}
    assert kept == {d for d, c in of.items() if d == c}
    assert m.deduplicate(docs).columns == docs.columns


def test_weighted_jaccard_is_exact(corpus):
    idf = np.ones(m.CELLS)
    sets = m.weighted_sets([(t or "").encode() for _, t in corpus], idf)
    from collections import Counter

    for i, j in ((40, 41), (3, 53), (5, len(corpus) - 1), (0, 1)):
        a, b = Counter(shingles(corpus[i][1])), Counter(shingles(corpus[j][1]))
        want = sum((a & b).values()) / max(1, sum((a | b).values()))
        assert abs(m.weighted_jaccard(sets[i], sets[j]) - want) < 1e-9


def test_collisions_follow_similarity(prose):
    """A sample of two weighted sets agrees about as often as they are similar."""
    rng = np.random.default_rng(0)
    sampler = m.Sampler(400, 1)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64) & ~np.uint64(0xFFFF)
    w = rng.choice([1.0, 2.0, 4.0, 3.996], 300)
    a, b = np.sort(x[:240]), np.sort(x[60:])
    wa, wb = (np.array([w[list(x).index(v)] for v in s]) for s in (a, b))
    ha, hb = (sampler.band_hashes(np.array([0]), s, q)[0] for s, q in ((a, wa), (b, wb)))
    want = m.weighted_jaccard((a, wa), (b, wb))
    assert abs((ha == hb).mean() - want) < 0.09


def test_empty_table_and_repeated_rows(spark, prose):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert m.near_duplicates(empty).count() == 0 and m.deduplicate(empty).count() == 0
    t = prose(50)
    twice = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["kept"]) for r in m.near_duplicates(twice).collect()) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert sorted(r["doc_id"] or 0 for r in m.deduplicate(twice).collect()) == [0, 1]


def test_links_between_failed_members_are_found(spark, prose):
    """a ~ b ~ c in a chain of which the ends are too far apart: one component."""
    w = prose(400).split()
    b = list(w)
    for k in range(6):
        b[5 + 12 * k] = f"b{k}"
    c = list(b)
    for k in range(6):
        c[205 + 12 * k] = f"c{k}"
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(b)), (3, " ".join(c))], "doc_id long, text string")
    assert {r["class_id"] for r in m.near_duplicates(docs).collect()} == {1}


def test_string_ids_and_tiles(spark, prose):
    """Buckets whose members aren't near their center are compared by tiles; ids are of any type."""
    base = prose(200).split()
    rows = []
    for g in range(3):  # three groups that share 60 percent: one bucket now and then, never one class
        own = prose(80).split()
        for k in range(8):
            w = base[:120] + own
            w[3 + 9 * k] = f"e{g}x{k}"
            rows.append((f"d{g}{k}", " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    of = {r["doc_id"]: r["class_id"] for r in m.near_duplicates(docs, bands=60, rows=2).collect()}
    assert of == {d: d[:2] + "0" for d, _ in rows}


def weighted_brute(texts):
    """(i, j, weighted Jaccard similarity) of all pairs, with exact document frequencies."""
    from collections import Counter

    sets = [Counter(shingles(t)) for t in texts]
    docs = Counter(s for x in sets for s in x)
    n = sum(map(bool, sets))
    idf = {s: float(m.inverse_frequency(np.array([c / n]))[0]) for s, c in docs.items()}
    sets = [{s: c * idf[s] for s, c in x.items()} for x in sets]
    total = [sum(x.values()) for x in sets]
    for i in range(len(texts)):
        for j in range(i):
            small, large = sorted((sets[i], sets[j]), key=len)
            common = sum(min(w, large[s]) for s, w in small.items() if s in large)
            if common:
                yield j, i, common / (total[i] + total[j] - common)


def test_query_against_weighted_pairs(spark, small):
    """Every pair well above the threshold is in one class, and every class hangs together by pairs at the threshold."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    of = {r["doc_id"]: r["class_id"] for r in m.op6_minhash(spark, small).collect()}
    linked: dict = {}
    found = above = 0
    for i, j, sim in weighted_brute([t for _, t in docs]):
        a, b = docs[i][0], docs[j][0]
        if sim >= m.THRESHOLD - 0.02:
            linked.setdefault(a, set()).add(b)
            linked.setdefault(b, set()).add(a)
        if sim >= m.THRESHOLD + 0.02:
            above, found = above + 1, found + (of[a] == of[b])
    assert above and found >= 0.98 * above
    for d, c in of.items():
        seen, todo = {d}, [d]
        while todo:
            for e in linked.get(todo.pop(), set()) - seen:
                seen.add(e)
                todo.append(e)
        assert c in seen


def test_query_against_all_pairs(spark, small):
    docs = [(r["doc_id"], set(shingles(r["text"]))) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    of = {r["doc_id"]: r["class_id"] for r in m.op6_minhash(spark, small).collect()}
    for i, (d, a) in enumerate(docs):
        for e, b in docs[:i]:
            j = len(a & b) / max(1, len(a | b))
            if j >= 0.9:
                assert of[d] == of[e]
            elif j < 0.3 and a and b:
                assert of[d] != of[e] or of[d] not in (d, e)
