import zlib

import numpy as np

from covey.llm import boosting, toxicity as m


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    score = boosting.Boosted(60).fit(x[:1000], y[:1000]).predict(x[1000:])
    assert ((score > 0) == y[1000:]).mean() > 0.93
    knots, fit = boosting.isotonic(score, y[1000:])
    p = np.interp(score, knots, fit)
    assert (np.diff(fit) >= 0).all() and abs(p.mean() - y[1000:].mean()) < 0.02 and p.min() >= 0 and p.max() <= 1


def test_features_of_one_text():
    def f(text):
        raw = text.encode()
        seen = m.Pass(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return dict(zip(m.FEATURES, seen.features([m.Terms([])] * 5)[0]))

    a = f("You are an IDIOT!! such a m0ron")
    assert a["fixed_density"] > 0 and a["near_hits"] > 0 and a["exclamations"] > 0 and a["hidden_hits"] > 0 and a["shouted_share"] > 0 and a["symbols_inside"] > 0
    b = f("a plain sentence")
    assert b["fixed_hits"] == b["near_hits"] == b["hidden_hits"] == 0
    assert f("")["words"] == 0


def corpus(prose, n=900):
    rows, labels = [], []
    for k in range(n):
        w, bad = prose(40 + k % 50).split(), k % 8 == 0
        if bad:
            for j in range(3):
                w.insert(5 + 9 * j, ["idiot", "vorgix", "scum"][(j + k) % 3])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    return rows, labels


def test_learning_and_held_out(spark, prose):
    rows, labels = corpus(prose)
    docs = spark.createDataFrame([*((d, t, 0) for d, t in rows), (5000, None, 0), (5001, "", 0), (None, "idiot", 0), (7, rows[7][1], 0)], "doc_id long, text string, score int")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    out = m.score_toxicity(docs, lab).collect()
    assert len(out) == len(rows) + 4
    of = {r["doc_id"]: r for r in out}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    test = [(of[d]["predicted"], y) for d, y in labels if of[d]["held_out"]]
    assert sum(p == y for p, y in test) / len(test) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert of[5000]["score"] == of[5001]["score"]
    # held-out labels don't matter
    flipped = spark.createDataFrame([(d, 1 - y if zlib.crc32(str(d).encode()) % 3 == 1 else y) for d, y in labels], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in m.score_toxicity(docs.repartition(5), flipped).collect()}
    assert all(abs(again[d] - of[d]["score"]) < 1e-12 for d, _ in rows)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in m.score_toxicity(docs, none).collect()] == [0.5, 0.5]
    assert m.score_toxicity(docs.limit(0), none).count() == 0


def test_query_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(r["score"], labels[r["doc_id"]]) for r in m.op10_toxicity(spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) > 0.9
