import re

from covey.llm import mixing as m


def waterfill(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    room, full, out = share * sum(sizes.values()), set(), {}
    while True:
        rest = room - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        out = {s: cap * sizes[s] for s in full} | {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if out[s] >= cap * sizes[s]}
        if not over:
            return out
        full |= over


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = m.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for d, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = waterfill(sizes)
    taken: dict = {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    return taken, want, got


def test_targets_are_met(spark, prose):
    rows = [(k, prose(1 + (k * 37) % 400), f"s{k % 5}" if k % 7 else None, 0) for k in range(300)] + [(900, None, "s1", 0), (901, "", "s9", 0), (902, prose(5000), "s1", 0), (3, prose(9), "s2", 0)]
    taken, want, got = check(spark, rows)
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 3 for s in want)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    again = m.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rates_are_the_nearest_to_one(spark, prose):
    """Rates are tilted by one dual variable a source, meet its target, and no other rates that do are nearer in relative entropy."""
    import numpy as np

    rows = [(k, prose(3 + (k * 53) % 300), f"s{k % 4}", 0) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got, rng = m.mix_sources(docs).collect(), np.random.default_rng(1)
    entropy = lambda r: np.sum(np.where(r > 0, r * np.log(np.maximum(r, 1e-300)), 0) - r + 1)
    for source in {r["source"] for r in got}:
        size, rate, target = (np.array([r[c] for r in got if r["source"] == source], float) for c in ("size", "rate", "target"))
        assert abs(size @ rate - target[0]) < 1e-5 * target[0] and (rate <= 2).all()
        inside = rate < 2 - 1e-9
        tilt = np.log(rate[inside]) / size[inside]
        assert not inside.any() or np.ptp(tilt) < 1e-9
        for _ in range(200):  # moves that keep the words taken
            i, j = rng.choice(len(size), 2, replace=False)
            step = rng.normal() * 0.05
            other = rate.copy()
            other[i] += step * size[j] / size[i] if size[j] < size[i] else step
            other[j] -= step if size[j] < size[i] else step * size[i] / size[j]
            if (other >= 0).all() and (other <= 2).all():
                assert entropy(other) >= entropy(rate) - 1e-7


def test_hot_cell_of_copies(spark, prose):
    text = prose(40)
    rows = [(k, text, "hot", 0) for k in range(500)] + [(1000 + k, prose(60), "cold", 0) for k in range(50)]
    taken, want, _ = check(spark, rows)
    assert abs(taken["hot"] - want["hot"]) <= 40 and abs(taken["cold"] - want["cold"]) <= 60


def test_mixed_rows(spark, prose):
    rows = [(k, prose(20 + k), f"s{k % 3}", 0) for k in range(60)] + [(5, "same text", "s0", 0), (5, "same text", "s0", 0), (None, "x y", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    plan = m.mix_sources(docs).groupBy("doc_id").sum("copies").collect()
    out = m.mixed_rows(docs)
    assert out.columns == docs.columns
    count = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert count == {r[0]: r[1] for r in plan if r[1]}
    texts = {(d, t) for d, t, _, _ in rows}
    assert all((r["doc_id"], r["text"]) in texts for r in out.collect())


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.mix_sources(none).count() == 0 and m.mixed_rows(none).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [r["taken"] for r in m.mix_sources(blank).collect()] == [0, 0]
