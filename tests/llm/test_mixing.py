import numpy as np

from docloom.llm import mixing as M


def test_rates():
    rate = M.copy_rates(np.array([100.0, 100.0, 10.0, 0.0]), np.array([0.5, 0.2, 0.2, 0.1]), np.array([2, 2, 3, 5]), 200)
    got = rate * [100, 100, 10, 0]
    assert abs(got.sum() - 200) < 1e-9 and rate[2] == 3 and rate[3] == 0 and abs(got[0] / got[1] - 2.5) < 1e-9
    assert M.copy_rates(np.array([10.0]), np.array([1.0]), np.array([2]), 1000).tolist() == [2.0]
    assert M.copy_rates(np.zeros(0), np.zeros(0), np.zeros(0), 5).tolist() == []


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(3)
    w = rng.integers(1, 50, 40).astype(float)
    p = np.full(40, 0.3)
    hits = np.zeros(40)
    for i in range(3000):
        out = M.pivot(p, w, np.random.default_rng(i), True)
        assert set(out) <= {0.0, 1.0}
        assert abs((out * w).sum() - (p * w).sum()) <= w.max()
        hits += out
    assert np.abs(hits / 3000 - 0.3).max() < 0.05
    left = M.pivot(p, w, np.random.default_rng(1), False)
    assert ((left > 0) & (left < 1)).sum() <= 1 and abs((left * w).sum() - (p * w).sum()) < 1e-6


def test_query(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 20)
    monkeypatch.setattr(M, "FAN_IN", 3)
    rng = np.random.default_rng(2)
    docs = [(i, "word " * int(rng.integers(1, 40)), "Big Source") for i in range(600)] + [(1000 + i, "word " * 20, " small_one") for i in range(8)] + [(2000, None, "big-source"), (2001, "", "big-source"), (2002, "x", None), (2003, "x", "other"), (0, "word", "Big Source")]
    docs = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, source string, copies string")
    targets = spark.createDataFrame([("big-source", 0.7, 1), ("small-one", 0.2, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    sizes = M.token_sizes(docs)
    plan = M.rates(sizes, targets, 6000)
    a = M.mix(sizes, plan)
    rows = a.collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 610  # every targeted document once
    assert max(r.copies for r in rows if r.source == "big-source") <= 1 and {r.copies for r in rows if r.source == "small-one"} == {3}
    report = {r.source: r for r in M.share_report(a, plan).collect()}
    assert report["none"].status == "no documents" and report["small-one"].status == "short" and report["none"].reached_share == 0
    assert abs(report["big-source"].tokens - (6000 - report["small-one"].tokens)) <= 45
    assert abs(sum(r.reached_share for r in report.values()) - 1) < 1e-9
    again = M.mix(sizes.repartition(5), plan)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect()))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    sizes = M.token_sizes(docs)
    plan = M.rates(sizes, targets)
    assert M.mix(sizes, plan).count() == 0 and M.share_report(M.mix(sizes, plan), plan).first().status == "no documents"
