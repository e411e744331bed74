"""The block join against brute force, with blocks and tiles so small that every path is taken."""

import numpy as np
import pytest

from docloom.operators import topk


@pytest.fixture
def small(monkeypatch):
    for name, n in {"BLOCK_QUERIES": 20, "BLOCK_ROWS": 30, "TILE_QUERIES": 7, "TILE_ROWS": 11, "MATCHES": 50}.items():
        monkeypatch.setattr(topk, name, n)


def best(scores, k):
    """Rank, key and score by falling score, smaller key first."""
    order = sorted(scores, key=lambda x: (-x[1], x[0]))[:k]
    return [(key, s, i + 1) for i, (key, s) in enumerate(order)]


def test_dense_with_ties(spark, small):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (150, 4)).astype(float)  # few different vectors: many ties, some all zero
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [1.0]), (502, [float("inf"), 1.0, 1.0, 1.0])], "k long, v array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:50])] + [(99, None), (None, [1.0] * 4)], "query_id long, v array<double>")
    got = {}
    for r in topk.dense_topk(asked, rows, "k", "v", 5).collect():
        got.setdefault(r.query_id, []).append((r.k, r.score, r["rank"]))
    norm = np.linalg.norm(x, axis=1)
    for i in range(50):
        if norm[i] == 0:
            assert i not in got
            continue
        want = best([(j, round(float(x[i] @ x[j] / norm[i] / norm[j]), 8)) for j in range(150) if norm[j]], 5)
        assert [(k, pytest.approx(s), n) for k, s, n in want] == sorted(got[i], key=lambda t: t[2])
    assert set(got) <= set(range(50))


def test_sparse_with_frequent_terms(spark, small):
    """A term in every text, rare terms, repeated terms, negative weights and sums of zero, nulls."""
    rng = np.random.default_rng(5)
    lists = [["all", "all"] + [f"t{t}" for t in rng.integers(0, 40, 6)] for _ in range(120)]
    weights = [[0.5, -0.5 if i % 3 else 0.25] + [float(w) for w in rng.integers(-3, 4, 6)] for i in range(120)]
    schema = "terms array<string>, weights array<double>"
    rows = spark.createDataFrame([(f"k{i:03d}", t, w) for i, (t, w) in enumerate(zip(lists, weights))] + [("n1", None, None), ("n2", [], []), ("n3", [None, "t1"], [1.0, None])], "k string, " + schema)
    asked = spark.createDataFrame([(i, lists[i], weights[i]) for i in range(45)] + [(90, ["nowhere"], [1.0]), (91, None, None)], "query_id long, " + schema)
    got = {}
    for r in topk.sparse_topk(asked, rows, "k", 4).collect():
        got.setdefault(r.query_id, []).append((r.k, r.score, r["rank"]))

    def sums(i):
        out = {}
        for t, w in zip(lists[i], weights[i]):
            out[t] = out.get(t, 0) + w
        return out

    for i in range(45):
        a = sums(i)
        want = best([(f"k{j:03d}", round(sum(w * b[t] for t, w in a.items() if t in b), 8)) for j in range(120) for b in [sums(j)] if set(a) & set(b)], 4)
        assert [(k, pytest.approx(s), n) for k, s, n in want] == sorted(got[i], key=lambda t: t[2])
    assert set(got) == set(range(45))


def test_empty(spark):
    none = spark.createDataFrame([], "k long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, v array<double>")
    assert topk.dense_topk(asked, none, "k", "v", 3).count() == 0
    lists = "terms array<string>, weights array<double>"
    assert topk.sparse_topk(spark.createDataFrame([], "query_id long, " + lists), spark.createDataFrame([("a", ["x"], [1.0])], "k string, " + lists), "k", 3).count() == 0


def test_bounds_leave_out_what_cannot_count(spark, small, monkeypatch):
    """Positive weights: as by brute force with ties, copies of rows and weights that bounds can't hold, though few products are formed."""
    monkeypatch.setattr(topk, "GROUP_QUERIES", 8)
    monkeypatch.setattr(topk, "FIRST_ROWS", 6)
    monkeypatch.setattr(topk, "BUCKETS", 64)
    rng = np.random.default_rng(7)
    text = lambda n: ["all"] * int(rng.integers(1, 4)) + [f"t{t}" for t in rng.zipf(1.3, n) % 60]
    lists = [text(int(rng.integers(3, 40))) for _ in range(140)]
    lists += lists[:10]
    even = lambda ts: [1.0 / len(ts)] * len(ts)
    schema = "terms array<string>, weights array<double>"
    held = [(f"k{i:03d}", t, even(t)) for i, t in enumerate(lists)] + [("z0", ["t1", "all"], [0.0, 0.5]), ("z1", ["t2", "all"], [-0.5, 0.25]), ("z2", None, None), ("z3", ["all", None], [0.5, 1.0])]
    rows = spark.createDataFrame(held, "k string, " + schema)
    asks = [text(int(rng.integers(1, 12))) for _ in range(50)] + [["nowhere"]]
    asked = spark.createDataFrame([(i, t, even(t)) for i, t in enumerate(asks)], "query_id long, " + schema)

    def sums(t, w):
        out = {}
        for x, y in zip(t or (), w or ()):
            if x is not None:
                out[x] = out.get(x, 0) + y
        return out

    weights = {k: sums(t, w) for k, t, w in held}
    for k in (1, 4):
        got = {}
        for r in topk.sparse_topk(asked, rows, "k", k).collect():
            got.setdefault(r.query_id, []).append((r.k, r.score, r["rank"]))
        for i, t in enumerate(asks):
            a = sums(t, even(t))
            want = best([(x, round(sum(w * b[t] for t, w in a.items() if t in b), 8)) for x, b in weights.items() if set(a) & set(b)], k)
            assert [(x, pytest.approx(s), n) for x, s, n in want] == sorted(got.get(i, []), key=lambda t: t[2])
    left = {r.k for r in topk.reachable(asked, rows, 1).collect()}
    assert {"z0", "z1"} <= left and len(left) < len(held)


def test_few_products_are_formed(monkeypatch):
    """A few rows have most of a term that every query holds: nearly all other pairs are left out by their bounds."""
    import pyarrow as pa

    cells, dense = [], topk._dense
    monkeypatch.setattr(topk, "_dense", lambda *a: cells.append(a[6] * a[7]) or dense(*a))
    q = pa.table({"query_id": list(range(600)), "terms": [["all", "all", f"t{i % 50}", f"u{i}"] for i in range(600)], "weights": [[0.25] * 4] * 600})
    x = pa.table({"k": list(range(4000)), "terms": [["all"] * (9 if i < 5 else 1) + [f"t{(i + j) % 50}" for j in range(1 if i < 5 else 9)] for i in range(4000)], "weights": [[0.1] * 10] * 4000})
    known = pa.compute.unique(q["terms"].combine_chunks().flatten())
    asks, held = (topk.Postings(t["terms"], t["weights"], topk._numbers(known)) for t in (q, x))
    found = topk.Best(600, 1)
    topk.bounded(asks, held, 600, 4000, len(known), found)
    r, c, s = found.result()
    brute = np.round(topk._dense(asks.row, asks.term, asks.weight, held.row, held.term, held.weight, 600, 4000, len(known)), 8)
    assert list(r) == list(range(600)) and list(c) == list(brute.argmax(1)) and np.allclose(s, brute.max(1))
    assert sum(cells[:-1]) < 600 * 4000 / 10
