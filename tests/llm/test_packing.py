import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from docloom.llm import packing as P


def brute_bounds(hist, k):
    lengths = [i for i in range(len(hist)) if hist[i]]
    best = None
    for n in range(1, min(k, len(lengths)) + 1):
        for inner in itertools.combinations(lengths[:-1], n - 1):
            b = [*inner, lengths[-1]]
            pad = sum(hist[x] * (min(y for y in b if y >= x) - x) for x in lengths)
            best = pad if best is None else min(best, pad)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=2, max_size=9), st.integers(1, 4))
def test_bounds_are_optimal(counts, k):
    hist = np.array([0, *counts])
    b = P.bucket_bounds(hist, k)
    if not hist.any():
        assert b == []
        return
    assert len(b) <= k and b[-1] == np.flatnonzero(hist)[-1]
    assert sum(hist[x] * (min(y for y in b if y >= x) - x) for x in np.flatnonzero(hist)) == brute_bounds(hist, k)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=120), st.integers(1, 6))
def test_plan_holds_everything_once(lengths, k):
    hist = np.bincount(lengths, minlength=41)
    plan = P.plan_batches(hist, 40, P.bucket_bounds(hist, k))
    lengths = np.array(sorted(lengths))
    rank = np.concatenate([np.arange(n) for n in hist if n])
    batch = P.assign(lengths, rank, plan)
    room = np.bincount(batch, lengths, plan.batches)
    assert room.max() <= 40 and (room > 0).all()
    assert plan.batches <= 1.5 * np.ceil(lengths.sum() / 40) + 1


def test_query(spark, monkeypatch):
    monkeypatch.setattr(P, "RANK_ROWS", 7)  # many salts
    rng = np.random.default_rng(1)
    sizes = [(f"n{i}", int(x)) for i, x in enumerate(rng.integers(1, 900, 300))] + [(f"h{i}", 100) for i in range(200)]
    sizes += [("big", 5000), ("full", 2048), ("null", None), ("zero", 0), ("minus", -1)]
    df = spark.createDataFrame([(*s, "x", 1) for s in sizes], "node string, token_count long, batch_no string, rank long")
    rows = P.pack(df, "node", "token_count").collect()
    packed = [r for r in rows if r.status == "packed"]
    fill = {}
    for r in packed:
        fill[r.batch_no] = fill.get(r.batch_no, 0) + r.n_tokens
    assert max(fill.values()) <= 2048 and len(fill) == max(fill) + 1
    total = sum(s for _, s in sizes if s and s > 0)
    assert sum(fill.values()) == total and len(fill) <= -(-total // 2048) * 1.02 + 1
    assert sorted(r.n_tokens for r in packed if r.node == "big") == [904, 2048, 2048]
    assert all(r.n_pieces == 1 for r in packed if r.node != "big")
    assert len({(r.node, r.piece_no) for r in packed}) == len(packed)
    assert {r.node for r in rows if r.status == "unusable"} == {"null", "zero", "minus"}
    assert P.pack(df.limit(0), "node", "token_count").count() == 0
    report = P.batch_report(P.pack(df, "node", "token_count")).collect()
    assert sum(r.batches for r in report) == len(fill)


def test_same_result_for_any_partitioning(spark):
    df = spark.createDataFrame([(f"n{i}", i % 37 + 1) for i in range(400)], "node string, token_count long")
    a = sorted(map(tuple, P.pack(df, "node", "token_count", 100).collect()))
    assert a == sorted(map(tuple, P.pack(df.repartition(7), "node", "token_count", 100).collect()))
