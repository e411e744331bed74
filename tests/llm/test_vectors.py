import numpy as np
import pyarrow as pa

from docloom.llm import vectors as V
from tests.nodes import table, uid

FIELDS = ("vector", "summary_vector")


def make(spark, extra=""):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((240, 64))
    for i in range(0, 60, 2):  # planted neighbours with cosines around the threshold
        g = rng.standard_normal(64)
        g -= g @ x[i] / (x[i] @ x[i]) * x[i]
        c = 0.85 + 0.15 * rng.random()
        u = x[i] / np.linalg.norm(x[i])
        x[i + 1] = c * u + np.sqrt(1 - c * c) * g / np.linalg.norm(g)
    x[100] = x[101] = x[102]
    x[103] = 3 * x[102]
    rows = [{"pk": uid(i), "vector": [float(np.float32(a)) for a in v], "summary_vector": None} for i, v in enumerate(x)]
    rows += [dict(rows[5]), {"pk": uid(900), "vector": [0.0] * 64}, {"pk": uid(901), "vector": [float("nan")] + [1.0] * 63}, {"pk": uid(902), "vector": [1.0] * 63}, {"pk": uid(903), "vector": None, "summary_vector": [1.0] * 64}, {"pk": uid(904), "summary_vector": [2.0] * 64}, {"pk": uid(905), "vector": [None] + [1.0] * 63}, {"pk": None, "title": None, "vector": [1.0] * 64}]
    return table(spark, rows, extra), x.astype(np.float32).astype(float)


def test_pairs_as_by_brute_force(spark, monkeypatch):
    nodes, x = make(spark, "field string, key string, cosine string")
    monkeypatch.setattr(V, "TASK_HOME", 3)  # a grid of tasks for every block
    monkeypatch.setattr(V, "TASK_VISIT", 5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {("vector", uid(i), uid(j)) for i in range(240) for j in range(i + 1, 240) if s[i, j] >= 0.9} | {("summary_vector", uid(903), uid(904))}
    got = V.similar_pairs(nodes, 0.9).collect()
    assert {(r.field, r.pk_a, r.pk_b) for r in got} == want and len(got) == len(want)
    assert all(abs(r.cosine - s[int(r.pk_a[-4:]), int(r.pk_b[-4:])]) < 1e-9 for r in got if r.field == "vector")


def test_nearest_is_exact(spark):
    nodes, x = make(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    got = {}
    for r in V.nearest(nodes, 10, 1, ("vector",)).collect():
        got.setdefault(r.pk, {})[r.rank] = (int(r.neighbour[-4:]), r.cosine)
    assert set(got) == {uid(i) for i in range(240)}
    for i in range(240):
        best = sorted(s[i])[::-1][:10]
        assert np.allclose([got[uid(i)][k][1] for k in range(1, 11)], best, atol=1e-8)
        assert uid(i) not in {uid(n) for n, _ in got[uid(i)].values()}


def test_error_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((300, 64)), rng.standard_normal((300, 64))
    (q, s, e), (p, t, f) = V.quantise(x), V.quantise(y)
    true = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    tile = (q.astype(float) * p).sum(1) * s * t
    assert (np.abs(true - tile) <= e * (1 + f) + f + 1e-6).all()


def test_blocks_meet_often_enough():
    for number in (0, 1):
        b = V.Blocks.suited(number, 0.9)
        assert b.meetings(0.9)[-1] >= V.RECALL and b.meetings(0.95)[-1] >= 0.9995 and b.visits < 20


def test_exact_mode_loses_nothing(spark, monkeypatch):
    """Every tile, with blocks and tiles so small that many meet; a low threshold, where the rotation would miss pairs."""
    nodes, x = make(spark)
    for name, n in {"BLOCK_ROWS": 40, "TILE_ROWS": 13, "TILE_COLUMNS": 7}.items():
        monkeypatch.setattr(V, name, n)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    for least in (0.2, 0.9):
        want = {(uid(i), uid(j)) for i in range(240) for j in range(i + 1, 240) if s[i, j] >= least}
        got = V.similar_pairs(nodes, least, ("vector",), exact=True).collect()
        assert {(r.pk_a, r.pk_b) for r in got} == want and len(got) == len(want)


def test_tiles_with_very_different_scales():
    """One limit a row and tile loses no pair when the largest values, and with them the scales, differ widely; runs are in order."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 64)) * np.exp(rng.standard_normal((400, 64)) * rng.integers(0, 3, (400, 1)))
    x[200:] = x[:200] + 0.1 * np.abs(x[:200]).mean(1, keepdims=True) * rng.standard_normal((200, 64))
    q, s, e = V.quantise(x)
    key = np.frombuffer(b"".join(i.to_bytes(16, "big") for i in range(400)), "V16")
    rows = (key, q, np.stack([s, e], 1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9)) if i < j}
    runs = list(V._tile(rows, rows, 0.9))
    assert all(r == sorted(r) for r in runs)
    merged = V._merged(runs, "vector")
    got = {(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in zip(merged["a"].to_pylist(), merged["b"].to_pylist())}
    assert true <= got and len(got) == merged.num_rows and len(got) < len(true) + 200


def test_nearest_over_many_blocks_and_tiles(spark, monkeypatch):
    for name, n in {"BLOCK_ROWS": 50, "BLOCK_QUERIES": 60, "TILE_COLUMNS": 9}.items():
        monkeypatch.setattr(V, name, n)
    test_nearest_is_exact(spark)


def test_ids_divisible(spark):
    ids = [uid(n) for n in (0, 20, 21, 40, 123456)] + ["ffffffff-ffff-5fff-8fff-ffffffffffff"]
    got = spark.createDataFrame([(i,) for i in ids], "node string").select("node", V.divisible("node", 20).alias("d")).collect()
    assert {r.node: r.d for r in got} == {i: int(i.replace("-", ""), 16) % 20 == 0 for i in ids}


def test_empty(spark):
    none = table(spark, [])
    assert V.similar_pairs(none).count() == 0 and V.nearest(none).count() == 0


def test_full_task_misses_no_pair_that_meets(spark):
    """16,000 vectors of one block, in pairs at cosine 0.905: 256 million products in one task, and no pair is lost."""
    rng, blocks, n, dim = np.random.default_rng(3), V.Blocks(0, 1), 24_000, V.DIM
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.standard_normal((n, dim))
    g -= (g * x).sum(1, keepdims=True) * x
    y = 0.905 * x + np.sqrt(1 - 0.905**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    x, y = x @ blocks.turn, y @ blocks.turn  # the largest coordinate of x becomes the first, and positive, in both
    at = np.abs(x).argmax(1)
    for z in (y, x):
        first = z[np.arange(n), at] * np.sign(x[np.arange(n), at])
        z[np.arange(n), at], z[:, 0] = z[:, 0].copy(), first
    x, y = x @ blocks.turn.T, y @ blocks.turn.T
    same = np.flatnonzero((blocks.of(x.astype(np.float32))[:, 0] == 0) & (blocks.of(y.astype(np.float32))[:, 0] == 0))[:8_000]
    assert len(same) == 8_000
    both = np.stack([x[same], y[same]], 1).reshape(-1, dim)
    q, scale, error = V.quantise(both)
    code = np.concatenate([q.view(np.uint8), scale[:, None].view(np.uint8), error[:, None].view(np.uint8)], 1)
    key = [i.to_bytes(16, "big") for i in range(len(code))]
    classes = spark.createDataFrame(pa.table({"field": ["vector"] * len(code), "key": key, "code": [c.tobytes() for c in code]}))
    found = {(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in V._candidates(classes, 0.9).collect()}
    assert {(i, i + 1) for i in range(0, len(code), 2)} <= found
