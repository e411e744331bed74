"""Most similar vectors by a block matrix join.

Vectors are scaled to int8 with the exact norm of what rounding took away. Blocks of int8 vectors are multiplied tile by tile
(their products are whole numbers below 2^24, so single precision, in which they are multiplied, holds them exactly); scales
and error norms bound every cosine from above and below, and only pairs whose bound reaches the threshold are recomputed
from the original vectors in double precision. What tiles find of a vector is merged by heaps.

``similar_pairs`` joins all vectors with all. With ``exact`` every tile is multiplied and no pair is lost. Without, which
tiles are multiplied follows from a random rotation: a vector's block is its largest signed coordinate, and it is also sent to
the blocks of its next largest ones. A pair above the threshold meets unless both miss the other's block; the number of
blocks visited is set by simulation so that this happens to at most ``1 - RECALL`` of the pairs at the threshold, less above
it. A block's home rows meet all its visiting rows, however many they are, so the share that is missed doesn't depend on the
size; full blocks are divided into a grid of tasks, bounded in rows on both sides.
``nearest`` multiplies a stated query set with all vectors, every tile, and keeps the best k of each query.

Equal vectors are one class: the join works on one representative of each and the members are joined afterwards, so a
vector that a third of all rows share costs one row. Vectors that are null, too short or long, all zero or hold a null, NaN
or infinite number have no neighbours.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docloom.llm.nodes import node_column
from docloom.operators.orphans import BloomFilter
from docloom.session import stash

DIM = 64
#: Share of the pairs exactly at the threshold that has to meet in a block, at least.
RECALL = 0.9985
#: Home rows and visiting rows of one tile task at most, about; fuller blocks are divided into a grid of tasks.
TASK_HOME, TASK_VISIT = 262_144, 262_144
#: Rows of a block where every tile is multiplied, and queries of a task of ``nearest``, at most, about.
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 131_072
#: Rows and columns of one tile.
TILE_ROWS, TILE_COLUMNS = 2_048, 4_096
CODE = 16 + DIM + 8  # key, int8 values, scale and error


def rotation(number: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(90_001 + number).standard_normal((DIM, DIM)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale and error norm of the rows of x, each brought to unit norm before."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = (np.abs(u).max(1) / 127).astype(np.float32)
    q = np.rint(u / scale[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
    error = np.linalg.norm(u - q * scale[:, None].astype(np.float64), axis=1)
    return q, scale, (error * (1 + 1e-6)).astype(np.float32)


class Blocks:
    """128 blocks by the largest signed coordinate after a rotation; a vector visits the blocks of its ``visits`` largest."""

    COUNT = 2 * DIM

    def __init__(self, number: int, visits: int):
        self.turn, self.visits = rotation(number), visits

    def of(self, v: np.ndarray) -> np.ndarray:
        """Block numbers of the rows of v, best first: column 0 is the home block."""
        a = v @ self.turn
        a = np.concatenate([a, -a], 1)
        m = min(self.visits, self.COUNT)
        top = np.argpartition(-a, m - 1, axis=1)[:, :m]
        order = np.argsort(-np.take_along_axis(a, top, 1), axis=1, kind="stable")
        return np.take_along_axis(top, order, 1)

    def meetings(self, cosine: float, pairs: int = 20_000) -> np.ndarray:
        """Share of random pairs with this cosine that meet with 1, 2, ... visits: one's home is among the other's. A simulation."""
        rng = np.random.default_rng(5)
        x = rng.standard_normal((pairs, DIM))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g = rng.standard_normal((pairs, DIM))
        g -= (g * x).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
        p, q = self.of(x.astype(np.float32)), self.of(y.astype(np.float32))
        return np.logical_or.accumulate((p == q[:, :1]) | (q == p[:, :1]), axis=1).mean(0)

    @classmethod
    def suited(cls, number: int, cosine: float) -> "Blocks":
        """The fewest visits with which a share of RECALL of the pairs at this cosine meets."""
        share = cls(number, cls.COUNT).meetings(cosine)
        return cls(number, int(np.flatnonzero(share >= RECALL)[0]) + 1)


def coded(deliveries: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, key, node, code) of every usable vector; key is a 128-bit hash of the vector, written to the shared folder."""
    rows = deliveries.select(node_column().alias("node"), *fields).filter("node is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field in fields:
                at, x = usable(batch.column(field))
                if not len(at):
                    continue
                q, scale, error = quantise(x)
                code = np.concatenate([q.view(np.uint8), scale[:, None].view(np.uint8), error[:, None].view(np.uint8)], 1)
                key = batch.column(f"key_{field}").take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([field] * len(at)), key, batch.column("node").take(pa.array(at)), _binary(code)], ["field", "key", "node", "code"])

    keyed = rows.select("*", *(vector_key(f).alias(f"key_{f}") for f in fields))
    return stash(keyed.mapInArrow(run, "field string, key binary, node string, code binary"), "codes")


def vector_key(field: str):
    """16 bytes that stand for the vector's numbers."""
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), F.col(field))), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and double precision rows of the usable vectors of a list column."""
    length = pa.compute.fill_null(pa.compute.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(length == DIM)
    if not len(at):
        return at, np.zeros((0, DIM))
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIM)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[good], x[good]


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _unpack(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, int8 values, and scales with errors, of concatenated codes."""
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(-1, CODE)
    key = np.ascontiguousarray(raw[:, :16]).view("V16").ravel()
    tail = np.ascontiguousarray(raw[:, 16 + DIM :]).view(np.float32)
    return key, np.ascontiguousarray(raw[:, 16 : 16 + DIM]).view(np.int8), tail


def _buffered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _codes(t: pa.Table) -> np.ndarray:
    key = np.frombuffer(b"".join(t["key"].to_pylist()), np.uint8).reshape(-1, 16)
    return np.concatenate([key, np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(-1, CODE - 16)], 1)


def _classes(codes: DataFrame) -> DataFrame:
    """One row for each different vector of a field."""
    return codes.groupBy("field", "key").agg(F.first("code").alias("code"))


def _tile_rows(classes: DataFrame, blocks: Blocks, count_only: bool = False) -> DataFrame:
    """(field, block, role, part, n, data): home ('h') and visiting ('v') rows by block, concatenated codes.

    With ``count_only`` data stays empty: cheap enough to run twice, so that the tiles needn't be written to be counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buffered(batches, 60_000):
            raw, field = _codes(t), np.array(t["field"].to_pylist())
            for name in np.unique(field):
                own = raw[field == name]
                value, scale = own[:, 16 : 16 + DIM].view(np.int8), np.ascontiguousarray(own[:, 16 + DIM : 20 + DIM]).view(np.float32)
                at = np.concatenate([blocks.of(value[i : i + 4096] * scale[i : i + 4096]) for i in range(0, len(own), 4096)])
                for role, number in (("h", at[:, :1]), ("v", at)):
                    row, flat = np.repeat(np.arange(len(own)), number.shape[1]), number.ravel()
                    order = np.argsort(flat, kind="stable")
                    row, flat = row[order], flat[order]
                    cuts = np.flatnonzero(np.diff(flat, prepend=-1))
                    ends = np.append(cuts[1:], len(flat))
                    data = [b"" if count_only else own[row[a:b]].tobytes() for a, b in zip(cuts, ends)]
                    n = len(cuts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(name)] * n), pa.array(flat[cuts].astype(np.int32)), pa.array([role] * n), pa.array(np.frombuffer(np.ascontiguousarray(own[row[cuts], :4]).tobytes(), np.int32)), pa.array((ends - cuts).astype(np.int32)), pa.array(data, pa.binary())],
                        ["field", "block", "role", "part", "n", "data"])

    return classes.mapInArrow(run, "field string, block int, role string, part int, n int, data binary")


def _tile(h: tuple, v: tuple, threshold: float) -> Iterator[list[tuple[float, bytes, bytes]]]:
    """Runs of (-bound, smaller key, larger key), in order, of the pairs whose cosine may reach the threshold.

    Tiles are products of int8 values. Their scales lie outside: the columns come in order of scale, so one limit a row,
    made with the largest scale of a tile, leaves few pairs, whose own bounds then decide.
    """
    hk, hq, ht = h
    order = np.argsort(v[2][:, 0], kind="stable")
    vk, vq, vt = (x[order] for x in v)
    for i in range(0, len(hq), TILE_ROWS):
        a, sa, ea = hq[i : i + TILE_ROWS].astype(np.float32), ht[i : i + TILE_ROWS, 0], ht[i : i + TILE_ROWS, 1]
        for j in range(0, len(vq), TILE_COLUMNS):
            b, sb, eb = vq[j : j + TILE_COLUMNS].astype(np.float32), vt[j : j + TILE_COLUMNS, 0], vt[j : j + TILE_COLUMNS, 1]
            slack = ea.max() * (1 + eb.max()) + eb.max() + 1e-5
            limit = (threshold - slack) / (sa * (sb.max() if threshold > slack else sb.min()))
            r, c = np.nonzero(a @ b.T >= limit[:, None])
            bound = (a[r] * b[c]).sum(1) * sa[r] * sb[c] + ea[r] * (1 + eb[c]) + eb[c] + 1e-5
            keep = bound >= threshold
            run = [(-float(z), min(x, y), max(x, y)) for z, x, y in zip(bound[keep], map(bytes, hk[i + r[keep]]), map(bytes, vk[j + c[keep]])) if x != y]
            if run:
                yield sorted(run)


def _merged(runs: Iterable[list[tuple[float, bytes, bytes]]], field: str) -> pa.Table:
    """The pairs of all runs, each once, best bound first: a heap over the runs."""
    seen: dict[tuple[bytes, bytes], None] = {}
    for _, x, y in heapq.merge(*runs):
        seen.setdefault((x, y))
    return pa.table({"field": pa.array([field] * len(seen), pa.string()), "a": pa.array([x for x, _ in seen], pa.binary()), "b": pa.array([y for _, y in seen], pa.binary())})


def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """(field, a, b), a < b: pairs of different vectors that meet in a block and whose bound reaches the threshold."""
    blocks = Blocks.suited(0, threshold)
    tiles, counts = _tile_rows(classes, blocks), _tile_rows(classes, blocks, count_only=True)
    # at most two fields times the number of blocks, a constant: 256 rows
    full = counts.groupBy("field", "block").agg(F.sum(F.when(F.col("role") == "h", F.col("n"))).alias("h"), F.sum(F.when(F.col("role") == "v", F.col("n"))).alias("v")).filter("h > 0")
    grid = full.select("field", "block", F.ceil(F.col("h") / TASK_HOME).cast("int").alias("hs"), F.ceil(F.col("v") / TASK_VISIT).cast("int").alias("vs"))
    home = F.col("role") == "h"
    own = F.pmod(F.xxhash64("part"), F.when(home, F.col("hs")).otherwise(F.col("vs"))).cast("int")
    spread = tiles.join(F.broadcast(grid), ["field", "block"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(home, F.col("vs")).otherwise(F.col("hs")) - 1)))
    spread = spread.select("field", "block", F.when(home, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(home, F.col("other")).otherwise(F.col("own")).alias("j"), "role", "data")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        home_row = np.array(t["role"].to_pylist()) == "h"
        data = t["data"].to_pylist()
        own, visit = ([x for x, h in zip(data, home_row) if h == role] for role in (True, False))
        return _merged(_tile(_unpack(own), _unpack(visit), threshold) if own and visit else (), key[0].as_py())

    return spread.groupBy("field", "block", "i", "j").applyInArrow(run, "field string, a binary, b binary").distinct()


def _every_tile(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(field, a, b), a < b: pairs of different vectors whose bound reaches the threshold, out of all tiles: exact."""
    parts = max(1, -(-n // BLOCK_ROWS))
    own = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    rows = classes.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = rows.select("field", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("home"), "key", "code")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        data, home = [a + b for a, b in zip(t["key"].to_pylist(), t["code"].to_pylist())], t["home"].to_pylist()
        h = [x for x, first in zip(data, home) if first]
        v = h if key[1].as_py() == key[2].as_py() else [x for x, first in zip(data, home) if not first]
        return _merged(_tile(_unpack(h), _unpack(v), threshold) if h and v else (), key[0].as_py())

    return rows.groupBy("field", "i", "j").applyInArrow(run, "field string, a binary, b binary")


def _exact(deliveries: DataFrame, pairs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """pairs(field, a, b, ...) with the cosine in double precision, from the stored vectors."""
    ends = pairs.select("field", F.explode(F.array("a", "b")).alias("key")).distinct()
    n = pairs.count()
    bloom = BloomFilter.of(ends, "key", 2 * n)
    raw = deliveries.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), vector_key(f).alias("key"), F.col(f).alias("x")) for f in fields))).alias("r")).select("r.*")
    # the filter leaves few vectors beside those needed, so that the shuffle carries only them
    vectors = raw.filter(bloom.maybe("key")).join(ends, ["field", "key"], "left_semi").dropDuplicates(["field", "key"])
    vectors = stash(vectors.withColumn("x", F.expr("transform(x, e -> double(e))")), "vectors")
    side = lambda k, x: vectors.select("field", F.col("key").alias(k), F.col("x").alias(x))
    joined = pairs.join(side("a", "x"), ["field", "a"]).join(side("b", "y"), ["field", "b"])
    dot = lambda p, q: f"aggregate(zip_with({p}, {q}, (u, w) -> u * w), 0D, (s, e) -> s + e)"
    return joined.withColumn("cosine", F.expr(f"{dot('x', 'y')} / sqrt({dot('x', 'x')} * {dot('y', 'y')})")).drop("x", "y")


def similar_classes(deliveries: DataFrame, threshold: float, fields: tuple[str, ...] = ("vector", "summary_vector"), exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs (field, a, b, cosine) of different vectors with a cosine of at least the threshold, and members (field, key, node)."""
    codes = coded(deliveries, fields)
    classes = stash(_classes(codes), "classes")
    pairs = stash(_every_tile(classes, classes.count(), threshold) if exact else _candidates(classes, threshold), "pairs")
    return _exact(deliveries, pairs, fields).filter(F.col("cosine") >= threshold), codes.select("field", "key", "node").distinct()


def similar_pairs(deliveries: DataFrame, threshold: float = 0.9, fields: tuple[str, ...] = ("vector", "summary_vector"), exact: bool = False) -> DataFrame:
    """(field, pk_a, pk_b, cosine), pk_a < pk_b: all pairs of nodes with a cosine of at least the threshold.

    ``exact`` multiplies every tile; without it at least RECALL of the pairs at the threshold meet, and more of those above.
    Nodes with equal vectors are pairs too (cosine 1): this writes classes out as pairs, so it is for data in which a vector
    has few copies; otherwise use ``similar_classes``. No usable vector: no rows.
    """
    pairs, members = similar_classes(deliveries, threshold, fields, exact)
    members = stash(members, "members")
    side = lambda k, n: members.select("field", F.col("key").alias(k), F.col("node").alias(n))
    across = pairs.join(side("a", "m"), ["field", "a"]).join(side("b", "n"), ["field", "b"]).select("field", "m", "n", "cosine")
    shared = members.groupBy("field", "key").agg(F.count("*").alias("c")).filter("c > 1")
    many = members.join(shared, ["field", "key"]).select("field", "key", "node")
    within = many.select("field", "key", F.col("node").alias("m")).join(many.select("field", "key", F.col("node").alias("n")), ["field", "key"]).filter("m < n").select("field", "m", "n", F.lit(1.0).alias("cosine"))
    both = across.unionByName(within).filter("m <> n")
    return both.select("field", F.least("m", "n").alias("pk_a"), F.greatest("m", "n").alias("pk_b"), "cosine").groupBy("field", "pk_a", "pk_b").agg(F.max("cosine").alias("cosine"))


def nearest(deliveries: DataFrame, k: int = 10, every: int = 20, fields: tuple[str, ...] = ("vector", "summary_vector")) -> DataFrame:
    """(field, pk, rank, neighbour, cosine): the k other nodes of highest cosine for the stated queries, against all rows.

    Queries are the nodes whose id, read as a number, is divisible by ``every`` (1: all nodes). Every tile of queries and
    vectors is multiplied; bounds decide which are recomputed, so the result is exact. Ties go to the smaller pk.
    """
    codes = coded(deliveries, fields)
    classes = stash(_classes(codes), "classes")
    n = max(1, classes.count())
    members = codes.select("field", "key", "node").distinct()
    asked = stash(members.filter(divisible("node", every)), "asked")
    queries = classes.join(asked.select("field", "key").distinct(), ["field", "key"], "left_semi")
    # blocks of bounded size on both sides: their number grows with the vectors
    parts = max(1, -(-n // BLOCK_ROWS), min(16, n // 8_192))
    q_parts = max(1, -(-asked.count() // BLOCK_QUERIES))
    hashed = lambda m: F.pmod(F.xxhash64("key"), F.lit(m)).cast("int")
    corpus = classes.withColumn("i", hashed(parts)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1)))).withColumn("role", F.lit("v"))
    visit = queries.withColumn("j", hashed(q_parts)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("role", F.lit("h"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        asks = np.array(t["role"].to_pylist()) == "h"
        data = [a + b for a, b in zip(t["key"].to_pylist(), t["code"].to_pylist())]
        q, c = ([x for x, h in zip(data, asks) if h == role] for role in (True, False))
        a, b, low, high = [], [], [np.zeros(0, np.float32)], [np.zeros(0, np.float32)]
        if q and c:
            (qk, *qs), (ck, *cs) = _unpack(q), _unpack(c)
            for r, col, least, most in best_bounds(*qs, *cs, k + 1):  # one more: a query finds its own class
                a += map(bytes, qk[r])
                b += map(bytes, ck[col])
                low.append(least)
                high.append(most)
        return pa.table({"field": pa.array([key[0].as_py()] * len(a), pa.string()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "low": np.concatenate(low).astype(np.float32), "high": np.concatenate(high).astype(np.float32)})

    tiles = corpus.select("field", "i", "j", "role", "key", "code").unionByName(visit.select("field", "i", "j", "role", "key", "code"))
    bounds = tiles.groupBy("field", "i", "j").applyInArrow(run, "field string, a binary, b binary, low float, high float")
    # of all blocks: whoever may still be among the best k + 1
    merged = bounds.groupBy("field", "a").agg(F.collect_list(F.struct("b", "low", "high")).alias("c"))

    @F.pandas_udf("array<binary>")
    def best(lists: pd.Series) -> pd.Series:
        def one(items):
            kth = heapq.nlargest(k + 1, (x["low"] for x in items))[-1]
            return [x["b"] for x in items if x["high"] >= kth]

        return lists.map(one)

    pairs = stash(merged.select("field", "a", F.explode(best("c")).alias("b")), "pairs")
    exact = _exact(deliveries, pairs, fields)
    # of a vector with many copies only the k + 1 first members can be needed
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("field", "key").orderBy("node"))).filter(F.col("r") <= k + 1)
    near = exact.join(first.select("field", F.col("key").alias("b"), F.col("node").alias("neighbour")), ["field", "b"])
    mine = near.join(asked.select("field", F.col("key").alias("a"), F.col("node").alias("pk")), ["field", "a"]).filter("pk <> neighbour")
    rank = F.row_number().over(Window.partitionBy("field", "pk").orderBy(F.desc("cosine"), "neighbour"))
    return mine.withColumn("rank", rank).filter(F.col("rank") <= k).select("field", "pk", "rank", "neighbour", "cosine")


def best_bounds(qq: np.ndarray, qt: np.ndarray, cq: np.ndarray, ct: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, lower bounds, upper bounds) of all that may be among a row's best k, a few rows at a time.

    Tiles are bounded in rows and columns. Each row keeps a heap of its k best lower bounds over the tiles; only what
    reaches the smallest of them at the end goes on.
    """
    for i in range(0, len(qq), 512):
        q, sq, eq = qq[i : i + 512].astype(np.float32), qt[i : i + 512, :1], qt[i : i + 512, 1:]
        heap = np.full((len(q), k), -np.inf, np.float32)
        found = []
        for j in range(0, len(cq), TILE_COLUMNS):
            x, sx, ex = cq[j : j + TILE_COLUMNS].astype(np.float32), ct[j : j + TILE_COLUMNS, 0], ct[j : j + TILE_COLUMNS, 1]
            near = (q @ x.T) * sq * sx
            slack = eq * (1 + ex.max()) + ex.max() + np.float32(1e-5)
            m = min(k, near.shape[1])
            top = np.partition(near, near.shape[1] - m, axis=1)[:, near.shape[1] - m :] - slack
            heap = np.partition(np.concatenate([heap, top], 1), m, axis=1)[:, m:]
            r, c = np.nonzero(near + slack >= heap.min(1)[:, None])
            found.append((r, c + j, near[r, c] - slack[r, 0], near[r, c] + slack[r, 0]))
        r, c, low, high = (np.concatenate(x) for x in zip(*found))
        keep = high >= heap.min(1)[r]
        yield i + r[keep], c[keep], low[keep], high[keep]


def divisible(column: str, by: int):
    """Whether a plain id, read as a hexadecimal number, is divisible: its digits folded, so that no number overflows."""
    digits = F.translate(F.col(column), "-", "")
    rest = F.lit(0).cast("long")
    for i in range(1, 33, 8):
        rest = F.pmod(rest * F.lit(16**8 % by) + F.conv(F.substring(digits, i, 8), 16, 10).cast("long"), F.lit(by))
    return F.coalesce(rest == 0, F.lit(False))
