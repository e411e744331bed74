"""Best k of all rows for every query, by a block join.

Queries and rows are hashed into blocks of bounded size and every block of queries meets every block of rows in one task, so
nothing is broadcast or collected, no key is hot (a term that every text holds is spread like any other) and a task's memory
is bounded by its two blocks. Inside, small tiles of scores are formed and only the best k of each query go on: the last
shuffle carries k rows a query and block of rows, however many rows share something with the query. Where all weights are
positive, upper bounds leave out the rows that can't reach what a few promising rows have already; the result stays exact.

Scores are rounded to ``DIGITS`` before ranking and ties go to the smaller key, so that results don't depend on the order of
summation or on the blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.session import stash

DIGITS = 8
#: Queries and rows of one task at most, about.
BLOCK_QUERIES, BLOCK_ROWS = 32_768, 32_768
#: Queries and rows of one tile of scores.
TILE_QUERIES, TILE_ROWS = 512, 8_192
#: Term matches that are multiplied at once.
MATCHES = 4_000_000
#: Below this many rows a block isn't worth a task of its own.
LEAST_ROWS = 2_048
#: Queries that share one upper bound, and promising rows that are looked at first.
GROUP_QUERIES, FIRST_ROWS = 256, 128
#: Terms by which rows are found promising; hashes of terms that bounds are kept for, before rows are sent to blocks.
FREQUENT_TERMS, BUCKETS = 1_000, 1 << 20
#: Weights below this are taken as if they could be lost in a product.
TINY = 1e-12
#: A bound that isn't below one, but for the rounding of its sum.
ENOUGH = 1 - 1e-9


def top(scored: DataFrame, by: str, key: str, k: int | Column, score: str = "score") -> DataFrame:
    """The best k rows of each ``by`` with their rank from 1; Spark prunes each partition to k first."""
    w = Window.partitionBy(by).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Best:
    """The best k columns of each row over tiles that come in order of columns; ties go to the smaller column."""

    def __init__(self, rows: int, k: int):
        self.k, self.low, self.found = k, np.full(rows, -np.inf), []

    def add(self, rows: np.ndarray, columns: np.ndarray, score: np.ndarray) -> None:
        """A tile of scores of some rows and rising columns; -inf marks what isn't found."""
        m = min(self.k, score.shape[1])
        low = np.maximum(self.low[rows], np.partition(score, score.shape[1] - m, axis=1)[:, score.shape[1] - m] if m == self.k else -np.inf)
        self.low[rows] = low
        r, c = np.nonzero((score >= low[:, None]) & (score > -np.inf))
        r, c, s = self._first(r, c, score[r, c])
        self.found.append((rows[r], columns[c], s))

    def _first(self, r: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((c, -s, r))
        r, c, s = r[order], c[order], s[order]
        begin = np.flatnonzero(np.diff(r, prepend=-1))
        place = np.arange(len(r)) - np.repeat(begin, np.diff(np.append(begin, len(r))))
        return r[place < self.k], c[place < self.k], s[place < self.k]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, score)."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return self._first(*(np.concatenate(x) for x in zip(*self.found)))


def _tiles(rows: int, columns: int):
    for i in range(0, rows, TILE_QUERIES):
        for j in range(0, columns, TILE_ROWS):
            yield i, min(rows, i + TILE_QUERIES), j, min(columns, j + TILE_ROWS)


def block_join(queries: DataFrame, rows: DataFrame, key: str, k: int, n_queries: int, n_rows: int, score: Callable[[pa.Table, pa.Table, Best], None]) -> DataFrame:
    """(query_id, key, score, rank) of ``queries(query_id, *payload)`` over ``rows(key, *payload)`` with equal payloads.

    ``score`` gets the queries and the rows (in order of the key) of one task and adds its tiles.
    """
    kind, q_kind = rows.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    payload = [c for c in rows.columns if c != key]
    width = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n_rows // BLOCK_ROWS), min(width, n_rows // LEAST_ROWS))
    q_parts = max(1, -(-n_queries // BLOCK_QUERIES))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = queries.select("query_id", F.lit(None).cast(kind).alias(key), *payload, every(parts).alias("__i"), block("query_id", q_parts).alias("__j"))
    held = rows.select(F.lit(None).cast(q_kind).alias("query_id"), key, *payload, block(key, parts).alias("__i"), every(q_parts).alias("__j"))

    def run(_: tuple, t: pa.Table) -> pa.Table:
        mine = pa.compute.is_valid(t["query_id"])
        q, x = t.filter(mine), t.filter(pa.compute.invert(mine)).sort_by(key)
        best = Best(q.num_rows, k)
        if q.num_rows and x.num_rows:
            score(q, x, best)
        r, c, s = best.result()
        return pa.table({"query_id": q["query_id"].take(pa.array(r)), key: x[key].take(pa.array(c)), "score": pa.array(s, pa.float64())})

    both = asks.filter("query_id is not null").unionByName(held.filter(F.col(key).isNotNull()))
    found = both.groupBy("__i", "__j").applyInArrow(run, f"query_id {q_kind}, {key} {kind}, score double")
    return top(found, "query_id", key, k)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def dense_topk(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, key, score, rank): exact cosine search of ``queries(query_id, vector)`` over all usable vectors of ``rows``.

    The usable length is the one that most rows have. Null, zero or wrongly long vectors, and those with a null, NaN or
    infinite number, are not found and find nothing. No usable vector: no rows.
    """
    sizes = rows.select(F.size(vector).alias("n")).filter("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return rows.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, score double, rank int")
    dim = sizes["n"]
    sound = (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)

    def score(q: pa.Table, x: pa.Table, best: Best) -> None:
        unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
        a, b = unit(_matrix(q[vector], dim)), unit(_matrix(x[vector], dim))
        for i, ii, j, jj in _tiles(len(a), len(b)):
            best.add(np.arange(i, ii), np.arange(j, jj), np.round(a[i:ii] @ b[j:jj].T, DIGITS))

    asked = queries.filter(sound).select("query_id", vector)
    return block_join(asked, rows.filter(sound).select(key, vector), key, k, asked.count(), sizes["count"], score)


class Postings:
    """(row, term, weight) of a column of term lists and one of weight lists, terms numbered, copies of a term summed up."""

    def __init__(self, terms: pa.ChunkedArray, weights: pa.ChunkedArray, number: Callable[[pa.Array], np.ndarray]):
        terms, weights = terms.combine_chunks(), weights.combine_chunks()
        length = pa.compute.fill_null(pa.compute.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
        row, code = np.repeat(np.arange(len(length)), length), number(terms.flatten())
        weight = weights.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        good = (code >= 0) & np.isfinite(weight)
        row, code, weight = row[good], code[good], weight[good]
        width = int(code.max(initial=0)) + 1
        both, at = np.unique(row * width + code, return_inverse=True)
        self.row, self.term, self.weight = both // width, both % width, np.bincount(at, weight, len(both))

    def rows(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.searchsorted(self.row, [a, b])
        return self.row[i:j] - a, self.term[i:j], self.weight[i:j]


def sparse_topk(queries: DataFrame, rows: DataFrame, key: str, k: int, terms: str = "terms", weights: str = "weights", n_rows: int | None = None) -> DataFrame:
    """(query_id, key, score, rank) by inner product of term weights, exact.

    ``queries``: query_id, terms, weights (lists of one length); ``rows``: key, terms, weights. A term that comes several
    times in a list counts with the sum of its weights; null terms and null or not finite weights are left out. Rows
    without a common term are not found. ``n_rows``, about the number of rows, only sets the number of blocks. Where the
    queries fill several blocks, and rows would be sent to each, those that reach no query's best k are left out before.
    """
    n_queries = queries.count()
    if n_queries > BLOCK_QUERIES:
        rows = stash(reachable(queries, stash(rows.select(key, terms, weights), "rows"), k, terms, weights), "reachable")
        n_rows = None

    def score(q: pa.Table, x: pa.Table, best: Best) -> None:
        known = pa.compute.unique(q[terms].combine_chunks().flatten()).drop_null()
        asks, held = Postings(q[terms], q[weights], _numbers(known)), Postings(x[terms], x[weights], _numbers(known))
        if min(asks.weight.min(initial=1), held.weight.min(initial=1)) > TINY:
            bounded(asks, held, q.num_rows, x.num_rows, len(known), best)
            return
        for i in range(0, q.num_rows, TILE_QUERIES):
            ii = min(q.num_rows, i + TILE_QUERIES)
            row, term, weight = asks.rows(i, ii)
            order = np.argsort(term, kind="stable")
            row, weight = row[order], weight[order]
            ends = np.searchsorted(term[order], np.arange(len(known) + 1))
            for j in range(0, x.num_rows, TILE_ROWS):
                jj = min(x.num_rows, j + TILE_ROWS)
                best.add(np.arange(i, ii), np.arange(j, jj), products(row, weight, ends, *held.rows(j, jj), ii - i, jj - j))

    n = rows.count() if n_rows is None else n_rows
    return block_join(queries.select("query_id", terms, weights), rows.select(key, terms, weights), key, k, n_queries, n, score)


def _numbers(known: pa.Array) -> Callable[[pa.Array], np.ndarray]:
    """The place of each term in ``known``, -1 for others."""
    return lambda values: pa.compute.fill_null(pa.compute.index_in(values, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _buckets(terms: pa.Array, n: int) -> np.ndarray:
    return np.array([zlib.crc32(str(t).encode("utf-8", "surrogatepass")) % n for t in terms.to_pylist()], np.int64)


def reachable(queries: DataFrame, rows: DataFrame, k: int, terms: str = "terms", weights: str = "weights") -> DataFrame:
    """``rows`` without those that can't be among the best k of any query, by the bounds of ``bounded`` over all queries at once.

    Three passes: the frequent terms of the queries, the rows that fit these best, and what share of a query's floor over those
    rows a term can bring. Terms are hashed to ``BUCKETS``; a bucket has the largest share of its terms, so that the bound holds.
    Rows with a weight that isn't positive stay, and all rows do if a query has one.
    """
    each = queries.select(F.explode(F.arrays_zip(terms, weights)).alias("e")).select(F.col(f"e.{terms}").alias("term"), F.col(f"e.{weights}").cast("double").alias("w"))
    heavy = each.filter("term is not null and w > 0 and w < double('infinity')").groupBy("term").agg(F.sum("w").alias("w")).orderBy(F.desc("w"), "term").limit(FREQUENT_TERMS).toArrow()
    known, mean = heavy["term"].combine_chunks(), heavy["w"].to_numpy()
    if not len(known):
        return rows
    lists = f"{terms} {rows.schema[terms].dataType.simpleString()}, {weights} {rows.schema[weights].dataType.simpleString()}"

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = Postings(t[terms], t[weights], _numbers(known))
            t = t.append_column("promise", pa.array(np.bincount(held.row, mean[held.term] * held.weight, t.num_rows), pa.float64()))
            best = t if best is None else pa.concat_tables([best, t])
            best = best.take(np.argsort(-best["promise"].to_numpy(), kind="stable")[: max(FIRST_ROWS, k)])
        if best is not None:
            yield from best.combine_chunks().to_batches()

    found = rows.select(terms, weights).mapInArrow(promising, f"{lists}, promise double")
    first = found.dropDuplicates([terms]).orderBy(F.desc("promise")).limit(max(FIRST_ROWS, k)).select(terms, weights).toArrow()

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, sound = np.zeros(BUCKETS), True
        for batch in batches:
            t = pa.Table.from_batches([batch])
            words = pa.compute.unique(t[terms].combine_chunks().flatten()).drop_null()
            asks, held = Postings(t[terms], t[weights], _numbers(words)), Postings(first[terms], first[weights], _numbers(words))
            sound &= bool(asks.weight.min(initial=1) > TINY)
            bucket = _buckets(words, BUCKETS)
            for a in range(0, t.num_rows, GROUP_QUERIES):
                row, term, weight = asks.rows(a, a + GROUP_QUERIES)
                low = _floors(row, term, weight, held.row, held.term, held.weight, min(GROUP_QUERIES, t.num_rows - a), first.num_rows, len(words), k)
                np.maximum.at(most, bucket[term], weight / low[row])
        hit = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, [] if sound else [-1]).astype(np.int64)), pa.array(np.append(most[hit], [] if sound else [1.0]))], ["bucket", "share"])

    bounds = queries.select(terms, weights).mapInArrow(shares, "bucket long, share double").groupBy("bucket").agg(F.max("share").alias("share")).toArrow()
    at, share = bounds["bucket"].to_numpy(), bounds["share"].to_numpy()
    if (at < 0).any():
        return rows

    def alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(BUCKETS)
        most[at] = share
        for batch in batches:
            words, weight = batch.column(terms), batch.column(weights)
            length = pa.compute.fill_null(pa.compute.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            row, coded = np.repeat(np.arange(len(length)), length), words.flatten().dictionary_encode()
            code = pa.compute.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            reach = np.append(most[_buckets(coded.dictionary, BUCKETS)], 0.0)[code]  # a null term is the last: nothing
            weight = weight.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            odd = ~((weight > TINY) & np.isfinite(weight))
            bound = np.bincount(row, np.where(odd, 0.0, reach * np.where(odd, 0.0, weight)), len(length))
            yield batch.filter(pa.array((bound >= ENOUGH) | (np.bincount(row, odd, len(length)) > 0)))

    return rows.mapInArrow(alive, rows.schema)


def _floors(row: np.ndarray, term: np.ndarray, weight: np.ndarray, x_row: np.ndarray, x_term: np.ndarray, x_weight: np.ndarray, rows: int, columns: int, n_terms: int, k: int) -> np.ndarray:
    """What a query's k best reach at least by some rows, and above zero; a rounded score reaches it from half a digit below."""
    if columns < k:
        return np.full(rows, TINY**3)
    score = np.round(_dense(row, term, weight, x_row, x_term, x_weight, rows, columns, n_terms), DIGITS)
    return np.maximum(np.partition(score, columns - k, axis=1)[:, columns - k] - 10.0**-DIGITS, TINY**3)


def bounded(asks: Postings, held: Postings, n_asks: int, n_held: int, n_terms: int, best: Best) -> None:
    """Add the best rows of each query where all weights are positive, without forming the products that can't count.

    The k-th best score of a query among a few promising rows is a floor of its result. Queries with alike frequent terms form
    groups; a term's share in the bound of a group is its largest weight in proportion to the floor. A row whose shares stay
    below one is below the floor of every query of the group. What is left is multiplied. Rows are tried for all queries at
    once before, so that most meet no group.
    """
    if not len(asks.row) or not len(held.row):
        return
    # frequent terms, the costliest first, as one number, exact in a double: queries in its order are alike
    load = np.bincount(asks.term, minlength=n_terms) * np.bincount(held.term, minlength=n_terms).astype(np.float64)
    digit = np.zeros(n_terms)
    digit[np.argsort(-load, kind="stable")[:52]] = 2.0 ** -np.arange(min(52, n_terms))
    order = np.argsort(np.bincount(asks.row, digit[asks.term], n_asks), kind="stable")
    place = np.empty(n_asks, np.int64)
    place[order] = np.arange(n_asks)
    by = np.argsort(place[asks.row], kind="stable")
    row, term, weight = place[asks.row[by]], asks.term[by], asks.weight[by]
    groups = [(a, min(n_asks, a + GROUP_QUERIES), *np.searchsorted(row, [a, a + GROUP_QUERIES])) for a in range(0, n_asks, GROUP_QUERIES)]

    mean, share = np.bincount(term, weight, n_terms), np.zeros(len(row))
    promise = np.bincount(held.row, mean[held.term] * held.weight, n_held)
    first, most = np.argsort(-promise, kind="stable")[: max(FIRST_ROWS, best.k)], np.zeros(n_terms)
    f_row, f_term, f_weight = _chosen(first, held.row, held.term, held.weight, n_held)
    for a, b, i, j in groups:
        low = _floors(row[i:j] - a, term[i:j], weight[i:j], f_row, f_term, f_weight, b - a, len(first), n_terms, best.k)
        share[i:j] = weight[i:j] / low[row[i:j] - a]
        np.maximum.at(most, term[i:j], share[i:j])

    alive = np.flatnonzero(np.bincount(held.row, most[held.term] * held.weight, n_held) >= ENOUGH)
    x_row, x_term, x_weight = _chosen(alive, held.row, held.term, held.weight, n_held)
    for a, b, i, j in groups:
        most = np.zeros(n_terms)
        np.maximum.at(most, term[i:j], share[i:j])
        left = np.flatnonzero(np.bincount(x_row, most[x_term] * x_weight, len(alive)) >= ENOUGH)
        step = max(1, TILE_QUERIES * TILE_ROWS // max(b - a, np.count_nonzero(most)))
        l_row, l_term, l_weight = _chosen(left, x_row, x_term, x_weight, len(alive))
        for c in range(0, len(left), step):
            columns = alive[left[c : c + step]]
            u, v = np.searchsorted(l_row, [c, c + step])
            score = _dense(row[i:j] - a, term[i:j], weight[i:j], l_row[u:v] - c, l_term[u:v], l_weight[u:v], b - a, len(columns), n_terms)
            best.add(order[a:b], columns, np.where(score > 0, np.round(score, DIGITS), -np.inf))


def _chosen(rows: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The postings of some of ``n`` rows, numbered by their place in ``rows``."""
    place = np.full(n, -1)
    place[rows] = np.arange(len(rows))
    at = np.flatnonzero(place[row] >= 0)
    return place[row[at]], term[at], weight[at]


def _dense(row: np.ndarray, term: np.ndarray, weight: np.ndarray, x_row: np.ndarray, x_term: np.ndarray, x_weight: np.ndarray, rows: int, columns: int, n_terms: int) -> np.ndarray:
    """Inner products as one product of matrices over the terms that both sides have."""
    mine, both = np.zeros(n_terms, bool), np.zeros(n_terms, bool)
    mine[term] = True
    both[x_term] = True
    used = np.flatnonzero(mine & both)
    place = np.full(n_terms, -1)
    place[used] = np.arange(len(used))
    at, of = np.flatnonzero(place[term] >= 0), np.flatnonzero(place[x_term] >= 0)
    q, x = np.zeros((rows, len(used))), np.zeros((len(used), columns))
    q[row[at], place[term[at]]] = weight[at]
    x[place[x_term[of]], x_row[of]] = x_weight[of]
    return q @ x


def products(row: np.ndarray, weight: np.ndarray, ends: np.ndarray, x_row: np.ndarray, x_term: np.ndarray, x_weight: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """A tile of inner products; ``row`` and ``weight`` are the queries' postings by term, ``ends`` where each term begins.

    Terms that fill more than a hundredth of the tile are multiplied as dense columns, the others match by match.
    """
    times = ends[x_term + 1] - ends[x_term]
    filled = np.bincount(x_term, minlength=len(ends) - 1) * np.diff(ends)
    heavy = filled > rows * columns / 100
    total, hit = np.zeros(rows * columns), np.zeros(rows * columns, bool)
    for chosen in np.array_split(np.flatnonzero(heavy), -(-int(heavy.sum()) // 512)) if heavy.any() else ():
        place = np.full(len(heavy), -1)
        place[chosen] = np.arange(len(chosen))
        term = np.repeat(np.arange(len(heavy)), np.diff(ends))
        q, x = np.zeros((rows, len(chosen))), np.zeros((len(chosen), columns))
        at, of = np.flatnonzero(place[term] >= 0), np.flatnonzero(place[x_term] >= 0)
        q[row[at], place[term[at]]] = weight[at]
        x[place[x_term[of]], x_row[of]] = x_weight[of]
        total += (q @ x).ravel()
        # what is found is decided by the terms in common, not by the sum
        q[row[at], place[term[at]]] = x[place[x_term[of]], x_row[of]] = 1
        hit |= (q.astype(np.float32) @ x.astype(np.float32)).ravel() > 0
    light = np.flatnonzero((times > 0) & ~heavy[x_term])
    x_row, x_term, x_weight, times = x_row[light], x_term[light], x_weight[light], times[light]
    steps = np.searchsorted(np.cumsum(times), np.arange(0, int(times.sum()), MATCHES), "left")
    for a, b in zip(steps, [*steps[1:], len(times)]):
        n = times[a:b]
        which = np.repeat(np.arange(a, b), n)
        at = ends[x_term[which]] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        cell = row[at] * columns + x_row[which]
        hit[cell] = True
        total += np.bincount(cell, weight[at] * x_weight[which], rows * columns)
    return np.where(hit, np.round(total, DIGITS), -np.inf).reshape(rows, columns)
