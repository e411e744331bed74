"""Filling containers of fixed capacity from optimal length buckets.

1. One pass counts the global histogram of lengths (at most ``capacity`` numbers, however many items).
2. Dynamic programming over the histogram chooses the bucket boundaries that minimise padding, the sum of
   (boundary - length) over all items.
3. Token-budget batches form inside each bucket, from the longest bucket down: items of the same bucket fill a batch, and the
   room that no item of the bucket fits into any more is topped up with the longest items of shorter buckets that fit.
   This step works on counts: a *pattern* (so many items of each length) is repeated as often as the counts allow, so the
   work depends on the capacity and not on the number of items.
4. Every item gets its rank among the items of its length (counted in salted groups, so a length that a third of all items
   share is no single task) and finds its batch in the plan by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from docloom.session import stash

#: Rows that share one salt of a length at most, about.
RANK_ROWS = 50_000


def bucket_bounds(histogram: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding; exact dynamic programming.

    ``histogram[l]`` is the number of items of length l. Ties go to the lower bound. No items: no bounds.
    """
    lengths = np.flatnonzero(histogram)
    if not len(lengths):
        return []
    n = np.concatenate([[0], np.cumsum(histogram[lengths], dtype=np.float64)])
    t = np.concatenate([[0], np.cumsum(histogram[lengths] * lengths, dtype=np.float64)])
    k = len(lengths)
    cost = np.concatenate([[0.0], np.full(k, np.inf)])
    back = []
    for _ in range(min(buckets, k)):
        # cost of a last bucket that holds lengths i..j-1 is length[j-1] * count - tokens
        table = cost[:k, None] + lengths[None, :] * (n[None, 1:] - n[:k, None]) - (t[None, 1:] - t[:k, None])
        table[np.tri(k, k, -1, dtype=bool)] = np.inf
        back.append(table.argmin(0))
        cost = np.concatenate([[0.0], table.min(0)])
    bounds, j = [], k
    for choice in reversed(back):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(choice[j - 1])
    return bounds[::-1]


@dataclass
class Plan:
    """Entry i: the items of length[i] ranked from start[i] on fill per[i] places in each batch from batch[i] on."""

    length: np.ndarray
    start: np.ndarray
    batch: np.ndarray
    per: np.ndarray
    batches: int
    bounds: list[int]


def plan_batches(histogram: np.ndarray, capacity: int, bounds: list[int]) -> Plan:
    """Token-budget batches from the counts; see the module's text. Deterministic."""
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    low = dict(zip(bounds, [0, *bounds[:-1]]))
    rows, batch = [], 0
    for bound in reversed(bounds):
        while True:
            room, pattern = capacity, []
            for floor in (low[bound], 0):  # the bucket's own items first, then shorter ones
                top = min(bound, room)
                while room and top > floor:
                    fit = np.flatnonzero(left[floor + 1 : top + 1])
                    if not len(fit):
                        break
                    length = int(floor + 1 + fit[-1])
                    taken = sum(c for x, c in pattern if x == length)
                    count = min(room // length, int(left[length]) - taken)
                    if count > 0:
                        pattern.append((length, count))
                        room -= length * count
                    top = min(length - 1, room)
                if not pattern:
                    break
            if not pattern or pattern[0][0] <= low[bound]:
                break
            times = min(int(left[x]) // c for x, c in pattern)
            for x, c in pattern:
                rows.append((x, int(used[x]), batch, c))
                used[x] += c * times
                left[x] -= c * times
            batch += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], batch, bounds)


def assign(length: np.ndarray, rank: np.ndarray, plan: Plan) -> np.ndarray:
    """Batch of each item, from its length and its rank (from 0) among the items of that length."""
    first = np.searchsorted(plan.length, length, "left")
    # ranks start anew with each length: search on (length, start) as one number
    span = int(plan.start.max(initial=0)) + int(rank.max(initial=0)) + 2
    entry = np.searchsorted(plan.length * span + plan.start, length * span + rank, "right") - 1
    entry = np.maximum(entry, first)
    return plan.batch[entry] + (rank - plan.start[entry]) // plan.per[entry]


def pieces(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, n_pieces, piece_size) of usable items; only an item above the capacity has more than one piece."""
    n = F.ceil(F.col(size) / F.lit(capacity)).cast("long")
    cut = items.filter(F.col(size) > 0).select(F.col(key), F.col(size).alias("__size"), n.alias("n_pieces"))
    whole = cut.withColumn("piece_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_pieces"))))
    return whole.select(key, "piece_no", "n_pieces", F.least(F.lit(capacity), F.col("__size") - (F.col("piece_no") - 1) * capacity).cast("long").alias("piece_size"))


def pack(items: DataFrame, key: str, size: str, capacity: int = 2048, buckets: int = 16) -> DataFrame:
    """Batches of at most ``capacity`` by ``size``, as little room left as possible.

    ``items`` has one row for each unique non-null ``key``. Result: key, piece_no, n_pieces, n_tokens, batch_no, bucket (its
    upper bound), status. ``packed`` rows lie in exactly one batch each. Items whose size is null or not positive are
    reported apart: one row with status ``unusable`` and nulls in the other columns. An item above the capacity is
    divided into full pieces and a rest, each with its own batch; no other item is divided. No items: no rows.
    """
    spark = items.sparkSession
    narrow = stash(items.select(F.col(key).alias("__key"), F.col(size).cast("long").alias("__size")), "items")
    parts = pieces(narrow, "__key", "__size", capacity)
    # the salt count follows the data, so that no (length, salt) group holds much more than RANK_ROWS rows
    counted = parts.groupBy("piece_size").agg(F.count("*").alias("n")).toArrow()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[counted["piece_size"].to_numpy()] = counted["n"].to_numpy()
    plan = plan_batches(histogram, capacity, bucket_bounds(histogram, buckets))
    salts = max(1, int(histogram.max()) // RANK_ROWS + 1)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("__key", "piece_no"), F.lit(salts)))
    offsets = salted.groupBy("piece_size", "salt").agg(F.count("*").alias("n")).select(
        "piece_size", "salt", (F.sum("n").over(Window.partitionBy("piece_size").orderBy("salt")) - F.col("n")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("piece_size", "salt").orderBy("__key", "piece_no"))
    ranked = salted.withColumn("place", place).join(offsets, ["piece_size", "salt"]).withColumn("rank", F.col("offset") + F.col("place") - 1)
    shared = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("long")
    def batch_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for length, rank in batches:
            yield pd.Series(assign(length.to_numpy(), rank.to_numpy(), shared.value))

    @F.pandas_udf("long")
    def bucket_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for length in batches:
            yield pd.Series(np.array(shared.value.bounds)[np.searchsorted(shared.value.bounds, length.to_numpy())])

    packed = ranked.select(F.col("__key").alias(key), "piece_no", "n_pieces", F.col("piece_size").alias("n_tokens"), batch_of("piece_size", "rank").alias("batch_no"), bucket_of("piece_size").alias("bucket"), F.lit("packed").alias("status"))
    apart = narrow.filter("__size is null or __size <= 0").select(F.col("__key").alias(key), F.lit("unusable").alias("status"))
    return packed.unionByName(apart, allowMissingColumns=True)


def batch_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row for each bucket of the longest item in a batch: batches, items, tokens and the share of room left."""
    each = packed.filter("status = 'packed'").groupBy("batch_no").agg(F.max("bucket").alias("bucket"), F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    return each.groupBy("bucket").agg(
        F.count("*").alias("batches"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        F.round(1 - F.sum("tokens") / (F.count("*") * F.lit(capacity)), 6).alias("room_left"))
