"""Joins and windows that keep working when one key holds a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: A key is hot from this many rows on; below, one task takes all its rows with ease.
HOT_ROWS = 200_000
#: At most this many keys can be hot, as each has more than 1/MAX_HOT of the rows: the proven bound of the broadcast.
MAX_HOT = 1000


def lookup_join(left: DataFrame, right: DataFrame, key: str, n_left: int, how: str = "left") -> DataFrame:
    """Join ``left`` to the unique rows of ``right`` on ``key`` without piling a hot key's rows into one task.

    ``n_left`` is the number of rows of ``left``. A key with more than ``max(HOT_ROWS, n_left / MAX_HOT)`` rows is
    hot; there are fewer than MAX_HOT of them, so their rows of ``right`` are broadcast. All others are joined by shuffle.
    If ``n_left`` itself is no larger than HOT_ROWS, no key can be hot. Null keys match nothing and, for ``left``, stay.
    """
    limit = max(HOT_ROWS, n_left // MAX_HOT)
    if n_left <= limit:
        return left.join(right, key, how)
    counted = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    hot = F.broadcast(counted.filter(F.col("__n") > limit).select(key))
    cold = left.join(hot, key, "left_anti").join(right, key, how)
    warm = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
    return cold.unionByName(warm)


#: Width of the ranges of an order number that windows are cut into.
RANGE = 100_000


def ranged(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``__range``, so that a window by key and range holds at most so many order numbers of a hot key."""
    return rows.withColumn("__range", F.floor(F.col(order) / F.lit(RANGE)))



def join_parts(rows: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``parts``, one row for each (keys, ``__range``); null keys are keys too."""
    every = [*keys, "__range"]
    same = reduce(Column.__and__, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in every))
    return rows.alias("l").join(parts.alias("r"), same).select("l.*", *(F.col(f"r.{c}") for c in parts.columns if c not in every))
