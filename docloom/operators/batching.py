"""Sequential batching and segmentation folds over ordered groups.

A fold has running state with resets, which no window frame expresses. Rows are sorted by group and order and stream through
one Arrow function, which holds the open batch or run and never a whole group; a group's state runs from its first item to
its last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from docloom.operators.skew import join_parts, ranged


def streamed(rows: DataFrame, group: list[str], order: list[Column | str], columns: list[str], schema: str, fold: Callable[[], Fold]) -> DataFrame:
    """Fold every group in order: rows are sorted by group and stream through, so a task holds only what the fold keeps.

    ``fold()`` is a new fold for each group; it gets the values of ``columns`` one row at a time and yields output rows
    (without the group's columns), at the end through ``end``.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out, types = None, None, [], None

        def made() -> pa.RecordBatch:
            columns_ = list(zip(*out)) if out else [()] * len(names)
            out.clear()
            kinds = dict(zip(names, pa_schema.types))
            return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, kinds[n])) for n, c in zip(names, columns_)], names)

        for batch in batches:
            types = {f.name: f.type for f in batch.schema}
            cols = [batch.column(c).to_pylist() for c in (*group, *columns)]
            for values in zip(*cols):
                key, rest = values[: len(group)], values[len(group) :]
                if state is None or key != now:
                    if state is not None:
                        out += [(*now, *x) for x in state.end()]
                    now, state = key, fold()
                out += [(*key, *x) for x in state.add(*rest)]
            yield made()
        if state is not None:
            out += [(*now, *x) for x in state.end()]
            yield made()

    pa_schema = to_arrow_schema(_parse_datatype_string(schema))
    sorted_rows = rows.repartition(*group).sortWithinPartitions(*group, *order)
    return sorted_rows.mapInArrow(run, schema)


class Fold:
    """State of one group."""

    def add(self, *values) -> Iterable[tuple]:
        raise NotImplementedError

    def end(self) -> Iterable[tuple]:
        return ()


class _Batches(Fold):
    def __init__(self, budget: int):
        self.budget, self.open, self.total, self.number = budget, [], 0, 0

    def add(self, item, tokens: int) -> list[tuple]:
        if tokens > self.budget:
            self.number += 1
            return [(item, self.number - 1)]
        closed = []
        if self.open and self.total + tokens > self.budget:
            closed = list(self.end())
            self.open, self.total, self.number = [], 0, self.number + 1
        self.open.append(item)
        self.total += tokens
        return closed

    def end(self) -> list[tuple]:
        return [(x, self.number) for x in self.open]


class _Padded(Fold):
    def __init__(self, budget: int):
        self.budget, self.batch, self.count, self.longest = budget, 0, 0, 0

    def add(self, item, size: int) -> list[tuple]:
        if self.count and (self.count + 1) * max(self.longest, size) > self.budget:
            self.batch, self.count, self.longest = self.batch + 1, 0, 0
        self.count, self.longest = self.count + 1, max(self.longest, size)
        return [(item, self.batch)]


class _Runs(Fold):
    def __init__(self, low: int, target: int):
        self.low, self.target, self.items, self.sizes, self.run, self.segment = low, target, [], [], 0, 0

    def add(self, item, size: int) -> list[tuple]:
        if size < self.target:
            self.items.append(item)
            self.sizes.append(size)
            return []
        out = [*self.end(), (item, self.run, self.segment)]
        self.run, self.segment = self.run + 1, self.segment + 1
        return out

    def end(self) -> list[tuple]:
        if not self.items:
            return []
        out = []
        for a, b in segments(self.sizes, self.low, self.target):
            out += [(x, self.run, self.segment) for x in self.items[a:b]]
            self.segment += 1
        self.items, self.sizes, self.run = [], [], self.run + 1
        return out


def _kinds(items: DataFrame, *names: str) -> str:
    return ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in names)


def token_batches(items: DataFrame, group: str, order: str, tokens: str, budget: int = 2048) -> DataFrame:
    """(group, order, batch): greedy batches in order. An item above the budget is a batch by itself and leaves the open one open.

    Batch numbers count in order of emission: an oversized item's number comes before the open batch's. Null tokens are none.
    """
    rows = items.select(group, order, F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("__n"))
    return streamed(rows, [group], [order, "__n"], [order, "__n"], _kinds(items, group, order) + ", batch int", lambda: _Batches(budget))


def padded_batches(items: DataFrame, group: str, order: str, length: str, budget: int = 5000) -> DataFrame:
    """(group, order, batch): by falling length (order breaks ties), a batch closes when count times its longest would pass the budget."""
    rows = items.select(group, order, F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("__n"))
    return streamed(rows, [group], [F.desc("__n"), order], [order, "__n"], _kinds(items, group, order) + ", batch int", lambda: _Padded(budget))


def segments(tokens: list[int], low: int, target: int) -> list[tuple[int, int]]:
    """Cut a run into segments of at most ``target`` tokens with as few as possible below ``low``; ties take the shortest last one."""
    best, back = [0] + [None] * len(tokens), [0] * (len(tokens) + 1)
    for end in range(1, len(tokens) + 1):
        total = 0
        for begin in range(end - 1, -1, -1):
            total += tokens[begin]
            if total > target:
                break
            if best[begin] is not None and (best[end] is None or best[begin] + (total < low) < best[end]):
                best[end], back[end] = best[begin] + (total < low), begin
    cuts, end = [], len(tokens)
    if best[end] is None:
        raise ValueError("an item is larger than the target")
    while end:
        cuts.append((back[end], end))
        end = back[end]
    return cuts[::-1]


def merge_segments(items: DataFrame, group: str, order: str, tokens: str, low: int = 256, target: int = 512) -> DataFrame:
    """(group, order, run, segment): runs of neighbours below the target, each cut by ``segments``; larger items stay alone."""
    rows = items.select(group, order, F.col(tokens).cast("long").alias("__n")).filter("__n is not null")
    return streamed(rows, [group], [order, "__n"], [order, "__n"], _kinds(items, group, order) + ", run int, segment int", lambda: _Runs(low, target))


def leaf_runs(items: DataFrame, group: str, order: str, mergeable: Column) -> DataFrame:
    """``items`` with ``run``: neighbours by ``order``, a number, that can be merged share a number, any other item has its own.

    Gaps and islands, within ranges of the order; what the ranges before a range end with and hold is added afterwards.
    """
    rows = ranged(items, order).withColumn("__m", mergeable)
    w = Window.partitionBy(group, "__range").orderBy(order)
    local = rows.withColumn("__s", F.when(F.col("__m") & F.coalesce(F.lag("__m").over(w), F.lit(False)), 0).otherwise(1))
    parts = local.groupBy(group, "__range").agg(F.sum("__s").alias("__starts"), F.max_by("__m", order).alias("__last"), F.min_by("__m", order).alias("__head"))
    before = Window.partitionBy(group).orderBy("__range")
    # a range's first item goes on with the run before it if both can be merged: then it starts none
    goes_on = F.col("__head") & F.coalesce(F.lag("__last").over(before), F.lit(False))
    tied = parts.withColumn("__on", goes_on.cast("int"))
    offset = F.coalesce(F.sum(F.col("__starts") - F.col("__on")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__on")
    joined = join_parts(local, tied.select(group, "__range", offset.alias("__offset")), [group])
    run = F.sum("__s").over(w) + F.col("__offset")
    return joined.withColumn("run", run).drop("__m", "__s", "__range", "__offset")
