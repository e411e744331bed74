"""At-least-once deliveries to exactly one row for each identifier.

The store is hash-bucketed and sorted: every upsert writes one run, a bucketed table with one sorted file for each bucket.
Before the shuffle each task keeps the best row of an identifier it holds, so an identifier delivered in a third of all rows
costs one row a task. Compaction merges sorted runs, two at a time and the smallest first: a full sort-merge join of equal
buckets, which needs neither a shuffle nor a sort of its inputs, lets equal identifiers collapse to the earliest delivery.
Upserting a batch again changes nothing after compaction (idempotent). The number of buckets follows the number of rows and
is doubled by a compaction that finds the buckets too full.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.functions.ids import node_id
from docloom.session import remove, scratch

#: Rows of one bucket, about; a compaction that finds more than twice as many doubles the buckets.
BUCKET_ROWS, LEAST_BUCKETS = 250_000, 8


@dataclass
class Run:
    table: str
    path: str
    rows: int


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


class DeliveryStore:
    """Hash-bucketed sorted runs of one row for each key in the shared folder.

    ``order`` (a long column, unique) decides which of several rows of a key stays: the lowest. Rows with a null key
    are kept out by ``upsert``; the caller decides about them. Extra columns may have any name.
    """

    def __init__(self, spark: SparkSession, key: str, order: str, buckets: int = LEAST_BUCKETS):
        self.spark, self.key, self.order, self.buckets = spark, key, order, buckets
        self.runs: list[Run] = []

    def _write(self, rows: DataFrame) -> Run:
        run = Run(f"docloom_run_{uuid.uuid4().hex}", scratch(self.spark, "run"), 0)
        rows.write.format("parquet").option("path", run.path).bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(run.table)
        run.rows = self.spark.table(run.table).count()  # from the files' footers
        return run

    def _drop(self, run: Run, files: bool = True) -> None:
        self.spark.sql(f"DROP TABLE {run.table}")
        if files:
            remove(self.spark, run.path)

    def _best(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (self.key, self.order)]
        if not rest:
            return rows.groupBy(self.key).agg(F.min(self.order).alias(self.order))
        best = F.min(F.struct(self.order, *rest)).alias("__best") if _orderable(rows, rest) else F.min_by(F.struct(self.order, *rest), self.order).alias("__best")
        return rows.groupBy(self.key).agg(best).select(self.key, "__best.*")

    def upsert(self, batch: DataFrame) -> None:
        """Add one sorted run with the batch's best row of each key."""
        rows = self._best(batch.filter(F.col(self.key).isNotNull()))
        self.runs.append(self._write(rows.repartition(self.buckets, self.key)))

    def merged(self, a: Run, b: Run) -> DataFrame:
        """The rows of two runs, equal keys collapsed: a merge of their sorted buckets."""
        x, y = self.spark.table(a.table).hint("merge").alias("x"), self.spark.table(b.table).alias("y")
        first = F.col(f"y.{self.order}").isNull() | (F.col(f"x.{self.order}") <= F.col(f"y.{self.order}"))
        pick = lambda c: F.when(first, F.col(f"x.`{c}`")).otherwise(F.col(f"y.`{c}`")).alias(c)
        both = x.join(y, F.col(f"x.{self.key}") == F.col(f"y.{self.key}"), "full")
        names = self.spark.table(a.table).columns
        return both.select(F.coalesce(f"x.{self.key}", f"y.{self.key}").alias(self.key), *(pick(c) for c in names if c != self.key))

    def compact(self) -> DataFrame:
        """Merge all runs into one and return the store's rows."""
        if not self.runs:
            raise ValueError("nothing was upserted")
        while len(self.runs) > 1:
            self.runs.sort(key=lambda r: -r.rows)
            b, a = self.runs.pop(), self.runs.pop()
            with _sorted_buckets(self.spark):
                self.runs.append(self._write(self.merged(a, b)))
            self._drop(a)
            self._drop(b)
        (run,) = self.runs
        if run.rows > 2 * BUCKET_ROWS * self.buckets:
            self.buckets *= 2
            self.runs = [self._write(self.spark.table(run.table).repartition(self.buckets, self.key))]
            self._drop(run)
        return self.spark.table(self.runs[0].table)

    def close(self) -> DataFrame:
        """Compact, take the tables out of the catalog and return the rows, which stay in the shared folder."""
        schema = self.compact().schema
        (run,) = self.runs
        self._drop(run, files=False)
        self.runs = []
        return self.spark.read.schema(schema).parquet(run.path)


@contextmanager
def _sorted_buckets(spark: SparkSession):
    """Let the planner rely on the order of a bucket's single file, so that a merge sorts nothing again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _orderable(rows: DataFrame, names: list[str]) -> bool:
    return not any("map" in kind for name, kind in rows.dtypes if name in names)


def _identified(deliveries: DataFrame) -> DataFrame:
    return deliveries.select(
        node_id(F.col("pk"), F.col("title"), F.col("partition_name")).alias("node"),
        F.col("delivery_no").cast("long").alias("delivery_no"),
        F.col("batch_no").cast("long").alias("batch_no"),
    )


def kept_deliveries(deliveries: DataFrame, runs: int = 3) -> DataFrame:
    """(node, delivery_no) of the row that stays of each node: the one with its lowest delivery_no.

    The batches are upserted in ``runs`` groups of consecutive batch numbers (rows without one in the first), then
    merged. Rows without an id (pk and title null) can't be told apart from others and are left out here.
    """
    rows = _identified(deliveries)
    low, high, n = deliveries.agg(F.min("batch_no"), F.max("batch_no"), F.count("*")).first()
    store = DeliveryStore(deliveries.sparkSession, "node", "delivery_no", buckets_for(n))
    if low is None or high == low:
        store.upsert(rows.select("node", "delivery_no"))
    else:
        width = -(-(high - low + 1) // runs)
        for i in range(runs):
            a = low + i * width
            inside = F.col("batch_no").between(a, a + width - 1)
            store.upsert(rows.filter(inside | F.col("batch_no").isNull() if i == 0 else inside).select("node", "delivery_no"))
    return store.close()


def surplus_deliveries(deliveries: DataFrame) -> DataFrame:
    """(delivery_no) of every row of a node but the one that stays. Rows without an id are never surplus."""
    kept = kept_deliveries(deliveries).select("delivery_no")
    return _identified(deliveries).filter(F.col("node").isNotNull()).select("delivery_no").join(kept, "delivery_no", "left_anti")


def exactly_once(deliveries: DataFrame) -> DataFrame:
    """All columns of exactly one delivery of each node, plus ``node``, the id in its plain form.

    Rows without an id stay, with a null ``node``: nothing shows that they repeat another row. An input column named
    ``node`` is replaced.
    """
    named = deliveries.withColumn("node", node_id(F.col("pk"), F.col("title"), F.col("partition_name")))
    kept = kept_deliveries(deliveries).select("delivery_no")
    return named.filter("node is null").unionByName(named.filter("node is not null").join(kept, "delivery_no", "left_semi").select(named.columns))
