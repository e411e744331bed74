"""The stored nodes as the llm operators need them: one row for each node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions.ids import node_id


def node_column() -> Column:
    """Plain id of a row of the node table, null where pk and title are null."""
    return node_id(F.col("pk"), F.col("title"), F.col("partition_name"))


def first_delivery(deliveries: DataFrame, *columns: str) -> DataFrame:
    """(node, columns) from the earliest delivery of each node; copies collapse before the shuffle."""
    rows = deliveries.select(node_column().alias("node"), F.col("delivery_no").cast("long").alias("__no"), *columns)
    return rows.filter("node is not null").groupBy("node").agg(*(F.min_by(c, "__no").alias(c) for c in columns))
