"""References to records that do not exist.

A Bloom filter of the present keys proves definite orphans without a shuffle of the references; only the references that the
filter lets through are checked by an exact join. The filter has ten bits a key, but never more than ``MAX_BITS``: beyond,
it lets more pass and the exact join does more of the work, so the broadcast is bounded and the result exact at any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.functions.ids import canonical_id, node_id
from docloom.operators.skew import lookup_join
from docloom.session import stash

#: 16 MiB of filter at most.
MAX_BITS = 1 << 27
HASHES = 4
FIELDS = ("parent_id", "left_sibling", "right_sibling", "related_links")


def _positions(key: str, bits: int) -> list:
    """Double hashing: position i is (h1 + i * h2) mod bits, bits a power of two."""
    h1, h2 = F.xxhash64(F.lit(17), F.col(key)), F.xxhash64(F.lit(71), F.col(key)).bitwiseOR(F.lit(1))
    at = [h1]
    for _ in range(HASHES - 1):
        at.append(F.try_add(F.shiftright(at[-1], 1), F.shiftright(h2, 1)))
    return [a.bitwiseAND(F.lit(bits - 1)) for a in at]


class BloomFilter:
    """Bits of the keys of a frame; ``maybe`` says for each row whether its key may be among them."""

    def __init__(self, spark: SparkSession, words: np.ndarray, bits: int):
        self.spark, self.bits = spark, bits
        self.shared = spark.sparkContext.broadcast(words)

    @classmethod
    def of(cls, keys: DataFrame, key: str, n: int, max_bits: int = MAX_BITS) -> "BloomFilter":
        """Build from the column ``key``; n, the number of keys, only sets the size. Words are merged by bit_or on the way."""
        bits = min(max_bits, 1 << max(13, (10 * max(1, n) - 1).bit_length()))
        at = keys.filter(F.col(key).isNotNull()).select(F.explode(F.array(*_positions(key, bits))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        got = words.toArrow()  # at most bits / 64 rows
        filled = np.zeros(bits // 64, np.int64)
        filled[got["word"].to_numpy()] = got["bits"].to_numpy()
        return cls(keys.sparkSession, filled, bits)

    def maybe(self, key: str):
        shared = self.shared

        @F.pandas_udf("boolean")
        def test(*at: pd.Series) -> pd.Series:
            words, hit = shared.value, np.ones(len(at[0]), bool)
            for a in at:
                a = a.to_numpy()
                hit &= (words[a >> 6] >> (a & 63)) & 1 == 1
            return pd.Series(hit)

        return test(*_positions(key, self.bits))


def node_states(deliveries: DataFrame, deletions: DataFrame) -> DataFrame:
    """(pk, first_at, present, refs) of each node; refs: distinct (field, ref) named by any of its deliveries.

    A node is present if its latest delivery is later than its latest deletion, or it was never deleted. A deletion or
    delivery without a time counts as not having one. Deletions of ids that never came don't matter.
    """
    one = lambda c: F.array(F.struct(F.lit(c).alias("field"), canonical_id(F.col(c)).alias("ref")))
    links = F.transform(F.coalesce(F.col("related_links.pk"), F.array().cast("array<string>")), lambda x: F.struct(F.lit("related_links").alias("field"), x.alias("ref")))
    rows = deliveries.select(
        node_id(F.col("pk"), F.col("title"), F.col("partition_name")).alias("pk"),
        F.col("delivered_at").alias("at"),
        F.array_sort(F.array_distinct(F.filter(F.concat(one("parent_id"), one("left_sibling"), one("right_sibling"), F.transform(links, lambda x: F.struct(x["field"].alias("field"), canonical_id(x["ref"]).alias("ref")))), lambda x: x["ref"].isNotNull()))).alias("refs"),
    ).filter(F.col("pk").isNotNull())
    # copies agree in structure, so the sets of a node are few: they collapse before the shuffle
    nodes = rows.groupBy("pk", "refs").agg(F.min("at").alias("a"), F.max("at").alias("z")).groupBy("pk").agg(
        F.min("a").alias("first_at"), F.max("z").alias("last_at"), F.array_distinct(F.flatten(F.collect_set("refs"))).alias("refs"))
    gone = deletions.select(canonical_id(F.col("pk")).alias("pk"), F.col("deleted_at").alias("d")).filter("pk is not null").groupBy("pk").agg(F.max("d").alias("deleted_at"))
    return nodes.join(gone, "pk", "left").select(
        "pk", "first_at", F.coalesce(F.col("deleted_at").isNull() | (F.col("last_at") > F.col("deleted_at")), F.lit(False)).alias("present"), "refs")


def orphan_references(deliveries: DataFrame, deletions: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(pk, ref_field, ref_pk, first_at): the distinct references of present nodes to ids that are not present.

    References that are null, '' or blank name nothing. ``first_at`` is the referring node's first delivery.
    """
    states = stash(node_states(deliveries, deletions), "states")
    alive = states.filter("present")
    present = alive.select("pk")
    n = alive.count()
    bloom = BloomFilter.of(present, "pk", n, max_bits)
    refs = alive.select("pk", "first_at", F.explode("refs").alias("r")).select("pk", "first_at", F.col("r.field").alias("ref_field"), F.col("r.ref").alias("ref_pk"))
    tested = stash(refs.withColumn("maybe", bloom.maybe("ref_pk")), "refs")
    proven = tested.filter("not maybe").drop("maybe")
    open_ = tested.filter("maybe").drop("maybe")
    known = present.select(F.col("pk").alias("ref_pk"), F.lit(True).alias("known"))
    checked = lookup_join(open_, known, "ref_pk", open_.count()).filter("known is null").drop("known")
    return proven.unionByName(checked)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(ref_field, month, n_references, n_nodes, n_targets) over ``orphan_references``; month is yyyy-MM, null without a time."""
    return orphans.groupBy("ref_field", F.date_format("first_at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_references"), F.countDistinct("pk").alias("n_nodes"), F.countDistinct("ref_pk").alias("n_targets"))
