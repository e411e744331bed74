"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies, so that the source has its target share of the total in
tokens, but never more than its cap. The whole part of that number is certain; the fraction is rounded by pivotal sampling:
two documents exchange token mass at random until one of them has a whole number, so the tokens of the source stay the
same up to one document. Blocks of documents are rounded in parallel; each block leaves at most one fraction, and these are
rounded again, level by level (a reduction tree), until one is left for each source.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docloom.llm.bpe import VOCABULARY, count_tokens
from docloom.session import stash

BLOCK_ROWS = 5_000
FAN_IN = 4_096


def source_key(source: Column) -> Column:
    """Sources whose names differ in case, blanks at the ends or separators only are the same; null and blank stay null."""
    key = F.regexp_replace(F.lower(F.btrim(source, F.lit(" \t\r\n　 "))), r"[\s_\-]+", "-")
    return F.when(key != "", key)


def copy_rates(tokens: np.ndarray, share: np.ndarray, cap: np.ndarray, total: float) -> np.ndarray:
    """Copies of each document for every source: proportional to share over tokens, at most cap, tokens sum to ``total``.

    What capped sources can't give is spread over the others in proportion to their shares. Sources without tokens, share
    or cap have rate 0. If all are capped the total is what they have.
    """
    rate = np.zeros(len(tokens))
    free = (tokens > 0) & (share > 0) & (cap > 0)
    rest = float(total)
    while free.any() and rest > 0:
        scale = rest / share[free].sum()
        over = free & (scale * share >= cap * tokens)
        if not over.any():
            rate[free] = scale * share[free] / tokens[free]
            break
        rate[over] = cap[over]
        rest -= (cap[over] * tokens[over]).sum()
        free &= ~over
    return rate


def pivot(p: np.ndarray, weight: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Round fractions p (between 0 and 1) keeping the sum of p * weight; at most one fraction is left, none if ``last``.

    All fractions are paired at once, each pair leaves at most one, and these are paired again.
    """
    p = p.astype(float).copy()
    while True:
        open_ = np.flatnonzero((p > 0) & (p < 1))
        if len(open_) < 2:
            break
        i, j = open_[0 : len(open_) // 2 * 2 : 2], open_[1::2]
        a, b = p[i], p[j]
        gain_a, gain_b, mass_a, mass_b = (1 - a) * weight[i], (1 - b) * weight[j], a * weight[i], b * weight[j]
        to_a, to_b = np.minimum(gain_a, mass_b), np.minimum(gain_b, mass_a)
        wins = rng.random(len(i)) * (to_a + to_b) < to_b  # the chance that keeps both expectations
        p[i] = np.where(wins, np.where(to_a == gain_a, 1.0, a + to_a / weight[i]), np.where(to_b == mass_a, 0.0, a - to_b / weight[i]))
        p[j] = np.where(wins, np.where(to_a == mass_b, 0.0, b - to_a / weight[j]), np.where(to_b == gain_b, 1.0, b + to_b / weight[j]))
        p[p > 1 - 1e-12] = 1.0
        p[p < 1e-12] = 0.0
    if last and len(open_):
        p[open_] = float(rng.random() < p[open_[0]])
    return p


def _level(df: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        rng = np.random.default_rng([seed, level, zlib.crc32(str(key[0]).encode()), int(key[1])])
        pdf["p"] = pivot(pdf["p"].to_numpy(), pdf["n_tokens"].to_numpy(float), rng, last)
        return pdf

    return df.groupBy("source", "block").applyInPandas(run, df.schema)


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens), one row for each doc_id, written; repeated rows of a doc_id count once (the longest)."""
    counted = count_tokens(documents.select("doc_id", source_key(F.col("source")).alias("source"), "text"), "text", ["doc_id", "source"], vocabulary)
    return stash(counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens")), "sizes")


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> pd.DataFrame:
    """source, target_share, max_repeats, n_documents, source_tokens, rate; one row for each target (a fixed, small table)."""
    spark = sizes.sparkSession
    wanted = targets.select(source_key(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats")).filter("source is not null")
    wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("source_tokens"))
    plan = wanted.join(have, "source", "left").fillna(0, ["n_documents", "source_tokens"]).toPandas().sort_values("source", ignore_index=True)
    tokens = plan["source_tokens"].to_numpy(float)
    plan["rate"] = copy_rates(tokens, plan["target_share"].to_numpy(float), plan["max_repeats"].to_numpy(float), tokens.sum() if total_tokens is None else total_tokens)
    return plan


def mix(sizes: DataFrame, plan: pd.DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every document of a source with a target; copies may be 0.

    Documents without tokens have no copies. The same input gives the same mixture, whatever the partitions are.
    """
    spark = sizes.sparkSession
    rows = [(r.source, int(np.floor(r.rate + 1e-12)), max(0.0, float(r.rate - np.floor(r.rate + 1e-12))), max(1, -(-int(r.n_documents) // BLOCK_ROWS))) for r in plan.itertuples()]
    table = spark.createDataFrame(rows, "source string, base long, fraction double, blocks long")
    docs = sizes.join(F.broadcast(table), "source").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    state = docs.select("source", "block", "doc_id", "n_tokens", "base", F.when(F.col("n_tokens") > 0, F.col("fraction")).otherwise(0.0).alias("p"))
    blocks, level, done = max([b for *_, b in rows], default=1), 0, []
    while True:
        last = blocks == 1
        state = stash(_level(state, level, last, seed), "pivot")
        done.append(state.filter("p = 0 or p = 1"))
        if last:
            break
        state = state.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / F.lit(FAN_IN)))
        blocks, level = -(-blocks // FAN_IN), level + 1
    every = reduce(DataFrame.unionByName, done)
    copies = F.when(F.col("n_tokens") > 0, F.col("base") + F.col("p").cast("long")).otherwise(0)
    return every.select("doc_id", "source", "n_tokens", copies.cast("long").alias("copies"))


def share_report(mixture: DataFrame, plan: pd.DataFrame) -> DataFrame:
    """Target and reached share of every source in the mixture's tokens; one row for each target.

    status: ``met``, ``short`` (all documents at their cap and still below the target) or ``no documents``.
    """
    used = mixture.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    table = mixture.sparkSession.createDataFrame(plan[["source", "target_share", "max_repeats", "n_documents", "source_tokens", "rate"]])
    total = used.agg(F.sum("tokens").alias("total"))
    joined = table.join(F.broadcast(used), "source", "left").join(F.broadcast(total))  # one row of totals
    status = F.when(F.col("source_tokens") == 0, "no documents").when(F.col("rate") >= F.col("max_repeats"), "short").otherwise("met")
    return joined.select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("reached_share"), "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        "n_documents", "source_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("copies", F.lit(0)).alias("copies"), status.alias("status"))
