"""End-to-end plans: building the node table from documents, and answering queries over it."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions import tree
from docloom.functions.ids import DYNAMIC_PARTITION, STATIC_PARTITION
from docloom.operators import retrieval as R
from docloom.session import stash

LINKS = "array<struct<text:string,url:string,pk:string,type:string>>"


def hashed_terms(text: Column) -> Column:
    """The default sparse encoder: hash of each lower-case token to its share of the text; tokens with one hash add up."""

    @F.pandas_udf("map<int,double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}

        def number(token: str) -> int:
            if token not in known:
                known[token] = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=4).digest(), "big") >> 1
            return known[token]

        def one(value: str | None) -> dict[int, float]:
            tokens = tree._TOKEN.findall((value or "").lower())
            return {t: n / len(tokens) for t, n in Counter(map(number, tokens)).items()}

        for texts in batches:
            yield texts.map(one, na_action=None)

    return encode(text)


@dataclass(frozen=True)
class Encoders:
    """What turns texts into numbers: a dense and a sparse encoder (column to column) and a token counter."""

    dense: Callable[[str], Column] = R.hashed_vector
    sparse: Callable[[Column], Column] = hashed_terms
    count: Callable[[str], int] = tree.count_tokens


def build_nodes(docs: DataFrame, low: int = 256, core: int = 512, most: int = 2048, encoders: Encoders = Encoders()) -> DataFrame:
    """``docs(source, name, text)`` to stored nodes: parsed, links resolved, encoded.

    Equal full titles of different documents share an id: the row of the last (source, text) stays, so a pk has one row.
    """
    parsed = tree.parse_documents(docs, low, core, most, encoders.count)
    rest = [c for c in parsed.columns if c != "pk"]
    chunks = stash(parsed.groupBy("pk").agg(F.max_by(F.struct(*rest), F.struct("source", "text")).alias("row")).select("pk", "row.*"), "chunks")
    links = tree.resolve_links(chunks).groupBy("pk").agg(F.array_sort(F.collect_list(F.struct(F.col("anchor").alias("text"), "url", F.coalesce("target", F.lit("")).alias("pk"), "type"))).alias("related_links"))
    rows = chunks.drop("outlinks").join(links, "pk", "left").withColumn("related_links", F.coalesce("related_links", F.array().cast(LINKS)))
    vector = encoders.dense("text")
    return rows.withColumns({"vector": vector, "summary_vector": vector, "summary": F.lit(""), "sparse_vector": encoders.sparse(F.col("text")), "title_sparse": encoders.sparse(F.col("title"))})


def static_track(queries: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, pk, source_type, seq): anchors by hybrid search over the static nodes, then their parents and links."""
    static = nodes.filter(F.col("partition_name") == STATIC_PARTITION)
    found = stash(R.hybrid_search(queries, static, R.Fields(top_k=k)), "anchors")
    anchors = stash(static.select("pk", "title", "summary_vector", "left_sibling", "right_sibling", "related_links").join(found.select("query_id", "pk", F.col("rank").alias("seq")), "pk"), "anchors")
    more = R.expand(anchors, static, queries.select("query_id", "vector"), order="seq")
    direct = found.select("query_id", "pk", F.lit("anchor").alias("source_type"), R.sequence_key(0, "rank"))
    return direct.unionByName(more.drop("score"))


def dynamic_track(queries: DataFrame, nodes: DataFrame, k: int = 2) -> DataFrame:
    """(query_id, pk, source_type, seq): events by hybrid search over the dynamic nodes, each followed by the static nodes it points to."""
    dynamic = nodes.filter(F.col("partition_name") == DYNAMIC_PARTITION)
    found = stash(R.hybrid_search(queries, dynamic, R.Fields(top_k=k)), "events")
    hits = found.join(dynamic.select("pk", "related_links"), "pk")
    linked = hits.select("query_id", "rank", F.posexplode("related_links").alias("at", "l")).filter("l.type = 'static_anchor' and l.pk <> ''")
    direct = found.select("query_id", "pk", F.lit("dynamic_event").alias("source_type"), R.sequence_key(3, "rank"))
    return direct.unionByName(linked.select("query_id", R.ids.canonical_id(F.col("l.pk")).alias("pk"), F.lit("link").alias("source_type"), R.sequence_key(3, "rank", F.col("at") + 1)))


def retrieve(queries: DataFrame, nodes: DataFrame, dynamic_operations: frozenset[str] | None = None, top_n: int = 5) -> DataFrame:
    """(query_id, rank, pk, source_type, rerank_score, is_event): both tracks merged by priority and reranked.

    ``queries``: query_id, text, vector, sparse_vector. ``nodes`` has one row for each plain pk. With
    ``dynamic_operations`` only queries whose column ``operation`` is among them search the events too; without, all do.
    """
    asked = queries if dynamic_operations is None else queries.filter(F.col("operation").isin(*dynamic_operations))
    tracks = static_track(queries, nodes).unionByName(dynamic_track(asked, nodes))
    merged = stash(R.priority_merge(tracks), "merged")
    c = merged.join(nodes.select("pk", "text", "node_type"), "pk").join(queries.select("query_id", F.col("text").alias("query")), "query_id").withColumnRenamed("position", "seq")
    return R.rerank(c, top_n).join(merged.select("query_id", "pk", "source_type"), ["query_id", "pk"])
