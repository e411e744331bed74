"""Hybrid retrieval: dense and sparse search, rank fusion, priority merge, expansion and reranking.

All queries of a batch are answered by one plan keyed by query id. Scores are rounded to ``DIGITS`` before ranking and ties go
to the smaller id, so that results don't depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import ids, text as T
from docloom.operators.topk import DIGITS, dense_topk, sparse_topk, top
from docloom.session import stash

#: What a document's way of being found is worth in a merge.
PRIORITY = {"dynamic_event": 4, "anchor": 3, "parent": 2, "link": 1, "sibling": 1, "unknown": 0}


@dataclass(frozen=True)
class Fields:
    """Names of the stored fields that the retriever reads, and its limits."""

    key: str = "pk"
    dense: str = "vector"
    sparse: str = "sparse_vector"
    title_sparse: str = "title_sparse"
    top_k: int = 5
    drop_ratio: float = 0.0
    rrf_k: int = 60


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 if either is all zero, null for null, unequal lengths or NaN."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms == 0, 0.0).otherwise(F.nanvl(dot(a, b) / norms, F.lit(None).cast("double"))))


def dense_search(queries: DataFrame, nodes: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, key, score, rank): exact cosine search over all usable node vectors; see ``topk.dense_topk``."""
    return dense_topk(queries, nodes, key, vector, k)


def postings(nodes: DataFrame, key: str, sparse: str) -> DataFrame:
    """(key, term, w): the inverted index of a map column."""
    return nodes.filter(F.col(sparse).isNotNull()).select(key, F.explode(sparse).alias("term", "w"))


def csr_maps(indptr: Column, indices: Column, data: Column) -> Column:
    """Rows of a compressed sparse matrix as an array of maps term to weight."""
    starts = F.slice(indptr, F.lit(1), F.size(indptr) - 1)
    return F.transform(starts, lambda a, i: F.map_from_arrays(F.slice(indices, a + 1, F.get(indptr, i + 1) - a), F.slice(data, a + 1, F.get(indptr, i + 1) - a)))


def sparse_search(queries: DataFrame, nodes: DataFrame, key: str, sparse: str, k: int, drop_ratio: float = 0.0, query_sparse: str | None = None) -> DataFrame:
    """(query_id, key, score, rank) by inner product of term weights; see ``topk.sparse_topk``.

    ``drop_ratio`` leaves out that share of a query's terms, lowest weights first (0: exact). No common term: not found.
    """
    asked = queries.select("query_id", F.map_entries(query_sparse or sparse).alias("e")).filter("size(e) > 0")
    if drop_ratio > 0:
        heaviest = F.array_sort(F.transform("e", lambda x: F.struct((-x["value"]).alias("w"), x["key"].alias("key"), x["value"].alias("value"))))
        asked = asked.withColumn("e", F.slice(heaviest, F.lit(1), F.ceil(F.size("e") * F.lit(1 - drop_ratio)).cast("int")))
    asked = asked.select("query_id", F.col("e.key").alias("terms"), F.col("e.value").alias("weights"))
    held = nodes.filter(F.size(sparse) > 0).select(key, F.map_keys(sparse).alias("terms"), F.map_values(sparse).alias("weights"))
    return sparse_topk(asked, held, key, k, n_rows=nodes.count())


def fuse(routes: list[DataFrame], key: str, k: int, rrf_k: int = 60) -> DataFrame:
    """(query_id, key, score, rank): reciprocal-rank fusion of ranked routes."""
    each = [r.select("query_id", key, (1 / (F.lit(rrf_k) + F.col("rank"))).alias("s")) for r in routes]
    scored = reduce(DataFrame.unionByName, each).groupBy("query_id", key).agg(F.round(F.sum("s"), DIGITS).alias("score"))
    return top(scored, "query_id", key, k)


def hybrid_search(queries: DataFrame, nodes: DataFrame, fields: Fields = Fields(), k: int | None = None) -> DataFrame:
    """The three routes (dense, text terms, title terms), each with twice k, fused to k.

    ``queries``: query_id and the fields' dense and sparse columns. The title route uses the text's query terms.
    """
    k = k or fields.top_k
    routes = [
        dense_search(queries, nodes, fields.key, fields.dense, 2 * k),
        sparse_search(queries, nodes, fields.key, fields.sparse, 2 * k, fields.drop_ratio),
        sparse_search(queries, nodes, fields.key, fields.title_sparse, 2 * k, fields.drop_ratio, query_sparse=fields.sparse),
    ]
    return fuse(routes, fields.key, k, fields.rrf_k)


def term_weights(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The default sparse encoder: (key, term, w), share of each lower-case token among a text's tokens."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(T.TOKEN), F.lit(0))
    rows = docs.select(key, tokens.alias("t")).select(key, F.size("t").alias("total"), F.explode("t").alias("term"))
    return rows.groupBy(key, "total", "term").agg(F.count("*").alias("n")).select(key, "term", (F.col("n") / F.col("total")).alias("w"))


def token_lists(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms, weights) for ``topk.sparse_topk``: every lower-case token of a text with its share, so that sums are ``term_weights``."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(T.TOKEN), F.lit(0))
    listed = rows.select(key, tokens.alias("terms")).filter(F.size("terms") > 0)
    return listed.select(key, "terms", F.array_repeat(F.lit(1.0) / F.size("terms"), F.size("terms")).alias("weights"))


def hashed_vector(text: str, dim: int = 64) -> Column:
    """The default dense encoder: signed hashing of lower-case tokens, unit norm; all zero for a text without tokens."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(T.TOKEN), F.lit(0))
    at = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dim)).cast("int").alias("i"), F.when(F.xxhash64(t, F.lit(1)) > 0, 1.0).otherwise(-1.0).alias("s")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(at, lambda x: x["i"] == i), F.lit(0.0), lambda a, x: a + x["s"]))
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(sums, lambda x: F.when(norm == 0, 0.0).otherwise(x / norm))


def distinct_queries(queries: DataFrame, text: str = "text") -> DataFrame:
    """(text, query_ids): each query text once, to be encoded once; null texts are left out."""
    return queries.filter(F.col(text).isNotNull()).groupBy(text).agg(F.array_sort(F.collect_set("query_id")).alias("query_ids"))


def priority_merge(candidates: DataFrame) -> DataFrame:
    """One row for each (query_id, pk): the first of highest priority, at the place where the pk was first seen.

    ``candidates``: query_id, pk, source_type, seq. Unknown types have priority 0. Rows without a pk are dropped.
    """
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.lower("source_type")), F.lit(0))
    rows = candidates.filter(F.col("pk").isNotNull()).withColumn("priority", rank)
    rest = [c for c in rows.columns if c not in ("query_id", "pk", "seq", "priority")]
    best = F.min(F.struct((-F.col("priority")).alias("p"), F.col("seq").alias("s"), *rest)).alias("b")
    return rows.groupBy("query_id", "pk").agg(F.min("seq").alias("position"), best).select("query_id", "pk", "position", (-F.col("b.p")).alias("priority"), *(F.col(f"b.{c}").alias(c) for c in rest))


def ancestors(anchors: DataFrame) -> DataFrame:
    """(query_id, pk, step, ancestor): ids of every proper ``_`` prefix of a title, longest first, step from 1."""
    parts = F.split("title", "_", -1)
    n = F.size(parts)
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = anchors.select("query_id", "pk", parts.alias("parts"), F.explode(steps).alias("step"))
    title = F.array_join(F.slice("parts", F.lit(1), F.size("parts") - F.col("step")), "_")
    return rows.select("query_id", "pk", "step", ids.uuid5(title, ids.NAMESPACE_URL).alias("ancestor"))


def expand_parents(anchors: DataFrame, nodes: DataFrame, queries: DataFrame, decay: float = 0.75, floor: float = 0.2, order: str = "pk") -> DataFrame:
    """(query_id, pk, anchor, step, score): ancestors of the anchors that stay similar to the query.

    ``anchors``: query_id, pk, title, summary_vector; ``nodes``: pk, summary_vector; ``queries``: query_id, vector. The walk
    goes from the longest title prefix up. A missing node, one without a vector or one that is an anchor itself is
    skipped; one below ``decay`` times the last score or not above ``floor`` ends its chain. Without an anchor vector the
    walk starts at 0.5. Each ancestor is emitted once for a query, for the first anchor by ``order``, a column of anchors.
    """
    queries = queries.select("query_id", F.col("vector").alias("q"))
    start = anchors.join(queries, "query_id").select("query_id", "pk", F.round(F.coalesce(cosine(F.col("q"), F.col("summary_vector")), F.lit(0.5)), DIGITS).alias("start"))
    chain = ancestors(anchors).join(anchors.select("query_id", F.col("pk").alias("ancestor")), ["query_id", "ancestor"], "left_anti")
    there = chain.join(nodes.select(F.col("pk").alias("ancestor"), F.col("summary_vector").alias("v")), "ancestor").join(queries, "query_id")
    scored = there.withColumn("sim", F.round(cosine(F.col("q"), F.col("v")), DIGITS)).filter("sim is not null")
    steps = scored.groupBy("query_id", "pk").agg(F.array_sort(F.collect_list(F.struct("step", "ancestor", "sim"))).alias("steps")).join(start, ["query_id", "pk"])
    none = F.array().cast("array<struct<step:int,ancestor:string,sim:double>>")
    state = F.struct(F.col("start").alias("now"), F.lit(True).alias("go"), none.alias("out"))

    def walk(s, x):
        ok = s["go"] & (x["sim"] >= F.lit(decay) * s["now"]) & (x["sim"] > floor)
        return F.struct(F.when(ok, x["sim"]).otherwise(s["now"]).alias("now"), ok.alias("go"), F.when(ok, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    walked = steps.select("query_id", F.col("pk").alias("anchor"), F.explode(F.aggregate("steps", state, walk, lambda s: s["out"])).alias("e"))
    place = anchors.select("query_id", F.col("pk").alias("anchor"), F.col(order).alias("place"))
    w = Window.partitionBy("query_id", "e.ancestor").orderBy("place")
    return walked.join(place, ["query_id", "anchor"]).withColumn("r", F.row_number().over(w)).filter("r = 1").select("query_id", F.col("e.ancestor").alias("pk"), "anchor", F.col("e.step").alias("step"), F.col("e.sim").alias("score"))


def expand_links(anchors: DataFrame, nodes: DataFrame, queries: DataFrame, seen: DataFrame, proportion: float = 0.5, most: int = 10) -> DataFrame:
    """(query_id, pk, source_type, score, rank): siblings and internal links of the anchors, best by summary cosine.

    ``anchors``: query_id, pk, seq, left_sibling, right_sibling, related_links. Candidates come in anchor order: left
    sibling, right sibling, links; the first mention of a pk decides its type. Ids in ``seen(query_id, pk)`` are left out. A
    query keeps min(most, max(1 + anchors, ceil(proportion * candidates))).
    """
    one = lambda c, t, place: F.struct(ids.canonical_id(F.col(c)).alias("pk"), F.lit(t).alias("source_type"), F.lit(place).alias("place"))
    links = F.transform(F.filter(F.coalesce("related_links", F.array().cast(anchors.schema["related_links"].dataType)), lambda x: x["type"] == "internal"), lambda x, i: F.struct(ids.canonical_id(x["pk"]).alias("pk"), F.lit("link").alias("source_type"), (i + 2).alias("place")))
    rows = anchors.select("query_id", "seq", F.explode(F.concat(F.array(one("left_sibling", "sibling", 0), one("right_sibling", "sibling", 1)), links)).alias("c")).filter("c.pk is not null")
    first = rows.groupBy("query_id", F.col("c.pk").alias("pk")).agg(F.min(F.struct("seq", "c.place", "c.source_type")).alias("f")).select("query_id", "pk", F.col("f.source_type").alias("source_type"))
    fresh = first.join(seen.select("query_id", "pk"), ["query_id", "pk"], "left_anti")
    counts = fresh.groupBy("query_id").agg(F.count("*").alias("n")).join(anchors.groupBy("query_id").agg(F.count("*").alias("a")), "query_id")
    limit = counts.select("query_id", F.least(F.lit(most), F.greatest(1 + F.col("a"), F.ceil(F.lit(proportion) * F.col("n")))).cast("int").alias("limit"))
    scored = fresh.join(nodes.select("pk", "summary_vector"), "pk").join(queries, "query_id").withColumn("score", F.round(cosine(F.col("vector"), F.col("summary_vector")), DIGITS)).filter("score is not null")
    return top(scored.join(limit, "query_id"), "query_id", "pk", F.col("limit")).select("query_id", "pk", "source_type", "score", "rank")


def expand(anchors: DataFrame, nodes: DataFrame, queries: DataFrame, order: str = "pk") -> DataFrame:
    """(query_id, pk, source_type, score, seq): parents, then links that are neither anchors nor parents found before.

    ``seq`` puts a query's rows in order: parents by (``order`` of their anchor, step up), then links by rank.
    """
    parents = stash(expand_parents(anchors, nodes, queries, order=order), "parents")
    seen = anchors.select("query_id", "pk").unionByName(parents.select("query_id", "pk"))
    place = anchors.select("query_id", F.col("pk").alias("anchor"), F.row_number().over(Window.partitionBy("query_id").orderBy(order)).alias("at"))
    up = parents.join(place, ["query_id", "anchor"]).select("query_id", "pk", F.lit("parent").alias("source_type"), "score", sequence_key(1, "at", "step"))
    return up.unionByName(expand_links(anchors, nodes, queries, seen).select("query_id", "pk", "source_type", "score", sequence_key(2, "rank")))


def sequence_key(stage: int, first: str | Column, second: str | Column = "0") -> Column:
    """``seq`` of a candidate: its stage and its place there. Structs compare field by field."""
    number = lambda c: (F.expr(c) if isinstance(c, str) else c).cast("long")
    return F.struct(F.lit(stage).alias("stage"), number(first).alias("first"), number(second).alias("second")).alias("seq")


def lexical_logits(query: Column, text: Column) -> tuple[Column, Column]:
    """The default scorer's (yes, no): distinct query tokens found in the text, and those missing."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(T.TOKEN), F.lit(0)))
    both = F.size(F.array_intersect(tokens(query), tokens(text)))
    return both.cast("double"), (F.size(tokens(query)) - both).cast("double")


def rerank(candidates: DataFrame, top_n: int = 5, scorer: Callable[[Column, Column], tuple[Column, Column]] | None = lexical_logits) -> DataFrame:
    """(query_id, pk, rerank_score, rank, is_event): events first at 0.999, then the best ``top_n`` others by score.

    ``candidates``: query_id, query, pk, text, node_type, seq. The score is the softmax of the scorer's (yes, no). Without a
    scorer (or where its score is null) the input order decides.
    """
    event = F.coalesce(F.lower("node_type") == "dynamic_event", F.lit(False))
    if scorer:
        yes, no = scorer(F.col("query"), F.col("text"))
        score = F.round(1 / (1 + F.exp(no - yes)), DIGITS)
    else:
        score = F.lit(None).cast("double")
    rows = candidates.withColumn("is_event", event).withColumn("rerank_score", F.when(event, 0.999).otherwise(score))
    w = Window.partitionBy("query_id", "is_event").orderBy(F.when(F.col("is_event"), 0.0).otherwise(-F.coalesce("rerank_score", F.lit(-1.0))), "seq")
    kept = rows.withColumn("place", F.row_number().over(w)).filter(F.col("is_event") | (F.col("place") <= top_n))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("is_event"), "place"))).select("query_id", "pk", "rerank_score", "rank", "is_event")


def instruction_for(operation: Column, table: dict[str, str], default: str) -> Column:
    """The scorer's instruction for an operation, the default for one that isn't in the table or null."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv)) if table else F.create_map().cast("map<string,string>")
    return F.coalesce(F.element_at(known, operation), F.lit(default))


def rerank_pair(instruction: Column, query: Column, title: Column, text: Column, source_type: Column, source_desc: Column) -> Column:
    """The text that a pair scorer reads."""
    context = F.concat(F.lit("[Retrieval Context]: Type="), F.coalesce(source_type, F.lit("unknown")), F.lit(". Info="), F.coalesce(source_desc, F.lit("Retrieved via vector search")))
    return F.concat(F.lit("<Instruct>: "), instruction, F.lit("\n<Query>: "), query, F.lit("\n<Document>: [Title]: "), F.coalesce(title, F.lit("Untitled Section")), F.lit("\n"), context, F.lit("\n[Content]: "), text)


def format_docs(docs: DataFrame) -> DataFrame:
    """(query_id, text): numbered entries of each query's documents, events first, otherwise in order of ``seq``.

    ``docs``: query_id, seq, title, text, node_type, source_desc, related_links. An event names its first static anchor.
    """
    event = F.coalesce(F.lower("node_type") == "dynamic_event", F.lit(False))
    guide = F.coalesce(F.get(F.filter("related_links", lambda x: x["type"] == "static_anchor"), 0)["text"], F.lit("None"))
    rows = docs.select("query_id", "seq", event.alias("event"), F.coalesce("title", F.lit("Unknown")).alias("title"), T.strip(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("source_desc", F.lit("Retrieved Document")).alias("source"), guide.alias("guide"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("event")).alias("later"), "seq", "event", "title", "text", "source", "guide"))).alias("all"))
    entry = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["title"], F.when(x["event"], F.concat(F.lit(" | guide: "), x["guide"])).otherwise(F.concat(F.lit(" | source: "), x["source"])), F.lit("\n"), x["text"])
    return lists.select("query_id", F.array_join(F.transform("all", entry), "\n\n").alias("text"))
