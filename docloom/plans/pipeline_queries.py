"""Scans, stores, pipelines and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import ids
from docloom.operators import messages as M
from docloom.plans import event_queries, pipeline
from docloom.plans.core_problems import _BASE, _canon
from docloom.plans.retrieval_queries import _COS, _GOOD, _KEPT, _SOME, _TOK, _WALK, _kept, _kept_once, _links
from docloom.session import scratch, stash, table
from docloom.sources import readers, store
from docloom.streaming import event_stream


def _nodes(spark, d):
    return table(spark, d, "knowledge_base_v3")


def filtered_scan(spark, d):
    return readers.scan(_nodes(spark, d), 'source like "%.md" && !(level == 0) && node_type in ["leaf", "section"]', ["delivery_no", "level", "node_type"], key="delivery_no")


def limited_scan(spark, d):
    """The scan with a limit: first 500 by delivery."""
    return readers.scan(_nodes(spark, d), "token_count >= 100", ["delivery_no", "token_count"], 500, "delivery_no")


def batch_fetch(spark, d):
    """Nodes named as left siblings, fetched in one semi join."""
    nodes = stash(_kept(spark, d), "nodes")
    wanted = nodes.select(ids.canonical_id(F.col("left_sibling")).alias("pk")).filter("pk is not null")
    return readers.fetch(nodes, wanted).select("pk", "delivery_no")


def partition_scan(spark, d):
    return _nodes(spark, d).filter("partition_name = 'dynamic_events'").select("delivery_no")


def store_cycle(spark, d):
    """Write both partitions, upsert every node's latest delivery, delete the nodes of node_deletions, read what is left."""
    s = store.NodeStore(spark, scratch(spark, "nodes"))
    s.recreate()
    rows = _nodes(spark, d).select(ids.node_id(F.col("pk"), F.col("title"), F.col("partition_name")).alias("pk"), "delivery_no", "partition_name", "title").filter("pk is not null")
    for p in (ids.STATIC_PARTITION, ids.DYNAMIC_PARTITION):
        part = rows.filter(F.col("partition_name") == p).drop("partition_name")
        s.upsert(part.filter("delivery_no % 2 = 0"), p, "delivery_no")
        s.upsert(part, p, "delivery_no")
    s.delete(table(spark, d, "node_deletions").select(ids.canonical_id(F.col("pk")).alias("pk")).filter("pk is not null"))
    return s.read().select("pk", "delivery_no", "partition_name")


def _index(spark, d):
    s = store.NodeStore(spark, scratch(spark, "nodes"), "delivery_no")
    s.append(_nodes(spark, d).select("delivery_no", "sparse_vector"), ids.STATIC_PARTITION)
    return s.index("sparse_vector", 0.2)


def sparse_index(spark, d):
    """The written index without the lightest fifth of each row's terms, counted by term."""
    return _index(spark, d).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def sparse_index_topk(spark, d):
    """Search over the written index for every delivery divisible by 20."""
    asked = _nodes(spark, d).filter("delivery_no % 20 = 0").select(F.col("delivery_no").alias("query_id"), "sparse_vector")
    return store.search_index(asked, _index(spark, d), "delivery_no", "sparse_vector", 10)


def stream_ttl_dedup(spark, d):
    """The time-to-live filter as a stream over the cleaned events, written as one run to the end."""
    source = stash(event_queries._clean(spark, d), "events")
    rows = event_stream.watch(spark, source._docloom_path, source.schema)
    out = scratch(spark, "kept")
    q = event_stream.suppress_repeats(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_no long").parquet(out)


def stream_event_store(spark, d):
    """Events through the whole stream: repeats suppressed, textified, anchored and stored; one row for each id, the latest."""
    source = stash(event_queries._clean(spark, d).withColumn("timestamp_str", F.col("at").cast("string")), "events")
    s = store.NodeStore(spark, scratch(spark, "nodes"))
    heard = event_stream.suppress_repeats(event_stream.watch(spark, source._docloom_path, source.schema))
    q = event_stream.textify_and_store(heard, s, stash(event_queries._static(spark, d), "static"), scratch(spark, "offsets"), scratch(spark, "dead"))
    q.awaitTermination()
    return s.read().select("pk", "timestamp", F.md5("text").alias("text_md5"), "parent_id", "token_count")


def retrieval(spark, d):
    """The whole answer path for every node whose delivery is divisible by 20: search, expansion, merge and rerank."""
    nodes = _kept_once(spark, d)
    sound = lambda c: (F.size(c) == 64) & ~F.exists(c, lambda x: F.isnan(x))
    vector = F.when(sound("vector") & F.exists("vector", lambda x: x != 0), F.col("vector"))
    asked = nodes.filter("delivery_no % 20 = 0").select(F.col("delivery_no").alias("query_id"), F.coalesce("title", F.lit("")).alias("text"), vector.alias("vector"), "sparse_vector")
    return pipeline.retrieve(stash(asked, "asked"), nodes.withColumn("summary_vector", F.when(sound("summary_vector"), F.col("summary_vector"))))


def build_nodes(spark, d):
    """Nodes built from all documents and reduced to their counts by document."""
    from docloom.plans.graph_queries import _docs

    built = pipeline.build_nodes(_docs(spark, d), 64, 128, 512)
    return built.groupBy("source").agg(F.count("*").alias("n_nodes"), F.sum("token_count").cast("long").alias("n_tokens"), F.sum(F.size("sparse_vector")).cast("long").alias("n_terms"))


def _turns(spark, d):
    """Runtime events of a subject as a conversation: kinds of events as roles."""
    role = F.element_at(F.array(*(F.lit(x) for x in ("user", "assistant", "system"))), (F.col("event_no") % 3 + 1).cast("int"))
    return table(spark, d, "runtime_events").filter("name is not null and message is not null").select(F.col("name").alias("conv_id"), F.col("event_no").alias("turn"), role.alias("role"), F.col("message").alias("text"))


def last_four_messages(spark, d):
    m = M.gather(_turns(spark, d), last=4)
    return m.select("conv_id", F.array_join(F.transform("messages", lambda x: x["turn"].cast("string")), " ").alias("turns"))


def last_assistant_message(spark, d):
    return M.last_answer(_turns(spark, d))


def inject_system_context(spark, d):
    m = M.gather(_turns(spark, d))
    return m.select("conv_id", F.size(M.with_context(F.col("messages"), "probe", "env: probe")).alias("n"))


def format_reflections(spark, d):
    m = M.gather(_turns(spark, d))
    return m.select("conv_id", F.md5(M.reflections(F.transform("messages", lambda x: x["text"]))).alias("md5"))


_ALL = (filtered_scan, limited_scan, batch_fetch, partition_scan, store_cycle, sparse_index, sparse_index_topk, stream_ttl_dedup, stream_event_store, retrieval, build_nodes, last_four_messages, last_assistant_message, inject_system_context, format_reflections)
QUERIES = {f.__name__: f for f in _ALL}

_INDEX = """ix AS (SELECT * FROM (SELECT delivery_no, unnest(map_keys(sparse_vector)) AS term, unnest(map_values(sparse_vector)) AS w FROM knowledge_base_v3)
  QUALIFY row_number() OVER (PARTITION BY delivery_no ORDER BY w DESC, term) <= ceil(count(*) OVER (PARTITION BY delivery_no) * 0.8))"""
_ROUTE = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk)"


def _hybrid(name: str, partition: str, k: int) -> str:
    """SQL of the hybrid search over one partition: ``name``(query_id, pk, rank)."""
    sparse = lambda field: f"""SELECT query_id, pk, {_ROUTE} AS rank FROM (SELECT query_id, pk, round(sum(qw * w), 8) AS score FROM qt JOIN
  (SELECT id AS pk, unnest(map_keys({field})) AS term, unnest(map_values({field})) AS w FROM kept WHERE partition_name = '{partition}') USING (term) GROUP BY ALL) QUALIFY rank <= {2 * k}"""  # noqa: E731
    return f"""{name}_routes AS (
  SELECT query_id, pk, {_ROUTE} AS rank FROM (SELECT q.query_id, n.id AS pk, {_COS('q.vector', 'n.vector')} AS score FROM qv q, kept n WHERE partition_name = '{partition}' AND {_GOOD('n.vector')} AND {_SOME('n.vector')}) QUALIFY rank <= {2 * k}
  UNION ALL {sparse('sparse_vector')} UNION ALL {sparse('title_sparse')}),
{name} AS (SELECT query_id, pk, {_ROUTE} AS rank FROM (SELECT query_id, pk, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM {name}_routes GROUP BY ALL) QUALIFY rank <= {k})"""


_RETRIEVAL = f"""WITH RECURSIVE {_KEPT},
asked AS (SELECT delivery_no AS query_id, coalesce(title, '') AS query, vector, sparse_vector FROM kept WHERE delivery_no % 20 = 0),
qv AS (SELECT query_id, vector FROM asked WHERE {_GOOD('vector')} AND {_SOME('vector')}),
qt AS (SELECT query_id, unnest(map_keys(sparse_vector)) AS term, unnest(map_values(sparse_vector)) AS qw FROM asked),
{_hybrid('found', 'static_knowledge', 5)}, {_hybrid('events_', 'dynamic_events', 2)},
st AS (SELECT * FROM kept WHERE partition_name = 'static_knowledge'),
anchors AS (SELECT f.query_id, f.pk, k.title, f.rank AS seq, CASE WHEN {_GOOD('k.summary_vector')} THEN k.summary_vector END AS sv, k.l, k.r, k.related_links FROM found f JOIN st k ON k.id = f.pk),
{_WALK.replace('JOIN kept k', 'JOIN st k')},
par AS (SELECT w.query_id, w.ancestor AS pk, a.seq AS nth, w.step, w.sim AS score FROM walk w JOIN anchors a ON a.query_id = w.query_id AND a.pk = w.pk WHERE w.i > 0 QUALIFY row_number() OVER (PARTITION BY w.query_id, w.ancestor ORDER BY a.seq) = 1),
{_links('SELECT query_id, pk FROM anchors UNION ALL SELECT query_id, pk FROM par').replace('JOIN kept k', 'JOIN st k')},
hit AS (SELECT e.query_id, e.rank, unnest(related_links, recursive := false) AS l, generate_subscripts(related_links, 1) AS nth FROM events_ e JOIN kept k ON k.id = e.pk),
cand AS (
  SELECT query_id, pk, 'anchor' AS source_type, 3 AS p, rank * 1000 AS seq FROM found
  UNION ALL SELECT query_id, pk, 'parent', 2, 1000000000 + nth * 1000 + step FROM par
  UNION ALL SELECT query_id, pk, source_type, 1, 2000000000 + rank * 1000 FROM ranked WHERE rank <= lim
  UNION ALL SELECT query_id, pk, 'dynamic_event', 4, 3000000000 + rank * 1000 FROM events_
  UNION ALL SELECT query_id, {_canon('hit.l.pk')}, 'link', 1, 3000000000 + rank * 1000 + nth FROM hit WHERE hit.l.type = 'static_anchor' AND hit.l.pk <> ''),
merged AS (SELECT query_id, pk, min(seq) AS seq, arg_min(source_type, -p * 10000000000 + seq) AS source_type FROM cand WHERE pk IS NOT NULL GROUP BY query_id, pk),
s AS (SELECT m.query_id, m.pk, m.seq, m.source_type, coalesce(lower(k.node_type) = 'dynamic_event', false) AS is_event, {_TOK.format('a.query')} AS q, {_TOK.format("coalesce(k.text, '')")} AS x FROM merged m JOIN kept k ON k.id = m.pk JOIN asked a ON a.query_id = m.query_id),
r AS (SELECT query_id, pk, seq, source_type, is_event, CASE WHEN is_event THEN 0.999 ELSE round(1 / (1 + exp(len(list_distinct(q)) - 2 * len(list_intersect(list_distinct(q), list_distinct(x))))), 8) END AS rerank_score FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, is_event ORDER BY CASE WHEN is_event THEN 0 ELSE -rerank_score END, seq) AS place FROM r)
SELECT query_id, pk, source_type, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY is_event DESC, place) AS rank, is_event FROM p WHERE is_event OR place <= 5"""

_TURN = "t AS (SELECT name AS conv_id, event_no AS turn, ['user', 'assistant', 'system'][event_no % 3 + 1] AS role, message AS text FROM runtime_events WHERE name IS NOT NULL AND message IS NOT NULL)"
SQL = {
    "retrieval": _RETRIEVAL,
    "filtered_scan": "SELECT delivery_no, level, node_type FROM knowledge_base_v3 WHERE source LIKE '%.md' AND NOT (level = 0) AND node_type IN ('leaf', 'section')",
    "limited_scan": "SELECT delivery_no, token_count FROM knowledge_base_v3 WHERE token_count >= 100 ORDER BY delivery_no LIMIT 500",
    "batch_fetch": f"WITH {_KEPT} SELECT id AS pk, delivery_no FROM kept WHERE id IN (SELECT l FROM kept WHERE l IS NOT NULL)",
    "partition_scan": "SELECT delivery_no FROM knowledge_base_v3 WHERE partition_name = 'dynamic_events'",
    "store_cycle": f"WITH {_BASE}, g AS (SELECT CASE WHEN coalesce(h, '') = '' THEN NULL ELSE concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) END AS pk FROM (SELECT translate(regexp_replace(lower(trim(pk, ' ' || chr(9) || chr(10) || chr(13))), '^urn:uuid:', ''), '{{}}-', '') AS h FROM node_deletions)) SELECT node AS pk, max(delivery_no) AS delivery_no, partition_name FROM ided WHERE node IS NOT NULL AND node NOT IN (SELECT pk FROM g WHERE pk IS NOT NULL) GROUP BY node, partition_name",
    "sparse_index": f"WITH {_INDEX} SELECT term, count(*) AS n FROM ix GROUP BY term",
    "sparse_index_topk": f"""WITH {_INDEX}, q AS (SELECT delivery_no AS query_id, unnest(map_keys(sparse_vector)) AS term, unnest(map_values(sparse_vector)) AS qw FROM knowledge_base_v3 WHERE delivery_no % 20 = 0)
SELECT query_id, delivery_no, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, delivery_no) AS rank FROM (SELECT query_id, delivery_no, round(sum(qw * w), 8) AS score FROM q JOIN ix USING (term) GROUP BY ALL) QUALIFY rank <= 10""",
    "stream_ttl_dedup": event_queries.SQL["ttl_dedup"],
    "stream_event_store": event_queries.STORED,
    "last_four_messages": f"WITH {_TURN} SELECT conv_id, string_agg(turn::VARCHAR, ' ' ORDER BY turn) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM t) WHERE r <= 4 GROUP BY conv_id",
    "last_assistant_message": f"WITH {_TURN} SELECT conv_id, arg_max(text, turn) AS text FROM t WHERE role = 'assistant' GROUP BY conv_id",
    "inject_system_context": f"WITH {_TURN} SELECT conv_id, count(*) + CASE WHEN bool_or(role = 'system' AND contains(text, 'probe')) THEN 0 ELSE 1 END AS n FROM t GROUP BY conv_id",
    "format_reflections": f"WITH {_TURN} SELECT conv_id, md5(string_agg(r || '. ' || text, chr(10) ORDER BY turn)) AS md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM t) GROUP BY conv_id",
}
