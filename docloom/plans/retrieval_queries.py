"""Retrieval over the stored nodes, with its SQL. Queries are the usable rows whose delivery_no is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docloom.functions import ids
from docloom.operators import batching, retrieval as R
from docloom.session import stash, table

_FIELDS = R.Fields(key="delivery_no")


def _nodes(spark, d) -> DataFrame:
    return table(spark, d, "knowledge_base_v3")


def _queries(spark, d, *more) -> DataFrame:
    return _nodes(spark, d).filter("delivery_no % 20 = 0").select(F.col("delivery_no").alias("query_id"), *more)


def dense_topk_cosine(spark, d):
    return R.dense_search(_queries(spark, d, "vector"), _nodes(spark, d), "delivery_no", "vector", 10)


def sparse_postings(spark, d):
    p = R.postings(_nodes(spark, d), "delivery_no", "sparse_vector")
    return p.groupBy("term").agg(F.count("*").alias("n"), F.round(F.max("w"), 8).alias("heaviest"))


def sparse_topk_ip(spark, d):
    return R.sparse_search(_queries(spark, d, "sparse_vector"), _nodes(spark, d), "delivery_no", "sparse_vector", 10)


def sparse_topk_dropped(spark, d):
    return R.sparse_search(_queries(spark, d, "sparse_vector"), _nodes(spark, d), "delivery_no", "sparse_vector", 10, drop_ratio=0.2)


def title_sparse_topk(spark, d):
    return R.sparse_search(_queries(spark, d, "sparse_vector"), _nodes(spark, d), "delivery_no", "title_sparse", 10, query_sparse="sparse_vector")


def hybrid_rrf(spark, d):
    return R.hybrid_search(_queries(spark, d, "vector", "sparse_vector"), _nodes(spark, d), _FIELDS)


def term_weights(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return R.term_weights(docs, "doc_id", "text").select("doc_id", "term", F.round("w", 8).alias("w"))


def distinct_queries(spark, d):
    q = _nodes(spark, d).select(F.col("delivery_no").alias("query_id"), F.col("title").alias("text"))
    return R.distinct_queries(q).select("text", F.array_join(F.transform("query_ids", lambda x: x.cast("string")), " ").alias("query_ids"))


def priority_merge(spark, d):
    """Candidates: every document with its source as the query, its url as the pk and a type by its id."""
    types = F.element_at(F.array(*(F.lit(x) for x in ("sibling", "link", "PARENT", "anchor", "dynamic_event", "other"))), (F.col("doc_id") % 6 + 1).cast("int"))
    c = table(spark, d, "documents").filter("source is not null").select(F.col("source").alias("query_id"), F.regexp_extract("url", r"^(https?://[^/]+/[^/]*)", 1).alias("pk"), types.alias("source_type"), F.col("doc_id").alias("seq"))
    return R.priority_merge(c)


def _kept(spark, d) -> DataFrame:
    """One row a node by canonical id: the delivery with the lowest number."""
    rows = _nodes(spark, d).withColumn("pk", ids.node_id(F.col("pk"), F.col("title"), F.col("partition_name"))).filter("pk is not null")
    first = rows.groupBy("pk").agg(F.min("delivery_no").alias("delivery_no")).select("delivery_no")
    return rows.join(first, "delivery_no", "left_semi")


def _kept_once(spark, d) -> DataFrame:
    """``_kept`` written, for plans that read it several times."""
    return stash(_kept(spark, d), "kept")


def _anchors(spark, d, nodes) -> DataFrame:
    """Every static node is the anchor of one query, made of it and the 19 nodes delivered around it."""
    return nodes.filter("partition_name = 'static_knowledge' and title is not null").withColumn("query_id", F.floor(F.col("delivery_no") / 20).cast("long")).withColumn("seq", F.col("delivery_no"))


def _query_vectors(nodes) -> DataFrame:
    """The query of a group of 20: the first usable vector among them."""
    good = nodes.filter((F.size("vector") == 64) & ~F.exists("vector", lambda x: F.isnan(x)) & F.exists("vector", lambda x: x != 0))
    return good.withColumn("query_id", F.floor(F.col("delivery_no") / 20).cast("long")).groupBy("query_id").agg(F.min_by("vector", "delivery_no").alias("vector"))


def _usable(nodes) -> DataFrame:
    ok = (F.size("summary_vector") == 64) & ~F.exists("summary_vector", lambda x: F.isnan(x))
    return nodes.withColumn("summary_vector", F.when(ok, F.col("summary_vector")))


def title_ancestors(spark, d):
    return R.ancestors(_anchors(spark, d, _kept(spark, d))).select("pk", "step", "ancestor")


def parent_expansion(spark, d):
    nodes = _usable(_kept_once(spark, d))
    return R.expand_parents(_anchors(spark, d, nodes), nodes, _query_vectors(nodes))


def link_expansion(spark, d):
    nodes = _usable(_kept_once(spark, d))
    anchors = _anchors(spark, d, nodes)
    return R.expand_links(anchors, nodes, _query_vectors(nodes), anchors)


def graph_expansion(spark, d):
    nodes = _usable(_kept_once(spark, d))
    return R.expand(_anchors(spark, d, nodes), nodes, _query_vectors(nodes)).drop("seq")


def _candidates(spark, d) -> DataFrame:
    rows = _nodes(spark, d).filter("pk is not null")
    return rows.select(F.floor(F.col("delivery_no") / 20).cast("long").alias("query_id"), F.coalesce("source", F.lit("none")).alias("query"), F.col("delivery_no").alias("pk"), "text", "node_type", F.col("delivery_no").alias("seq"), "title", "related_links", F.lit(None).cast("string").alias("source_desc"))


def rerank_topn(spark, d):
    return R.rerank(_candidates(spark, d))


def rerank_input_order(spark, d):
    return R.rerank(_candidates(spark, d), scorer=None).select("query_id", "pk", "rank", "is_event")


def rerank_pairs(spark, d):
    c = _candidates(spark, d)
    # the kind of a node stands for the operation
    instruction = R.instruction_for(F.lower("node_type"), {"dynamic_event": "Find passages that explain the event.", "root": "Find pages on the subject."}, "Find passages that answer the query.")
    pair = R.rerank_pair(instruction, F.col("query"), F.col("title"), F.col("text"), F.lit("anchor"), F.col("source_desc"))
    return c.select("pk", F.md5(pair).alias("pair_md5"))


def format_docs(spark, d):
    return R.format_docs(_candidates(spark, d)).select("query_id", F.md5("text").alias("md5"), F.length("text").alias("n"))


def token_batches(spark, d):
    rows = _nodes(spark, d).filter("token_count > 0 and source is not null").select("source", "delivery_no", "token_count")
    return batching.token_batches(rows, "source", "delivery_no", "token_count", 2048)


def padded_batches(spark, d):
    rows = _nodes(spark, d).filter("token_count > 0 and source is not null").select("source", "delivery_no", "token_count")
    return batching.padded_batches(rows, "source", "delivery_no", "token_count", 5000)


def merge_dp_segments(spark, d):
    rows = _nodes(spark, d).filter("token_count > 0 and parent_id is not null").select("parent_id", "delivery_no", "token_count")
    return batching.merge_segments(rows, "parent_id", "delivery_no", "token_count", 64, 256)


def leaf_runs(spark, d):
    rows = _nodes(spark, d).filter("source is not null").select("source", "delivery_no", "node_type", "token_count")
    m = F.coalesce((F.lower("node_type") == "leaf") & (F.col("token_count") < 100), F.lit(False))
    return batching.leaf_runs(rows, "source", "delivery_no", m).select("source", "delivery_no", "run")


_ALL = (dense_topk_cosine, sparse_postings, sparse_topk_ip, sparse_topk_dropped, title_sparse_topk, hybrid_rrf, term_weights, distinct_queries, priority_merge, title_ancestors, parent_expansion, link_expansion, graph_expansion, rerank_topn, rerank_input_order, rerank_pairs, format_docs, token_batches, padded_batches, merge_dp_segments, leaf_runs)
QUERIES = {f.__name__: f for f in _ALL}

from docloom.plans.core_problems import _BASE, _canon  # noqa: E402

_GOOD = lambda c: f"len({c}) = 64 AND len(list_filter({c}, lambda x: isnan(x))) = 0"
_SOME = lambda c: f"len(list_filter({c}, lambda x: x <> 0)) > 0"
_COS = lambda a, b: f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 8)"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, delivery_no)"
_DENSE = f"""dense AS (SELECT query_id, delivery_no, score, {_RANK} AS rank FROM (
  SELECT q.delivery_no AS query_id, n.delivery_no, {_COS('q.vector', 'n.vector')} AS score FROM
    (SELECT * FROM knowledge_base_v3 WHERE delivery_no % 20 = 0 AND {_GOOD('vector')} AND {_SOME('vector')}) q, (SELECT * FROM knowledge_base_v3 WHERE {_GOOD('vector')} AND {_SOME('vector')}) n) QUALIFY rank <= 10)"""


def _sparse(name: str, field: str, drop: bool = False) -> str:
    keep = " QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY qw DESC, term) <= ceil(count(*) OVER (PARTITION BY query_id) * 0.8)" if drop else ""
    return f"""{name} AS (SELECT query_id, delivery_no, score, {_RANK} AS rank FROM (
  SELECT query_id, delivery_no, round(sum(qw * w), 8) AS score FROM
    (SELECT * FROM (SELECT delivery_no AS query_id, unnest(map_keys(sparse_vector)) AS term, unnest(map_values(sparse_vector)) AS qw FROM knowledge_base_v3 WHERE delivery_no % 20 = 0){keep}) q
    JOIN (SELECT delivery_no, unnest(map_keys({field})) AS term, unnest(map_values({field})) AS w FROM knowledge_base_v3) p USING (term) GROUP BY ALL) QUALIFY rank <= 10)"""


_KEPT = f"{_BASE}, kept AS (SELECT *, node AS id FROM ided WHERE node IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY delivery_no) = 1)"
_EXP = f"""{_KEPT},
qv AS (SELECT delivery_no // 20 AS query_id, arg_min(vector, delivery_no) AS vector FROM kept WHERE {_GOOD('vector')} AND {_SOME('vector')} GROUP BY 1),
anchors AS (SELECT delivery_no // 20 AS query_id, id AS pk, title, delivery_no AS seq, CASE WHEN {_GOOD('summary_vector')} THEN summary_vector END AS sv, l, r, related_links FROM kept WHERE partition_name = 'static_knowledge' AND title IS NOT NULL),
tp AS (SELECT query_id, pk, string_split(title, '_') AS parts FROM anchors),
up AS (SELECT query_id, pk, step, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(array_to_string(parts[1:len(parts) - step], '_'))) AS u FROM (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS step FROM tp WHERE len(parts) > 1)),
anc AS (SELECT query_id, pk, step, substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' || substr('89ab', 1 + (position(substr(u, 17, 1) IN '0123456789abcdef') - 1) % 4, 1) || substr(u, 18, 3) || '-' || substr(u, 21, 12) AS ancestor FROM up),
sc AS (SELECT a.query_id, a.pk, a.step, a.ancestor, {_COS('qv.vector', 'k.summary_vector')} AS sim FROM anc a JOIN kept k ON k.id = a.ancestor JOIN qv ON qv.query_id = a.query_id
  WHERE {_GOOD('k.summary_vector')} AND {_SOME('k.summary_vector')} AND NOT EXISTS (SELECT 1 FROM anchors x WHERE x.query_id = a.query_id AND x.pk = a.ancestor)
  UNION ALL SELECT a.query_id, a.pk, a.step, a.ancestor, 0.0 FROM anc a JOIN kept k ON k.id = a.ancestor JOIN qv ON qv.query_id = a.query_id
  WHERE {_GOOD('k.summary_vector')} AND NOT {_SOME('k.summary_vector')} AND NOT EXISTS (SELECT 1 FROM anchors x WHERE x.query_id = a.query_id AND x.pk = a.ancestor)),
num AS (SELECT *, row_number() OVER (PARTITION BY query_id, pk ORDER BY step) AS i FROM sc),
walk(query_id, pk, i, step, ancestor, sim) AS (
  SELECT a.query_id, a.pk, 0::BIGINT, 0::BIGINT, '', CASE WHEN a.sv IS NULL THEN 0.5 WHEN {_SOME('a.sv')} THEN {_COS('qv.vector', 'a.sv')} ELSE 0.0 END FROM anchors a JOIN qv ON qv.query_id = a.query_id
  UNION ALL SELECT n.query_id, n.pk, n.i, n.step, n.ancestor, n.sim FROM walk w JOIN num n ON n.query_id = w.query_id AND n.pk = w.pk AND n.i = w.i + 1 WHERE n.sim >= 0.75 * w.sim AND n.sim > 0.2),
par AS (SELECT query_id, ancestor AS pk, pk AS anchor, step, sim AS score FROM walk WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY query_id, ancestor ORDER BY pk) = 1)"""
_WALK = _EXP[_EXP.index("tp AS (") : _EXP.index(",\npar AS")]  # ancestors and the walk up, from ``anchors`` and ``qv``


def _links(seen: str) -> str:
    return f"""raw AS (SELECT query_id, seq, 0 AS place, 'sibling' AS source_type, l AS pk FROM anchors UNION ALL SELECT query_id, seq, 1, 'sibling', r FROM anchors
  UNION ALL SELECT query_id, seq, 1 + k, 'link', {_canon('lpk')} FROM (SELECT query_id, seq, unnest(related_links, recursive := false).pk AS lpk, generate_subscripts(related_links, 1) AS k FROM (SELECT query_id, seq, list_filter(related_links, lambda x: x.type = 'internal') AS related_links FROM anchors))),
fst AS (SELECT query_id, pk, source_type FROM raw WHERE pk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, pk ORDER BY seq, place) = 1),
fresh AS (SELECT * FROM fst f WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.query_id = f.query_id AND s.pk = f.pk)),
lim AS (SELECT query_id, least(10, greatest(1 + (SELECT count(*) FROM anchors a WHERE a.query_id = f.query_id), ceil(0.5 * count(*)))) AS lim FROM fresh f GROUP BY query_id),
lk AS (SELECT f.query_id, f.pk, f.source_type, CASE WHEN {_SOME('k.summary_vector')} THEN {_COS('qv.vector', 'k.summary_vector')} ELSE 0.0 END AS score FROM fresh f JOIN kept k ON k.id = f.pk JOIN qv ON qv.query_id = f.query_id WHERE {_GOOD('k.summary_vector')}),
ranked AS (SELECT lk.*, row_number() OVER (PARTITION BY lk.query_id ORDER BY score DESC, pk) AS rank, lim FROM lk JOIN lim ON lim.query_id = lk.query_id)"""


_TOK = r"regexp_extract_all(lower({}), '[一-鿿]|[A-Za-z0-9_]+|[^ \t\r\nA-Za-z0-9_一-鿿]')"
_CAND = "cand AS (SELECT delivery_no // 20 AS query_id, coalesce(source, 'none') AS query, delivery_no AS pk, text, lower(node_type) = 'dynamic_event' AS is_event, lower(node_type) AS kind, title, related_links FROM knowledge_base_v3 WHERE pk IS NOT NULL)"
_LISTS = "WITH RECURSIVE items AS (SELECT {g} AS g, delivery_no // {c} AS c, delivery_no AS o, token_count AS t, row_number() OVER (PARTITION BY {g}, delivery_no // {c} ORDER BY {by}) AS i FROM knowledge_base_v3 WHERE token_count > 0 AND {g} IS NOT NULL)"

SQL = {
    "dense_topk_cosine": f"WITH {_DENSE} SELECT * FROM dense",
    "sparse_postings": "SELECT term, count(*) AS n, round(max(w), 8) AS heaviest FROM (SELECT unnest(map_keys(sparse_vector)) AS term, unnest(map_values(sparse_vector)) AS w FROM knowledge_base_v3) GROUP BY term",
    "sparse_topk_ip": f"WITH {_sparse('s', 'sparse_vector')} SELECT * FROM s",
    "sparse_topk_dropped": f"WITH {_sparse('s', 'sparse_vector', True)} SELECT * FROM s",
    "title_sparse_topk": f"WITH {_sparse('s', 'title_sparse')} SELECT * FROM s",
    "hybrid_rrf": f"""WITH {_DENSE}, {_sparse('a', 'sparse_vector')}, {_sparse('b', 'title_sparse')},
u AS (SELECT query_id, delivery_no, rank FROM dense UNION ALL SELECT query_id, delivery_no, rank FROM a UNION ALL SELECT query_id, delivery_no, rank FROM b)
SELECT query_id, delivery_no, score, {_RANK} AS rank FROM (SELECT query_id, delivery_no, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM u GROUP BY ALL) QUALIFY rank <= 5""",
    "term_weights": f"SELECT doc_id, term, round(count(*)::DOUBLE / any_value(n), 8) AS w FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term, len({_TOK.format('text')}) AS n FROM documents) GROUP BY doc_id, term",
    "distinct_queries": "SELECT title AS text, string_agg(delivery_no::VARCHAR, ' ' ORDER BY delivery_no) AS query_ids FROM knowledge_base_v3 WHERE title IS NOT NULL GROUP BY title",
    "priority_merge": """WITH c AS (SELECT source AS query_id, regexp_extract(url, '^(https?://[^/]+/[^/]*)', 1) AS pk, ['sibling', 'link', 'PARENT', 'anchor', 'dynamic_event', 'other'][doc_id % 6 + 1] AS source_type, [1, 1, 2, 3, 4, 0][doc_id % 6 + 1]::BIGINT AS priority, doc_id AS seq FROM documents WHERE source IS NOT NULL AND url IS NOT NULL)
SELECT query_id, pk, min(seq) AS position, max(priority) AS priority, arg_min(source_type, -priority * 1000000000 + seq) AS source_type FROM c GROUP BY query_id, pk""",
    "title_ancestors": f"WITH {_EXP.split('sc AS')[0].rstrip().rstrip(',')} SELECT pk, step, ancestor FROM anc",
    "parent_expansion": f"WITH RECURSIVE {_EXP} SELECT * FROM par",
    "link_expansion": f"WITH RECURSIVE {_EXP}, {_links('SELECT query_id, pk FROM anchors')} SELECT query_id, pk, source_type, score, rank FROM ranked WHERE rank <= lim",
    "graph_expansion": f"WITH RECURSIVE {_EXP}, {_links('SELECT query_id, pk FROM anchors UNION ALL SELECT query_id, pk FROM par')} SELECT query_id, pk, 'parent' AS source_type, score FROM par UNION ALL SELECT query_id, pk, source_type, score FROM ranked WHERE rank <= lim",
    "rerank_topn": f"""WITH {_CAND},
s AS (SELECT *, len(list_intersect(list_distinct({_TOK.format('query')}), list_distinct({_TOK.format("coalesce(text, '')")}))) AS yes, len(list_distinct({_TOK.format('query')})) AS all_ FROM cand),
r AS (SELECT query_id, pk, is_event, CASE WHEN is_event THEN 0.999 ELSE round(1 / (1 + exp(all_ - 2 * yes)), 8) END AS rerank_score FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, is_event ORDER BY CASE WHEN is_event THEN 0 ELSE -rerank_score END, pk) AS place FROM r)
SELECT query_id, pk, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY is_event DESC, place) AS rank, is_event FROM p WHERE is_event OR place <= 5""",
    "rerank_input_order": f"""WITH {_CAND}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, is_event ORDER BY pk) AS place FROM cand)
SELECT query_id, pk, row_number() OVER (PARTITION BY query_id ORDER BY is_event DESC, place) AS rank, is_event FROM p WHERE is_event OR place <= 5""",
    "rerank_pairs": f"WITH {_CAND} SELECT pk, md5('<Instruct>: ' || CASE kind WHEN 'dynamic_event' THEN 'Find passages that explain the event.' WHEN 'root' THEN 'Find pages on the subject.' ELSE 'Find passages that answer the query.' END || chr(10) || '<Query>: ' || query || chr(10) || '<Document>: [Title]: ' || coalesce(title, 'Untitled Section') || chr(10) || '[Retrieval Context]: Type=anchor. Info=Retrieved via vector search' || chr(10) || '[Content]: ' || text) AS pair_md5 FROM cand",
    "format_docs": f"""WITH {_CAND}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_event DESC, pk) AS i FROM cand),
e AS (SELECT query_id, i, '[' || i || '] ' || coalesce(title, 'Unknown') || CASE WHEN is_event THEN ' | guide: ' || coalesce(list_filter(related_links, lambda x: x.type = 'static_anchor')[1].text, 'None') ELSE ' | source: Retrieved Document' END || chr(10) || regexp_replace(coalesce(text, ''), '^[\\s\\x{{3000}}\\x{{00a0}}]+|[\\s\\x{{3000}}\\x{{00a0}}]+$', '', 'g') AS t FROM n)
SELECT query_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS md5, len(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS n FROM e GROUP BY query_id""",
    "token_batches": _LISTS.format(g="source", c=1000000000, by="delivery_no") + """,
f(g, c, i, nxt, s, op, b) AS (
  SELECT g, c, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, -1::BIGINT FROM (SELECT DISTINCT g, c FROM items)
  UNION ALL
  SELECT f.g, f.c, x.i, CASE WHEN x.t > 2048 OR (f.op > 0 AND f.s + x.t > 2048) THEN f.nxt + 1 ELSE f.nxt END,
    CASE WHEN x.t > 2048 THEN f.s WHEN f.op > 0 AND f.s + x.t > 2048 THEN x.t ELSE f.s + x.t END, CASE WHEN x.t > 2048 THEN f.op WHEN f.op > 0 AND f.s + x.t > 2048 THEN 1 ELSE f.op + 1 END,
    CASE WHEN x.t > 2048 THEN f.nxt END FROM f JOIN items x ON x.g = f.g AND x.c = f.c AND x.i = f.i + 1),
e AS (SELECT f.g, f.c, f.i, f.b, f.nxt, f.op, sum(CASE WHEN f.b IS NULL AND f.op = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY f.g, f.c ORDER BY f.i) AS opn FROM f WHERE f.i > 0),
lst AS (SELECT g, c, opn, max(nxt) AS last_nxt FROM e GROUP BY ALL),
clo AS (SELECT g, c, opn, coalesce((SELECT min(e2.nxt) - 1 FROM e e2 WHERE e2.g = l.g AND e2.c = l.c AND e2.opn = l.opn + 1 AND e2.b IS NULL), last_nxt) AS batch FROM lst l)
SELECT x.g AS source, x.o AS delivery_no, coalesce(e.b, clo.batch) AS batch FROM e JOIN items x ON x.g = e.g AND x.c = e.c AND x.i = e.i LEFT JOIN clo ON clo.g = e.g AND clo.c = e.c AND clo.opn = e.opn""",
    "padded_batches": _LISTS.format(g="source", c=1000000000, by="token_count DESC, delivery_no") + """,
f(g, i, b, k, m) AS (
  SELECT DISTINCT g, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM items
  UNION ALL
  SELECT f.g, x.i, CASE WHEN (f.k + 1) * greatest(f.m, x.t) <= 5000 OR f.k = 0 THEN f.b ELSE f.b + 1 END,
    CASE WHEN (f.k + 1) * greatest(f.m, x.t) <= 5000 THEN f.k + 1 ELSE 1 END, CASE WHEN (f.k + 1) * greatest(f.m, x.t) <= 5000 THEN greatest(f.m, x.t) ELSE x.t END
  FROM f JOIN items x ON x.g = f.g AND x.i = f.i + 1)
SELECT x.g AS source, x.o AS delivery_no, f.b AS batch FROM f JOIN items x ON x.g = f.g AND x.i = f.i""",
    "merge_dp_segments": """WITH RECURSIVE items AS (SELECT parent_id AS g, delivery_no AS o, token_count AS t, row_number() OVER (PARTITION BY parent_id ORDER BY delivery_no) AS i FROM knowledge_base_v3 WHERE token_count > 0 AND parent_id IS NOT NULL),
s AS (SELECT *, CASE WHEN t < 256 AND coalesce(lag(t) OVER (PARTITION BY g ORDER BY i), 256) < 256 THEN 0 ELSE 1 END AS begins FROM items),
r AS (SELECT g, o, t, i, sum(begins) OVER (PARTITION BY g ORDER BY i) - 1 AS run FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY g, run ORDER BY i) AS j, sum(t) OVER (PARTITION BY g, run ORDER BY i) AS ps FROM r),
p AS (SELECT g, run, list_prepend(0::HUGEINT, list(ps ORDER BY j)) AS ps, count(*) AS m, max(t) AS big FROM n GROUP BY g, run),
f(g, run, i, best, back) AS (
  SELECT g, run, 0::BIGINT, [0::BIGINT], [0::BIGINT] FROM p WHERE big < 256
  UNION ALL
  SELECT g, run, i + 1, list_append(best, x.c), list_append(back, x.b) FROM (
    SELECT f.g, f.run, f.i, f.best, f.back, list_sort(list_filter(list_transform(range(0, f.i + 1), lambda b: {'c': f.best[b + 1] + CASE WHEN p.ps[f.i + 2] - p.ps[b + 1] < 64 THEN 1 ELSE 0 END, 'last': -b, 'b': b, 'fits': p.ps[f.i + 2] - p.ps[b + 1] <= 256}), lambda y: y.fits))[1] AS x
    FROM f JOIN p ON p.g = f.g AND p.run = f.run WHERE f.i < p.m)),
fin AS (SELECT f.g, f.run, f.back, p.m FROM f JOIN p ON p.g = f.g AND p.run = f.run AND f.i = p.m),
b(g, run, e, s, back) AS (SELECT g, run, m, back[m + 1], back FROM fin UNION ALL SELECT g, run, s, back[s + 1], back FROM b WHERE s > 0),
num AS (SELECT g, run, s, e, row_number() OVER (PARTITION BY g ORDER BY run, s) - 1 AS segment FROM (SELECT g, run, s, e FROM b UNION ALL SELECT g, run, 0, m FROM p WHERE big >= 256))
SELECT n.g AS parent_id, n.o AS delivery_no, n.run, num.segment FROM n JOIN num ON n.g = num.g AND n.run = num.run AND n.j > num.s AND n.j <= num.e""",
    "leaf_runs": """WITH m AS (SELECT source, delivery_no, coalesce(lower(node_type) = 'leaf' AND token_count < 100, false) AS m FROM knowledge_base_v3 WHERE source IS NOT NULL),
s AS (SELECT *, CASE WHEN m AND coalesce(lag(m) OVER (PARTITION BY source ORDER BY delivery_no), false) THEN 0 ELSE 1 END AS s FROM m)
SELECT source, delivery_no, sum(s) OVER (PARTITION BY source ORDER BY delivery_no)::BIGINT AS run FROM s""",
}
