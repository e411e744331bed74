"""Trees, links and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docloom.functions import html, ids, tree
from docloom.operators import graph, hierarchy
from docloom.plans.core_problems import _BASE, _LINKS, _canon
from docloom.plans.retrieval_queries import _KEPT, _kept, _kept_once
from docloom.session import stash, table
from docloom.sources import readers


def _docs(spark, d) -> DataFrame:
    """Texts below a head of four lines, headings raised by one level: these texts keep their title in the first line."""
    docs = table(spark, d, "documents")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^#(#+ )", "$1")
    head = F.concat(F.lit("# doc\n[HLINK: "), F.coalesce("url", F.lit("none")), F.lit("]\n\n\n"))
    return docs.select(F.col("doc_id").cast("string").alias("source"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.concat(head, body).alias("text"))


def _chunks(spark, d) -> DataFrame:
    """Trees of all documents with small sizes, so that all rules are at work on these texts."""
    return tree.parse_documents(_docs(spark, d), 64, 128, 512)


def tree_chunks(spark, d):
    return _chunks(spark, d).select("source", "pk", "title", "parent_id", "level", "node_type", "token_count", "from_split", "merged", F.size("child_ids").alias("n_children"), F.md5("text").alias("text_md5"))


def tree_roots(spark, d):
    """One root a document, and whether it owns the url of the document's head."""
    urls = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.coalesce("url", F.lit("none")).alias("url"))
    roots = _chunks(spark, d).filter("node_type = 'root'").select("source", "pk", "entry_urls")
    return roots.join(urls, "source").select("source", "pk", F.array_contains("entry_urls", F.col("url")).alias("owns_url"))


def _stored_links(spark, d) -> tuple[DataFrame, DataFrame]:
    """(links, nodes) of the stored nodes. A link's url is the one its target is entered by, every third with another
    fragment; links without a target keep theirs, as the stored urls themselves belong to no node."""
    nodes = _kept_once(spark, d)
    entry = nodes.select(F.col("pk").alias("to"), F.get("entry_urls", 0).alias("entry")).filter("entry is not null")
    links = nodes.select("pk", "delivery_no", F.posexplode("related_links").alias("pos", "l")).select("pk", "delivery_no", "pos", F.coalesce("l.text", F.lit("")).alias("anchor"), F.coalesce("l.url", F.lit("")).alias("own"), ids.canonical_id(F.col("l.pk")).alias("to"))
    changed = F.when((F.col("delivery_no") + F.col("pos")) % 3 == 0, F.concat(F.substring_index("entry", "#", 1), F.lit("#other"))).otherwise(F.col("entry"))
    return links.join(entry, "to", "left").select("pk", "anchor", F.coalesce(changed, "own").alias("url")), nodes


def link_resolution(spark, d):
    return tree.resolve_urls(*_stored_links(spark, d))


def link_stats(spark, d):
    links, nodes = _stored_links(spark, d)
    return tree.link_statistics(nodes, tree.resolve_urls(links, nodes))


def tree_links(spark, d):
    """Links between the trees of all documents, resolved."""
    return tree.resolve_links(stash(_chunks(spark, d), "chunks"))


def header_document(spark, d):
    """Head (first four lines) and body of every document."""
    docs = readers.header_and_body(table(spark, d, "documents").filter("text is not null").select("doc_id", "text"))
    return docs.select("doc_id", F.md5("header").alias("head_md5"), F.md5("body").alias("body_md5"))


def heading_scan(spark, d):
    """Headings of exactly level 2 with their place among the document's lines."""
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "value"))
    return lines.filter(F.col("value").rlike(r"^##[ \t]+\S")).select("doc_id", "line", F.regexp_extract("value", r"(?s)^##[ \t]+(.*)", 1).alias("heading"))


def dup_title_numbering(spark, d):
    rows = table(spark, d, "knowledge_base_v3").filter("parent_id is not null and title is not null").select("delivery_no", "parent_id", F.element_at(F.split("title", "_"), -1).alias("name"))
    return graph.number_titles(rows, "parent_id", "name", "delivery_no").select("delivery_no", "unique_title")


def unique_filenames(spark, d):
    rows = table(spark, d, "documents").filter("url is not null").select("doc_id", F.lit(0).alias("all"), F.regexp_extract("url", r"^https?://[^/]+/([^/#]*)", 1).alias("name"))
    return graph.number_titles(rows, "name", "name", "doc_id").select("doc_id", F.col("unique_title").alias("filename"))


def title_conflicts(spark, d):
    """Names that several documents' urls share: the urls and how many."""
    rows = table(spark, d, "documents").filter("url is not null").select(F.regexp_extract("url", r"^https?://[^/]+/([^/#]*)", 1).alias("name"), "url").distinct()
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.min("url").alias("first_url")).filter("n > 1")


def sibling_links(spark, d):
    rows = _kept(spark, d).select("pk", ids.canonical_id(F.col("parent_id")).alias("parent"), "delivery_no").filter("parent is not null")
    return graph.sibling_links(rows, "parent", "pk", "delivery_no")


def child_join(spark, d):
    """Children listed by a node that are there, with their place."""
    nodes = _kept(spark, d)
    listed = nodes.select(F.col("pk").alias("parent"), F.posexplode("child_ids").alias("pos", "c")).select("parent", "pos", ids.canonical_id(F.col("c")).alias("pk"))
    return listed.join(nodes.select("pk", "title"), "pk").select("parent", "pos", "pk", "title")


def tree_edges(spark, d):
    return graph.edges(_kept(spark, d))


def subtree_preorder(spark, d):
    """Text of every subtree below a top node, in pre-order of delivery."""
    deliveries = table(spark, d, "knowledge_base_v3")
    found = stash(hierarchy.hierarchy(deliveries), "tree").filter("path is not null")
    nodes = _kept(spark, d).select("pk", "text", F.col("delivery_no").alias("pos"))
    texts = graph.subtree_texts(nodes, found.select("pk", "path"), found.filter("depth = 0").select(F.col("pk").alias("root")))
    return texts.select("root", F.md5("text").alias("md5"), F.length("text").alias("n"))


def dead_links(spark, d):
    return graph.dead_links(_kept(spark, d))


def link_walk(spark, d):
    nodes = _kept(spark, d)
    return graph.walk(nodes, nodes.filter("lower(node_type) = 'root'"))


def tree_problems(spark, d):
    return graph.tree_problems(_kept(spark, d))


def title_collisions(spark, d):
    """Ids that several titles claim: their rule would give these titles ids of their own."""
    rows = table(spark, d, "knowledge_base_v3").filter("title is not null").select(ids.node_id(F.col("pk"), F.col("title"), F.col("partition_name")).alias("pk"), "title").distinct()
    return rows.groupBy("pk").agg(F.count("*").alias("n_titles"), F.min("title").alias("first_title")).filter("n_titles > 1")


def crawl_frontier(spark, d):
    """Pages reached from the tops of all trees over contents and internal links, with the fewest steps."""
    nodes = _kept_once(spark, d)
    up = nodes.select(ids.canonical_id(F.col("parent_id")).alias("src"), F.col("pk").alias("dst")).filter("src is not null")
    across = nodes.select(F.col("pk").alias("src"), F.explode("related_links").alias("l")).filter("l.type = 'internal'").select("src", ids.canonical_id(F.col("l.pk")).alias("dst")).filter("dst is not null")
    tops = nodes.filter("partition_name = 'static_knowledge'").select(F.col("pk").alias("url"), ids.canonical_id(F.col("parent_id")).alias("p")).filter("p is null").select("url")
    return graph.frontier(stash(up.unionByName(across).distinct(), "links"), tops)


def absolute_urls(spark, d):
    """Links of six kinds resolved against every document's url."""
    docs = table(spark, d, "documents").filter("url is not null").select("doc_id", "url")
    kinds = docs.withColumn("href", F.explode(F.array(*(F.lit(x) for x in ("https://a.test/x", "/root/p", "#frag", "sub/page", "//b.test/y", "mailto:x")))))
    return kinds.select("doc_id", "href", html.absolute_url(F.col("url"), F.col("href")).alias("full"))


def html_pages(spark, d):
    """A short page of one form for every document, converted to annotated Markdown; ``html_documents`` converts whole texts."""
    docs = table(spark, d, "documents").filter("url is not null").select("doc_id", "url", "lang")
    page = F.concat(F.lit("<html><head><title>T "), F.col("doc_id").cast("string"), F.lit(" | Kubernetes</title></head><body><main><nav><ol><li><a href='/'>Docs</a></li><li><a href='/x'>Part</a></li></ol></nav><h1 id='top'>Head</h1><p>See <a href='/next/"), F.col("doc_id").cast("string"), F.lit("'>next <b>page</b></a>.</p><div class=\"toolbar\">no</div></main></body></html>"))
    text = html.convert_column(page, F.col("url"))
    return docs.select("doc_id", text.alias("markdown"))


def _document_pages(spark, d) -> DataFrame:
    """(doc_id, url, page): every document's whole text as it stands, between a table, an alert, code and misnested headers with its lines."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.coalesce("url", F.lit("")).alias("url"), "text")
    safe = F.replace(F.replace(F.replace(F.substring_index("text", "\n", 1), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    docs = docs.withColumn("line", safe).withColumn("id", F.col("doc_id").cast("string"))
    page = F.concat(
        F.lit("<html><head><title>T "), "id", F.lit(" | Kubernetes</title></head><body><main><nav><ol><li><a href='/'>Docs</a></li></ol></nav><h1 id='top'>Head</h1><h4>Deep</h4><h3>Less deep</h3><h5>概要</h5>"),
        F.lit("<table><tr><th>id</th><th>line</th></tr><tr><td>"), "id", F.lit("</td><td>"), "line", F.lit("<br>end</td></tr><tr><td><ul><li>a</li><li>b</li></ul></td><td><pre>x\ny</pre></td></tr></table>"),
        F.lit("<div class=\"alert alert-info\"><p>"), "line", F.lit("</p><h2>After "), "id", F.lit("</h2><p>moved</p></div><pre><code data-lang='yaml'>name: "), "line", F.lit("</code></pre><p>Use <code>a<code>b</code></code> and <tt></tt>.</p><div>"),
        "text", F.lit("</div></main></body></html>"))
    return docs.select("doc_id", "url", page.alias("page"))


def html_documents(spark, d):
    """Pages with the whole text of every document, converted to annotated Markdown."""
    return _document_pages(spark, d).select("doc_id", html.convert_column(F.col("page"), F.col("url")).alias("markdown"))


_ALL = (tree_chunks, tree_roots, tree_links, link_resolution, link_stats, header_document, heading_scan, dup_title_numbering, unique_filenames, title_conflicts, sibling_links, child_join, tree_edges, subtree_preorder, dead_links, link_walk, tree_problems, title_collisions, crawl_frontier, absolute_urls, html_pages, html_documents)
QUERIES = {f.__name__: f for f in _ALL}

_NAME = "regexp_extract(url, '^https?://[^/]+/([^/#]*)', 1)"
_LIST = f"listed AS (SELECT id AS parent, pos, {_canon('c')} AS pk FROM (SELECT id, unnest(child_ids) AS c, generate_subscripts(child_ids, 1) - 1 AS pos FROM kept))"

_RESOLVED = f"""lk AS (SELECT id AS pk, delivery_no, k - 1 AS pos, coalesce(l.text, '') AS anchor, coalesce(l.url, '') AS own, {_canon('l.pk')} AS goal FROM (SELECT id, delivery_no, unnest(related_links, recursive := false) AS l, generate_subscripts(related_links, 1) AS k FROM kept)),
ur AS (SELECT lk.pk, anchor, coalesce(CASE WHEN (lk.delivery_no + pos) % 3 = 0 THEN string_split(t.entry_urls[1], '#')[1] || '#other' ELSE t.entry_urls[1] END, own) AS url FROM lk LEFT JOIN kept t ON t.id = lk.goal),
ow AS (SELECT url, arg_max(id, row(source, id)) AS owner FROM (SELECT id, source, unnest(entry_urls) AS url FROM kept) WHERE url IS NOT NULL GROUP BY url),
rs AS (SELECT ur.*, coalesce(a.owner, b.owner) AS target, CASE WHEN coalesce(a.owner, b.owner) IS NULL THEN 'external' ELSE 'internal' END AS type FROM ur LEFT JOIN ow a ON a.url = ur.url LEFT JOIN ow b ON b.url = string_split(ur.url, '#')[1])"""

SQL = {
    "tree_roots": r"SELECT doc_id::VARCHAR AS source, substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' || substr('89ab', 1 + (position(substr(u, 17, 1) IN '0123456789abcdef') - 1) % 4, 1) || substr(u, 18, 3) || '-' || substr(u, 21, 12) AS pk, owns_url FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc' || doc_id)) AS u, true AS owns_url FROM documents)",
    "header_document": "SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[1:4], chr(10))) AS head_md5, md5(coalesce(array_to_string(string_split(text, chr(10))[5:], chr(10)), '')) AS body_md5 FROM documents WHERE text IS NOT NULL",
    "heading_scan": r"SELECT doc_id, line, regexp_extract(value, '^##[ \t]+(.*)', 1) AS heading FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents) WHERE regexp_matches(value, '^##[ \t]+\S')",
    "dup_title_numbering": "SELECT delivery_no, CASE WHEN n > 1 THEN name || '_' || n ELSE name END AS unique_title FROM (SELECT delivery_no, name, row_number() OVER (PARTITION BY parent_id, name ORDER BY delivery_no) AS n FROM (SELECT delivery_no, parent_id, string_split(title, '_')[-1] AS name FROM knowledge_base_v3 WHERE parent_id IS NOT NULL AND title IS NOT NULL))",
    "unique_filenames": f"SELECT doc_id, CASE WHEN n > 1 THEN name || '_' || n ELSE name END AS filename FROM (SELECT doc_id, {_NAME} AS name, row_number() OVER (PARTITION BY {_NAME} ORDER BY doc_id) AS n FROM documents WHERE url IS NOT NULL)",
    "title_conflicts": f"SELECT {_NAME} AS name, count(DISTINCT url) AS n, min(url) AS first_url FROM documents WHERE url IS NOT NULL GROUP BY 1 HAVING count(DISTINCT url) > 1",
    "sibling_links": f"WITH {_KEPT} SELECT id AS pk, coalesce(lag(id) OVER w, '') AS \"left\", coalesce(lead(id) OVER w, '') AS \"right\" FROM kept WHERE parent IS NOT NULL WINDOW w AS (PARTITION BY parent ORDER BY delivery_no)",
    "child_join": f"WITH {_KEPT}, {_LIST} SELECT l.parent, l.pos, l.pk, k.title FROM listed l JOIN kept k ON k.id = l.pk",
    "tree_edges": f"WITH {_KEPT}, {_LIST} SELECT 'child' AS kind, parent AS src, pk AS dst, pos FROM listed WHERE pk IS NOT NULL UNION ALL SELECT 'left', id, l, 0 FROM kept WHERE l IS NOT NULL UNION ALL SELECT 'right', id, r, 0 FROM kept WHERE r IS NOT NULL",
    "subtree_preorder": f"""{_LINKS.replace('walk(pk, level, root, depth, path, dangling)', 'walk(pk, level, root, depth, path, dangling, k)').replace('SELECT pk, level, pk, 0, pk, dangling FROM tops', 'SELECT t.pk, t.level, t.pk, 0, t.pk, t.dangling, [f.d] FROM tops t JOIN firsts f ON f.pk = t.pk').replace("w.path || '/' || n.pk, w.dangling FROM walk w JOIN nodes n ON n.parent = w.pk", "w.path || '/' || n.pk, w.dangling, list_append(w.k, f.d) FROM walk w JOIN nodes n ON n.parent = w.pk JOIN firsts f ON f.pk = n.pk").replace('tops AS', "firsts AS (SELECT node AS pk, min(delivery_no) AS d, coalesce(arg_min(text, delivery_no), '') AS text FROM ided WHERE node IS NOT NULL GROUP BY node), tops AS", 1)}
SELECT w.root, md5(string_agg(f.text, chr(10) || chr(10) ORDER BY w.k)) AS md5, len(string_agg(f.text, chr(10) || chr(10) ORDER BY w.k)) AS n FROM walk w JOIN firsts f ON f.pk = w.pk GROUP BY w.root""",
    "dead_links": f"WITH {_KEPT}, x AS (SELECT DISTINCT id AS pk, {_canon('t')} AS target FROM (SELECT id, unnest(list_filter(related_links, lambda x: x.type = 'internal')).pk AS t FROM kept)) SELECT pk, target FROM x WHERE target IS NOT NULL AND target NOT IN (SELECT id FROM kept)",
    "tree_problems": f"""WITH {_KEPT}, {_LIST}, d AS (SELECT DISTINCT parent, pk FROM listed WHERE pk IS NOT NULL)
SELECT id AS pk, 'not listed by its parent' AS problem FROM kept k WHERE parent IS NOT NULL AND parent IN (SELECT id FROM kept) AND NOT EXISTS (SELECT 1 FROM d WHERE d.parent = k.parent AND d.pk = k.id)
UNION ALL SELECT DISTINCT d.pk, 'listed by another node' FROM d JOIN kept k ON k.id = d.pk WHERE k.parent IS NULL OR k.parent <> d.parent""",
    "title_collisions": f"WITH {_BASE} SELECT node AS pk, count(DISTINCT title) AS n_titles, min(title) AS first_title FROM ided WHERE title IS NOT NULL GROUP BY node HAVING count(DISTINCT title) > 1",
    "crawl_frontier": f"""WITH RECURSIVE {_KEPT},
e AS (SELECT DISTINCT parent AS src, id AS dst FROM kept WHERE parent IS NOT NULL UNION SELECT id, {_canon('t')} FROM (SELECT id, unnest(list_filter(related_links, lambda x: x.type = 'internal')).pk AS t FROM kept)),
f(url, depth) USING KEY (url) AS (
  SELECT id, 0 FROM kept WHERE partition_name = 'static_knowledge' AND parent IS NULL
  UNION SELECT e.dst, min(f.depth + 1) FROM f JOIN e ON e.src = f.url WHERE e.dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM recurring.f g WHERE g.url = e.dst) GROUP BY e.dst)
SELECT url, depth FROM f""",
    "link_walk": f"""WITH RECURSIVE {_KEPT},
x AS (SELECT DISTINCT id AS pk, {_canon('t')} AS next FROM (SELECT id, unnest(list_filter(related_links, lambda x: x.type = 'internal')).pk AS t FROM kept)),
live AS (SELECT pk, next FROM x WHERE next IN (SELECT id FROM kept)),
w(start, hop, pk) AS (SELECT id, 0, id FROM kept WHERE lower(node_type) = 'root'
  UNION ALL SELECT w.start, w.hop + 1, arg_min(l.next, md5(w.start || l.next || '1')) FROM w JOIN live l ON l.pk = w.pk WHERE w.hop < 5 GROUP BY w.start, w.hop)
SELECT start, hop, pk FROM w""",
    "link_resolution": f"WITH {_KEPT}, {_RESOLVED} SELECT pk, anchor, url, target, type FROM rs",
    "link_stats": f"""WITH {_KEPT}, {_RESOLVED}, per AS (SELECT pk, count(*) AS n, count(target) AS inside FROM rs GROUP BY pk)
SELECT (SELECT sum(len(entry_urls))::BIGINT FROM kept) AS anchors, (SELECT max(len(entry_urls)) FROM kept) AS most_anchors, sum(n)::BIGINT AS links, sum(inside)::BIGINT AS resolved, max(n) AS most_links FROM per""",
    "absolute_urls": r"""SELECT doc_id, href, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^(https?:)', 1) || href WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href WHEN href LIKE '#%' THEN regexp_extract(url, '^([^#]*)', 1) || href
  ELSE CASE WHEN regexp_extract(url, '^(https?://[^/?#]+(?:/[^?#]*/)?)', 1) LIKE '%/' THEN regexp_extract(url, '^(https?://[^/?#]+(?:/[^?#]*/)?)', 1) ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' END || href END AS "full"
FROM documents, (VALUES ('https://a.test/x'), ('/root/p'), ('#frag'), ('sub/page'), ('//b.test/y'), ('mailto:x')) h(href) WHERE url IS NOT NULL""",
    "html_pages": r"""SELECT doc_id, '# T ' || doc_id || chr(10) || '[HLINK: ' || url || ']' || chr(10) || 'Docs / Part' || chr(10) || chr(10) || '# Head [HLINK: ' || regexp_replace(url, '#.*$', '') || '#top]' || chr(10) || chr(10)
  || 'See [ANCHOR: nextpage, HLINK: ' || regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/next/' || doc_id || '].' || chr(10) AS markdown FROM documents WHERE url IS NOT NULL""",
}
