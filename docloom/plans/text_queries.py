"""Text scalars over the documents and nodes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.functions import ids, text as T
from docloom.plans.core_problems import _BASE
from docloom.session import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_base_v3")


def text_blocks(spark, d):
    text, blocks = T.lifted_blocks("text")
    return _docs(spark, d).select("doc_id", text.alias("lifted"), blocks.alias("blocks")).select("doc_id", "lifted", F.array_join("blocks", "\x01").alias("blocks"), F.size("blocks").alias("n_blocks"))


def text_blocks_restored(spark, d):
    text, blocks = T.lifted_blocks("text")
    return _docs(spark, d).select("doc_id", text.alias("lifted"), blocks.alias("blocks")).select("doc_id", T.restored("lifted", "blocks").alias("restored"))


def entry_hlinks(spark, d):
    text, urls = T.entry_links("text")
    return _docs(spark, d).filter(F.col("text").contains("[HLINK:")).select("doc_id", F.md5(text).alias("clean_md5"), F.array_join(urls, " ").alias("urls"))


def exit_hlinks(spark, d):
    text, links = T.exit_links("text")
    rows = _docs(spark, d).filter(F.col("text").contains("[ANCHOR:")).select("doc_id", links.alias("links"))
    return rows.select("doc_id", F.explode("links").alias("anchor", "urls")).select("doc_id", "anchor", F.array_join("urls", " ").alias("urls"))


def merged_outlinks(spark, d):
    """Outlinks of every node merged with those of its parent, where that is there."""
    from docloom.plans.retrieval_queries import _kept_once

    first = F.transform(F.filter(F.coalesce("related_links", F.array().cast("array<struct<text:string,url:string,pk:string,type:string>>")), lambda x: F.coalesce(x["text"], F.lit("")) != ""), lambda x: F.struct(x["text"].alias("n"), F.coalesce(x["url"], F.lit("")).alias("u")))
    names = F.array_distinct(F.transform("l", lambda x: x["n"]))
    links = F.map_from_arrays(names, F.transform(names, lambda n: F.array_distinct(F.transform(F.filter("l", lambda x: x["n"] == n), lambda x: x["u"]))))
    rows = _kept_once(spark, d).select("pk", ids.canonical_id(F.col("parent_id")).alias("parent"), first.alias("l")).select("pk", "parent", links.alias("links"))
    up = rows.select(F.col("pk").alias("parent"), F.col("links").alias("other"))
    return rows.join(up, "parent").select("pk", F.explode(T.merged_links("links", "other")).alias("anchor", "urls")).select("pk", "anchor", F.array_join("urls", " ").alias("urls"))


def node_labels(spark, d):
    label = T.node_label(F.col("title"), F.col("text"), F.lower("node_type"), F.col("level"))
    return _nodes(spark, d).select("delivery_no", label.alias("label"))


def token_counts(spark, d):
    return _docs(spark, d).select("doc_id", T.token_count("text").cast("long").alias("n_tokens"))


def length_bands(spark, d):
    return _docs(spark, d).select("doc_id", T.format_length(F.length("text") * 977).alias("band"))


def node_ids(spark, d):
    return _nodes(spark, d).filter("title is not null").select("delivery_no", ids.uuid5(F.col("title"), ids.NAMESPACE_URL).alias("node_id"), ids.uuid5(F.col("title"), ids.NAMESPACE_OID).alias("event_id"))


def valid_ids(spark, d):
    return _nodes(spark, d).select("delivery_no", ids.is_version5(F.col("pk")).alias("valid"))


def markdown_fixes(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.markdown_fixes("text")).alias("md5"))


def regex_replace_lines(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.replace_lines("text", "^#+ ", "= ")).alias("md5"))


def regex_insert_title(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.insert_before("text", "^## ", "# Inserted\n")).alias("md5"))


def match_positions(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.occurrences("text", "HLINK")).alias("m")).select("doc_id", F.col("m.position").cast("long").alias("position"), F.col("m.post_length").cast("long").alias("post_length"), F.md5("m.post_text").alias("post_md5"))


def match_statistics(spark, d):
    """Share of documents with the text and the length statistics of what follows it; exact median."""
    docs = _docs(spark, d)
    hits = docs.select(F.explode(T.occurrences("text", "HLINK")).alias("m")).select(F.col("m.post_length").alias("n"))
    stats = hits.agg(F.max("n").cast("long").alias("longest"), F.min("n").cast("long").alias("shortest"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.sum("n").cast("long").alias("total"), F.count("n").alias("matches"))
    share = docs.agg(F.coalesce(F.avg(F.col("text").contains("HLINK").cast("double")) * 100, F.lit(0.0)).alias("percentage"), F.count("*").alias("documents"))
    return share.join(stats)  # one row each


def content_report(spark, d):
    """The content check as text lines, one for each match: place, length in words, first 200 characters."""
    m = _docs(spark, d).select("doc_id", F.explode(T.occurrences("text", "HLINK")).alias("m"))
    preview = F.concat(F.substring("m.post_text", 1, 200), F.lit("..."))
    return m.select("doc_id", F.format_string("%d @ %d: %s", "doc_id", "m.position", T.format_length("m.post_length")).alias("line"), F.md5(preview).alias("preview_md5"))


def residual_markers(spark, d):
    """Nodes whose fields still hold link markers: counts by field and pattern, and five sample nodes by delivery."""
    rows = _nodes(spark, d).selectExpr("delivery_no", "stack(4, 'text', text, 'title', title, 'nav_next_step', nav_next_step, 'nav_see_also', nav_see_also) as (field, value)")
    hit = rows.select("delivery_no", "field", F.explode(F.array(*(F.struct(F.lit(p).alias("pattern"), F.coalesce(F.col("value").contains(p), F.lit(False)).alias("hit")) for p in ("[HLINK:", "[ANCHOR:", "@@BLOCK_")))).alias("p")).filter("p.hit")
    # min over (number) keeps at most five through the aggregation: first five by row_number
    from pyspark.sql import Window

    w = Window.partitionBy("field", "p.pattern").orderBy("delivery_no")
    counts = hit.groupBy("field", F.col("p.pattern").alias("pattern")).agg(F.count("*").alias("n"))
    first = hit.withColumn("r", F.row_number().over(w)).filter("r <= 5").groupBy("field", F.col("p.pattern").alias("pattern")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("delivery_no")), lambda x: x.cast("string")), " ").alias("samples"))
    return counts.join(first, ["field", "pattern"])


def two_of_three(spark, d):
    """Nodes for which at least two, or exactly one, of three API words occur."""
    words = ["HTTP", "参数", "Response"]
    n = sum((F.coalesce(F.col("text").contains(w), F.lit(False)).cast("int") for w in words), F.lit(0))
    return _nodes(spark, d).select("delivery_no", n.alias("n")).filter("n >= 1").select("delivery_no", (F.col("n") >= 2).alias("at_least_two"), (F.col("n") == 1).alias("exactly_one"))


def navigation_roots(spark, d):
    """Nodes with navigation texts and whether they are roots, as they have to be."""
    has = F.coalesce(F.col("nav_next_step") != "", F.lit(False)) | F.coalesce(F.col("nav_see_also") != "", F.lit(False))
    return _nodes(spark, d).filter(has).select("delivery_no", (F.lower("node_type") == "root").alias("is_root"))


def root_titles(spark, d):
    """Roots whose title isn't the name of their source file."""
    name = F.regexp_replace(F.regexp_extract("source", r"([^/\\]+)$", 1), r"\.md$", "")
    return _nodes(spark, d).filter((F.lower("node_type") == "root") & F.col("title").isNotNull() & F.col("source").isNotNull()).select("delivery_no", "title", name.alias("file")).filter("title <> file")


def metadata_codec(spark, d):
    """Stored rows decoded: node types of any case to the known ones, unknown to leaf; lists never null."""
    t = F.lower("node_type")
    known = t.isin("dynamic_event", "root", "section", "container", "leaf")
    return _nodes(spark, d).select("delivery_no", F.when(known, t).otherwise("leaf").alias("node_type"), F.size(F.coalesce("child_ids", F.array().cast("array<string>"))).alias("n_children"), F.size(F.coalesce("entry_urls", F.array().cast("array<string>"))).alias("n_urls"))


def sibling_label_lines(spark, d):
    """Numbered lines of the entry urls of each node, None where there are none."""
    return _nodes(spark, d).select("delivery_no", T.numbered_lines("entry_urls").alias("lines"))


def stored_limits(spark, d):
    """Fields that exceed a limit, with limits an eighth of the stored schema's (65,535 bytes of text, 1,024 of title, 256 children)."""
    rows = _nodes(spark, d)
    over = T.over_limits(rows.schema, {"pk": 256, "text": 8_191, "title": 128, "source": 128, "child_ids": 32, "entry_urls": 25})
    return rows.select("delivery_no", F.array_join(over, ",").alias("over")).filter("over <> ''")


_ALL = (text_blocks, text_blocks_restored, entry_hlinks, exit_hlinks, merged_outlinks, node_labels, token_counts, length_bands, node_ids, valid_ids, markdown_fixes, regex_replace_lines, regex_insert_title, match_positions, match_statistics, content_report, residual_markers, two_of_three, navigation_roots, root_titles, metadata_codec, sibling_label_lines, stored_limits)
QUERIES = {f.__name__: f for f in _ALL}

_B = "(?s)(```.*?```|:::.*?:::)"
_WS = r"[\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_strip = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_EXIT = r"\\?\[ANCHOR:\s*(.*?),\s*HLINK:\s*(.*?)\\?\]"
_OUT = f"""outlinks AS (
  SELECT doc_id, {_strip('n')} AS anchor, {_strip('u')} AS url, k FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '{_EXIT}', 1)) AS n, unnest(regexp_extract_all(text, '{_EXIT}', 2)) AS u, generate_subscripts(regexp_extract_all(text, '{_EXIT}', 1), 1) AS k FROM documents WHERE contains(text, '[ANCHOR:'))),
grouped AS (SELECT doc_id, anchor, string_agg(url, ' ' ORDER BY k) AS urls FROM (SELECT doc_id, anchor, url, min(k) AS k FROM outlinks GROUP BY ALL) GROUP BY ALL)"""
_MATCH = """m AS (
  SELECT doc_id, text, unnest(list_transform(generate_series(1, len(parts) - 1), lambda i: len(list_aggregate(parts[1:i], 'string_agg', 'HLINK')))) AS position
  FROM (SELECT doc_id, text, string_split(text, 'HLINK') AS parts FROM documents WHERE text IS NOT NULL))"""
_U5 = lambda ns: f"(substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' || substr('89ab', 1 + (position(substr(u, 17, 1) IN '0123456789abcdef') - 1) % 4, 1) || substr(u, 18, 3) || '-' || substr(u, 21, 12))".replace("u,", f"{ns},")
_BAND = lambda n: f"(CASE WHEN {n} < 1000 THEN {n}::VARCHAR || ' 字符' WHEN {n} < 1000000 THEN printf('%.1f', {n} / 1000) || '千字符' ELSE printf('%.2f', {n} / 1000000) || '兆字符' END)"

SQL = {
    "text_blocks": f"""SELECT doc_id, array_to_string(list_transform(string_split_regex(text, '{_B}'), lambda x, i: CASE WHEN i = 1 THEN x ELSE '@@BLOCK_' || (i - 2)::VARCHAR || '@@' || x END), '') AS lifted,
  array_to_string(regexp_extract_all(text, '{_B}', 1), chr(1)) AS blocks, len(regexp_extract_all(text, '{_B}', 1)) AS n_blocks FROM documents WHERE text IS NOT NULL""",
    "text_blocks_restored": "SELECT doc_id, text AS restored FROM documents WHERE text IS NOT NULL",
    "entry_hlinks": rf"SELECT doc_id, md5({_strip(chr(114) + 'egexp_replace(text, ' + chr(39) + r'\[HLINK:\s*(.*?)\]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}) AS clean_md5, array_to_string(regexp_extract_all(text, '\[HLINK:\s*(.*?)\]', 1), ' ') AS urls FROM documents WHERE contains(text, '[HLINK:')",
    "exit_hlinks": f"WITH {_OUT} SELECT doc_id, anchor, urls FROM grouped",
    "merged_outlinks": f"""WITH {_BASE}, kept AS (SELECT * FROM ided WHERE node IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY delivery_no) = 1),
l AS (SELECT node, x.text AS anchor, coalesce(x.url, '') AS url, k FROM (SELECT node, unnest(related_links, recursive := false) AS x, generate_subscripts(related_links, 1) AS k FROM kept) WHERE coalesce(x.text, '') <> ''),
p AS (SELECT c.node, c.parent FROM kept c WHERE c.parent IN (SELECT node FROM kept)),
both_ AS (SELECT p.node, anchor, url, k FROM p JOIN l ON l.node = p.node UNION ALL SELECT p.node, anchor, url, 100000 + k FROM p JOIN l ON l.node = p.parent)
SELECT node AS pk, anchor, string_agg(url, ' ' ORDER BY k) AS urls FROM (SELECT node, anchor, url, min(k) AS k FROM both_ GROUP BY ALL) GROUP BY ALL""",
    "node_labels": f"""SELECT delivery_no, title || chr(10) || CASE WHEN len(f) > 30 THEN left(f, 10) || '...' || right(f, 10) ELSE f END || chr(10) || '[' || lower(node_type) || '][L' || level::VARCHAR || ']' AS label
FROM (SELECT *, replace(replace({_strip('text')}, chr(10), ' '), '"', '''') AS f FROM knowledge_base_v3)""",
    "token_counts": r"SELECT doc_id, len(regexp_extract_all(text, '[一-鿿]|[A-Za-z0-9_]+|[^ \t\r\nA-Za-z0-9_一-鿿]')) AS n_tokens FROM documents WHERE text IS NOT NULL",
    "length_bands": f"SELECT doc_id, {_BAND('(len(text) * 977)')} AS band FROM documents WHERE text IS NOT NULL",
    "node_ids": f"SELECT delivery_no, {_U5('a')} AS node_id, {_U5('b')} AS event_id FROM (SELECT delivery_no, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(title)) AS a, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(title)) AS b FROM knowledge_base_v3 WHERE title IS NOT NULL)",
    "valid_ids": r"SELECT delivery_no, coalesce(regexp_full_match(translate(regexp_replace(lower(trim(pk, ' ' || chr(9) || chr(10) || chr(13))), '^(urn:)?(uuid:)?', ''), '{}-', ''), '[0-9a-f]{12}5[0-9a-f]{19}'), false) AS valid FROM knowledge_base_v3",
    "markdown_fixes": f"""SELECT doc_id, md5(replace(replace(regexp_replace(regexp_replace(text, '```{_WS}*\\n', '```' || chr(10), 'g'), '\\n-{{3,}}\\n', chr(10) || chr(10), 'g'), '| :--- ', '| :--- | '), '&lt;br&gt;', '<br>')) AS md5 FROM documents WHERE text IS NOT NULL""",
    "regex_replace_lines": "SELECT doc_id, md5(regexp_replace(text, '(?m)^#+ ', '= ', 'g')) AS md5 FROM documents WHERE text IS NOT NULL",
    "regex_insert_title": "SELECT doc_id, md5(regexp_replace(text, '(?m)^## ', '# Inserted' || chr(10) || '## ')) AS md5 FROM documents WHERE text IS NOT NULL",
    "match_positions": f"WITH {_MATCH} SELECT doc_id, position, len(text) - position - 5 AS post_length, md5(regexp_replace(substr(text, position + 6), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS post_md5 FROM m",
    "match_statistics": f"""WITH {_MATCH}, n AS (SELECT len(text) - position - 5 AS n FROM m)
SELECT (SELECT coalesce(avg(contains(text, 'HLINK')::INT) * 100, 0) FROM documents WHERE text IS NOT NULL) AS percentage, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS documents,
  max(n) AS longest, min(n) AS shortest, avg(n) AS mean, median(n) AS median, sum(n)::BIGINT AS total, count(n) AS matches FROM n""",
    "content_report": f"WITH {_MATCH} SELECT doc_id, doc_id || ' @ ' || position || ': ' || {_BAND('(len(text) - position - 5)')} AS line, md5(substr(regexp_replace(substr(text, position + 6), '\\n{{3,}}', chr(10) || chr(10), 'g'), 1, 200) || '...') AS preview_md5 FROM m",
    "residual_markers": """WITH v AS (SELECT delivery_no, 'text' AS field, text AS value FROM knowledge_base_v3 UNION ALL SELECT delivery_no, 'title', title FROM knowledge_base_v3 UNION ALL SELECT delivery_no, 'nav_next_step', nav_next_step FROM knowledge_base_v3 UNION ALL SELECT delivery_no, 'nav_see_also', nav_see_also FROM knowledge_base_v3),
h AS (SELECT delivery_no, field, pattern, row_number() OVER (PARTITION BY field, pattern ORDER BY delivery_no) AS r FROM v, (VALUES ('[HLINK:'), ('[ANCHOR:'), ('@@BLOCK_')) AS p(pattern) WHERE contains(value, pattern))
SELECT field, pattern, count(*) AS n, string_agg(delivery_no::VARCHAR, ' ' ORDER BY delivery_no) FILTER (WHERE r <= 5) AS samples FROM h GROUP BY ALL""",
    "two_of_three": "SELECT delivery_no, n >= 2 AS at_least_two, n = 1 AS exactly_one FROM (SELECT delivery_no, contains(text, 'HTTP')::INT + contains(text, '参数')::INT + contains(text, 'Response')::INT AS n FROM knowledge_base_v3) WHERE n >= 1",
    "navigation_roots": "SELECT delivery_no, lower(node_type) = 'root' AS is_root FROM knowledge_base_v3 WHERE coalesce(nav_next_step, '') <> '' OR coalesce(nav_see_also, '') <> ''",
    "root_titles": r"SELECT delivery_no, title, regexp_replace(regexp_extract(source, '([^/\\]+)$', 1), '\.md$', '') AS file FROM knowledge_base_v3 WHERE lower(node_type) = 'root' AND title <> regexp_replace(regexp_extract(source, '([^/\\]+)$', 1), '\.md$', '')",
    "metadata_codec": "SELECT delivery_no, CASE WHEN lower(node_type) IN ('dynamic_event', 'root', 'section', 'container', 'leaf') THEN lower(node_type) ELSE 'leaf' END AS node_type, coalesce(len(child_ids), 0) AS n_children, coalesce(len(entry_urls), 0) AS n_urls FROM knowledge_base_v3",
    "sibling_label_lines": "SELECT delivery_no, CASE WHEN coalesce(len(entry_urls), 0) = 0 THEN 'None' ELSE array_to_string(list_transform(entry_urls, lambda x, i: i::VARCHAR || '. ' || x), chr(10)) END AS lines FROM knowledge_base_v3",
    "stored_limits": """SELECT * FROM (SELECT delivery_no, array_to_string(list_filter([CASE WHEN strlen(pk) > 256 THEN 'pk' END, CASE WHEN strlen(text) > 8191 THEN 'text' END, CASE WHEN strlen(title) > 128 THEN 'title' END, CASE WHEN strlen(source) > 128 THEN 'source' END, CASE WHEN len(child_ids) > 32 THEN 'child_ids' END, CASE WHEN len(entry_urls) > 25 THEN 'entry_urls' END], lambda x: x IS NOT NULL), ',') AS over FROM knowledge_base_v3) WHERE over <> ''""",
}
