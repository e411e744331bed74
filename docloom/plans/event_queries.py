"""Events and crawl logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docloom.functions import ids
from docloom.operators import crawl_log as L, events as E
from docloom.plans.core_problems import _BASE, _canon
from docloom.plans.retrieval_queries import _KEPT, _TOK, _kept
from docloom.session import stash, table


def _clean(spark, d) -> DataFrame:
    return E.clean_events(table(spark, d, "runtime_events"))


def _log(spark, d) -> DataFrame:
    return table(spark, d, "crawl_log")


def event_cleaning(spark, d):
    return _clean(spark, d).select("event_no", "at")


def warning_events(spark, d):
    """Events of a kind, the filter before anything else."""
    return table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", "value")


def ttl_dedup(spark, d):
    return E.suppress_repeats(stash(_clean(spark, d), "events"), "at", "event_no").select("event_no")


def ttl_dedup_users(spark, d):
    """The same filter on user events with two days of silence."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return E.suppress_repeats(rows, "at", "event_id", 172_800, ["user_id", "event_type"]).select("event_id")


def _texts(spark, d) -> DataFrame:
    return E.textify(_clean(spark, d).withColumn("timestamp_str", F.col("at").cast("string")))


def event_textify(spark, d):
    return _texts(spark, d).select("event_no", "pk", "title", F.md5("abstract_text").alias("abstract_md5"), F.md5("specific_text").alias("specific_md5"))


def _static(spark, d) -> DataFrame:
    return _kept(spark, d).filter("partition_name = 'static_knowledge'").select("pk", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def event_anchor(spark, d):
    return E.static_anchors(stash(_texts(spark, d), "texts"), stash(_static(spark, d), "static"))


def event_upsert_latest(spark, d):
    """Stored rows of all events, the latest of each id."""
    texts = stash(_texts(spark, d), "texts")
    anchors = E.static_anchors(texts, stash(_static(spark, d), "static"))
    rows = E.event_rows(texts.join(anchors.drop("score"), "event_no", "left")).withColumn("text_md5", F.md5("text"))
    last = E.latest(rows.select("pk", "timestamp", "text_md5", "parent_id", "token_count"), "pk", "timestamp", "text_md5")
    return last


def event_collisions(spark, d):
    """Titles, and with them ids, under which events of different texts would be stored."""
    return _texts(spark, d).groupBy("title").agg(F.countDistinct("abstract_text").alias("n")).filter("n > 1")


def _pods(spark, d) -> DataFrame:
    """What is known about pods: the latest event of each, as the state of one container."""
    last = E.latest(_clean(spark, d).filter("lower(obj_kind) = 'pod' and namespace is not null and name is not null").select(F.concat_ws("/", "namespace", "name").alias("k"), "at", "event_no", "namespace", "name", "reason"), "k", "at", "event_no")
    ended = F.col("reason").isin("OOMKilled", "Error", "CrashLoopBackOff")
    status = F.struct(F.lit("main").alias("name"), F.when(ended, F.col("reason")).alias("terminated_reason"), F.when(ended, 137).alias("exit_code"), F.when(~F.coalesce(ended, F.lit(False)), F.col("reason")).alias("waiting_reason"))
    return last.select("namespace", "name", F.array(status).alias("statuses"), F.coalesce(F.col("reason") == "Killing", F.lit(False)).alias("deleted"))


def event_enrich(spark, d):
    """Events with the state of their pods in the text forms; '' for other kinds and for pods nothing is known about."""
    rows = E.enrich_pods(_clean(spark, d).withColumn("timestamp_str", F.col("at").cast("string")), stash(_pods(spark, d), "pods"))
    return E.textify(rows).select("event_no", "detail", "short_state", "title", F.md5("specific_text").alias("specific_md5"))


def _changes(spark, d) -> DataFrame:
    """Deliveries and deletions of nodes as changes of resources."""
    nodes = table(spark, d, "knowledge_base_v3").select(ids.node_id(F.col("pk"), F.col("title"), F.col("partition_name")).alias("uid"), F.unix_micros(F.col("delivered_at").cast("timestamp")).alias("seq"), "delivery_no", "title", "node_type", "partition_name", "parent_id").filter("uid is not null")
    first = Window.partitionBy("uid").orderBy("seq", "delivery_no")
    owner = F.struct(F.coalesce("parent_id", F.lit("")).alias("uid"), F.lit("Node").alias("kind"), F.lit(True).alias("controller"))
    came = nodes.select("uid", F.struct("seq", "delivery_no").alias("seq"), F.when(F.row_number().over(first) == 1, "ADDED").otherwise("MODIFIED").alias("change_type"), F.coalesce(F.lower("node_type"), F.lit("")).alias("obj_kind"), F.coalesce("title", F.lit("")).alias("name"), F.col("partition_name").alias("namespace"), F.array(owner).alias("owner_references"))
    gone = table(spark, d, "node_deletions").select(ids.canonical_id(F.col("pk")).alias("uid"), F.struct(F.unix_micros(F.col("deleted_at").cast("timestamp")).alias("seq"), (F.col("deletion_no") + 10**12).alias("delivery_no")).alias("seq"), F.lit("DELETED").alias("change_type")).filter("uid is not null")
    return came.unionByName(gone, allowMissingColumns=True)


def resource_changes(spark, d):
    """The text forms of every change of a node."""
    return E.resource_texts(_changes(spark, d).filter("change_type <> 'DELETED'")).select(F.col("seq.delivery_no").alias("delivery_no"), "title", "parent_uid", F.md5("specific_text").alias("specific_md5"), "abstract_text")


def resource_topology(spark, d):
    """The nodes whose last change is no deletion."""
    return E.topology(_changes(spark, d)).select(F.col("uid").alias("pk"), F.col("seq.delivery_no").alias("delivery_no"), "change_type")


def asof_start_save(spark, d):
    return L.saved_pairs(L.parse(_log(spark, d)))


def log_workers(spark, d):
    return L.parse(_log(spark, d)).select("line_no", "worker")


def crawl_totals(spark, d):
    return L.totals(L.parse(_log(spark, d)))


def file_conflicts(spark, d):
    return L.name_conflicts(L.saved_pairs(L.parse(_log(spark, d))))


def unsaved_urls(spark, d):
    parsed = stash(L.parse(_log(spark, d)), "log")
    return L.unsaved(parsed, L.saved_pairs(parsed))


def file_differences(spark, d):
    """The log against a list of files: those saved on lines whose number isn't divisible by 3, and three strangers."""
    parsed = stash(L.parse(_log(spark, d)), "log")
    files = parsed.filter("saved_file is not null and line_no % 3 <> 0").select(F.col("saved_file").alias("file")).unionByName(spark.createDataFrame([("a.docx",), ("b.docx",), ("c.docx",)], "file string"))
    return L.file_differences(parsed, files)


def error_taxonomy(spark, d):
    return L.errors(_log(spark, d))


def error_summary(spark, d):
    return L.error_lines(L.errors(_log(spark, d)))


def crawl_findings(spark, d):
    parsed = stash(L.parse(_log(spark, d)), "log")
    return L.findings(parsed, stash(L.saved_pairs(parsed), "pairs"))


_ALL = (event_cleaning, warning_events, ttl_dedup, ttl_dedup_users, event_textify, event_anchor, event_upsert_latest, event_collisions, event_enrich, resource_changes, resource_topology, asof_start_save, log_workers, crawl_totals, file_conflicts, unsaved_urls, file_differences, error_taxonomy, error_summary, crawl_findings)
QUERIES = {f.__name__: f for f in _ALL}

_EV = """ev AS (SELECT *, coalesce(CASE WHEN timestamp BETWEEN 946684800 AND 4102444800 THEN timestamp END, floor(epoch(try_cast(timestamp_str AS TIMESTAMPTZ)))::BIGINT, floor(epoch(received_at))::BIGINT) AS at_ FROM runtime_events),
cl AS (SELECT kind, reason, message, namespace, name, obj_kind, at_, min(event_no) AS event_no FROM ev GROUP BY ALL)"""


def _ttl(source: str, key: str, order: str, ttl: int) -> str:
    return f"""o AS (SELECT {key} AS key_, at_, {order} AS no, row_number() OVER (PARTITION BY {key} ORDER BY at_, {order}) AS i FROM {source}),
f(key_, i, no, last_, go) AS (SELECT key_, i, no, at_, true FROM o WHERE i = 1
  UNION ALL SELECT o.key_, o.i, o.no, CASE WHEN o.at_ - f.last_ >= {ttl} THEN o.at_ ELSE f.last_ END, o.at_ - f.last_ >= {ttl} FROM f JOIN o ON o.key_ = f.key_ AND o.i = f.i + 1)
SELECT no AS {order} FROM f WHERE go"""


_TX = f"""{_EV},
tx AS (SELECT *, 'Alert: ' || coalesce(obj_kind, '') || ' ' || coalesce(name, '') || ' - ' || coalesce(reason, '') AS title, '资源类型: ' || coalesce(obj_kind, '') || '. 故障: ' || coalesce(reason, '') || '. 日志: ' || substr(coalesce(message, ''), 1, 300) AS abstract_text,
  '【运行警报】' || chr(10) || 'Resource: ' || coalesce(obj_kind, '') || ' ' || coalesce(namespace, '') || '/' || coalesce(name, '') || chr(10) || 'Reason: ' || coalesce(reason, '') || chr(10) || 'Message: ' || coalesce(message, '') || chr(10) || 'State: N/A' || chr(10) || 'Time: ' || coalesce(at_::VARCHAR, '') AS specific_text FROM cl),
tp AS (SELECT *, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(title)) AS u FROM tx),
te AS (SELECT *, substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' || substr('89ab', 1 + (position(substr(u, 17, 1) IN '0123456789abcdef') - 1) % 4, 1) || substr(u, 18, 3) || '-' || substr(u, 21, 12) AS pk FROM tp)"""
_AN = f"""{_TX}, {_KEPT},
st AS (SELECT id AS pk, coalesce(title, '') AS title, coalesce(text, '') AS text FROM kept WHERE partition_name = 'static_knowledge'),
qt AS (SELECT abstract_text, {_TOK.format('abstract_text')} AS tk FROM (SELECT DISTINCT abstract_text FROM te)),
qw AS (SELECT abstract_text, term, count(*)::DOUBLE / any_value(n) AS qw FROM (SELECT abstract_text, unnest(tk) AS term, len(tk) AS n FROM qt) GROUP BY ALL),
nw AS (SELECT pk, term, count(*)::DOUBLE / any_value(n) AS w FROM (SELECT pk, unnest({_TOK.format('text')}) AS term, len({_TOK.format('text')}) AS n FROM st) GROUP BY ALL),
an AS (SELECT abstract_text, pk AS anchor_pk, score FROM (SELECT abstract_text, pk, round(sum(qw * w), 8) AS score FROM qw JOIN nw USING (term) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY abstract_text ORDER BY score DESC, pk) = 1)"""
_LG = r"""lg AS (SELECT line_no, value, CASE WHEN regexp_matches(value, '线程: (Worker-\d+)') THEN regexp_extract(value, '线程: (Worker-\d+)', 1) END AS named,
  CASE WHEN regexp_matches(value, '开始爬取: (https?://\S+)') THEN regexp_extract(value, '开始爬取: (https?://\S+)', 1) END AS started,
  CASE WHEN regexp_matches(value, '文档已保存为 (.+\.docx)') THEN string_split(regexp_extract(value, '文档已保存为 (.+\.docx)', 1), '/')[-1] END AS saved_file,
  CASE WHEN regexp_matches(value, '❌ 处理失败 (https?://\S+):') THEN regexp_extract(value, '❌ 处理失败 (https?://\S+):', 1) END AS failed,
  CASE WHEN regexp_matches(value, '📊 进度: (\d+)/(\d+)') THEN regexp_extract(value, '📊 进度: (\d+)/(\d+)', 1)::BIGINT END AS visited,
  CASE WHEN regexp_matches(value, '📊 进度: (\d+)/(\d+)') THEN regexp_extract(value, '📊 进度: (\d+)/(\d+)', 2)::BIGINT END AS total FROM crawl_log),
wk AS (SELECT *, last_value(named IGNORE NULLS) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS worker FROM lg),
pr AS (SELECT line_no, url, saved_file AS file FROM (SELECT *, last_value(started IGNORE NULLS) OVER (PARTITION BY worker ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS url FROM wk WHERE worker IS NOT NULL) WHERE saved_file IS NOT NULL AND url IS NOT NULL)"""
_ER = r"""er AS (SELECT error, count(*) AS n, count(DISTINCT url) AS n_urls FROM (
  SELECT CASE WHEN contains(m, 'HTTPSConnectionPool') THEN 'ConnectionError' WHEN contains(m, 'Read timed out') THEN 'TimeoutError' WHEN contains(m, '404') THEN 'HTTP 404' WHEN contains(m, 'SSLError') THEN 'SSLError' ELSE m END AS error, regexp_replace(u, '[.,]$', '') AS url
  FROM (SELECT trim(regexp_extract(value, '❌ 处理失败 (.*?): (.*)', 2), ' ' || chr(9) || chr(10) || chr(13)) AS m, trim(regexp_extract(value, '❌ 处理失败 (.*?): (.*)', 1), ' ' || chr(9) || chr(10) || chr(13)) AS u FROM crawl_log WHERE regexp_matches(value, '❌ 处理失败 (.*?): (.*)'))) GROUP BY error)"""

SQL = {
    "event_cleaning": f"WITH {_EV} SELECT event_no, at_ AS \"at\" FROM cl",
    "warning_events": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error'",
    "ttl_dedup": f"WITH RECURSIVE {_EV}, ke AS (SELECT *, row(namespace, obj_kind, name, reason, substr(message, 1, 50))::VARCHAR AS k FROM cl), {_ttl('ke', 'k', 'event_no', 60)}",
    "ttl_dedup_users": f"WITH RECURSIVE u AS (SELECT event_id, user_id || '/' || event_type AS k, floor(epoch(ts))::BIGINT AS at_ FROM events), {_ttl('u', 'k', 'event_id', 172800)}",
    "event_textify": f"WITH {_TX} SELECT event_no, pk, title, md5(abstract_text) AS abstract_md5, md5(specific_text) AS specific_md5 FROM te",
    "event_anchor": f"WITH {_AN} SELECT te.event_no, an.anchor_pk, st.title AS anchor_title, an.score FROM te JOIN an ON an.abstract_text = te.abstract_text JOIN st ON st.pk = an.anchor_pk",
    "event_upsert_latest": f"WITH {_AN} SELECT te.pk, te.at_ AS timestamp, md5(specific_text) AS text_md5, coalesce(an.anchor_pk, '') AS parent_id, len(specific_text) AS token_count FROM te LEFT JOIN an ON an.abstract_text = te.abstract_text QUALIFY row_number() OVER (PARTITION BY te.pk ORDER BY te.at_ DESC, md5(specific_text) DESC) = 1",
    "event_collisions": f"WITH {_TX} SELECT title, count(DISTINCT abstract_text) AS n FROM te GROUP BY title HAVING count(DISTINCT abstract_text) > 1",
    "event_enrich": f"""WITH {_EV},
pod AS (SELECT namespace, name, (max({{'a': at_, 'b': event_no, 'reason': reason}})).reason AS reason FROM (SELECT namespace, name, at_, event_no, reason FROM cl WHERE lower(obj_kind) = 'pod' AND namespace IS NOT NULL AND name IS NOT NULL) GROUP BY ALL),
ps AS (SELECT namespace, name, CASE WHEN reason = 'Killing' THEN '[Pod已删除]' WHEN reason IS NULL THEN '' WHEN reason IN ('OOMKilled', 'Error', 'CrashLoopBackOff') THEN '[main] Terminated: ' || reason || ' (ExitCode: 137)' ELSE '[main] Waiting: ' || reason END AS detail,
  CASE WHEN reason = 'Killing' THEN 'Deleted' ELSE coalesce(reason, '') END AS short_state FROM pod),
en AS (SELECT cl.*, coalesce(ps.detail, '') AS detail, coalesce(ps.short_state, '') AS short_state FROM cl LEFT JOIN ps ON cl.namespace = ps.namespace AND cl.name = ps.name AND cl.obj_kind = 'Pod')
SELECT event_no, detail, short_state, 'Alert: ' || coalesce(obj_kind, '') || ' ' || coalesce(name, '') || ' - ' || coalesce(reason, '') || CASE WHEN short_state <> '' THEN ' [' || short_state || ']' ELSE '' END AS title,
  md5('【运行警报】' || chr(10) || 'Resource: ' || coalesce(obj_kind, '') || ' ' || coalesce(namespace, '') || '/' || coalesce(name, '') || chr(10) || 'Reason: ' || coalesce(reason, '') || chr(10) || 'Message: ' || coalesce(message, '') || chr(10) || 'State: ' || CASE WHEN detail <> '' THEN detail ELSE 'N/A' END || chr(10) || 'Time: ' || coalesce(at_::VARCHAR, '')) AS specific_md5 FROM en""",
    "resource_changes": f"""WITH {_BASE}, c AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY delivered_at, delivery_no) AS n FROM ided WHERE node IS NOT NULL),
a AS (SELECT *, CASE WHEN n = 1 THEN '已上线/部署' ELSE '配置变更/状态更新' END AS act, coalesce(lower(node_type), '') AS obj, coalesce(title, '') AS nm, coalesce(parent_id, '') AS up FROM c)
SELECT delivery_no, 'Resource: ' || nm || ' (' || obj || ')' AS title, up AS parent_uid,
  md5('【资源拓扑变更】' || chr(10) || 'Resource: ' || obj || '/' || nm || chr(10) || 'Namespace: ' || partition_name || chr(10) || 'Action: ' || act || chr(10) || 'Parent: Node (UID: ' || up || ')' || chr(10)) AS specific_md5, obj || ' ' || act || ' in ' || partition_name AS abstract_text FROM a""",
    "resource_topology": f"""WITH {_BASE}, c AS (SELECT node AS pk, delivered_at AS t, delivery_no, CASE WHEN row_number() OVER (PARTITION BY node ORDER BY delivered_at, delivery_no) = 1 THEN 'ADDED' ELSE 'MODIFIED' END AS change_type FROM ided WHERE node IS NOT NULL
  UNION ALL SELECT {_canon('pk')}, deleted_at, deletion_no + 1000000000000, 'DELETED' FROM node_deletions)
SELECT pk, delivery_no, change_type FROM (SELECT * FROM c WHERE pk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pk ORDER BY t DESC NULLS LAST, delivery_no DESC) = 1) WHERE change_type <> 'DELETED'""",
    "asof_start_save": f"WITH {_LG} SELECT line_no, url, file FROM pr",
    "log_workers": f"WITH {_LG} SELECT line_no, worker FROM wk",
    "crawl_totals": f"WITH {_LG} SELECT count(DISTINCT started) AS visited_urls, count(DISTINCT saved_file) AS saved_files, count(DISTINCT failed) AS failed_urls, (SELECT visited FROM lg WHERE total IS NOT NULL ORDER BY total DESC, line_no LIMIT 1) AS visited, max(total) AS total FROM lg",
    "file_conflicts": f"WITH {_LG} SELECT file, count(*) AS n, string_agg(url, ' ' ORDER BY line_no) AS urls FROM pr GROUP BY file HAVING count(*) > 1",
    "unsaved_urls": f"WITH {_LG} SELECT DISTINCT started AS url FROM lg WHERE started IS NOT NULL AND started NOT IN (SELECT url FROM pr) AND started NOT IN (SELECT failed FROM lg WHERE failed IS NOT NULL)",
    "file_differences": f"""WITH {_LG}, fl AS (SELECT DISTINCT saved_file AS file FROM lg WHERE saved_file IS NOT NULL AND line_no % 3 <> 0 UNION SELECT * FROM (VALUES ('a.docx'), ('b.docx'), ('c.docx'))), sv AS (SELECT DISTINCT saved_file AS file FROM lg WHERE saved_file IS NOT NULL)
SELECT file, 'not in the log' AS "where" FROM fl WHERE file NOT IN (SELECT file FROM sv) UNION ALL SELECT file, 'not on disk' FROM sv WHERE file NOT IN (SELECT file FROM fl)""",
    "crawl_findings": f"""WITH {_LG},
fa AS (SELECT DISTINCT failed FROM lg WHERE failed IS NOT NULL), co AS (SELECT file, string_agg(url, ' ' ORDER BY line_no) AS urls FROM pr GROUP BY file HAVING count(*) > 1),
un AS (SELECT DISTINCT started AS url FROM lg WHERE started IS NOT NULL AND started NOT IN (SELECT url FROM pr) AND started NOT IN (SELECT failed FROM fa))
SELECT 1 AS section, '0' AS item, '日志中记录的访问URL数量: ' || count(DISTINCT started) AS line FROM lg UNION ALL SELECT 1, '1', '日志中记录的保存文件数量: ' || count(DISTINCT saved_file) FROM lg UNION ALL SELECT 1, '2', '日志中记录的失败URL数量: ' || count(DISTINCT failed) FROM lg
UNION ALL SELECT 1, '3', '最终进度: ' || coalesce((SELECT visited || '/' || total FROM lg WHERE total IS NOT NULL ORDER BY total DESC, line_no LIMIT 1), '0/0')
UNION ALL SELECT 2, '', '失败URL: ' || count(*) FROM fa HAVING count(*) > 0 UNION ALL SELECT 2, failed, '  - ' || failed FROM fa
UNION ALL SELECT 3, '', '发现 ' || count(*) || ' 个文件名被多个URL使用:' FROM co HAVING count(*) > 0 UNION ALL SELECT 3, file, '文件名: ' || file || ' URL: ' || urls FROM co
UNION ALL SELECT 4, '', '发现 ' || count(*) || ' 个URL被访问但未保存:' FROM un HAVING count(*) > 0 UNION ALL SELECT 4, url, '  - ' || url FROM un
UNION ALL SELECT 5, u, '最后访问的URL: ' || u FROM (SELECT arg_max(started, line_no) AS u FROM lg WHERE started IN (SELECT url FROM un)) WHERE u IS NOT NULL""",
    "error_taxonomy": f"WITH {_ER} SELECT error, n, n_urls FROM er",
    "error_summary": f"WITH {_ER} SELECT row_number() OVER (ORDER BY n DESC, error) AS rank, rpad(substr(error, 1, 40), 40, ' ') || ' | ' || lpad(n::VARCHAR, 6, ' ') || ' | ' || lpad(n_urls::VARCHAR, 6, ' ') AS line FROM er",
}

# what the stream stores: of the events that the time-to-live filter lets through and that name a reason, kind and name, the latest of each id
_HEARD = SQL["ttl_dedup"].removeprefix(f"WITH RECURSIVE {_EV}, ").replace("\nSELECT no AS event_no FROM f WHERE go", ",\nheard AS (SELECT no FROM f WHERE go)")
STORED = f"""WITH RECURSIVE {_AN}, {_HEARD}
SELECT te.pk, te.at_ AS timestamp, md5(specific_text) AS text_md5, coalesce(an.anchor_pk, '') AS parent_id, len(specific_text) AS token_count FROM (SELECT * FROM te WHERE event_no IN (SELECT no FROM heard) AND reason IS NOT NULL AND obj_kind IS NOT NULL AND name IS NOT NULL) te
LEFT JOIN an ON an.abstract_text = te.abstract_text QUALIFY row_number() OVER (PARTITION BY te.pk ORDER BY te.at_ DESC, specific_text DESC) = 1"""
