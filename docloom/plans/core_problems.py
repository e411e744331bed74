"""The queries of the general problems 2, 3 and 6 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.operators import delivery_store, hierarchy, orphans
from docloom.session import stash, table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_base_v3")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.found_cycles(_nodes(spark, d))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(_nodes(spark, d)).withColumn("path", F.array_join("path", "/"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(_nodes(spark, d)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery_store.surplus_deliveries(_nodes(spark, d))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    kept = delivery_store.exactly_once(_nodes(spark, d))
    return kept.select("node", "delivery_no", "title", "timestamp")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(_nodes(spark, d), table(spark, d, "node_deletions"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("pk", "ref_field", "ref_pk")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(stash(_orphans(spark, d), "orphans"))


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p3_found, p3_kept, p6_found, p6_report)}


def _canon(c: str) -> str:
    t = f"regexp_replace(lower(regexp_replace({c}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), '^urn:uuid:', '')"
    h = f"translate({t}, '{{}}-', '')"
    return f"(CASE WHEN coalesce({h}, '') = '' THEN NULL ELSE concat_ws('-', {h}[1:8], {h}[9:12], {h}[13:16], {h}[17:20], {h}[21:32]) END)"


_U5 = "sha1(unhex(CASE WHEN partition_name = 'dynamic_events' THEN '6ba7b8129dad11d180b400c04fd430c8' ELSE '6ba7b8119dad11d180b400c04fd430c8' END) || encode(title))"
_VARIANT = "substr('89ab', 1 + (position(substr(u5, 17, 1) IN '0123456789abcdef') - 1) % 4, 1)"
_BASE = f"""base AS (
  SELECT *, {_U5} AS u5 FROM knowledge_base_v3),
ided AS (
  SELECT coalesce({_canon('pk')}, substr(u5, 1, 8) || '-' || substr(u5, 9, 4) || '-5' || substr(u5, 14, 3) || '-' || {_VARIANT} || substr(u5, 18, 3) || '-' || substr(u5, 21, 12)) AS node,
         {_canon('parent_id')} AS parent, {_canon('left_sibling')} AS l, {_canon('right_sibling')} AS r, * EXCLUDE (u5)
  FROM base)"""

_LINKS = f"""WITH RECURSIVE {_BASE},
nodes AS (SELECT node AS pk, min(parent) AS parent, arg_min(level, delivery_no) FILTER (level IS NOT NULL) AS level FROM ided WHERE node IS NOT NULL GROUP BY node),
tops AS (SELECT n.pk, n.level, n.parent IS NOT NULL AS dangling FROM nodes n LEFT JOIN nodes p ON n.parent = p.pk WHERE p.pk IS NULL),
walk(pk, level, root, depth, path, dangling) AS (
  SELECT pk, level, pk, 0, pk, dangling FROM tops
  UNION ALL
  SELECT n.pk, n.level, w.root, w.depth + 1, w.path || '/' || n.pk, w.dangling FROM walk w JOIN nodes n ON n.parent = w.pk)"""

_CYCLES = f"""WITH RECURSIVE {_BASE},
nodes AS (SELECT node AS pk, min(parent) AS parent FROM ided WHERE node IS NOT NULL GROUP BY node),
good(pk) AS (
  SELECT n.pk FROM nodes n LEFT JOIN nodes p ON n.parent = p.pk WHERE p.pk IS NULL
  UNION ALL
  SELECT n.pk FROM good g JOIN nodes n ON n.parent = g.pk),
rest AS (SELECT pk, parent FROM nodes WHERE pk NOT IN (SELECT pk FROM good)),
reach(start, pos) AS (
  SELECT pk, parent FROM rest
  UNION
  SELECT r.start, x.parent FROM reach r JOIN rest x ON x.pk = r.pos)"""

_ON = "cyc AS (SELECT start AS pk, min(pos) AS cycle_pk FROM reach WHERE start IN (SELECT start FROM reach WHERE start = pos) GROUP BY start)"

_ORPHANS = f"""WITH {_BASE},
nodes AS (SELECT node AS pk, min(delivered_at) AS first_at, max(delivered_at) AS last_at FROM ided WHERE node IS NOT NULL GROUP BY node),
gone AS (SELECT {_canon('pk')} AS pk, max(deleted_at) AS deleted_at FROM node_deletions GROUP BY 1),
alive AS (SELECT n.pk, n.first_at FROM nodes n LEFT JOIN gone g ON n.pk = g.pk WHERE g.deleted_at IS NULL OR n.last_at > g.deleted_at),
links AS (SELECT node, unnest(related_links).pk AS raw FROM ided),
refs AS (
  SELECT node AS pk, 'parent_id' AS ref_field, parent AS ref_pk FROM ided
  UNION SELECT node, 'left_sibling', l FROM ided
  UNION SELECT node, 'right_sibling', r FROM ided
  UNION SELECT node, 'related_links', {_canon('raw')} FROM links),
orphan AS (SELECT a.pk, a.first_at, ref_field, ref_pk FROM refs JOIN alive a ON a.pk = refs.pk WHERE ref_pk IS NOT NULL AND ref_pk NOT IN (SELECT pk FROM alive))"""

SQL = {
    "p2_found": f"{_CYCLES}, {_ON} SELECT pk, cycle_pk FROM cyc",
    "p2_descendants": f"""{_LINKS},
chain(pk, descendant_pk, distance) AS (
  SELECT n.parent, n.pk, 1 FROM nodes n JOIN walk w ON w.pk = n.pk WHERE w.depth > 0
  UNION ALL
  SELECT n.parent, c.descendant_pk, c.distance + 1 FROM chain c JOIN nodes n ON n.pk = c.pk JOIN walk w ON w.pk = n.pk WHERE w.depth > 0)
SELECT pk, descendant_pk, distance FROM chain""",
    "p3_found": f"WITH {_BASE} SELECT delivery_no FROM (SELECT delivery_no, node, min(delivery_no) OVER (PARTITION BY node) AS kept FROM ided) WHERE node IS NOT NULL AND delivery_no > kept",
    "p3_kept": f"WITH {_BASE} SELECT node, delivery_no, title, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY delivery_no) AS rn FROM ided) WHERE rn = 1 OR node IS NULL",
    "p6_found": f"{_ORPHANS} SELECT DISTINCT pk, ref_field, ref_pk FROM orphan",
    "p6_report": f"{_ORPHANS} SELECT ref_field, strftime(first_at, '%Y-%m') AS month, count(*) AS n_references, count(DISTINCT pk) AS n_nodes, count(DISTINCT ref_pk) AS n_targets FROM (SELECT DISTINCT * FROM orphan) GROUP BY ALL",
}
SQL["p2_hierarchy"] = f"""{_LINKS.replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)},
rest AS (SELECT pk, parent, level FROM nodes WHERE pk NOT IN (SELECT pk FROM walk)),
reach(start, pos) AS (
  SELECT pk, parent FROM rest
  UNION
  SELECT r.start, x.parent FROM reach r JOIN rest x ON x.pk = r.pos),
{_ON},
below AS (SELECT up AS pk, count(*) AS n FROM (SELECT w.pk, unnest(string_split(w.path, '/')) AS up FROM walk w) WHERE up <> pk GROUP BY up)
SELECT w.pk, w.root AS root_pk, w.depth, w.path, coalesce(b.n, 0) AS n_descendants, CASE WHEN w.dangling THEN 'dangling' ELSE 'tree' END AS status, NULL::VARCHAR AS cycle_pk, w.level = w.depth AS level_agrees
FROM walk w LEFT JOIN below b ON b.pk = w.pk
UNION ALL
SELECT rest.pk, NULL, NULL, NULL, NULL, CASE WHEN c.pk IS NULL THEN 'below_cycle' ELSE 'cycle' END, c.cycle_pk, NULL FROM rest LEFT JOIN cyc c ON c.pk = rest.pk"""
