"""Operational events: cleaning, duplicate suppression, text forms, static anchors and stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions import ids
from docloom.operators import retrieval
from docloom.operators.batching import Fold, streamed
from docloom.operators.topk import sparse_topk

#: Seconds that a key stays quiet, and how much of a message belongs to the key.
TTL, KEY_CHARS = 60, 50
ACTIONS = {"ADDED": "已上线/部署", "MODIFIED": "配置变更/状态更新", "DELETED": "已下线/删除"}


def event_time(*candidates: Column) -> Column:
    """The first time that is there, else now; its zone is taken as UTC."""
    return F.coalesce(*candidates, F.current_timestamp())


def dedup_key(message: str = "message") -> list[Column]:
    """What makes two events the same: namespace, kind, name, reason and the head of the message; null equals null."""
    return [F.col("namespace"), F.col("obj_kind"), F.col("name"), F.col("reason"), F.substring(message, 1, KEY_CHARS).alias("head")]


def suppress_repeats(events: DataFrame, time: str, order: str, ttl: int = TTL, keys: list[str] | None = None) -> DataFrame:
    """The events that a time-to-live filter lets through: the first of a key, then whatever comes ``ttl`` or more after the last one let through.

    A suppressed event doesn't extend the silence. Times are seconds; events without one are let through. A key's events
    stream through a fold in order of (time, ``order``) that holds one number. Only the first event of a key and second
    matters to it, so equal seconds collapse before the shuffle, however large a storm is.
    """
    named = events if keys else events.withColumn("__head", F.substring("message", 1, KEY_CHARS))
    keys = keys or ["namespace", "obj_kind", "name", "reason", "__head"]
    timed = named.filter(F.col(time).isNotNull()).groupBy(*keys, F.col(time).cast("long").alias("__t")).agg(F.min(order).alias("__no"))
    schema = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in keys) + f", __no {events.schema[order].dataType.simpleString()}"
    kept = streamed(timed, keys, ["__t", "__no"], ["__no", "__t"], schema, lambda: _Silence(ttl)).select(F.col("__no").alias(order))
    return events.join(kept, order, "left_semi").unionByName(events.filter(F.col(time).isNull()))


class _Silence(Fold):
    def __init__(self, ttl: int):
        self.ttl, self.last = ttl, None

    def add(self, number, at: int) -> list[tuple]:
        if self.last is not None and at - self.last < self.ttl:
            return []
        self.last = at
        return [(number,)]


def clean_events(events: DataFrame) -> DataFrame:
    """Runtime events with stored seconds that can be trusted: ``timestamp``, else the text, else the time of receipt.

    Payloads delivered twice (all fields but event_no and received_at equal) count once, the earliest.
    """
    seconds = F.when(F.col("timestamp").between(946_684_800, 4_102_444_800), F.col("timestamp"))
    parsed = F.unix_timestamp(F.try_to_timestamp("timestamp_str"))
    at = F.coalesce(seconds, parsed, F.unix_timestamp(F.col("received_at").cast("timestamp")))
    rows = events.withColumn("at", at)
    same = ["kind", "reason", "message", "namespace", "name", "obj_kind", "at"]
    return rows.groupBy(*same).agg(F.min("event_no").alias("event_no"))


def pod_state(statuses: Column) -> tuple[Column, Column]:
    """(detail, short form) of container statuses, an array of struct<name, terminated_reason, exit_code, waiting_reason>.

    The short form has the distinct termination reasons in order; a waiting reason only if none came before; two at most.
    """
    said = F.transform(F.filter(statuses, lambda s: s["terminated_reason"].isNotNull() | s["waiting_reason"].isNotNull()), lambda s: F.when(s["terminated_reason"].isNotNull(), F.concat(F.lit("["), s["name"], F.lit("] Terminated: "), s["terminated_reason"], F.lit(" (ExitCode: "), s["exit_code"].cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("["), s["name"], F.lit("] Waiting: "), s["waiting_reason"])))
    none = F.array().cast("array<string>")

    def add(acc, s):
        return F.when(s["terminated_reason"].isNotNull(), F.concat(acc, F.array(s["terminated_reason"]))).when(s["waiting_reason"].isNotNull() & (F.size(acc) == 0), F.array(s["waiting_reason"])).otherwise(acc)

    short = F.slice(F.array_distinct(F.aggregate(statuses, none, add)), 1, 2)
    return F.array_join(said, " | "), F.array_join(short, "/")


def textify(events: DataFrame) -> DataFrame:
    """``events`` with title, abstract_text (no names, message cut to 300), specific_text and pk.

    Uses the columns detail and short_state where present (pod enrichment). Nulls read as ''.
    """
    e = lambda c: F.coalesce(F.col(c), F.lit("")) if c in events.columns else F.lit("")
    suffix = F.when(e("short_state") != "", F.concat(F.lit(" ["), e("short_state"), F.lit("]"))).otherwise("")
    title = F.concat(F.lit("Alert: "), e("obj_kind"), F.lit(" "), e("name"), F.lit(" - "), e("reason"), suffix)
    abstract = F.concat(F.lit("资源类型: "), e("obj_kind"), F.lit(". 故障: "), e("reason"), F.lit(". 日志: "), F.substring(e("message"), 1, 300), F.when(e("detail") != "", F.concat(F.lit(". 资源状态: "), e("detail"))).otherwise(""))
    specific = F.concat(F.lit("【运行警报】\nResource: "), e("obj_kind"), F.lit(" "), e("namespace"), F.lit("/"), e("name"), F.lit("\nReason: "), e("reason"), F.lit("\nMessage: "), e("message"), F.lit("\nState: "), F.when(e("detail") != "", e("detail")).otherwise("N/A"), F.lit("\nTime: "), e("timestamp_str"))
    return events.withColumns({"title": title, "abstract_text": abstract, "specific_text": specific}).withColumn("pk", ids.uuid5(F.col("title"), ids.NAMESPACE_OID))


def static_anchors(events: DataFrame, nodes: DataFrame, key: str = "event_no") -> DataFrame:
    """(key, anchor_pk, anchor_title, score): the static node that fits an abstract text best, by shared terms.

    ``nodes``: pk, title, text. Weights are the default encoder's on both sides; ties go to the smaller pk. Equal abstract
    texts are searched once.
    """
    texts = events.groupBy("abstract_text").agg(F.min(key).alias("query_id"))
    asked, held = retrieval.token_lists(texts, "query_id", "abstract_text"), retrieval.token_lists(nodes, "pk", "text")
    best = sparse_topk(asked, held, "pk", 1, n_rows=nodes.count()).join(nodes.select("pk", F.col("title").alias("anchor_title")), "pk")
    return events.select(key, "abstract_text").join(texts, "abstract_text").join(best, "query_id").select(key, F.col("pk").alias("anchor_pk"), "anchor_title", "score")


def event_rows(events: DataFrame) -> DataFrame:
    """Stored rows of textified events; anchor_pk and anchor_title may be null (no anchor)."""
    link = F.struct(F.concat(F.lit("Troubleshooting Guide: "), F.coalesce("anchor_title", F.lit(""))).alias("text"), F.lit("").alias("url"), F.col("anchor_pk").alias("pk"), F.lit("static_anchor").alias("type"))
    none = F.array().cast("array<struct<text:string,url:string,pk:string,type:string>>")
    texts = F.array().cast("array<string>")
    blank = {c: F.lit("") for c in ("left_sibling", "right_sibling", "nav_next_step", "nav_see_also")}
    return events.select(
        "pk", F.col("specific_text").alias("text"), F.lit("k8s_informer").alias("source"), "title", F.coalesce("anchor_pk", F.lit("")).alias("parent_id"), texts.alias("child_ids"), F.lit("dynamic_event").alias("node_type"),
        F.lit(0).cast("long").alias("level"), F.length("specific_text").cast("long").alias("token_count"), F.lit(False).alias("from_split"), F.lit(False).alias("merged"), texts.alias("entry_urls"),
        F.when(F.col("anchor_pk").isNotNull(), F.array(link)).otherwise(none).alias("related_links"), F.col("abstract_text").alias("summary"), F.col("at").cast("long").alias("timestamp"), F.lit(ids.DYNAMIC_PARTITION).alias("partition_name"),
        *(v.alias(k) for k, v in blank.items()))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The upsert's result: the last row of each key by the order columns; whole rows are compared after a partial maximum."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    plain = not any("map" in k for c, k in rows.dtypes if c in rest)
    pick = F.max(F.struct(*order, *rest)) if plain else F.max_by(F.struct(*order, *rest), F.struct(*order))
    return rows.groupBy(key).agg(pick.alias("m")).select(key, *(F.col(f"m.{c}").alias(c) for c in (*order, *rest)))


def resource_texts(changes: DataFrame) -> DataFrame:
    """Resource changes with parent_uid, parent_kind, title, specific_text and abstract_text.

    The parent is the first controlling owner, else the first owner. An unknown action keeps its own name in the specific text
    and reads None in the abstract one.
    """
    refs = F.col("owner_references")
    owner = F.coalesce(F.get(F.filter(refs, lambda r: r["controller"]), 0), F.get(refs, 0))
    action = F.element_at(F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv)), F.col("change_type"))
    rows = changes.withColumn("parent_uid", F.coalesce(owner["uid"], F.lit(""))).withColumn("parent_kind", F.coalesce(owner["kind"], F.lit("")))
    specific = F.concat(F.lit("【资源拓扑变更】\nResource: "), F.col("obj_kind"), F.lit("/"), F.col("name"), F.lit("\nNamespace: "), F.col("namespace"), F.lit("\nAction: "), F.coalesce(action, F.col("change_type")), F.lit("\nParent: "), F.col("parent_kind"), F.lit(" (UID: "), F.col("parent_uid"), F.lit(")\n"))
    abstract = F.concat(F.col("obj_kind"), F.lit(" "), F.coalesce(action, F.lit("None")), F.lit(" in "), F.col("namespace"))
    return rows.withColumn("title", F.concat(F.lit("Resource: "), F.col("name"), F.lit(" ("), F.col("obj_kind"), F.lit(")"))).withColumn("specific_text", specific).withColumn("abstract_text", abstract)


def topology(changes: DataFrame) -> DataFrame:
    """Latest state of each resource uid, deleted ones taken out. (An extension: the rule as found stores no deletions.)"""
    return latest(changes, "uid", "seq").filter("change_type <> 'DELETED'")


def enrich_pods(events: DataFrame, pods: DataFrame) -> DataFrame:
    """``events`` with detail and short_state of their pods, '' for other kinds and for pods nothing is known about.

    ``pods``: namespace, name (unique together), statuses (see ``pod_state``), deleted. A deleted pod reads as such.
    """
    detail, short = pod_state(F.coalesce("statuses", F.array().cast("array<struct<name:string,terminated_reason:string,exit_code:int,waiting_reason:string>>")))
    known = pods.select("namespace", "name", F.lit("Pod").alias("obj_kind"), F.when(F.col("deleted"), "[Pod已删除]").otherwise(detail).alias("detail"), F.when(F.col("deleted"), "Deleted").otherwise(short).alias("short_state"))
    joined = events.join(known, ["namespace", "name", "obj_kind"], "left")
    return joined.withColumn("detail", F.coalesce("detail", F.lit(""))).withColumn("short_state", F.coalesce("short_state", F.lit("")))
