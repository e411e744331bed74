"""The event pipeline as a stream: filter, duplicate suppression, text forms, anchors, upsert."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators import events as E
from docloom.session import drop_stash, stash
from docloom.sources.store import NodeStore

#: Hashes of keys that share a row of state.
SHARDS = 2048


def watch(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of event payloads that arrive as Parquet files; offsets live in the query's checkpoint (resume without gaps)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def suppress_repeats(events: DataFrame, ttl: int = E.TTL, lateness: str | None = None) -> DataFrame:
    """The events that the time-to-live filter lets through, on their own clock ``at`` (seconds), so that it can be replayed.

    State is one number for each key, kept by ``SHARDS`` hashes of the keys, as Spark's call of a Python function for a group
    costs far more than an event. With ``lateness`` (an interval) a watermark on ``at`` drops events that come later
    than that and removes the state of silent keys; without, all events are heard and the state stays. Within a batch a
    key's events are taken in order of (at, event_no); one older than the last let through passes if it is ``ttl``
    seconds apart, and one without a time passes. Checkpoints with one state row for each key can't be continued.
    """
    rows, timeout = events, GroupStateTimeout.NoTimeout
    if lateness:
        rows, timeout = events.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", lateness), GroupStateTimeout.EventTimeTimeout
    # lengths before the parts: no two keys read the same, and null is no text
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    keyed = rows.withColumn("__key", F.md5(F.concat(*(part(c) for c in E.dedup_key()))))
    keyed = keyed.withColumn("__shard", F.pmod(F.xxhash64("__key"), F.lit(SHARDS)).cast("int"))
    schema = events.schema

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = json.loads(state.get[0]) if state.exists else {}
        if not state.hasTimedOut:
            got, kept = pd.concat(frames).sort_values(["at", "event_no"]), []
            for row, (key, at) in enumerate(zip(got["__key"], got["at"])):
                before = last.get(key)
                if pd.isna(at):
                    kept.append(row)
                elif before is None or abs(at - before) >= ttl:
                    kept.append(row)
                    last[key] = int(at) if before is None else max(before, int(at))
            yield got.iloc[kept][schema.names]
        if lateness:
            heard = state.getCurrentWatermarkMs() // 1000
            last = {key: at for key, at in last.items() if at + ttl > heard}
        if last:
            state.update((json.dumps(last),))
            if lateness:
                state.setTimeoutTimestamp(max(min(last.values()) + ttl, heard + 1) * 1000)
        elif state.exists:
            state.remove()

    return keyed.groupBy("__shard").applyInPandasWithState(step, schema, "last string", "append", timeout)


def textify_and_store(events: DataFrame, store: NodeStore, static: DataFrame, checkpoint: str, dead: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch's events as nodes: text forms, best static node, upsert into the dynamic partition.

    ``static``: pk, title, text. Rows without a reason, kind or name go to the Parquet folder ``dead`` and stop nothing.
    An upsert may be repeated after a crash without changing the result.
    """

    def write(batch: DataFrame, number: int) -> None:
        good = F.col("reason").isNotNull() & F.col("obj_kind").isNotNull() & F.col("name").isNotNull()
        heard = stash(batch, "heard")  # each plan over the batch itself would run the suppression again
        try:
            if dead:
                heard.filter(~good).write.mode("overwrite").parquet(f"{dead}/batch={number}")
            texts = E.textify(heard.filter(good))
            if texts.isEmpty():
                return
            anchors = E.static_anchors(texts, static)
            rows = E.event_rows(texts.join(anchors.select("event_no", "anchor_pk", "anchor_title"), "event_no", "left"))
            store.upsert(rows.drop("partition_name"), "dynamic_events", "timestamp", "text")
        finally:
            drop_stash(heard)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()
