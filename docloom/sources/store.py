"""The node table on disk: Parquet by ``partition_name`` and hash bucket of the key, in generations.

A change writes only the buckets it touches into a new generation; then a new numbered pointer file is put in place by one
rename, and readers take the pointer with the highest number. They see the old state or the new one, a crash in between
leaves the old, and two writers at once can't both win. Generations that none of the last ``KEEP`` pointers names are removed.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.operators.events import latest
from docloom.operators.topk import sparse_topk

#: Pointers that stay readable, the newest included: plans made before a change can still run.
KEEP = 3


class NodeStore:
    """Nodes under ``root``; a pointer names the folders of each partition's buckets and the columns of its rows."""

    def __init__(self, spark: SparkSession, root: str, key: str = "pk", buckets: int = 16):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path("pointers")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path("pointers"))]
        return sorted(int(m[1]) for m in (re.fullmatch(r"(\d+)\.json", n) for n in names) if m)

    def _pointer(self, number: int | None = None) -> dict[str, dict]:
        have = self._pointers()
        if not have:
            return {}
        stream = self._fs().open(self._path(f"pointers/{have[-1] if number is None else number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _swap(self, pointer: dict[str, dict], before: int | None) -> None:
        """Publish a state made from pointer ``before``; fails if another writer was first."""
        fs = self._fs()
        new, target = self._path(f"pointers/new-{uuid.uuid4().hex}"), self._path(f"pointers/{(before or 0) + 1}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(new, target):
            fs.delete(new, False)
            raise RuntimeError("another writer changed the store")
        self._clean()

    def _clean(self) -> None:
        have = self._pointers()
        kept, gone = have[-KEEP:], have[:-KEEP]
        folders = lambda numbers: {f for n in numbers for p in self._pointer(n).values() for fs in p["buckets"].values() for f in fs}
        old, new = folders(gone), folders(kept)
        whole = {f.rsplit("/", 1)[0] for f in old} - {f.rsplit("/", 1)[0] for f in new}
        for folder in whole | {f for f in old - new if f.rsplit("/", 1)[0] not in whole}:
            self._fs().delete(self._path(folder), True)
        for n in gone:
            self._fs().delete(self._path(f"pointers/{n}.json"), False)

    def _last(self) -> tuple[int | None, dict[str, dict]]:
        have = self._pointers()
        return (have[-1], self._pointer(have[-1])) if have else (None, {})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, partition: str) -> dict[str, list[str]]:
        """Rows written by bucket: the folders of the buckets that hold any."""
        folder = f"{partition}/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path(folder)) if s.isDirectory()]
        return {n.removeprefix("bucket="): [f"{folder}/{n}"] for n in names if n.startswith("bucket=")}

    def recreate(self) -> None:
        """Drop the table and start an empty one."""
        self._swap({}, self._last()[0])

    @staticmethod
    def _own(pointer: dict[str, dict], partition: str, rows: DataFrame | None = None) -> dict[str, list[str]]:
        """The folders of a partition by bucket; the columns of new rows are added to its columns."""
        own = pointer.setdefault(partition, {"columns": {}, "buckets": {}})
        for f in rows.schema if rows is not None else ():
            own["columns"].setdefault(f.name, f.dataType.simpleString())
        return own["buckets"]

    def append(self, rows: DataFrame, partition: str) -> None:
        """Add rows to a partition. A failure fails the job: no batch is lost silently."""
        number, pointer = self._last()
        own = self._own(pointer, partition, rows)
        for bucket, folders in self._write(rows, partition).items():
            own.setdefault(bucket, []).extend(folders)
        self._swap(pointer, number)

    def _rows(self, folders: list[str], columns: dict[str, str]) -> DataFrame:
        """Rows of some folders; the known columns save a look into the files, one that a folder lacks is null."""
        schema = ", ".join(f"`{c}` {kind}" for c, kind in columns.items())
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def read(self, *partitions: str) -> DataFrame:
        """The rows of the named partitions (all without names), with ``partition_name``; only their folders are read."""
        out = None
        for p, own in self._pointer().items():
            folders = [f for fs in own["buckets"].values() for f in fs]
            if not folders or partitions and p not in partitions:
                continue
            rows = self._rows(folders, own["columns"]).withColumn("partition_name", F.lit(p))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            raise ValueError("the store has no rows there")
        return out

    def load(self, *partitions: str) -> DataFrame:
        """The rows kept in the executors' memory, as far as they fit, for repeated searches; ``unpersist`` releases them."""
        return self.read(*partitions).persist(StorageLevel.MEMORY_AND_DISK)

    def upsert(self, rows: DataFrame, partition: str, *order: str) -> None:
        """Put rows in place of those with the same key; of several new rows of a key the last by ``order`` counts.

        Only the buckets of the new keys are read and written again.
        """
        number, pointer = self._last()
        own = self._own(pointer, partition, rows)
        columns = pointer[partition]["columns"]
        fresh = self._write(latest(rows, self.key, *order), partition)
        old = [f for b in fresh for f in own.get(b, [])]
        if old:
            new = self._rows([f for fs in fresh.values() for f in fs], columns)
            kept = self._rows(old, columns).join(new.select(self.key), self.key, "left_anti")
            written = self._write(kept.unionByName(new, allowMissingColumns=True), partition)
            for fs in fresh.values():
                self._fs().delete(self._path(fs[0]).getParent(), True)
            fresh = written
        own.update(fresh)
        self._swap(pointer, number)

    def delete(self, keys: DataFrame, *partitions: str) -> None:
        """Take out the rows with the keys of ``keys``; unknown ones make no difference. Untouched buckets stay as they are."""
        number, pointer = self._last()
        wanted = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        touched = [str(r[0]) for r in wanted.select(self._bucket()).distinct().collect()]  # at most the number of buckets
        for p in partitions or list(pointer):
            own = self._own(pointer, p)
            old = [f for b in touched for f in own.get(b, [])]
            if not old:
                continue
            written = self._write(self._rows(old, pointer[p]["columns"]).join(wanted, self.key, "left_anti"), p)
            for b in touched:
                own.pop(b, None)
            own.update(written)
        self._swap(pointer, number)

    def index(self, sparse: str, drop_ratio: float = 0.0) -> DataFrame:
        """The search index of a map column, written: (key, terms, weights), heaviest first.

        ``drop_ratio`` leaves out that share of a row's terms, lowest weights first. ``search_index`` reads it.
        """
        path = f"{self.root}/index/{uuid.uuid4().hex}"
        heaviest = F.array_sort(F.transform(F.map_entries(sparse), lambda x: F.struct((-x["value"]).alias("w"), x["key"].alias("term"))))
        rows = self.read().filter(F.size(sparse) > 0).select(self.key, heaviest.alias("e"))
        kept = rows.select(self.key, F.slice("e", F.lit(1), F.ceil(F.size("e") * F.lit(1 - drop_ratio)).cast("int")).alias("e"))
        kept.select(self.key, F.col("e.term").alias("terms"), F.transform("e", lambda x: -x["w"]).alias("weights")).write.parquet(path)
        return self.spark.read.parquet(path)


def search_index(queries: DataFrame, index: DataFrame, key: str, sparse: str, k: int) -> DataFrame:
    """(query_id, key, score, rank) of ``queries(query_id, sparse)`` over a written index."""
    asked = queries.filter(F.size(sparse) > 0).select("query_id", F.map_keys(sparse).alias("terms"), F.map_values(sparse).alias("weights"))
    return sparse_topk(asked, index, key, k)


def write_markdown(docs: DataFrame, path: str) -> None:
    """Non-empty texts as Parquet rows (name, text); empty and null ones are left out."""
    docs.filter(F.coalesce(F.length("text"), F.lit(0)) > 0).select("name", "text").write.mode("overwrite").parquet(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines, one row each with its rank, as one sorted text file."""
    lines.orderBy("rank").coalesce(1).select("line").write.mode("overwrite").text(path)
