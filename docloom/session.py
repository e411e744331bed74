"""Session set-up, table loading and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

_roots: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(master: str = "local[8]", app: str = "docloom", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application, so that it needn't be installed there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="docloom-code-"), "docloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder for lineage cuts: the cluster's ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests, one machine) a folder of our own is made; on a
    cluster without the setting this raises, as executors would write to disks that no other reads. The sub-folder of
    this application is deleted when the driver ends.
    """
    app = spark.sparkContext.applicationId
    if app in _roots:
        return _roots[app]
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-")
    root = f"{base.rstrip('/')}/docloom-{app}-{uuid.uuid4().hex[:8]}"
    _roots[app] = root
    atexit.register(_remove_quietly, spark, root)
    return root


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone already; the folder then stays for the cluster's own cleaning
        pass


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    The copy survives the loss of any executor, unlike a cached or locally checkpointed frame.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def stash_counted(df: DataFrame, tag: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``stash``, and how many of the rows fulfil each condition, observed while they are written."""
    seen = Observation()
    out = stash(df.observe(seen, *(F.count_if(c).alias(name) for name, c in counts.items())), tag)
    return out, {name: int(seen.get.get(name) or 0) for name in counts}


def drop_stash(df: DataFrame) -> None:
    """Delete what ``stash`` wrote, once no later plan reads it."""
    path = getattr(df, "_docloom_path", None)
    if path:
        remove(df.sparkSession, path)
