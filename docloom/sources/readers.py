"""Scans: documents and logs from files, settings, and lookups in the node table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docloom.functions.ids import canonical_id


def markdown_directory(spark: SparkSession, path: str) -> DataFrame:
    """(source, name, text) of every ``*.md`` file of a folder; the name is the file's without its ending."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    file = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return files.select(F.col("_metadata.file_path").alias("source"), F.regexp_replace(F.url_decode(file), r"\.md$", "").alias("name"), F.col("value").alias("text"))


def header_and_body(docs: DataFrame, text: str = "text", lines: int = 4) -> DataFrame:
    """``docs`` with header (the first lines) and body (the rest); null texts give nulls."""
    parts = F.split(text, "\n", -1)
    return docs.withColumn("header", F.array_join(F.slice(parts, 1, lines), "\n")).withColumn("body", F.array_join(F.slice(parts, F.lit(lines + 1), F.greatest(F.size(parts), F.lit(1))), "\n"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of log files, lines numbered from 0 within each file.

    A large file is read in splits: lines are numbered within each and moved on by the lines of the splits before.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value").withColumn("at", F.monotonically_increasing_id())
    lines = raw.withColumn("n", F.row_number().over(Window.partitionBy("file", "split").orderBy("at")))
    sizes = lines.groupBy("file", "split").agg(F.max("n").alias("size"))
    # one row a split, so the window over a file's splits is small
    before = F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(sizes.select("file", "split", before.alias("before")), ["file", "split"]).select("file", (F.col("before") + F.col("n") - 1).alias("line_no"), "value")


def lines_of(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(line_no, value) of lines given as a list."""
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(name, command, args, env) of the servers in a JSON settings file; missing parts are null."""
    schema = "mcpServers map<string, struct<command:string, args:array<string>, env:map<string,string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("mcpServers").alias("name", "s")).select("name", "s.*")


def store_filter(expression: str) -> str:
    """A filter of the store's language as Spark SQL: ``in [..]`` lists, ``&&``, ``||``, ``==`` and ``!`` are understood.

    Quoted texts are kept as they are.
    """
    out = []
    for i, part in enumerate(re.split(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')""", expression)):
        if i % 2 == 0:
            part = part.replace("&&", " and ").replace("||", " or ").replace("[", "(").replace("]", ")")
            part = re.sub(r"!(?!=)", " not ", part)
        elif part[0] == '"':
            part = "'" + part[1:-1].replace("'", "\\'") + "'"
        out.append(part)
    return "".join(out)


def scan(nodes: DataFrame, expression: str, fields: list[str] | None = None, limit: int | None = None, key: str = "pk") -> DataFrame:
    """Rows that pass a store filter; with a limit the first by key. Filter and columns reach the Parquet scan."""
    rows = nodes.filter(store_filter(expression))
    rows = rows.orderBy(key).limit(limit) if limit is not None else rows
    return rows.select(*fields) if fields else rows


def lookup(nodes: DataFrame, pk: str) -> DataFrame:
    """The row of one id, in any notation; no row if it isn't there."""
    return nodes.filter(canonical_id(F.col("pk")) == canonical_id(F.lit(pk))).limit(1)


def fetch(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of a list of ids ``wanted(pk)``; repeated and unknown ids make no difference. An empty list gives no rows."""
    return nodes.join(wanted.select("pk").distinct(), "pk", "left_semi")
