"""Analytics over crawler logs: an ordered stream of lines of interleaved workers.

A line belongs to the worker named last before it, so lines need an explicit order. The order is cut into ranges of
``RANGE`` lines; each range is filled forward by itself and the last values of earlier ranges (one row a range) are carried
over, so that no window sees the whole log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import text as T

RANGE = 100_000
#: The forms of the log's lines. The saved form is a parameter, as crawlers differ in the file type.
START = r"开始爬取: (https?://\S+)"
SAVED = r"文档已保存为 (.+\.docx)"
FAILED = r"❌ 处理失败 (https?://\S+):"
ERROR = r"❌ 处理失败 (.*?): (.*)"
PROGRESS = r"📊 进度: (\d+)/(\d+)"
WORKER = r"线程: (Worker-\d+)"


def _found(pattern: str, group: int = 1) -> Column:
    return F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, group))


def fill_forward(rows: DataFrame, order: str, column: str, out: str, by: str | None = None) -> DataFrame:
    """``rows`` with ``out``: the latest non-null ``column`` at or before each row, for each value of ``by``."""
    keys = [by] if by else []
    ranged = rows.withColumn("__range", F.floor(F.col(order) / RANGE))
    inside = Window.partitionBy("__range", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("__own", F.last(column, ignorenulls=True).over(inside))
    ends = ranged.groupBy("__range", *keys).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("__end"))
    # one row a range (and key): its value is carried over to the later ranges
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("__before", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    joined = local.join(starts, ["__range", *keys], "left")
    return joined.withColumn(out, F.coalesce("__own", "__before")).drop("__range", "__own", "__before")


def parse(log: DataFrame, saved: str = SAVED) -> DataFrame:
    """``log(line_no, value)`` with worker, started, saved_file, failed and progress of each line; null lines hold nothing."""
    rows = log.select("line_no", "value", _found(WORKER).alias("named"), _found(START).alias("started"), F.element_at(F.split(_found(saved), "/"), -1).alias("saved_file"), _found(FAILED).alias("failed"), _found(PROGRESS).cast("long").alias("visited"), _found(PROGRESS, 2).cast("long").alias("total"))
    return fill_forward(rows, "line_no", "named", "worker").drop("named")


def saved_pairs(parsed: DataFrame) -> DataFrame:
    """(line_no, url, file): every saved file with the url that its worker started last before; without one there's no pair."""
    own = parsed.filter("worker is not null and (started is not null or saved_file is not null)")
    filled = fill_forward(own, "line_no", "started", "url", by="worker")
    return filled.filter("saved_file is not null and url is not null").select("line_no", "url", F.col("saved_file").alias("file"))


def totals(parsed: DataFrame) -> DataFrame:
    """One row: distinct started, saved and failed, and the progress at the largest total (the first on ties)."""
    best = F.max_by(F.struct("visited", "total"), F.when(F.col("total").isNotNull(), F.struct("total", (-F.col("line_no")).alias("l"))))
    return parsed.agg(F.countDistinct("started").alias("visited_urls"), F.countDistinct("saved_file").alias("saved_files"), F.countDistinct("failed").alias("failed_urls"), best.alias("b")).select("visited_urls", "saved_files", "failed_urls", F.col("b.visited").alias("visited"), F.col("b.total").alias("total"))


def name_conflicts(pairs: DataFrame) -> DataFrame:
    """(file, n, urls): files that were saved for more than one start."""
    return pairs.groupBy("file").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "url"))), lambda x: x["url"]), " ").alias("urls")).filter("n > 1")


def unsaved(parsed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(url): started, but neither saved nor failed."""
    started = parsed.select(F.col("started").alias("url")).filter("url is not null").distinct()
    return started.join(pairs.select("url"), "url", "left_anti").join(parsed.select(F.col("failed").alias("url")), "url", "left_anti")


def file_differences(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(file, where): files of ``files(file)`` that the log doesn't mention, and those of the log that aren't there."""
    logged = parsed.select(F.col("saved_file").alias("file")).filter("file is not null").distinct()
    here = files.select("file").distinct()
    return here.join(logged, "file", "left_anti").withColumn("where", F.lit("not in the log")).unionByName(logged.join(here, "file", "left_anti").withColumn("where", F.lit("not on disk")))


def errors(log: DataFrame) -> DataFrame:
    """(error, n, n_urls): failures by class, most frequent first."""
    rows = log.filter(F.col("value").rlike(ERROR)).select(T.error_class(F.regexp_extract("value", ERROR, 2)).alias("error"), T.clean_url(F.regexp_extract("value", ERROR, 1)).alias("url"))
    return rows.groupBy("error").agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls"))


def error_lines(stats: DataFrame) -> DataFrame:
    """(rank, line): the error summary in fixed columns, by falling count."""
    w = Window.orderBy(F.desc("n"), "error")  # a few error classes
    return stats.select(F.row_number().over(w).alias("rank"), F.concat(F.rpad(F.substring("error", 1, 40), 40, " "), F.lit(" | "), F.lpad(F.col("n").cast("string"), 6, " "), F.lit(" | "), F.lpad(F.col("n_urls").cast("string"), 6, " ")).alias("line"))


def findings(parsed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(section, item, line): the report of one crawl, to be read in order of section and item.

    Sections: totals, failed urls, files of several urls, urls that were neither saved nor failed, and of these the one
    started last. ``item`` is '' for a section's head and otherwise what the line is about.
    """
    t = totals(parsed)
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    heads = F.array(F.concat(F.lit("日志中记录的访问URL数量: "), n("visited_urls")), F.concat(F.lit("日志中记录的保存文件数量: "), n("saved_files")), F.concat(F.lit("日志中记录的失败URL数量: "), n("failed_urls")), F.concat(F.lit("最终进度: "), n("visited"), F.lit("/"), n("total")))
    basic = t.select(F.lit(1).alias("section"), F.posexplode(heads).alias("item", "line")).withColumn("item", F.col("item").cast("string"))
    listed = lambda rows, c, section, line: rows.select(F.lit(section).alias("section"), F.col(c).alias("item"), line.alias("line"))
    headed = lambda rows, section, text: rows.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(section).alias("section"), F.lit("").alias("item"), F.format_string(text, "n").alias("line"))
    failed = parsed.filter("failed is not null").select("failed").distinct()
    several = name_conflicts(pairs)
    open_ = unsaved(parsed, pairs)
    last = parsed.join(open_, F.col("started") == F.col("url"), "left_semi").agg(F.max_by("started", "line_no").alias("url")).filter("url is not null")
    bullet = lambda c: F.concat(F.lit("  - "), c)
    parts = [
        basic, headed(failed, 2, "失败URL: %d"), listed(failed, "failed", 2, bullet(F.col("failed"))),
        headed(several, 3, "发现 %d 个文件名被多个URL使用:"), listed(several, "file", 3, F.concat(F.lit("文件名: "), "file", F.lit(" URL: "), "urls")),
        headed(open_, 4, "发现 %d 个URL被访问但未保存:"), listed(open_, "url", 4, bullet(F.col("url"))), listed(last, "url", 5, F.concat(F.lit("最后访问的URL: "), "url"))]
    return reduce(DataFrame.unionByName, parts)
