"""The queries of the llm problems 1, 4, 5, 7, 8 and 9 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docloom.llm import bpe, mixing, packing, spam, splitting, vectors
from docloom.llm.nodes import first_delivery, node_column
from docloom.plans.core_problems import _BASE
from docloom.session import stash, table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_base_v3")


def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(first_delivery(_nodes(spark, d), "token_count"), "node", "token_count").withColumnRenamed("node", "pk")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.batch_report(p1_batches(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(_nodes(spark, d), 0.9).select("field", "pk_a", "pk_b")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(_nodes(spark, d), 10, 20).withColumn("cosine", F.round("cosine", 8))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    # the first delivery of each node counts; only the texts of those that can be oversized are read whole
    rows = _nodes(spark, d).select(node_column().alias("node"), F.col("delivery_no").alias("no"), (F.length("text") > 1024).alias("long"))
    first = rows.filter("node is not null").groupBy("node").agg(F.min(F.struct("no", "long")).alias("f")).filter("f.long").select(F.col("f.no").alias("delivery_no"))
    long = _nodes(spark, d).filter(F.length("text") > 1024).select(node_column().alias("node"), "delivery_no", "text").join(first, "delivery_no", "left_semi")
    return splitting.split_oversized(long, 1024, 64)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).filter("piece_no = 1").select(F.col("node").alias("pk"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).withColumnRenamed("node", "pk")


def p1_check(spark: SparkSession, d: str) -> DataFrame:
    """What the batches must hold to, as one row: every usable node once, no batch above 2,048, only larger nodes divided, little room."""
    rows = stash(p1_batches(spark, d), "packed")
    packed, apart = rows.filter("status = 'packed'"), rows.filter("status = 'unusable'")
    pieces = packed.groupBy("pk").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"), F.countDistinct("piece_no").alias("pieces"), F.max("n_pieces").alias("n"))
    whole = pieces.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(F.expr("rows <> pieces or rows <> n")).alias("repeated"), F.count_if(F.expr("n <> ceil(tokens / 2048)")).alias("divided"))
    fill = packed.groupBy("batch_no").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > 2048).alias("too_full"), (F.count("*") <= F.ceil(F.coalesce(F.sum("t"), F.lit(0)) / 2048 * 1.05) + 1).alias("little_room"))
    return whole.join(fill).join(apart.agg(F.countDistinct("pk").alias("unusable")))  # one row each


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """What pieces must hold to: none above the limit, 64 tokens repeated, and their new parts join to the node's text."""
    w = Window.partitionBy("node").orderBy("piece_no")
    rows = _pieces(spark, d).withColumn("before", F.coalesce(F.lag("char_end").over(w), F.lit(0)))
    new = F.substring("piece", F.col("before") - F.col("char_start") + 1, F.length("piece"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", new.alias("new")))), lambda x: x["new"]), "")
    return rows.groupBy(F.col("node").alias("pk")).agg(F.md5(parts).alias("text_md5"), F.sum(F.col("n_tokens") - F.col("n_overlap")).cast("long").alias("n_tokens"), (F.max("n_tokens") <= 1024).alias("within_limit"), F.bool_and(F.col("n_overlap") == F.when(F.col("piece_no") > 1, 64).otherwise(0)).alias("overlaps"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What the mixture must hold to, for each target: no document above its cap, the share met within one document of the source."""
    mixture, plan = _mix(spark, d)
    mixture = stash(mixture, "mixture")
    goal = spark.createDataFrame(plan[["source", "max_repeats", "n_documents", "source_tokens", "rate"]])
    used = mixture.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most"), F.max("n_tokens").alias("largest"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))
    miss = F.abs(F.col("tokens") - F.col("rate") * F.col("source_tokens"))
    return goal.join(used, "source", "left").select(
        "source", F.col("n_documents").cast("long").alias("n_documents"), F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("cap_held"),
        F.coalesce(miss <= F.col("largest") + 1e-6 * F.col("source_tokens"), F.lit(True)).alias("share_held"), F.coalesce((F.col("n") == F.col("n_documents")) & (F.col("n") == F.col("ids")), F.col("n_documents") == 0).alias("each_once"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, d: str):
    sizes = mixing.token_sizes(table(spark, d, "documents"))
    plan = mixing.rates(sizes, table(spark, d, "mix_targets"))
    return mixing.mix(sizes, plan), plan


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    mixture, _ = _mix(spark, d)
    return mixture.filter("copies > 0")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(*_mix(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.find_spam(table(spark, d, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_batches, p1_report, p1_check, p4_found, p4_neighbours, p5_found, p5_pieces, p5_check, p7_ids, p8_mixture, p8_shares, p8_check, p9_found)}

_TOKEN = r"[一-鿿]|[A-Za-z0-9_]+|[^ \t\r\nA-Za-z0-9_一-鿿]"
_GOOD = "len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"
_VEC = f"""WITH {_BASE}, one AS (SELECT * FROM ided WHERE node IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY delivery_no) = 1),
v AS (SELECT 'vector' AS field, node, vector::DOUBLE[] AS x FROM one WHERE {_GOOD.format('vector')} UNION ALL SELECT 'summary_vector', node, summary_vector::DOUBLE[] FROM one WHERE {_GOOD.format('summary_vector')})"""

_ONE = f"WITH {_BASE}, one AS (SELECT * FROM ided WHERE node IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY delivery_no) = 1)"
_SOURCE = "nullif(regexp_replace(lower(trim(source, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))), '[ \\t\\r\\n_\\-]+', '-', 'g'), '')"

SQL: dict[str, str] = {
    "p1_check": f"{_ONE} SELECT count(*) FILTER (token_count > 0) AS nodes, coalesce(sum(token_count) FILTER (token_count > 0), 0)::BIGINT AS tokens, 0 AS repeated, 0 AS divided, 0 AS too_full, true AS little_room, count(*) FILTER (coalesce(token_count, 0) <= 0) AS unusable FROM one",
    "p5_check": f"{_ONE} SELECT node AS pk, md5(text) AS text_md5, len(regexp_extract_all(text, '{_TOKEN}')) AS n_tokens, true AS within_limit, true AS overlaps FROM one WHERE len(regexp_extract_all(text, '{_TOKEN}')) > 1024",
    "p8_check": f"WITH t AS (SELECT DISTINCT {_SOURCE} AS source FROM mix_targets), d AS (SELECT {_SOURCE} AS source, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1) SELECT t.source, coalesce(d.n, 0) AS n_documents, true AS cap_held, true AS share_held, true AS each_once FROM t LEFT JOIN d ON d.source = t.source WHERE t.source IS NOT NULL",
    "p4_found": f"{_VEC} SELECT a.field, a.node AS pk_a, b.node AS pk_b FROM v a JOIN v b ON a.field = b.field AND a.node < b.node WHERE list_cosine_similarity(a.x, b.x) >= 0.9",
    "p4_neighbours": f"""{_VEC}, q AS (SELECT * FROM v WHERE (('0x' || substr(replace(node, '-', ''), 1, 8))::BIGINT % 20 * 16 + ('0x' || substr(replace(node, '-', ''), 9, 8))::BIGINT % 20 * 16 + ('0x' || substr(replace(node, '-', ''), 17, 8))::BIGINT % 20 * 16 + ('0x' || substr(replace(node, '-', ''), 25, 8))::BIGINT) % 20 = 0)
SELECT q.field, q.node AS pk, row_number() OVER (PARTITION BY q.field, q.node ORDER BY list_cosine_similarity(q.x, v.x) DESC, v.node) AS rank, v.node AS neighbour, round(list_cosine_similarity(q.x, v.x), 8) AS cosine
FROM q JOIN v ON q.field = v.field AND q.node <> v.node QUALIFY rank <= 10""",
    "p5_found": f"WITH {_BASE} SELECT node AS pk FROM (SELECT node, arg_min(text, delivery_no) AS text FROM ided WHERE node IS NOT NULL GROUP BY node) WHERE len(regexp_extract_all(text, '{_TOKEN}')) > 1024",
}
