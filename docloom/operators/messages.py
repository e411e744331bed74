"""Message lists of conversations: windows, insertions and text views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions.text import numbered_lines

MESSAGE = "struct<turn:long,role:string,text:string>"


def gather(turns: DataFrame, conv: str = "conv_id", last: int | None = None) -> DataFrame:
    """(conv, messages): ordered messages of each conversation; with ``last`` only the latest so many.

    The cut is made by rank before the lists are built, so a long conversation costs no more than ``last`` rows.
    """
    if last:
        from pyspark.sql import Window

        w = Window.partitionBy(conv).orderBy(F.desc("turn"))
        turns = turns.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= last)
    return turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def last_answer(turns: DataFrame, conv: str = "conv_id", is_call: Column | None = None) -> DataFrame:
    """(conv, text): the latest assistant message that is no tool call; conversations without one are missing."""
    said = turns.filter((F.col("role") == "assistant") & (~is_call if is_call is not None else F.lit(True)))
    return said.groupBy(conv).agg(F.max_by("text", "turn").alias("text"))


def with_context(messages: Column, label: str, text: str) -> Column:
    """Messages with a system message in front, unless a system message holds the label already."""
    there = F.exists(messages, lambda m: (m["role"] == "system") & F.coalesce(m["text"].contains(label), F.lit(False)))
    first = F.struct(F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit(text).alias("text"))
    return F.when(there, messages).otherwise(F.concat(F.array(first), messages))


def reflections(items: Column) -> Column:
    """Numbered reflections, or None."""
    return numbered_lines(items)


def analysis_view(a: Column) -> Column:
    """Text view of an analysis struct<technical_summary, target_operation, risk_level, entities>; "None" for null."""
    names = F.array_join(F.transform(a["entities"], lambda e: F.concat(F.lit('{"name": "'), e["name"], F.lit('", "type": "'), e["type"], F.lit('"}'))), ", ")
    text = F.concat(F.lit("   - 技术摘要: "), a["technical_summary"], F.lit("\n   - 操作类型: "), a["target_operation"], F.lit("\n   - 风险等级: "), a["risk_level"], F.lit("\n   - 关键实体: ["), names, F.lit("]"))
    return F.when(a.isNull(), "None").otherwise(text)


def evaluation_view(e: Column) -> Column:
    """Text view of an evaluation struct<status, feedback>; "None" for null."""
    return F.when(e.isNull(), "None").otherwise(F.concat(F.lit("   - 评估状态: "), e["status"], F.lit("\n   - 反馈信息: "), e["feedback"]))


def plan_view(p: Column) -> Column:
    """Text view of a plan struct<action, search_queries, tool_name, tool_args, final_answer>; "None" for null."""
    head = F.array(F.concat(F.lit("   - 动作类型: "), p["action"]))
    queries = F.transform(p["search_queries"], lambda q, i: F.concat(F.lit("   - Query "), (i + 1).cast("string"), F.lit(": "), q))
    tool = F.array(F.concat(F.lit("   - 调用工具: "), p["tool_name"]), F.concat(F.lit("   - 工具参数: "), p["tool_args"]))
    answer = F.array(F.concat(F.lit("   - 最后回答: "), p["final_answer"]))
    none = F.array().cast("array<string>")
    rest = F.when(p["action"] == "Retrieve", queries).when(p["action"] == "Tool_Use", tool).when(p["action"] == "Direct_Answer", answer)
    return F.when(p.isNull(), "None").otherwise(F.array_join(F.concat(head, F.coalesce(rest, none)), "\n"))
