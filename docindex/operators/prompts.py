"""Grounded prompts for a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TEMPLATE = "【参考文档片段】\n{context}\n\n{history}【用户问题】\n{question}\n\nAnswer from the passages above and mark what they do not say."
NO_HIT_TEMPLATE = "【参考文档片段】\n(no passages)\n\n{history}【用户问题】\n{question}\n\nNo passage was found; mark the whole answer as a suggestion."


def format_context(results: DataFrame) -> DataFrame:
    """(query_id, context): a query's results by rank, each under a line that says where
    it comes from. At most k rows for each query are gathered."""
    # Labels.
    label = F.when(F.coalesce("source_type", F.lit("chm")) == "chm", F.lit("【CHM】")).otherwise(F.lit("【Demo】"))
    fields = [("符号", "symbol"), ("标题", "title"), ("章节", "chapter"), ("工程", "demo_name"), ("文件", "file_path")]
    info = F.concat_ws(", ", *(F.when(F.col(c) != "", F.concat(F.lit(f"{name}: "), F.col(c))) for name, c in fields))
    head = F.concat(label, F.lit(" [片段 "), F.col("rank").cast("string"), F.lit("]"), F.when(info != "", F.concat(F.lit(" ("), info, F.lit(")"))).otherwise(F.lit("")))
    text = F.concat(head, F.lit("\n"), F.coalesce("content", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n---\n\n").alias("context"))


def history_section(messages: DataFrame, last_n: int = 6, max_chars: int = 500) -> DataFrame:
    """(conv_id, turn, history): what was said before each turn, the last ``last_n``
    messages cut to ``max_chars``; empty for the first. Texts are cut before they are
    shuffled. Anyone but the user is the assistant."""
    who = F.when(F.col("role") == "user", F.lit("用户")).otherwise(F.lit("助手"))
    said = F.coalesce("text", F.lit(""))
    cut = F.when(F.length(said) > max_chars, F.concat(F.substring(said, 1, max_chars), F.lit("..."))).otherwise(said)
    lines = messages.select("conv_id", "turn", F.concat(who, F.lit(": "), cut).alias("line"))
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-last_n, -1)
    rows = lines.withColumn("_l", F.collect_list("line").over(before))
    text = F.concat(F.lit("【对话历史】\n"), F.array_join("_l", "\n"), F.lit("\n\n"))
    return rows.select("conv_id", "turn", F.when(F.size("_l") > 0, text).otherwise(F.lit("")).alias("history"))


def _fill(template: str, values: dict[str, Column]) -> Column:
    """The template with its {names} replaced; what is put in is not looked at again."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p] if n % 2 else F.lit(p) for n, p in enumerate(parts) if n % 2 or p))


def build_prompts(questions: DataFrame, contexts: DataFrame, histories: DataFrame | None = None, template: str = TEMPLATE, no_hit_template: str = NO_HIT_TEMPLATE) -> DataFrame:
    """(query_id, prompt) for every question (query_id, question); ``histories`` has
    query_id and history. Questions without a context get the other template."""
    rows = questions.join(contexts.select("query_id", "context"), "query_id", "left")
    rows = rows.join(histories.select("query_id", "history"), "query_id", "left") if histories is not None else rows.withColumn("history", F.lit(""))
    values = {"context": F.col("context"), "history": F.coalesce("history", F.lit("")), "question": F.coalesce("question", F.lit(""))}
    return rows.select("query_id", F.when(F.col("context").isNull(), _fill(no_hit_template, values)).otherwise(_fill(template, values)).alias("prompt"))


def session_history(messages: DataFrame, clear: Column | None = None) -> DataFrame:
    """Add ``session_no`` and ``position`` to messages (conv_id, turn, …): a message for
    which ``clear`` holds ends a session and belongs to none; positions count from 1 within a session."""
    is_clear = F.coalesce(clear, F.lit(False)) if clear is not None else F.lit(False)
    in_order = W.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumn("_clear", is_clear).withColumn("session_no", F.sum(F.col("_clear").cast("int")).over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    kept = rows.where(~F.col("_clear")).drop("_clear")
    return kept.withColumn("position", F.row_number().over(W.partitionBy("conv_id", "session_no").orderBy("turn")))
