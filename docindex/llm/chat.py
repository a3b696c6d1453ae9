"""Preference formatting: a chosen and a rejected conversation share their first
turns; these become one prompt, the rest of each a completion in which only
what the assistant says is trained on.

Turns stay rows until the end, so a conversation of any length is compared and
cut without one task holding it. A conversation is one row, whatever its number of turns; only where its
text is too long for a row does it come out in numbered parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import load

#: Characters from which on a conversation goes on in another row, and turn numbers that stay together.
PART_CHARS, TURNS = 50_000_000, 1000


def render(role: Column, text: Column) -> Column:
    """One turn in the template: a header line with the role, the text, an end mark."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def _turns(side: DataFrame) -> DataFrame:
    """A row for each (pair_id, turn). A null role is a user, a null text is empty,
    rows that share a turn number follow each other by role and text; rows without
    pair or turn belong to no conversation and are left out."""
    rows = side.where("pair_id is not null and turn is not null").select("pair_id", "turn", F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"))
    return rows.groupBy("pair_id", "turn").agg(F.array_sort(F.collect_list("said")).alias("said"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Prompts and completions from two tables (pair_id, turn, role, text).

    The prompt ends before the first turn that differs or that one side lacks.
    A row for each pair; of one of more than ``PART_CHARS`` characters a row for each part of about that length: ``n_common``, ``n_chosen`` and
    ``n_rejected`` turns of that part, ``prompt``, ``chosen``, ``rejected`` and their masks,
    spans (start, end; code points, end exclusive) of the completion that count in
    training: the assistant's texts with their end marks."""
    both = _turns(chosen).alias("c").join(_turns(rejected).alias("r"), ["pair_id", "turn"], "full")
    both = both.select("pair_id", "turn", F.col("c.said").alias("c"), F.col("r.said").alias("r"))
    first = both.where(~F.col("c").eqNullSafe(F.col("r"))).groupBy("pair_id").agg(F.min("turn").alias("first"))
    cut = both.join(first, "pair_id", "left").withColumn("common", F.coalesce(F.col("turn") < F.col("first"), F.lit(True)))
    size = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + F.length(render(s["role"], s["text"]))), F.lit(0))
    cut = cut.withColumn("stretch", F.floor(F.col("turn") / TURNS))
    sizes = cut.groupBy("pair_id", "stretch").agg(F.sum(size(F.col("c")) + size(F.col("r"))).alias("n"))
    before = W.partitionBy("pair_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)  # a row for each stretch
    parts = sizes.select("pair_id", "stretch", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / PART_CHARS).alias("part")).where("part > 0")
    cut = cut.join(parts, ["pair_id", "stretch"], "left")
    part = F.coalesce("part", F.lit(0).cast("long"))

    def gather(name: str, when: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(when & F.col(name).isNotNull(), F.struct("turn", F.col(name).alias("said")))))

    rows = cut.groupBy("pair_id", part.alias("part")).agg(gather("c", F.col("common")).alias("p"), gather("c", ~F.col("common")).alias("c"), gather("r", ~F.col("common")).alias("r"))

    def said(name: str) -> Column:
        return F.flatten(F.transform(F.col(name), lambda t: t["said"]))

    def text(name: str) -> Column:
        return F.array_join(F.transform(F.col(name), lambda s: render(s["role"], s["text"])), "")

    def mask(name: str) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(acc: Column, s: Column) -> Column:
            end = acc["at"] + F.length(render(s["role"], s["text"]))
            start = acc["at"] + F.length(s["role"]) + 5
            own = F.array(F.struct(start.alias("start"), (end - 1).alias("end")))
            return F.struct(end.alias("at"), F.when(s["role"] == "assistant", F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(F.col(name), empty, step)["spans"]

    flat = rows.select("pair_id", "part", *(said(n).alias(n) for n in "pcr"))
    return flat.select("pair_id", "part", *(F.size(n).alias(a) for n, a in zip("pcr", ("n_common", "n_chosen", "n_rejected"), strict=True)), text("p").alias("prompt"), text("c").alias("chosen"), mask("c").alias("chosen_mask"), text("r").alias("rejected"), mask("r").alias("rejected_mask"))


def preference_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations (conv_id, turn, role, text), one for each: the
    conversation as it is was chosen; rejected is the same up to its last
    assistant turn, where it says again what the assistant said first (nothing, if
    that is the only one), and ends. Conversations without an assistant are equal on both sides."""
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    ours = rows.where("role = 'assistant'").groupBy("pair_id").agg(F.min_by("text", F.struct("turn", F.coalesce("text", F.lit("")))).alias("_text"), F.min("turn").alias("_first"), F.max("turn").alias("_last"))
    marked = rows.join(ours, "pair_id", "left")
    stale = F.when(F.col("_first") == F.col("_last"), F.lit("")).otherwise(F.col("_text"))
    at_last = (F.col("turn") == F.col("_last")) & (F.col("role") == "assistant")
    rejected = marked.where("_last is null or turn <= _last").select("pair_id", "turn", "role", F.when(at_last, stale).otherwise(F.col("text")).alias("text"))
    return rows, rejected


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_preferences(*preference_pairs(load(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(F.col(c), lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select(F.col("pair_id").alias("conv_id"), "part", "n_common", "n_chosen", "n_rejected", *(F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")), spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))


OP9_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
a AS (SELECT conv_id, min(turn) AS first, max(turn) AS last, arg_min(text, turn) AS said FROM t WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT t.conv_id, t.turn, t.role, CASE WHEN t.turn = a.last AND t.role = 'assistant' THEN CASE WHEN a.first = a.last THEN '' ELSE a.said END ELSE t.text END AS text
  FROM t LEFT JOIN a USING (conv_id) WHERE a.last IS NULL OR t.turn <= a.last),
b AS (SELECT coalesce(t.conv_id, r.conv_id) AS conv_id, coalesce(t.turn, r.turn) AS turn, t.role AS crole, t.text AS ctext, r.role AS rrole, r.text AS rtext
  FROM t FULL JOIN r ON t.conv_id = r.conv_id AND t.turn = r.turn),
z AS (SELECT conv_id, turn // 1000 AS stretch, sum(coalesce(length(crole) + length(ctext) + 13, 0) + coalesce(length(rrole) + length(rtext) + 13, 0)) AS n FROM b GROUP BY ALL),
y AS (SELECT conv_id, stretch, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 50000000 AS BIGINT) AS part FROM z),
f AS (SELECT *, min(CASE WHEN crole IS DISTINCT FROM rrole OR ctext IS DISTINCT FROM rtext THEN turn END) OVER (PARTITION BY conv_id) AS first FROM b),
c AS (SELECT f.*, part, first IS NULL OR turn < first AS common,
  '<|' || crole || '|>' || chr(10) || ctext || '<|end|>' || chr(10) AS cr, '<|' || rrole || '|>' || chr(10) || rtext || '<|end|>' || chr(10) AS rr FROM f JOIN y ON y.conv_id = f.conv_id AND y.stretch = f.turn // 1000),
o AS (SELECT *, sum(CASE WHEN NOT common THEN length(cr) END) OVER w AS cend, sum(CASE WHEN NOT common THEN length(rr) END) OVER w AS rend FROM c WINDOW w AS (PARTITION BY conv_id, part ORDER BY turn))
SELECT conv_id, part, CAST(count(*) FILTER (WHERE common) AS INTEGER) AS n_common, CAST(count(cr) FILTER (WHERE NOT common) AS INTEGER) AS n_chosen, CAST(count(rr) FILTER (WHERE NOT common) AS INTEGER) AS n_rejected,
  sha256(coalesce(string_agg(cr, '' ORDER BY turn) FILTER (WHERE common), '')) AS prompt_sha256,
  sha256(coalesce(string_agg(cr, '' ORDER BY turn) FILTER (WHERE NOT common), '')) AS chosen_sha256,
  sha256(coalesce(string_agg(rr, '' ORDER BY turn) FILTER (WHERE NOT common), '')) AS rejected_sha256,
  coalesce(string_agg(CAST(CAST(cend - length(cr) + length(crole) + 5 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(cend - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY turn) FILTER (WHERE NOT common AND crole = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(CAST(rend - length(rr) + length(rrole) + 5 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(rend - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY turn) FILTER (WHERE NOT common AND rrole = 'assistant'), '') AS rejected_mask
FROM o GROUP BY conv_id, part
"""
