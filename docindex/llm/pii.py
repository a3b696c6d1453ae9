"""Personal data by bootstrapped contextual extraction, in built-in functions.

Spans that fixed expressions find and checks confirm are the seeds. The words
around seeds and around whatever else looks like an identifier are lexical
patterns; patterns and instances form a graph, scored in turns: a pattern is
trusted by how many of its instances are known, an unknown instance by the
patterns that it occurs in. Instances of high score are found wherever they occur.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, load, materialize, row_key
from .spans import joined, labelled, with_matches

KINDS = ["email", "ip", "card", "phone"]
# \G or a look-behind lets a match start only where a run starts, as any later
# start in the run fails too; possessive quantifiers keep long runs linear.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text without any match of the kind mostly lacks; cheaper to look for.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Something with a digit or an at sign that may be an identifier.
OTHER = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z_.-]*+[0-9@])[A-Za-z0-9]++(?:[-_./:@]++[A-Za-z0-9]++)*+"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"

#: A pattern needs so many seeds' worth of instances, and that share of all its
#: instances; an instance that score.
SUPPORT, CONFIDENCE, ACCEPT = 3, 0.7, 0.9


def is_valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits) <= 19, F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def find_base(docs: DataFrame) -> DataFrame:
    """Add an array column of (start, end, value) for each kind; needs ``text`` without nulls."""
    for kind in KINDS:
        docs = docs.withColumn("_searched", _hinted(HINTS[kind]))
        docs = with_matches(docs, kind, "_searched", PATTERNS[kind])
        docs = docs.withColumn(kind, _valid(kind))
    return docs.drop("_searched")


def _hinted(hint: str) -> Column:
    """The text if it has what any match has, else nothing to search."""
    return F.when(F.col("text").rlike(hint), F.col("text")).otherwise(F.lit(""))


def _valid(kind: str) -> Column:
    return F.filter(F.col(kind), lambda s: is_valid(kind, s["value"]))


def occurrences(docs: DataFrame) -> DataFrame:
    """Seeds and candidates with their lexical patterns: key, start, end, instance,
    kind (null for candidates), patterns."""
    every = "|".join([*(f"(?:{PATTERNS[k]})" for k in ("email", "phone", "ip", "card")), f"(?:{OTHER})"])
    found = with_matches(docs.where(F.col("text").rlike("[0-9@]")).select("key", "text"), "seen", "text", every, context=True)
    # From a plain explode Spark infers a filter on the array's size, which would run the whole chain above twice.
    one = found.select("key", F.explode_outer("seen").alias("s")).where("s is not null").select("key", "s.*")
    kind = F.coalesce(*(F.when(F.col("value").rlike(f"^(?:{PATTERNS[k]})$") & is_valid(k, F.col("value")), F.lit(k)) for k in KINDS))
    word = lambda c, p: F.lower(F.regexp_extract(c, p, 1))
    left, left2, right = word("before", r"(\p{L}+)\P{L}*$"), word("before", r"(\p{L}+\P{L}+\p{L}+)\P{L}*$"), word("after", r"^\P{L}*(\p{L}+)")
    one = one.select("key", "start", "end", F.lower("value").alias("instance"), kind.alias("kind"), left.alias("l"), F.regexp_replace(left2, r"\P{L}+", " ").alias("ll"), right.alias("r"))
    patterns = F.array(F.when(F.col("l") != "", F.concat(F.lit("l "), "l")), F.when(F.col("ll") != "", F.concat(F.lit("ll "), "ll")), F.when((F.col("l") != "") & (F.col("r") != ""), F.concat(F.lit("lr "), "l", F.lit(" "), "r")))
    return one.select("key", "start", "end", "instance", "kind", F.array_compact(patterns).alias("patterns"))


def bootstrap(seen: DataFrame, rounds: int | None = None, support: int = SUPPORT, confidence: float = CONFIDENCE, accept: float = ACCEPT) -> DataFrame:
    """(instance, kind) of candidates that the patterns vouch for. Repeats count
    once: the graph has an edge for each distinct pattern and instance. Rounds end
    when none finds a new instance, or after ``rounds``."""
    edges = seen.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.first("kind").alias("kind"))
    edges = materialize(edges, "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    graph = materialize(join_by_key(edges, sizes, "pattern", "n"), "graph")
    seeds = graph.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    known, found, reached = seeds, None, None
    for _ in itertools.count() if rounds is None else range(rounds):
        scored = graph.select("pattern", "instance", "n").join(known, "instance")
        trust = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.first("n").alias("n")).withColumn("trust", F.col("mass") / F.col("n"))
        trust = trust.where((F.col("mass") >= support) & (F.col("trust") >= confidence)).select("pattern", F.col("kind").alias("as_kind"), F.least("trust", F.lit(0.99)).alias("trust"), "n")
        trust = trust.groupBy("pattern").agg(F.max_by(F.struct("as_kind", "trust"), F.struct("trust", "as_kind")).alias("t"), F.first("n").alias("count"))
        voted = join_by_key(graph.where("kind is null").select("pattern", "instance"), trust, "pattern", "count")
        score = F.lit(1.0) - F.exp(F.sum(F.log(F.lit(1.0) - F.col("t.trust"))))
        best = voted.groupBy("instance", F.col("t.as_kind").alias("kind")).agg(score.alias("score")).groupBy("instance").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("b"))
        found = materialize(best.where(F.col("b.score") >= accept).select("instance", "b.kind", "b.score"), "found")
        # What was found stays so, or rounds might swing to and fro for ever.
        found = found if reached is None else materialize(reached.unionByName(found.join(reached, "instance", "left_anti")), "found")
        before, now = 0 if reached is None else reached.count(), found.count()
        if now == before:
            break
        reached, known = found, seeds.unionByName(found)
    return found.select("instance", "kind")


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in ``docs`` (doc_id, text), a row for each row.

    ``email``, ``ip``, ``card``, ``phone``: arrays of (start, end, value) of what the
    expressions find; ``added``: (start, order, end, kind) of what the patterns add,
    clear of all those. Null texts count as empty; repeated rows give repeated
    rows; other columns are dropped."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    seen = materialize(occurrences(keyed), "seen")
    found = bootstrap(seen)
    hits = seen.where("kind is null").select("key", "start", "end", "instance")
    counted = hits.groupBy("instance").agg(F.count("*").alias("n")).join(found, "instance")
    placed = join_by_key(hits, counted, "instance", "n")
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int") - 1
    added = placed.distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "kind"))).alias("added"))
    base = find_base(keyed).drop("text")
    out = base.join(added, "key", "left").drop("key")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    fixed = F.concat(*(F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS))
    out = out.withColumn("_fixed", F.when(F.col("added").isNotNull(), fixed))
    clear = lambda a: ~F.exists(F.col("_fixed"), lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))
    return out.withColumn("added", F.when(F.col("added").isNull(), none).otherwise(F.filter("added", clear))).drop("_fixed")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(load(spark, sf_dir, "documents"))
    base = found.withColumn("base", labelled(KINDS))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return base.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
