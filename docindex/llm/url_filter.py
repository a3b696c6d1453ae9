"""URL filters by a tree of path templates for each host, in built-in functions.

Rules say what is known of some URLs. For the others the paths of a host are put into a tree, segment by segment: at each node
values that many of its pages have stay as they are, the many others become a
wildcard, and branches whose pages the rules judge alike are merged. Templates whose labelled pages
are mostly blocked are rejected with all their pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, join_by_key, load, materialize, row_key

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Rules are part of the plan, so their number is bounded.
MOST_RULES = 1000
#: Levels of the tree; what follows the last one counts as one segment.
DEPTH = 8
#: A value stays if so many pages of its node have it, and that share of them.
SUPPORT, SHARE = 3, 0.05
#: Branches are told apart if a share of theirs differs by so many standard errors.
APART = 1.96
#: A template is rejected from this smoothed share of blocked pages among labelled ones.
PURITY = 0.8

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits: its host or a subdomain of it, and a
    path that starts with its own; null if none does. Of equally long ones the alphabetically first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    kind = "struct<rule:string,verdict:string>"
    first = F.lit(None).cast(kind)
    for verdict, of, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))[::-1]:
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(start))
        first = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(first)
    return first


def _apart(x: Column, n: Column, y: Column, m: Column) -> Column:
    """Whether x of n and y of m differ significantly; half a success and half a failure are added to both, so that
    few pages show nothing."""
    p, q = (x + 0.5) / (n + 1), (y + 0.5) / (m + 1)
    pooled = (x + y + 1.0) / (n + m + 2)
    return F.abs(p - q) > APART * F.sqrt(pooled * (1 - pooled) * (1.0 / (n + 1) + 1.0 / (m + 1)))


def path_templates(paths: DataFrame, depth: int = DEPTH, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(host, path, n, bad, good, template) for ``paths`` (host, path, n, bad, good; a row for each distinct host and path, with its pages, and how many of
    them are labelled so), as a table.

    Level by level: in each node a segment that at least ``support`` pages and a ``share`` of the node have is a branch, all other segments
    are one branch, ``*``. The branches, in order of their shares of bad and good pages, are merged with the one before
    unless either share differs significantly: a merged branch is called ``*`` if that is in it, else ``(a|b)``. A level
    costs one shuffle of distinct paths that reach it, counted before they move; keys that hold many rows are not moved."""
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.when(F.startswith("path", F.lit("/")), F.substring("path", 2, 1 << 30)).otherwise(F.col("path")), "/", depth))
    now = materialize(paths.select("host", "path", "n", "bad", "good", segments.alias("segments"), F.lit("").alias("template")), "paths")
    for level in range(depth):
        here = now.where(F.size("segments") > level)
        if here.isEmpty():
            break
        keyed = here.withColumn("value", F.element_at("segments", level + 1)).withColumn("node", row_key(F.col("host"), F.col("template"))).withColumn("key", row_key(F.col("host"), F.col("template"), F.col("value")))
        whole = keyed.groupBy("node").agg(F.sum("n").alias("whole"))
        many = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("pages"), F.first("node").alias("node"), F.first("value").alias("value")).where(F.col("pages") >= support)
        kept = materialize(many.join(whole, "node").where(F.col("pages") >= share * F.col("whole")).select("key", "rows", F.col("value").alias("branch")), "branches")
        placed = materialize(join_by_key(keyed.drop("value"), kept, "key", "rows", "left").withColumn("rows", F.lit(None)).drop("rows").withColumn("branch", F.coalesce(F.concat(F.lit("="), "branch"), F.lit("*"))), "placed")
        # At most 1 / share branches and the wildcard in each node.
        sums = placed.groupBy("node", "branch").agg(F.count("*").alias("rows"), *(F.sum(c).alias(c) for c in ("n", "bad", "good")))
        row = W.partitionBy("node").orderBy(F.col("bad") / F.col("n"), F.col("good") / F.col("n"), "branch")
        last = {c: F.lag(c).over(row) for c in ("n", "bad", "good")}
        new = last["n"].isNull() | _apart(F.col("bad"), F.col("n"), last["bad"], last["n"]) | _apart(F.col("good"), F.col("n"), last["good"], last["n"])
        grouped = sums.withColumn("new", new.cast("int")).withColumn("group", F.sum("new").over(row))
        names = F.array_sort(F.collect_list("branch").over(W.partitionBy("node", "group")))
        plain = F.transform(names, lambda b: F.substring(b, 2, 1 << 30))
        name = F.when(F.array_contains(names, "*"), F.lit("*")).when(F.size(names) == 1, plain[0]).otherwise(F.concat(F.lit("("), F.array_join(plain, "|"), F.lit(")")))
        called = materialize(grouped.select(row_key(F.col("node"), F.col("branch")).alias("key"), "rows", name.alias("name")), "merged")
        done = placed.withColumn("key", row_key(F.col("node"), F.col("branch")))
        done = join_by_key(done, called, "key", "rows").select("host", "path", "n", "bad", "good", "segments", F.concat("template", F.lit("/"), "name").alias("template"))
        old, now = now, materialize(now.where(F.size("segments") <= level).unionByName(done), "paths")
        drop(old, kept, placed, called)
    return now


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", purity: float = PURITY) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (the longest of ``rules`` that fits, else null), ``verdict`` (the rule's, else the method's: allow or block),
    ``template`` and ``purity`` to the rows of ``pages``.

    The rules' verdicts are the labels. A template's purity is (blocked + 1) / (labelled + 2); pages without a rule are blocked
    from ``purity`` on, so templates without labelled pages are allowed. Null urls and those without ``://`` have an empty host and path; repeated rows count as
    pages of their own. Columns of ``pages`` that are named like the new ones give way."""
    added = ["host", "path", "rule", "verdict", "template", "purity"]
    cols = [c for c in pages.columns if c == url or c.lower() not in added]
    rest = [c for c in cols if c.lower() not in added]
    read = pages.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("kept") if rest else F.struct(F.lit(1)).alias("kept"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    read = read.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    labels = [F.sum(F.when(F.col("fit.verdict") == v, 1).otherwise(0)).alias(name) for v, name in (("block", "bad"), ("allow", "good"))]
    paths = path_templates(read.groupBy("host", "path").agg(F.count("*").alias("n"), *labels))
    sums = paths.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("rows"))
    sums = sums.select(row_key(F.col("host"), F.col("template")).alias("key"), ((F.col("bad") + 1) / (F.col("bad") + F.col("good") + 2)).alias("purity"), "rows")
    judged = join_by_key(paths.select("host", "path", "n", "template", row_key(F.col("host"), F.col("template")).alias("key")), sums, "key", "rows")
    judged = materialize(judged.select(row_key(F.col("host"), F.col("path")).alias("key"), "n", "template", "purity"), "templates")
    out = join_by_key(read.withColumn("key", row_key(F.col("host"), F.col("path"))), judged, "key", "n")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("purity") >= purity, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*(F.col(f"kept.`{c}`") for c in rest), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")
