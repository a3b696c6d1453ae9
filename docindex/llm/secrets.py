"""Secret scans through a trigram index, in built-in functions.

From each rule's expression a Boolean query over trigrams is derived: what a
text must contain to be able to match. The index holds postings (trigram,
document) of the trigrams that queries ask for; postings of a document are
intersected under the query, and only documents that pass are searched with the
expression itself. Rules without mandatory trigrams search every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flag_among, load, materialize, row_key, spare
from .spans import joined, labelled, with_matches


@dataclass(frozen=True)
class Rule:
    """An expression (the same to Python and Java), and what a match must look
    like as a whole to count; matches that don't are dropped without a retry."""

    name: str
    pattern: str
    check: str = ""


#: The first three are the base, in that order. ``hex`` takes runs of 16 or more at once,
#: as shorter runs don't count. Formats of well-known services follow.
RULES = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}$"""),
    Rule("access", r"AKIA[A-Z0-9]+", r"^.{18,}$"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
]
BASE = [r.name for r in RULES[:3]]

#: A query in conjunctive form: of each clause one alternative has to hold, and all its trigrams with it.
Query = list[frozenset[frozenset[str]]]
_MOST = 64


@dataclass
class _Seen:
    """What is known of a part of an expression: the only strings that it can match
    (lower case), if these are few, and clauses that hold besides."""

    exact: set[str] | None
    clauses: Query = field(default_factory=list)


def _clause(strings: set[str]) -> Query:
    if not strings or min(map(len, strings)) < 3:
        return []
    ways = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return [frozenset(w for w in ways if not any(v < w for v in ways))]


def _look(node) -> _Seen:
    kind, arg = str(node[0]), node[1]
    if kind == "LITERAL":
        return _Seen({chr(arg).lower()})
    if kind == "IN":
        if all(str(k) == "LITERAL" for k, _ in arg):
            return _Seen({chr(c).lower() for _, c in arg})
        return _Seen(None)
    if kind == "SUBPATTERN":
        return _sequence(arg[-1])
    if kind == "BRANCH":
        ways = [_sequence(w) for w in arg[1]]
        if all(w.exact is not None for w in ways) and sum(len(w.exact) for w in ways) <= _MOST:
            return _Seen(set().union(*(w.exact for w in ways)))
        each = [[*w.clauses, *_clause(w.exact or set())] for w in ways]
        # One alternative of one clause of each way is enough for a valid, weaker clause.
        return _Seen(None, [frozenset().union(*(c[0] for c in each))] if all(each) else [])
    if kind in ("MAX_REPEAT", "POSSESSIVE_REPEAT", "MIN_REPEAT"):
        low, high, inner = arg[0], arg[1], _sequence(arg[2])
        if (low, high) == (0, 1) and inner.exact is not None:
            return _Seen({"", *inner.exact})
        if low and inner.exact is not None and low == high and len(inner.exact) ** low <= _MOST:
            return _Seen({"".join(p) for p in product(inner.exact, repeat=low)})
        return _Seen(None, [*inner.clauses, *_clause(inner.exact or set())] if low else [])
    if kind in ("ASSERT", "ASSERT_NOT", "AT"):
        return _Seen({""})
    return _Seen(None)


def _sequence(nodes) -> _Seen:
    now: set[str] = {""}
    clauses: Query = []
    whole = True
    for node in nodes:
        seen = _look(node)
        clauses += seen.clauses
        if seen.exact is not None and len(now) * len(seen.exact) <= _MOST:
            now = {a + b for a in now for b in seen.exact}
            continue
        clauses += _clause(now)
        whole, now = False, seen.exact if seen.exact is not None and len(seen.exact) <= _MOST else {""}
    return _Seen(now) if whole and not clauses else _Seen(None, clauses + _clause(now))


def trigram_query(pattern: str) -> Query:
    """The clauses that a text, in lower case, satisfies if it matches; none if the
    expression has no mandatory trigrams."""
    seen = _sequence(re._parser.parse(pattern))  # type: ignore[attr-defined]
    return seen.clauses + _clause(seen.exact or set())


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index of ``keyed`` (key, text) for these trigrams: (trigram, key), trigram
    being the place in the list."""
    lower = keyed.select("key", F.lower("text").alias("text"))
    there = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(t)), F.lit(n)) for n, t in enumerate(trigrams))))
    return lower.select("key", F.explode(there).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule], trigrams: list[str]) -> DataFrame:
    """Intersect postings: (key, rules) of the documents that can match some rule with trigrams."""
    at = {t: n for n, t in enumerate(trigrams)}
    words = range(-(-len(trigrams) // 63))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") % 63)
    sets = index.groupBy("key").agg(*(F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words))

    def holds(way: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in words:
            if need := sum(1 << at[t] % 63 for t in way if at[t] // 63 == w):
                out &= F.col(f"m{w}").bitwiseAND(F.lit(need).cast("long")) == F.lit(need).cast("long")
        return out

    passed = []
    for rule in rules:
        ok = F.lit(True)
        for clause in trigram_query(rule.pattern):
            one = F.lit(False)
            for way in sorted(clause, key=sorted):
                one |= holds(way)
            ok &= one
        passed.append(F.when(ok, F.lit(rule.name)))
    return sets.select("key", F.array_compact(F.array(*passed)).alias("rules")).where(F.size("rules") > 0)


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Add to ``docs`` (doc_id, text and others) an array column (start, end, value) for
    each rule, named like it after ``secret_``. Null texts count as empty; rows
    and other columns stay as they are; any with the names of these arrays give way."""
    new = {f"secret_{r.name}".lower() for r in rules}
    docs = docs.select(*(c for c in docs.columns if c.lower() not in new))
    text, key, passed, searched, flag = (spare(docs.columns, f"secret_{x}_") for x in ("text", "key", "rules", "searched", "flag"))
    keyed = docs.withColumn(text, F.coalesce("text", F.lit(""))).withColumn(key, row_key(F.col("doc_id"), F.col(text)))
    picky = [r for r in rules if trigram_query(r.pattern)]
    trigrams = sorted({t for r in picky for clause in trigram_query(r.pattern) for way in clause for t in way})
    able = candidates(postings(keyed.select(F.col(key).alias("key"), F.col(text).alias("text")), trigrams), picky, trigrams)
    able = materialize(able.select(F.col("key").alias(key), F.col("rules").alias(passed)), "candidates")
    # Only texts that can have a candidate are moved to it.
    marked = flag_among(keyed, key, able.select(key), flag)
    out = marked.where(F.col(flag)).join(able, key, "left").unionByName(marked.where(~F.col(flag)).withColumn(passed, F.lit(None).cast("array<string>")))
    for rule in rules:
        name = f"secret_{rule.name}"
        search = F.array_contains(passed, rule.name) if rule in picky else F.lit(True)
        out = out.withColumn(searched, F.when(search, F.col(text)).otherwise(F.lit("")))
        out = with_matches(out, name, searched, rule.pattern)
        if rule.check:
            out = out.withColumn(name, _checked(name, rule.check))
    return out.drop(text, searched, key, passed, flag)


def _checked(name: str, check: str) -> Column:
    return F.filter(name, lambda s: s["value"].rlike(check))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; overlapping ones count as one.
    ``n_chars``, if there, follows the text. Null texts stay null."""
    cols = docs.columns
    found = find_secrets(docs.select(F.struct(*cols).alias("row"), "doc_id", "text"))
    spans = F.array_sort(F.concat(*(F.transform(F.col(f"secret_{r.name}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for r in RULES)))
    found = found.withColumn("_spans", spans)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("gaps"))

    def step(s: Column, p: Column) -> Column:
        gap = F.array(F.struct(s["at"].alias("start"), p["start"].alias("end")))
        return F.struct(F.greatest(s["at"], p["end"]).alias("at"), F.when(p["start"] >= s["at"], F.concat(s["gaps"], gap)).otherwise(s["gaps"]).alias("gaps"))

    found = found.withColumn("_kept", F.aggregate("_spans", empty, step))
    pieces = F.transform(F.col("_kept.gaps"), lambda g: F.substring(F.col("text"), g["start"] + 1, g["end"] - g["start"]))
    rest = F.substring(F.col("text"), F.col("_kept.at") + 1, F.length("text"))
    cut = F.when(F.size("_spans") > 0, F.concat(F.array_join(pieces, mark), F.lit(mark), rest)).otherwise(F.col("text"))
    changed = {"text": cut}
    if "n_chars" in cols:
        changed["n_chars"] = F.when(F.size("_spans") > 0, F.length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*((changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in cols))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(load(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.select("doc_id", *(F.col(f"secret_{r.name}").alias(r.name) for r in RULES))
    found = found.withColumn("base", labelled(BASE)).withColumn("all", labelled([r.name for r in RULES]))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
