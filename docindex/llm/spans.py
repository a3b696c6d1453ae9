"""Positions of regex matches with built-in functions only.

``split`` gives what lies between matches and ``regexp_extract_all`` the matches;
running sums over the lengths of both give the positions. Offsets count code
points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums run over blocks of so many matches, so that long texts stay near linear.
BLOCK = 64
#: Characters on either side of a match that its context is taken from. A word that lies across that border
#: is left out, so no context has a part of a word.
CONTEXT = 128


def with_matches(df: DataFrame, name: str, text: str, pattern: str, context: bool = False) -> DataFrame:
    """Add ``name``: array of (start, end, value) of the pattern's leftmost
    non-overlapping matches in column ``text`` (no nulls); with ``context`` also the
    ``before`` and ``after`` of each, whole words of up to CONTEXT characters."""
    gaps, found, pieces, sums = (f"_{name}_{x}" for x in ("gaps", "found", "pieces", "sums"))
    cols = df.columns
    df = df.withColumns({gaps: F.split(text, pattern, -1), found: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))})

    def whole(gap: Column, cut: Column, edge: str) -> Column:
        return F.when(F.length(gap) > CONTEXT, F.regexp_replace(cut, edge, "")).otherwise(gap)

    def piece(gap: Column, value: Column) -> Column:
        return F.struct(F.length(gap).alias("gap"), F.length(value).alias("length"), value.alias("value"), *([whole(gap, F.right(gap, F.lit(CONTEXT)), r"^\p{L}+").alias("before")] if context else []))

    made = F.slice(F.zip_with(gaps, found, piece), 1, F.size(found))
    if context:
        after = F.transform(F.slice(F.col(gaps), 2, F.size(found)), lambda g: whole(g, F.left(g, F.lit(CONTEXT)), r"\p{L}++$"))
        made = F.zip_with(made, after, lambda p, a: p.withField("after", a))
    df = df.withColumn(pieces, made)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda b: F.slice(F.col(pieces), b * BLOCK + 1, F.lit(BLOCK)))
    none = F.array().cast("array<array<struct<gap:int,length:int,value:string%s>>>" % (",before:string,after:string" if context else ""))
    df = df.withColumn(pieces, F.when(F.size(pieces) > 0, blocks).otherwise(none))
    total = F.transform(F.col(pieces), lambda b: F.aggregate(b, F.lit(0), lambda s, p: s + p["gap"] + p["length"]))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
    df = df.withColumn(sums, F.aggregate(total, zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before")))["before"])
    kind = "array<struct<start:int,end:int,value:string%s>>" % (",before:string,after:string" if context else "")

    def place(block: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

        def step(s: Column, p: Column) -> Column:
            start = s["at"] + p["gap"]
            one = F.struct(start.alias("start"), (start + p["length"]).alias("end"), p["value"].alias("value"), *([p["before"].alias("before"), p["after"].alias("after")] if context else []))
            return F.struct((start + p["length"]).alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

        return F.aggregate(block, first, step)["out"]

    return df.withColumn(name, F.flatten(F.zip_with(pieces, sums, place))).select(*cols, name)


def labelled(kinds: list[str]) -> Column:
    """All spans of columns named like their kinds, by start, then by the order of ``kinds``: (start, order, end, kind)."""

    def of(order: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*(of(n, k) for n, k in enumerate(kinds))))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
