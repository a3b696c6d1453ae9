"""Repeated passages by content-defined chunking.

A gear rolling hash over the last 16 bytes is the least among its neighbours where a
chunk ends, so chunk borders move with the text and are the same again a few dozen
bytes after an insertion. Two chunks in a row make a unit; units with one digest are one
unit, whose first occurrence (smallest doc_id, then smallest position) is the original,
the others are repeats. Repeats that overlap make a passage, so the order of its chunks
was there before, too. White space counts as one space between words. Units that lie among so few others that no passage
could be long enough are left out where they are made.

A passage ends in the midst of chunks. Each unit therefore carries two bits of
the hash of each of the 31 words before and after it: no more words than agree with those of
the original belong to the passage, or more than 31. Where that may make a passage long enough, the hashes of these words
themselves are compared, of as many as it takes. Only documents with such places have their texts moved.

Documents with equal texts are one document; the others are repeats as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MAP_BITS, attach, brief_shuffles, drop, flag_among, join_by_key, load, map_of_bits, materialize, spare

#: Bytes: neighbours on either side among which a border has the least hash, and most in a chunk.
NEAR, MOST = 10, 512
#: Words of a passage.
MIN_WORDS = 51
#: Words beside a unit that it knows two bits of.
BESIDE = 31

_U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(7))
_GEAR = _RANDOM.integers(0, 2**16, 256, np.uint16)
#: Two digests: values of the bytes and an odd base each.
_VALUES = _RANDOM.integers(0, 2**64, (2, 256), _U)
_BASES = (0xD1342543DE82EF95, 0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _rolling(b: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: 16 bits, so bytes further back are shifted out."""
    h = _GEAR[b]
    width = 1
    while width < 16:  # a window of twice the width from two of this width
        if len(h) > width:
            h[width:] += h[:-width] << np.uint16(width)
        width *= 2
    return h


def borders(b: np.ndarray) -> np.ndarray:
    """Where chunks of a text start or end, in bytes, both ends of the text included."""
    n = len(b)
    if not n:
        return np.zeros(1, np.int64)
    h = _rolling(b)
    edge = np.full(NEAR, 2**16 - 1, np.uint16)
    padded = np.concatenate([edge, h, edge])
    least, w = padded, 1
    while 2 * w <= NEAR:
        least, w = np.minimum(least[:-w], least[w:]), 2 * w
    if w < NEAR:
        least = np.minimum(least[: len(least) - (NEAR - w)], least[NEAR - w :])
    # least[i] is that of padded[i : i + NEAR]
    at = np.flatnonzero((h < least[:n]) & (h <= least[NEAR + 1 : NEAR + 1 + n])) + 1
    at = np.concatenate([[0], at[(at >= NEAR) & (at < n)], [n]])
    gap = np.diff(at)
    if gap.max() > MOST:
        at = np.concatenate([np.arange(a, e, MOST) if e - a > MOST else [a] for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] + [[n]]).astype(np.int64)
    return at


class Prefixes:
    """Hashes of parts of a text from prefix sums of byte values times powers of an odd base."""

    def __init__(self, which: int):
        self.value, self.base = _VALUES[which], _BASES[which]
        self.power = self.inverse = np.ones(1, _U)

    def __call__(self, b: np.ndarray):
        if len(b) >= len(self.power):
            n = 1 << len(b).bit_length()
            with np.errstate(over="ignore"):
                self.power, self.inverse = (np.concatenate([[_U(1)], np.cumprod(np.full(n, x, _U))]) for x in (self.base, pow(self.base, -1, 2**64)))
        total = np.zeros(len(b) + 1, _U)
        np.cumsum(self.value[b] * self.power[: len(b)], out=total[1:])
        return lambda start, end: _mix((total[end] - total[start]) * self.inverse[start] + (end - start).astype(_U))


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end, in bytes: runs without ASCII white space; letters of scripts
    that use no spaces (Thai, Lao, and those from U+3000 on) are words of their own."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = np.concatenate([[True], _BLANK[b], [True]])
    starts, ends = blank[:-1] & ~blank[1:], ~blank[:-1] & blank[1:]
    if b.max() >= 0xE0:
        first = (b & 0xC0) != 0x80
        lead = np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
        second = b[np.minimum(lead + 1, len(b) - 1)]
        wide = (b[lead] >= 0xE3) | (b[lead] == 0xE0) & (second >= 0xB8) & (second <= 0xBB)
        alone = np.concatenate([[False], wide, [False]])
        new = np.concatenate([first, [True]]) & ~blank[1:]
        starts |= new & alone[1:]  # such a letter starts a word, and so does what follows it
        starts |= new & alone[:-1] & ~blank[:-1]
        ends |= starts & ~blank[:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends)


def _beside(code: np.ndarray, step: int) -> np.ndarray:
    """For each word two bits of it and of the 30 words before (step -1) or after it, the nearest lowest; 0 is no word."""
    out = np.zeros(len(code), np.int64)
    for k in range(min(BESIDE, len(code))):
        part = slice(k, None) if step < 0 else slice(None, len(code) - k)
        out[part] |= (code[: len(code) - k] if step < 0 else code[k:]) << (2 * k)
    return out


UNITS = "key long, check long, doc_id long, start long, end long, first long, last long, before long, after long"
_NAMES = [x.split()[0] for x in UNITS.split(", ")]


def _long_enough(able: np.ndarray, at: np.ndarray, begins: np.ndarray, ends: np.ndarray, min_words: int) -> np.ndarray:
    """``able`` without units that no passage of ``min_words`` words can have. A border hangs on the 26 bytes before and the 10 after it. If a passage
    went on that far beyond the border before or behind a row of able units, it would have one more unit on that side, able as well; so it
    ends within these bytes, and the words that lie there are the most that it can have."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], able.view(np.int8), [0]])))
    a, z = edge[::2], edge[1::2]  # units a to z - 1 have the borders a to z + 1
    low = np.where(a > 0, at[np.maximum(a - 1, 0)] - 26, -1)
    high = np.where(z + 2 < len(at), at[np.minimum(z + 2, len(at) - 1)] + 10, at[-1] + 1)
    enough = np.searchsorted(ends, high, "left") - np.searchsorted(begins, low, "right") >= min_words
    return able & np.repeat(np.concatenate([[0], np.stack([enough, np.zeros_like(enough)], 1).ravel()]), np.diff(np.concatenate([[0], edge, [len(able)]]))).astype(bool)


def _units(digests: list[Prefixes], raw: bytes, known: np.ndarray | None, min_words: int = 1) -> list[np.ndarray] | None:
    """Of each two chunks in a row whose first digest is in the map of bits ``known``, and that a passage of ``min_words`` words can have: two digests,
    where they are (bytes), their first and last word and what lies beside these; without a map the first digest of each. White space counts as
    one space between words, so that chunks are the same however lines are broken."""
    joined = b" ".join(raw.split())
    if not joined:
        return None
    b = np.frombuffer(joined, np.uint8)
    at = borders(b)
    if len(at) < 3:
        at = np.array([at[0], at[-1], at[-1]])
    start, end = at[:-2], at[2:]
    one = digests[0](b)
    key = one(start, end)
    if known is None:
        return [key.view(np.int64)]
    bit = key & _U(MAP_BITS - 1)
    able = (known[bit >> _U(3)] >> (bit & _U(7)).astype(np.uint8)) & 1 > 0
    if not able.any():
        return None
    begins, ends = words(b)
    # Borders of chunks that were cut for their length hang on more bytes; letters that are words of their own may have spaces between them or not.
    if np.diff(at).max() < MOST and b.max() < 0xE0:
        able = _long_enough(able, at, begins, ends, min_words)
        if not able.any():
            return None
    key, start, end = key[able], start[able], end[able]
    two = digests[1](b)
    code = (one(begins, ends) >> _U(40)).astype(np.int64) % 3 + 1
    first = np.minimum(np.searchsorted(ends, start, "right"), len(begins) - 1)
    last = np.maximum(np.searchsorted(begins, end, "left") - 1, 0)
    out = [key.view(np.int64), two(start, end).view(np.int64), start, end, first, last, _beside(code, -1)[first], _beside(code, 1)[last]]
    if joined != raw:
        blank = np.concatenate([[True], _BLANK[np.frombuffer(raw, np.uint8)], [True]])
        there = np.flatnonzero(blank[:-1] & ~blank[1:])
        here = np.concatenate([[0], np.flatnonzero(b == 32) + 1])
        out[2:4] = [there[w] + x - here[w] for x in (start, end) for w in [np.searchsorted(here, x, "right") - 1]]
    return out


#: Rows of units that go out at once, or those of a text.
_ROWS = 100_000


def units(docs: DataFrame, known: Broadcast[np.ndarray] | None = None, min_words: int = 1) -> DataFrame:
    """The units of ``docs`` (doc_id, text) that the map of bits ``known`` has and that a passage of ``min_words`` words can have: two halves of a 128-bit digest, where the unit lies in
    code points, its first and last word (numbers from 0) and two bits of each of 31 words at
    both ends; without a map ``key`` of all, the first half. Null texts and ids
    have none, nor have texts without words. Of equal texts in a task those with larger ids may be left out."""
    import xxhash

    names = _NAMES[:1] if known is None else _NAMES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, seen = [Prefixes(0), Prefixes(1)], {}
        bits = None if known is None else known.value
        cols: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in names]
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                raw = text.encode()
                digest = xxhash.xxh3_128_digest(raw)
                if seen.get(digest, doc + 1) <= doc:  # the document with the smallest id is always looked at
                    continue
                if len(seen) < 1_000_000:
                    seen[digest] = doc
                if (own := _units(digests, raw, bits, min_words)) is None:
                    continue
                if bits is not None:
                    key, check, start, end, *rest = own
                    if len(raw) != len(text):
                        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                        start, end = points[start], points[end]
                    own = [key, check, np.full(len(key), doc, np.int64), start, end, *rest]
                for c, v in zip(cols, own, strict=True):
                    c.append(v)
                held += len(own[0])
                if held > _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)
                    cols, held = [[np.empty(0, np.int64)] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "key long" if known is None else UNITS)


#: The lower bit of each pair.
_ODD = sum(1 << 2 * k for k in range(BESIDE))


def _agreeing(mine: Column, other: Column) -> Column:
    """How many words beside two units agree, from the nearest on."""
    none = F.bitwise_not(mine.bitwiseOR(F.shiftright(mine, 1))).bitwiseAND(F.lit(_ODD))  # where there is no word
    odd = mine.bitwiseXOR(other).bitwiseOR(none)
    return F.when(odd == 0, F.lit(BESIDE)).otherwise((F.round(F.log2(odd.bitwiseAND(-odd))).cast("int") / 2).cast("int"))


def _longest(first: str, last: str, left: str, right: str, min_words: int) -> Column:
    """How many words a passage may have whose units have these ends, of which so many words beside them may agree; ``min_words`` if that isn't known."""
    inner, left, right = F.greatest(F.col(last) - F.col(first) - 1, F.lit(0)), F.col(left), F.col(right)
    # One word may be all that lies between the ends; else the words at both ends and those between them.
    return F.when((left >= BESIDE) | (right >= BESIDE), F.greatest(F.lit(min_words), inner)).otherwise(F.greatest(inner + left + right, left, right))


def _firsts(some: DataFrame) -> DataFrame:
    """(key, check, o): where each repeated unit is first. One row for each, whatever the number of its repeats."""
    place = ("doc_id", "start", "first", "last", "before", "after")
    return some.groupBy("key", "check").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("o")).where("n > 1").drop("n")


def _repeats(some: DataFrame, firsts: DataFrame) -> DataFrame:
    """The units of ``some`` that occurred before, each in one row with its first occurrence. All units go through one join, so that it makes
    at most as many rows as there are units; where a unit has very many repeats, Spark splits their partition, as the rows of ``firsts`` fit each part."""
    return some.join(firsts, ["key", "check"]).where("not (doc_id = o.doc_id and start = o.start)")


_LEFT, _RIGHT = 0, 1


def _words_beside(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(at, hashes) for each of ``places`` (at: struct of doc_id, word, side; ask): the hashes of ``ask`` words from that one on,
    to the left or right, fewer where the text ends. Places of a document are gathered in its row; it has two for each of its words at most."""
    needs = places.groupBy("at").agg(F.max("ask").alias("ask")).groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("at.word", "at.side", "ask")).alias("asked"))
    needs = materialize(needs, "asked")
    able = flag_among(docs, "doc_id", needs.select("doc_id"), "able").where("able").select("doc_id", "text")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = Prefixes(0)
        for batch in batches:
            for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                b = np.frombuffer(text.as_py().encode(), np.uint8)
                hashes = digest(b)(*words(b)).view(np.int64)
                word, side, ask = (asked.values.field(k).to_numpy() for k in range(3))
                # The parts of one text that are asked for, one after the other.
                first = np.where(side == _LEFT, np.maximum(word - ask + 1, 0), np.clip(word, 0, len(hashes)))
                size = np.maximum(np.where(side == _LEFT, np.minimum(word, len(hashes) - 1) + 1, np.minimum(word + ask, len(hashes))) - first, 0)
                ends = np.cumsum(size)
                within = np.arange(ends[-1]) - np.repeat(ends - size, size)
                back = np.repeat(side == _LEFT, size)
                flat = hashes[np.where(back, np.repeat(first + size - 1, size) - within, np.repeat(first, size) + within)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), doc)), pa.array(word), pa.array(side), lists], ["doc_id", "word", "side", "hashes"])

    found = able.join(needs, "doc_id").select("doc_id", "text", "asked").mapInArrow(look, "doc_id long, word long, side int, hashes array<long>")
    out = materialize(found.select(F.struct("doc_id", "word", "side").alias("at"), "hashes"), "beside")
    drop(needs)
    return out


def _exact_ends(docs: DataFrame, sides: DataFrame) -> DataFrame:
    """(run, side, total): of ``sides`` (run, mine and other: structs of doc_id, word, side; ask) how many words agree from these words on. ``ask`` words at most do,
    unless it is BESIDE: then more are compared, eight times as many each time, while all agree. Rows with one doc_id count together: the longest agreement is taken."""
    state, rounds = sides.withColumn("total", F.lit(0).cast("long")), []
    while True:
        places = state.select(F.col("mine").alias("at"), "ask").unionByName(state.select(F.col("other").alias("at"), "ask"))
        beside = _words_beside(docs, places)
        others = state.groupBy("other").agg(F.count("*").alias("n"))
        others = others.join(beside.select(F.col("at").alias("other"), F.col("hashes").alias("theirs")), "other")
        both = join_by_key(state.join(beside.select(F.col("at").alias("mine"), F.col("hashes").alias("ours")), "mine"), others, "other", "n")
        same = F.zip_with(F.slice("ours", 1, F.col("ask")), F.slice("theirs", 1, F.col("ask")), lambda a, b: F.coalesce(a == b, F.lit(False)))
        agree = F.when(F.array_contains(same, False), F.array_position(same, F.lit(False)).cast("long") - 1).otherwise(F.size(same).cast("long"))
        got = both.withColumn("agree", agree).groupBy("run", "side", "mine", "other", "ask", "total").agg(F.max("agree").alias("agree"))
        got = materialize(got.withColumn("total", F.col("total") + F.col("agree")), "agreed")
        drop(beside)
        rounds.append(got)
        more = got.where((F.col("agree") == F.col("ask")) & (F.col("ask") >= BESIDE))
        if more.isEmpty():
            break
        step = F.when(F.col("side") == _LEFT, -F.col("agree")).otherwise(F.col("agree"))
        moved = lambda c: F.struct(F.col(f"{c}.doc_id").alias("doc_id"), (F.col(f"{c}.word") + step).alias("word"), F.col(f"{c}.side").alias("side"))
        state = more.select("run", "side", moved("mine").alias("mine"), moved("other").alias("other"), (F.col("ask") * 8).alias("ask"), "total")
    out = rounds[0]
    for later in rounds[1:]:
        out = out.unionByName(later)
    return out.groupBy("run", "side").agg(F.max("total").alias("total"))


def _tables(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of documents with equal texts all but the first; rows of repeats that overlap and may make a passage; how many words agree at
    both ends of these. Every step ends in a table."""
    whole = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").cast("long").alias("size"))
    same = whole.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("source_doc_id")).where("n > 1")
    copies = join_by_key(whole, materialize(same, "same"), "digest", "n").where("doc_id <> source_doc_id")
    copies = materialize(copies.select("doc_id", "source_doc_id", "size").distinct(), "copies")

    again = units(docs).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    known = docs.sparkSession.sparkContext.broadcast(map_of_bits(again, "key"))
    some = materialize(units(docs, known, min_words), "units")
    firsts = materialize(_firsts(some), "firsts")
    hits = _repeats(some, firsts)
    left = F.least(_agreeing(F.col("before"), F.col("o.before")), F.col("first") + 1)
    right = _agreeing(F.col("after"), F.col("o.after"))
    origin = F.struct("o.doc_id", "o.start", "o.first", "o.last").alias("o")
    hits = hits.select("doc_id", "start", "end", "first", "last", left.alias("left"), right.alias("right"), origin)
    order = W.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = hits.withColumn("new", F.coalesce((reach <= F.col("start")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.size(F.collect_set("start")).alias("n_units"),
        F.min_by(F.struct("first", "left", "o"), F.struct("start", "end", "o")).alias("a"), F.max_by(F.struct("last", "right", "o"), F.struct("end", "start", "o")).alias("z"),
    )
    runs = runs.join(copies.select("doc_id").distinct(), "doc_id", "left_anti")
    runs = runs.where(_longest("a.first", "z.last", "a.left", "z.right", min_words) >= min_words)
    runs = runs.select(F.struct("doc_id", "run").alias("run"), "start", "end", "n_units", "a", "z", F.col("a.left").alias("left"), F.col("z.right").alias("right"))
    runs = materialize(runs, "runs")
    drop(some, firsts)
    known.unpersist()
    word = lambda doc, at, side: F.struct(F.col(doc).alias("doc_id"), F.col(at).alias("word"), F.lit(side).alias("side"))
    side = lambda n, mine, other, ask: runs.select("run", F.lit(n).alias("side"), word("run.doc_id", mine, n).alias("mine"), word(f"{other[0]}.o.doc_id", other, n).alias("other"), F.col(ask).cast("long").alias("ask")).where("ask > 0")
    return copies, runs, _exact_ends(docs, side(_LEFT, "a.first", "a.o.first", "left").unionByName(side(_RIGHT, "z.last", "z.o.last", "right")))


def find_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of at least ``min_words`` words of ``docs`` (doc_id, text) that occurred before:

    doc_id, start, end (code points, end exclusive: the whole chunks in it), first_word,
    n_words (the passage itself, its first word counted from 0), n_units and source_doc_id,
    where the first of its units was found first. Of documents with equal texts all but the one with the
    smallest doc_id are a passage each. Rows with one doc_id count as one document, and a
    document may repeat itself. Null ids and texts have none.

    Words are runs without ASCII white space; letters of scripts without spaces count as words."""
    attach(docs.sparkSession)
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    with brief_shuffles(docs.sparkSession):
        copies, runs, ends = _tables(docs, min_words)
    total = lambda n: F.coalesce(F.max(F.when(F.col("side") == n, F.col("total"))), F.lit(0))
    ends = ends.groupBy("run").agg(total(_LEFT).alias("left"), total(_RIGHT).alias("right"))
    # Where units start and end within words that differ, no words beside them were asked for.
    runs = runs.drop("left", "right").join(ends, "run", "left").fillna(0, ["left", "right"])
    first, last = F.col("a.first") - F.col("left") + 1, F.col("z.last") + F.col("right")
    runs = runs.select(F.col("run.doc_id").alias("doc_id"), "start", "end", first.alias("first_word"), (last - first).alias("n_words"), "n_units", F.col("a.o.doc_id").alias("source_doc_id"))
    found = runs.where(F.col("n_words") >= min_words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(words(np.frombuffer(t.as_py().encode(), np.uint8))[0]) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_words"])

    sources = copies.select(F.col("source_doc_id").alias("doc_id")).distinct()
    able = flag_among(docs, "doc_id", sources, "able").where("able").select("doc_id", "text")
    lengths = able.join(sources, "doc_id").mapInArrow(count, "doc_id long, n_words long").groupBy("doc_id").agg(F.max("n_words").alias("n_words")).withColumnRenamed("doc_id", "source_doc_id")
    many = copies.groupBy("source_doc_id").agg(F.count("*").alias("n")).join(lengths, "source_doc_id")
    full = join_by_key(copies, many, "source_doc_id", "n").where(F.col("n_words") >= min_words)
    full = full.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"), F.lit(0).cast("long").alias("first_word"), "n_words", F.lit(0).alias("n_units"), "source_doc_id")
    return found.unionByName(full)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the words of their repeated passages and the white space after these;
    rows without any stay as they are. Other columns stay."""
    attach(docs.sparkSession)
    spans = find_passages(docs, min_words).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("spans"))
    cols = docs.columns
    name = spare(cols, "spans")
    spans = materialize(spans.withColumnRenamed("spans", name), "spans")
    flag = spare([*cols, name], "able")
    marked = flag_among(docs, "doc_id", spans.select("doc_id"), flag)
    able = marked.where(flag).select(*cols).join(spans, "doc_id", "left")
    text, own = cols.index("text"), len(cols)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, its in zip(batch.column(text), batch.column(own), strict=True):
                t = value.as_py()
                if t is not None and its.as_py():
                    raw = t.encode()
                    begins, _ = words(np.frombuffer(raw, np.uint8))
                    stops = [*begins.tolist(), len(raw)]
                    kept, at = [], 0
                    for s in its.as_py():
                        a, e = (stops[min(s["first_word"] + k, len(begins))] for k in (0, s["n_words"]))
                        kept.append(raw[at : max(at, a)])
                        at = max(at, e)
                    t = b"".join([*kept, raw[at:]]).decode()
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == text else c for k, c in enumerate(batch.columns[:own])], cols)

    changed = able.select(*cols, name).mapInArrow(cut, docs.select(*cols).schema)
    return marked.where(~F.col(flag)).select(*cols).unionByName(changed)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(load(spark, sf_dir, "documents"))
