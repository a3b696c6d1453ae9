"""Benchmark decontamination by greedy string tiling.

Runs of a few tokens of the test items, by their rolling hashes, are seeds; Spark joins
them with the seeds of documents. A document and an item that share any are tiled:
the longest match of tokens is marked as a tile, then the longest among what is still unmarked, and
so on, each found by Karp-Rabin hashes of windows. An item counts as leaked into a document if
the tiles cover enough of it; as tiles may lie in any order, reordered passages
are caught too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAP_BITS, ROW_BITS, attach, drop, flag_among, join_by_key, load, materialize, row_key, spare

_TOKENS = re.compile(r"\w+").findall
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Shortest tile, in tokens, and the share of an item's tokens that tiles must cover.
MIN_TILE, MIN_COVERAGE = 5, 0.5
#: Documents and items of one seed that are joined in one group.
PART = 1000


class _Words(dict):
    """Hashes of words, kept for those seen lately."""

    KEPT = 200_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > self.KEPT:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word.encode(errors="surrogatepass"))
        return out


def _ids(text: str | None, words: _Words) -> np.ndarray:
    found = _TOKENS((text or "").lower())
    return np.fromiter(map(words.__getitem__, found), _U, len(found))


class Windows:
    """Hashes of windows of any length of a sequence, from prefix sums."""

    def __init__(self, ids: np.ndarray):
        n = len(ids) + 1
        self.power, self.inverse = (np.concatenate([[_U(1)], np.cumprod(np.full(n - 1, b, _U))]) for b in (_BASE, pow(_BASE, -1, 2**64)))
        self.total = np.concatenate([[_U(0)], np.cumsum(ids * self.power[: n - 1])])

    def __call__(self, n: int, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(len(self.total) - n) if at is None else at
        h = (self.total[at + n] - self.total[at]) * self.inverse[at]
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return h ^ (h >> _U(32)) ^ _U(n)


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Where windows of n tokens start that hold nothing marked."""
    if len(marked) < n:
        return np.empty(0, np.int64)
    count = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(count[n:] == count[:-n])


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document start, item start, length) of at least ``least`` tokens of
    two sequences of token hashes. Of equally long matches the one that is first in the
    document, then in the item, is taken. The length of the longest is found by halving, so
    a tile takes n log n steps however often tokens repeat."""
    used_d, used_i = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    hash_d, hash_i = Windows(doc), Windows(item)

    def match(n: int) -> tuple[int, int] | None:
        at_d, at_i = _free(used_d, n), _free(used_i, n)
        if not len(at_d) or not len(at_i):
            return None
        keys, first = np.unique(hash_i(n, at_i), return_index=True)
        h = hash_d(n, at_d)
        place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        for k in np.flatnonzero(keys[place] == h):
            i, j = int(at_d[k]), int(at_i[first[place[k]]])
            if np.array_equal(doc[i : i + n], item[j : j + n]):  # not only their hashes
                return i, j
        return None

    out = []
    most = min(len(doc), len(item))
    while most >= least and (best := match(least)):
        low, high = least, most  # there is a match of ``low``, none above ``high``
        while low < high:
            n = (low + high + 1) // 2
            if found := match(n):
                low, best = n, found
            else:
                high = n - 1
        out.append((*best, low))
        used_d[best[0] : best[0] + low] = True
        used_i[best[1] : best[1] + low] = True
        most = low
    return out


def tile(doc: np.ndarray, item: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """``tiles`` of a document and an item, by looking only at those parts of the document that share a seed."""
    n = min(min_tile, len(item))
    if not n or len(doc) < n:
        return []
    hit = np.isin(Windows(doc)(n), Windows(item)(n))
    if not hit.any():
        return []
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.flatnonzero(hit) + n, -1)
    at = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    # Parts are set apart by a token that no item has.
    ends = np.flatnonzero(np.diff(at) > 1) + 1
    at = np.insert(at, ends, -1)
    some = np.where(at >= 0, doc[at], 0)
    return [(int(at[i]), j, length) for i, j, length in tiles(some, np.where(item == 0, 1, item).astype(_U), n)]


def _telling(seeds: DataFrame, min_coverage: float) -> DataFrame:
    """Of the seeds (item, n_tokens, n, seed, starts, n_hits) of each item those that a document must have one of to hold a leak: item, seed.

    Tiles cover nothing but places of seeds that the document has. So the seeds that most documents have may be
    left out as long as all places of these together are too few for ``min_coverage``. An item's
    seeds are gathered in one row, which is as long as its text."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kept = [], []
            for row in map(dict, (zip(batch.schema.names, (c[k].as_py() for c in batch.columns), strict=True) for k in range(batch.num_rows))):
                covered, n_covered = bytearray(row["n_tokens"]), 0
                for k, seed in enumerate(row["found"]):
                    for start in seed["starts"]:
                        n_covered += row["n"] - sum(covered[start : start + row["n"]])
                        covered[start : start + row["n"]] = b"\1" * row["n"]
                    if n_covered >= min_coverage * row["n_tokens"]:
                        kept += [s["seed"] for s in row["found"][k:]]
                        keys += [row["item"]] * (len(row["found"]) - k)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(kept, pa.int64())], ["item", "seed"])

    found = F.sort_array(F.collect_list(F.struct("n_hits", "seed", "starts")), asc=False).alias("found")
    return seeds.groupBy("item", "n_tokens", "n").agg(found).mapInArrow(keep, "item binary, seed long")


def _pairs(hits: DataFrame, kept: DataFrame, often: DataFrame) -> DataFrame:
    """Documents and items (key, item) that share a seed of ``kept`` (item, seed); ``hits`` has key and seed, ``often`` seed and n_hits.
    A seed of many documents or items is split into parts of about PART of each, so what is
    copied for that is less than a PART-th of the pairs."""
    parts = kept.groupBy("seed").agg(F.count("*").alias("n_items")).join(often, "seed")
    parts = parts.select("seed", "n_hits", "n_items", F.ceil(F.col("n_hits") / PART).alias("key_parts"), F.ceil(F.col("n_items") / PART).alias("item_parts"))
    parts = materialize(parts, "parts")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = join_by_key(hits, parts, "seed", "n_hits").select("seed", "key", F.pmod(F.xxhash64("key"), "key_parts").alias("a"), each("item_parts").alias("b"))
    right = join_by_key(kept, parts, "seed", "n_items").select("seed", "item", each("key_parts").alias("a"), F.pmod(F.xxhash64("item"), "item_parts").alias("b"))
    return left.join(right, ["seed", "a", "b"]).select("key", "item").distinct()


LEAKS = "key binary, item_id {0}, item_tokens long, covered_tokens long, coverage double, tiles array<struct<doc_start:int,item_start:int,length:int>>"


def _leaks(keyed: DataFrame, benchmark: DataFrame, min_tile: int, min_coverage: float) -> DataFrame:
    """Leaks into the distinct documents of ``keyed`` (key, text), a row for each key and item."""
    attach(keyed.sparkSession)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().withColumn("item", row_key(F.col("item_id"), F.col("text")))

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            keys, n_token, n_seed, starts, seeds = [], [], [], [], [np.empty(0, _U)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = _ids(text.as_py(), words)
                if n := min(min_tile, len(ids)):
                    own, which, count = np.unique(Windows(ids)(n), return_inverse=True, return_counts=True)
                    seeds.append(own)
                    starts += np.split(np.argsort(which, kind="stable").astype(np.int32), np.cumsum(count)[:-1])
                    keys += [key] * len(own)
                    n_token += [len(ids)] * len(own)
                    n_seed += [n] * len(own)
            cols = [pa.array(keys, pa.binary()), pa.array(n_token, pa.int32()), pa.array(n_seed, pa.int32()), pa.array(np.concatenate(seeds).view(np.int64)), pa.array(starts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["item", "n_tokens", "n", "seed", "starts"])

    seeds = materialize(items.select("item", "text").mapInArrow(item_seeds, "item binary, n_tokens int, n int, seed long, starts array<int>"), "seeds")
    lengths = sorted(r[0] for r in seeds.select("n").distinct().collect())  # at most min_tile
    # A map of bits of fixed size tells most seeds that no item has; the join does the rest.
    place = F.pmod("seed", F.lit(MAP_BITS))
    marked = seeds.groupBy(F.floor(place / ROW_BITS).alias("row")).agg(F.call_function("bitmap_construct_agg", place % ROW_BITS).alias("bits"))
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for row, part in marked.collect():  # 4 MB at most
        bits[row * ROW_BITS // 8 : (row + 1) * ROW_BITS // 8] = np.frombuffer(part, np.uint8)
    shared = keyed.sparkSession.sparkContext.broadcast(bits)

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = _Words(), shared.value
        for batch in batches:
            keys, found = [], [np.empty(0, _U)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = _ids(text.as_py(), words)
                windows = Windows(ids)
                for n in lengths:
                    if n <= len(ids):
                        h = windows(n)
                        at = h & _U(MAP_BITS - 1)
                        found.append(np.unique(h[(known[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 > 0]))
                        keys += [key] * len(found[-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(found).view(np.int64))], ["key", "seed"])

    hits = materialize(keyed.mapInArrow(doc_seeds, "key binary, seed long").distinct(), "hits")
    often = hits.groupBy("seed").agg(F.count("*").alias("n_hits"))
    by_seed = materialize(seeds.groupBy("seed").agg(F.count("*").alias("n_items")).join(often, "seed"), "by-seed")
    kept = materialize(_telling(join_by_key(seeds, by_seed, "seed", "n_items"), min_coverage), "telling")
    pairs = materialize(_pairs(hits, kept, by_seed.drop("n_items")), "pairs")
    texts = flag_among(keyed, "key", pairs.select("key"), "able").where("able").select("key", "text").dropDuplicates(["key"])
    often = pairs.groupBy("item").agg(F.count("*").alias("n_pairs"))
    asked = join_by_key(pairs, items.withColumnRenamed("text", "item_text").join(often, "item"), "item", "n_pairs").select("key", "item_id", "item_text")

    tile_kind = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = _Words(), (None, np.empty(0, _U))
        for batch in batches:
            rows, keep = [], []
            for k, (key, text, item) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(3), strict=True)):
                if last[0] != key:
                    last = (key, _ids(text.as_py(), words))
                own = _ids(item.as_py(), words)
                got = tile(last[1], own, min_tile)
                covered = sum(t[2] for t in got)
                if covered and covered >= min_coverage * len(own):
                    keep.append(k)
                    rows.append((len(own), covered, covered / len(own), [dict(zip(("doc_start", "item_start", "length"), t, strict=True)) for t in got]))
            cols = [*zip(*rows, strict=True)] if rows else [[]] * 4
            own_cols = [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.float64(), tile_kind], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(2).take(pa.array(keep, pa.int64())), *own_cols], ["key", "item_id", "item_tokens", "covered_tokens", "coverage", "tiles"])

    found = materialize(texts.join(asked, "key").select("key", "text", "item_id", "item_text").mapInArrow(look, LEAKS.format(kind)), "leaks")
    drop(seeds, hits, by_seed, kept, pairs)
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row for each document (doc_id, text) and test item (item_id, text) of
    which tiles cover at least ``min_coverage``: doc_id, item_id, item_tokens, covered_tokens, coverage and
    tiles; positions are in tokens (``\\w+``, lower case). Null or empty texts and items match nothing; items shorter than
    ``min_tile`` must occur whole; repeated documents give repeated rows."""
    keyed = docs.where("text is not null").select("doc_id", "text").withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    found = _leaks(keyed.select("key", "text"), benchmark, min_tile, min_coverage)
    rows = flag_among(keyed.select("key", "doc_id"), "key", found.select("key"), "able").where("able").select("key", "doc_id")
    return rows.join(found, "key").drop("key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The documents that no test item leaked into, rows and columns as they are."""
    cols = docs.columns
    key, flag = spare(cols, "key"), spare(cols, "flag")
    keyed = docs.withColumn(key, F.when(F.col("text").isNotNull(), row_key(F.col("doc_id"), F.col("text"))))
    found = _leaks(keyed.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "text"), benchmark, min_tile, min_coverage)
    leaked = found.select(F.col("key").alias(key)).distinct()
    marked = flag_among(keyed, key, leaked, flag)
    clean = marked.where(F.col(flag)).join(leaked, key, "left_anti")
    return marked.where(~F.col(flag)).select(*cols).unionByName(clean.select(*cols))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_tokens", "covered_tokens", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"))
