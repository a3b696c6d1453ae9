"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, drop, materialize

#: Nodes that a task holds at once.
_HELD = 1 << 18


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as stars around the smallest nodes, as far as those that a task holds at once show it."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (j := root.setdefault(i, i)) != i:
            root[i] = i = root[j]
        return i

    def stars() -> pa.RecordBatch:
        ends = [(find(n), n) for n in list(root)]
        a, b = zip(*ends, strict=True) if ends else ((), ())
        both = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        return both.filter(pa.array([x != y for x, y in ends], pa.bool_()))

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            i, j = find(x), find(y)
            root[max(i, j)] = min(i, j)
        if len(root) > _HELD:
            yield stars()
            root.clear()
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; longs), root being the
    component's smallest node.

    Each task makes stars of its own edges first. Large-star and small-star steps in turn, until the edges are stars, each with its
    smallest node in the middle: each node's larger neighbours are hung below its smallest one,
    then its smaller ones. Every step is joins and aggregates over the edges and ends in a table."""
    attach(edges.sparkSession)
    now = materialize(edges.where("a <> b").select("a", "b").mapInArrow(_stars, "a long, b long").distinct(), "edges")
    while True:
        ends = now.select(F.col("a").alias("node"), F.lit(0).alias("below")).unionByName(now.select(F.col("b").alias("node"), F.lit(1).alias("below")))
        loose = ends.groupBy("node").agg(F.sum("below").alias("below"), F.count("*").alias("n")).where("below > 0 and n > 1")
        if loose.isEmpty():  # a node below another one has no other edge
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = now.withColumnsRenamed({"a": "u", "b": "v"}).join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(low, "b")
        small = hung.where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
        old = now
        now = materialize(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
        drop(old)
