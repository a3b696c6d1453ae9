"""Exact cosine search that skips what can't be among the nearest.

Vectors of unit length are laid out by the nearest of a few centroids, in blocks by their distance from it.
If a query has distance D from a centroid and k vectors within T of itself, then by the triangle
inequality any vector nearer than T has a distance between D - T and D + T from that centroid: blocks outside of
that ring are not multiplied, and cells whose whole ring lies outside not read. Queries come in
blocks too, as a table that is joined with the blocks of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import attach, materialize, new_path
from .search import _matrix, _top, _unit

#: Bytes of vectors in a block, and queries in one.
BLOCK_BYTES, QUERIES = 1 << 22, 128
#: Centroids are fitted on at most so many vectors for each, in so many rounds. Where they lie decides what is skipped, never a result.
SAMPLE, ROUNDS = 64, 8
#: Distances are rounded; bounds are wider by this.
SLACK = 1e-6


@dataclass(frozen=True)
class Layout:
    """``blocks``: (cell, low, high, ids, vectors), the distances from the centroid in each block; ``inner``, ``outer`` and ``sizes``: least and
    greatest distance and number of vectors of each cell. The last cell holds vectors of zeros, which are near nothing."""

    blocks: DataFrame
    centroids: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    sizes: np.ndarray


def _centroids(sample: np.ndarray, cells: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    sample = np.unique(sample[np.linalg.norm(sample, axis=1) > 0], axis=0)
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    now = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ now.T, axis=1)
        sums = np.zeros_like(now)
        np.add.at(sums, nearest, sample)
        now = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), now)
    return now


def _away(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from centroids."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * vectors @ centroids.T))


def lay_out(index: DataFrame, cells: int = 256, seed: int = 0) -> Layout:
    """Write the vectors of ``index`` (chunk_id, vector; null vectors are left out) by cells, as a table.

    Centroids come from a sample of about ``SAMPLE`` vectors for each of the ``cells``, whatever the size of the index; every
    vector is laid out. Blocks are cut after sorting by cell and distance, so a cell that holds most vectors
    lies in as many tasks as it needs."""
    spark = index.sparkSession
    attach(spark)
    rows = index.where("vector is not null").select("chunk_id", "vector")
    n, least, most = rows.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if least != most:
        raise ValueError("vectors of several lengths")
    id_type, dimension = rows.schema["chunk_id"].dataType, most or 0
    share = min(1.0, 2.0 * SAMPLE * cells / max(n, 1))
    picked = rows.select("vector") if share == 1 else rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector")
    sample = picked.limit(2 * SAMPLE * cells).toArrow().column(0).combine_chunks()
    centroids = _centroids(_unit(_matrix(sample, dimension)), cells, seed) if n else np.zeros((0, dimension))
    known = spark.sparkContext.broadcast(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unit(_matrix(batch.column(1), dimension))
            cell, away = np.full(len(units), len(known.value), np.int32), np.zeros(len(units))
            some = np.linalg.norm(units, axis=1) > 0
            if some.any():
                far = _away(units[some], known.value)
                cell[some] = np.argmin(far, axis=1)
                away[some] = far.min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(away), batch.column(0), batch.column(1)], ["cell", "away", "chunk_id", "vector"])

    kind = index.schema["vector"].dataType.simpleString()
    id_arrow, element = to_arrow_type(id_type), to_arrow_type(index.schema["vector"].dataType).value_type
    most_rows = max(1, BLOCK_BYTES // (8 * max(dimension, 1)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            away, ids, flat = rows.column("away").to_numpy(), rows.column("chunk_id").combine_chunks(), rows.column("vector").combine_chunks().flatten()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids.cast(id_arrow), flat.cast(element))]
            return pa.RecordBatch.from_arrays([pa.array([rows.column("cell")[0].as_py()], pa.int32()), pa.array([away.min()]), pa.array([away.max()]), *lists], ["cell", "low", "high", "ids", "vectors"])

        for batch in batches:
            cell = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if held and held[0].column(0)[0].as_py() != cell[a]:
                        yield block()
                        held = []
                    take = min(b - a, most_rows - sum(len(h) for h in held))
                    held.append(batch.slice(a, take))
                    a += take
                    if sum(len(h) for h in held) >= most_rows:
                        yield block()
                        held = []
        if held:
            yield block()

    placed = materialize(rows.mapInArrow(place, f"cell int, away double, chunk_id {id_type.simpleString()}, vector {kind}"), "placed")
    sorted_rows = placed.repartitionByRange("cell", "away").sortWithinPartitions("cell", "away")
    blocks = sorted_rows.mapInArrow(pack, f"cell int, low double, high double, ids array<{id_type.simpleString()}>, vectors {kind}")
    path = new_path(spark, "layout")
    blocks.write.partitionBy("cell").parquet(path)  # a cell that nobody asks for is not read
    schema = blocks.select(*[c for c in blocks.columns if c != "cell"], "cell").schema
    laid = spark.read.schema(schema).parquet(path) if n else spark.createDataFrame([], schema)
    inner, outer, sizes = np.full(len(centroids) + 1, np.inf), np.full(len(centroids) + 1, -np.inf), np.zeros(len(centroids) + 1, np.int64)
    for cell, low, high, size in laid.groupBy("cell").agg(F.min("low"), F.max("high"), F.sum(F.size("ids"))).collect():  # at most cells + 1 rows
        inner[cell], outer[cell], sizes[cell] = low, high, size
    return Layout(laid, centroids, inner, outer, sizes)


def _asked(layout: Layout, k: int, first: bool):
    """Blocks of queries (query_id, vector, reach) with the cells that they need: (cell, low, high, names, matrix, reach). In
    the first round the nearest cells that hold ``k`` vectors, else all that ``reach`` touches; a null reach touches everything."""
    centroids, inner, outer, sizes = layout.centroids, layout.inner, layout.outer, layout.sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                matrix = _unit(_matrix(part.column(1), centroids.shape[1]))
                zero = ~(np.linalg.norm(matrix, axis=1) > 0)
                far = _away(matrix, centroids)
                need = np.zeros((len(part), len(sizes)), bool)
                low, high = np.full(len(sizes), -np.inf), np.full(len(sizes), np.inf)
                if first:
                    order = np.argsort(far, axis=1)
                    held = np.cumsum(sizes[order], axis=1)
                    for q in range(len(part)):
                        need[q, order[q, : np.searchsorted(held[q], k) + 1]] = True
                else:
                    reach = np.where(zero, np.inf, part.column(2).fill_null(np.inf).to_numpy(zero_copy_only=False)) + SLACK
                    need[:, :-1] = (far - reach[:, None] <= outer[:-1]) & (far + reach[:, None] >= inner[:-1])
                    # Vectors of zeros score 0, which is a distance of the square root of 2.
                    need[:, -1] = reach >= np.sqrt(2.0)
                    low[:-1] = np.where(need[:, :-1], far - reach[:, None], np.inf).min(axis=0)
                    high[:-1] = np.where(need[:, :-1], far + reach[:, None], -np.inf).max(axis=0)
                cells = np.flatnonzero(need.any(axis=0) & (sizes > 0))
                for cell in cells.tolist():  # each cell gets only the queries that need it
                    own = np.flatnonzero(need[:, cell])
                    lists = [part.column(0).take(pa.array(own)), pa.array(matrix[own].ravel())]
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([low[cell]]), pa.array([high[cell]]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)], ["cell", "low", "high", "names", "matrix"])

    return run


def _pairs(queries: DataFrame, layout: Layout, k: int, first: bool) -> DataFrame:
    """Blocks of queries joined with the blocks of vectors that they have to be multiplied with."""
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.mapInArrow(_asked(layout, k, first), f"cell int, low double, high double, names array<{kind}>, matrix array<double>")
    asked = materialize(asked, "asked")
    cells = [r[0] for r in asked.select("cell").distinct().collect()]  # at most as many as there are centroids
    blocks = layout.blocks.where(F.col("cell").isin(cells)).withColumnsRenamed({"low": "from", "high": "to"})
    return blocks.join(asked, "cell").where((F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from"))).select("ids", "vectors", "names", "matrix")


def _multiply(k: int, query_type: pa.DataType, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ids, flat, names, matrix = (c[n].values for c in batch.columns)
                units = matrix.to_numpy().reshape(len(names), -1)
                vectors = _unit(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
                scores = units @ vectors.T
                least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else np.full((len(names), 1), -np.inf)
                q, row = np.nonzero(scores >= least)
                best = _top(pa.table({"q": q, "score": scores[q, row], "id": ids.take(pa.array(row))}), k)
                if len(best):
                    yield from pa.table([names.take(best.column("q").combine_chunks()).cast(query_type), best.column("id").cast(id_type), best.column("score")], names=["query_id", "chunk_id", "score"]).to_batches()

    return run


def _best_of(pairs: DataFrame, k: int, query_kind, id_kind) -> DataFrame:
    schema = f"query_id {query_kind.simpleString()}, chunk_id {id_kind.simpleString()}, score double"
    found = pairs.mapInArrow(_multiply(k, to_arrow_type(query_kind), to_arrow_type(id_kind)), schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_in(queries: DataFrame, layout: Layout, k: int) -> DataFrame:
    """``search.nearest`` over a layout: (query_id, chunk_id, score, rank), the same rows whatever is skipped. The first round looks into each
    query's nearest cells for how far its k-th vector is at most, the second one into all blocks within that reach. Query ids have to differ."""
    spark = queries.sparkSession
    attach(spark)
    query_kind, id_kind = queries.schema["query_id"].dataType, layout.blocks.schema["ids"].dataType.elementType
    rows = queries.where("query_id is not null and vector is not null").select("query_id", "vector")
    if not len(layout.centroids) and not layout.sizes.sum():
        return spark.createDataFrame([], f"query_id {query_kind.simpleString()}, chunk_id {id_kind.simpleString()}, score double, rank int")
    near = _best_of(_pairs(rows.withColumn("reach", F.lit(None).cast("double")), layout, k, True), k, query_kind, id_kind)
    reach = near.where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("score"))).alias("reach"))
    asking = materialize(rows.join(reach, "query_id", "left"), "reach")
    return _best_of(_pairs(asking, layout, k, False), k, query_kind, id_kind)
