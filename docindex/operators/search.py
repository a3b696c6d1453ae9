"""Exact cosine search for many queries at once, with metadata filters.

Queries go to the vectors, in blocks of bounded size: each task multiplies its
vectors with a block of queries, a bounded number of scores at a time, and keeps the best k of each,
so that only k rows for each query and task are shuffled to be merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import attach, materialize

#: Bytes of query vectors that one pass over the index broadcasts.
BLOCK_BYTES = 64_000_000
#: Scores that a task holds at once.
CELLS = 4_000_000


def l2_normalize(vector: Column | str) -> Column:
    """To unit length; a zero vector stays as it is."""
    v = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def apply_filters(index: DataFrame, filters: dict[str, Any] | None) -> DataFrame:
    """Rows that meet all filters: a list asks for any of its values, anything else
    for that value, None for null. A column the index lacks is null everywhere."""
    for key, value in (filters or {}).items():
        col = F.col(key) if key in index.columns else F.lit(None)
        if isinstance(value, list | tuple | set):
            some = [v for v in value if v is not None]
            ok = col.isin(some) if some else F.lit(False)
            index = index.where(F.coalesce(ok, F.lit(False)) | (col.isNull() if None in value else F.lit(False)))
        else:
            index = index.where(col.isNull() if value is None else col == F.lit(value))
    return index


def source_filter(source: str | None) -> dict[str, Any]:
    """The filter for one kind of source; None or "all" is no filter."""
    if source in (None, "all"):
        return {}
    if source not in ("chm", "demo"):
        raise ValueError(f"no source {source!r}")
    return {"source_type": source}


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=m.copy(), where=norm > 0)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dimension:
        raise ValueError(f"vectors that aren't of {dimension} numbers")
    return flat.reshape(-1, dimension)


def _top(pool: pa.Table, k: int) -> pa.Table:
    """Of rows (q, score, id) the best k of each q, ties by id."""
    pool = pool.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
    q = pool.column("q").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return pool.filter(pa.array(rank < k))


def _best(queries: np.ndarray, names: list, k: int, query_type: pa.DataType, id_type: pa.DataType):
    """A task's best k for each query, ties by id. At most CELLS scores are held at once."""
    units = _unit(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(names), -np.inf)  # no score below is among the best any more
        schema = pa.schema([("q", pa.int64()), ("score", pa.float64()), ("id", id_type)])
        pool, size, kept = [schema.empty_table()], 0, 0
        for batch in batches:
            if not len(batch):
                continue
            vectors = _unit(_matrix(batch.column(1), queries.shape[1]))
            step = max(1, CELLS // len(batch))
            for at in range(0, len(names), step):
                scores = units[at : at + step] @ vectors.T
                if len(batch) > k:
                    least[at : at + step] = np.maximum(least[at : at + step], np.partition(scores, len(batch) - k, axis=1)[:, len(batch) - k])
                q, row = np.nonzero(scores >= least[at : at + step, None])
                pool.append(pa.table([pa.array(q + at), pa.array(scores[q, row]), batch.column(0).take(pa.array(row))], schema=schema))
                size += len(q)
            if size > 2 * kept + CELLS // 16:
                pool = [_top(pa.concat_tables(pool).combine_chunks(), k)]
                size = kept = len(pool[0])
                full, n = np.unique(pool[0].column("q").to_numpy(), return_counts=True)
                last = np.cumsum(n) - 1
                least[full[n == k]] = pool[0].column("score").to_numpy()[last[n == k]]
        best = _top(pa.concat_tables(pool).combine_chunks(), k)
        if len(best):
            ids = pa.array(names, query_type).take(best.column("q").combine_chunks())
            yield from pa.table([ids, best.column("id"), best.column("score")], names=["query_id", "chunk_id", "score"]).to_batches()

    return run


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray, int]]:
    """Query ids and vectors, one block after the other on the driver, and how many there are."""
    rows = queries.where("query_id is not null and vector is not null").select("query_id", "vector")
    n, size = rows.agg(F.count("*"), F.sum(F.size("vector") * 8)).first()
    blocks = -(-(size or 0) // BLOCK_BYTES)
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = part.collect()
        if got:
            yield [r[0] for r in got], np.array([r[1] for r in got], np.float64), blocks


def nearest(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k nearest by cosine, ties by chunk_id.
    Queries (query_id, vector) of one dimension; vectors of the index have to agree.
    Fewer than k are found only if the index is smaller; null vectors are in no result."""
    spark = index.sparkSession
    attach(spark)
    id_kind, query_kind = index.schema["chunk_id"].dataType, queries.schema["query_id"].dataType
    schema = f"query_id {query_kind.simpleString()}, chunk_id {id_kind.simpleString()}, score double"
    vectors = index.where("vector is not null").select("chunk_id", "vector")
    found = None
    for names, matrix, blocks in _blocks(queries):
        part = vectors.mapInArrow(_best(matrix, names, k, to_arrow_type(query_kind), to_arrow_type(id_kind)), schema)
        if blocks > 1:  # a block runs before the next one comes, so that the driver holds one at a time
            part = materialize(part, "nearest")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: DataFrame, k: int, filters: dict[str, Any] | None = None, source: str | None = None, filter_mode: str = "exact", overfetch: int = 3) -> DataFrame:
    """(query_id, chunk_id, score, rank) with the index's other columns.

    ``exact`` filters first and finds the k nearest of what is left; ``post`` finds
    ``overfetch`` times k (k without filters), then filters, and may end with fewer.
    Contents are joined to the winners only."""
    wanted = {**(filters or {}), **source_filter(source)}
    others = index.drop("vector")
    order = W.partitionBy("query_id").orderBy("rank")
    if filter_mode == "exact":
        return nearest(queries, apply_filters(index, wanted), k).join(others, "chunk_id").select("query_id", "chunk_id", "score", "rank", *[c for c in others.columns if c != "chunk_id"])
    if filter_mode != "post":
        raise ValueError(f"no filter mode {filter_mode!r}")
    found = nearest(queries, index, k * overfetch if wanted else k).join(others, "chunk_id")
    kept = apply_filters(found, wanted).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return kept.select("query_id", "chunk_id", "score", "rank", *[c for c in others.columns if c != "chunk_id"])


def citations(results: DataFrame) -> DataFrame:
    """(query_id, rank, label, score, symbol, file) to show: score with four decimals,
    at most 20 characters of symbol, of long files the last 32."""
    filled = lambda c: F.nullif(c, F.lit(""))
    file = F.coalesce(filled("file_path"), filled("chapter"), "source_file", F.lit("-"))
    short = F.when(F.length(file) > 35, F.concat(F.lit("..."), F.right(file, F.lit(32)))).otherwise(file)
    label = F.when(F.coalesce("source_type", F.lit("chm")) == "chm", F.lit("CHM")).otherwise(F.lit("Demo"))
    return results.select("query_id", "rank", label.alias("label"), F.format_string("%.4f", "score").alias("score"), F.substring(F.coalesce("symbol", F.lit("-")), 1, 20).alias("symbol"), short.alias("file"))
