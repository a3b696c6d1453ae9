"""What the operators of this subpackage share: reading tables, tables that
outlive executors, row keys and joins that survive a hot key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import MOST_HOT, join_by_key, spare  # noqa: F401
from ..session import attach, brief_shuffles, drop, load_table, materialize, new_path, shared_dir  # noqa: F401

#: Rows of text per Arrow batch of the queries.
TEXT_BATCH = 1000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, for the queries and the pipeline; operators take any table. Where the session has
    no bound of its own on the rows of an Arrow batch, it gets one: with Spark's 10,000 texts a batch
    two Python workers and their buffers took an executor of 3 GB beyond its memory."""
    bound = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(bound) == "10000":  # Spark's own value
        spark.conf.set(bound, str(TEXT_BATCH))
    return load_table(spark, sf_dir, table)


def row_key(*cols: Column) -> Column:
    """A digest of several columns that tells nulls from empty strings, to join
    rows back together where ids may be null or repeat."""
    parts = [F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.md5(c.cast("string")))) for c in cols]
    return F.unhex(F.md5(F.concat_ws("", *parts)))


#: Bits of the map that ``flag_among`` broadcasts, at most 4 MB, and of one of its rows (Spark's own size).
MAP_BITS, ROW_BITS = 1 << 25, 1 << 15


def map_of_bits(ids: DataFrame, column: str) -> np.ndarray:
    """A map of MAP_BITS bits, of which those are set that numbers in ``column`` have as their lowest bits; 4 MB whatever the input."""
    place = F.pmod(column, F.lit(MAP_BITS))
    marked = ids.where(F.col(column).isNotNull()).groupBy(F.floor(place / ROW_BITS).alias("row")).agg(F.call_function("bitmap_construct_agg", place % ROW_BITS).alias("bits"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for row, part in marked.collect():
        out[row * ROW_BITS // 8 : (row + 1) * ROW_BITS // 8] = np.frombuffer(part, np.uint8)
    return out


def flag_among(df: DataFrame, column: str, ids: DataFrame, flag: str) -> DataFrame:
    """Add ``flag``: true for every row of ``df`` whose ``column`` is among ``ids`` (one column of
    that name) and for few others; rows with the flag still have to be joined. It saves
    moving rows that can't have a partner. The map of bits that is broadcast is of fixed size, so with
    very many ids more rows get the flag; none is ever missed."""
    row, place, bits = (spare([*df.columns, flag], n) for n in ("map_row", "map_place", "map_bits"))
    at = F.pmod(F.xxhash64(column), F.lit(MAP_BITS))
    marked = ids.where(F.col(column).isNotNull()).select(F.floor(at / ROW_BITS).alias(row), (at % ROW_BITS).alias(place))
    marked = marked.groupBy(row).agg(F.call_function("bitmap_construct_agg", F.col(place)).alias(bits))
    out = df.withColumn(row, F.floor(at / ROW_BITS)).withColumn(place, (at % ROW_BITS).cast("int")).join(F.broadcast(marked), row, "left")
    byte = F.conv(F.hex(F.substring(bits, (F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, F.col(place) % 8) == 1
    return out.withColumn(flag, F.coalesce(is_set, F.lit(False))).drop(row, place, bits)
