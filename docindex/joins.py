"""Joins that survive a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys can be hot, so the list of them may be broadcast.
MOST_HOT = 1000


def join_by_key(rows: DataFrame, by_key: DataFrame, key: str, count: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join ``rows`` with ``by_key``, which has one row per key and in ``count``
    how many rows of ``rows`` have that key.

    A key counts as hot if it has more than one in MOST_HOT of the rows that
    ``count`` adds up to: fewer than MOST_HOT keys can, so these are broadcast
    and their rows stay where they are. The others are shuffled; none of them
    has more than that share of the rows. ``how`` is ``inner`` or ``left``. ``counts`` has the keys and counts where
    ``by_key`` is costly to make, as it is read once more for each question; ``by_key`` then needs no counts."""
    spark = rows.sparkSession
    counts = by_key if counts is None else counts
    total = counts.agg(F.sum(count)).first()[0] or 0
    least = max(1000, total // MOST_HOT)
    hot = counts.where(F.col(count) > least).select(key).toArrow()  # a list of keys would go through Python workers of another kind, which stay beside those of the tasks
    if not hot.num_rows:
        return rows.join(by_key, key, how)
    names = spark.createDataFrame(hot, by_key.select(key).schema)
    is_hot = F.broadcast(names.withColumn("_hot", F.lit(True)))
    marked = rows.join(is_hot, key, "left")
    few = F.broadcast(by_key.join(F.broadcast(names), key, "left_semi"))
    out = marked.where("_hot").drop("_hot").join(few, key, how)
    return out.unionByName(marked.where("_hot is null").drop("_hot").join(by_key, key, how))


def spare(columns: list[str], name: str) -> str:
    """``name``, or something longer if ``columns`` has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
