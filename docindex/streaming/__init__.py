"""Continuous ingest: pages that come, change or vanish become versions of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_documents, to_chunks
from ..operators.embed import EmbedFn, embed_chunks
from ..operators.html import clean_html, drop_empty
from ..operators.index import append_to_index, index_exists, write_index


def store_pages(batch: DataFrame, number: int, path: str, embed_fn: EmbedFn, stream: str, html_col: str = "html", key_col: str = "path", gone: Column | None = None, order: Column | None = None) -> None:
    """Put a batch of pages into the index at ``path`` in the place of what it has of them, as one version that
    carries the batch's number: a batch that runs again, also after it failed half-way or its progress was lost, changes
    nothing. Pages where ``gone`` holds, and those without any text, leave nothing in the index. Of rows with one key the last by ``order`` counts."""
    if order is not None:
        last = W.partitionBy(key_col).orderBy(order.desc())
        batch = batch.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")
    live = batch if gone is None else batch.where(~F.coalesce(gone, F.lit(False)))
    good, _ = drop_empty(clean_html(live, html_col, key_col))
    chunks = embed_chunks(to_chunks(chunk_documents(good), "chm", F.col("source_file")), embed_fn)
    sources = batch.select(F.lit("chm").alias("source_type"), F.col(key_col).alias("source_key"))
    if index_exists(batch.sparkSession, path):
        append_to_index(chunks, path, "replace", sources, (stream, number))
    else:
        write_index(chunks, path, {stream: number})


def ingest_pages(pages: DataFrame, path: str, checkpoint: str, embed_fn: EmbedFn, html_col: str = "html", key_col: str = "path", gone: Column | None = None, order: Column | None = None) -> StreamingQuery:
    """Clean, chunk and embed pages of a stream (path, html) and put them into the index at ``path``, batch by batch
    (see ``store_pages``). ``gone`` marks tombstones: rows that say that a page is no more. Only one batch's keys are
    compared with each other: no state is kept. The stream is known to the index by the folder of its checkpoint."""

    def store(batch: DataFrame, number: int) -> None:
        store_pages(batch.persist(), number, path, embed_fn, checkpoint.rstrip("/"), html_col, key_col, gone, order)
        batch.unpersist()

    return pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
