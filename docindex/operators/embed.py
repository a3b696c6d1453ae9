"""Embedding in batches through a function that is passed in."""

from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_embed_text
from ..joins import join_by_key, spare
from ..session import attach, names_in, new_path

#: From texts to an array with a row of floats for each.
EmbedFn = Callable[[list[str]], np.ndarray]


def hashing_embedder(dimension: int = 64) -> EmbedFn:
    """Feature hashing: each word adds 1 or -1 to one place. Deterministic and
    free of models, for tests and as a stand-in."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % dimension] += 1 if h & 0x10000 else -1
        return out

    return embed


def _attempt(embed: EmbedFn, texts: list[str], retries: int, backoff: float) -> np.ndarray:
    for n in range(1, retries + 1):
        try:
            got = np.asarray(embed(texts), np.float32)
            break
        except Exception:
            if n == retries:
                raise
            time.sleep(backoff * n)
    if got.ndim != 2 or len(got) != len(texts):
        raise ValueError(f"{len(texts)} texts have an embedding of shape {got.shape}")
    return got


def _embedder(embed_fn: EmbedFn, batch_size: int, max_retries: int, backoff: float, names: list[str]):
    """The last column's texts in the place of a ``vector``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.slice(at, batch_size)
                vectors = _attempt(embed_fn, part.column(part.num_columns - 1).to_pylist(), max_retries, backoff)
                flat = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * vectors.shape[1], pa.array(vectors.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], flat], names)

    return run


_VECTOR = T.StructField("vector", T.ArrayType(T.FloatType()))


def embed_chunks(df: DataFrame, embed_fn: EmbedFn, batch_size: int = 100, max_retries: int = 3, backoff: float = 1.0, text_col: str = "content", max_chars: int = 15_000) -> DataFrame:
    """Add ``vector`` to each row, from the cleaned text of ``text_col``; rows stay in
    their order and place. Null texts are embedded as empty ones; a column of that name gives way. A batch that fails
    is tried again after 1, 2, … times ``backoff`` seconds, and fails the task after
    ``max_retries``."""
    attach(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name.lower() != "vector"]
    text = spare(df.columns, "text_to_embed")
    rows = df.select(*(F.col(f"`{f.name}`") for f in kept), F.coalesce(clean_embed_text(text_col, max_chars), F.lit("")).alias(text))
    return rows.mapInArrow(_embedder(embed_fn, batch_size, max_retries, backoff, [*(f.name for f in kept), "vector"]), T.StructType([*kept, _VECTOR]))


def embed_distinct(df: DataFrame, embed_fn: EmbedFn, store: str | None = None, batch_size: int = 100, max_retries: int = 3, backoff: float = 1.0, text_col: str = "content", max_chars: int = 15_000) -> DataFrame:
    """``embed_chunks`` that gives each distinct cleaned text to ``embed_fn`` once.

    Texts are told apart by a digest of 256 bits. Vectors are written before they are joined, so that no later step and no lost executor makes them anew; in the folder
    ``store`` (one for each model) they stay for later calls, and only texts that it lacks are embedded. Rows move to
    their vectors by the digest alone, those of very common texts not at all."""
    spark = df.sparkSession
    attach(spark)
    kept = [c for c in df.columns if c.lower() != "vector"]
    digest, row = (spare([*df.columns, "vector"], n) for n in ("text_digest", "embedded_row"))
    text = F.coalesce(clean_embed_text(text_col, max_chars), F.lit(""))
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias(row), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias(digest))
    texts = keyed.groupBy(digest).agg(F.first("text").alias("text"), F.count("*").alias("n"))
    folder = store.rstrip("/") if store else new_path(spark, "vectors")
    kind = T.StructType([T.StructField(digest, T.BinaryType()), _VECTOR])
    stored = T.StructType([T.StructField("digest", T.BinaryType()), _VECTOR])
    have = [f"{folder}/{n}" for n in names_in(spark, folder) if n.startswith("part-") and "_SUCCESS" in names_in(spark, f"{folder}/{n}")]
    known = spark.read.schema(stored).parquet(*have).withColumnRenamed("digest", digest) if have else spark.createDataFrame([], kind)
    new = texts.join(known.select(digest), digest, "left_anti").select(digest, "text")
    made = new.repartition(digest).mapInArrow(_embedder(embed_fn, batch_size, max_retries, backoff, [digest, "vector"]), kind)
    at = f"{folder}/part-{uuid.uuid4().hex}"
    made.withColumnRenamed(digest, "digest").write.parquet(at)
    every = spark.read.schema(stored).parquet(*have, at).withColumnRenamed("digest", digest).dropDuplicates([digest])
    counted = texts.select(digest, "n").join(every, digest)
    return join_by_key(keyed.select(row, digest), counted, digest, "n").select(*(F.col(f"{row}.`{c}`") for c in kept), "vector")


def embed_queries(df: DataFrame, embed_fn: EmbedFn, text_col: str = "question", **options) -> DataFrame:
    return embed_chunks(df, embed_fn, text_col=text_col, **options)


def check_dimension(df: DataFrame, dimension: int, vector_col: str = "vector") -> DataFrame:
    """The rows whose vectors have another length; none, if all is well."""
    return df.where(F.coalesce(F.size(vector_col) != dimension, F.lit(True)))
