"""The training-data pipeline: stages from documents to packed sequences, each
written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docindex.llm import decontam, ngram_join, packing, secrets, toxicity
from docindex.llm.common import load, new_path, spare

#: Bytes of texts and their columns in one Arrow batch. Stages follow each other on the same executors, which
#: keep what their largest batches took, in Python and outside the heap.
BATCH = "1m"


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch in the session, unless it has a bound of its own."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that score as toxic. The model is fitted on the
    labelled ones among ``docs``."""
    bound_batches(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), load(spark, sf_dir, "labels"))
    score, sentences = spare(docs.columns, "score"), spare(docs.columns, "sentences")
    return toxicity.score_toxicity(docs, model, "text", score, sentences).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by shingle similarity."""
    bound_batches(spark)
    return ngram_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a test item."""
    bound_batches(spark)
    return decontam.drop_leaks(docs, load(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    bound_batches(spark)
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut documents into token pieces and give these their places in sequences."""
    bound_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Models, components and token ids are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
