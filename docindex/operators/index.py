"""The index: chunks with vectors as Parquet, in snapshots.

Files are never changed. A write puts new files beside the old ones, by source type and bucket of
the source's key, and then names a new version: a small file that says which parts of which writes make up the
index, with its columns, dimension and count. It appears by an atomic rename, so a reader sees one version whole, a
write that stops half-way has changed nothing, and of two writers at once one is told so.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, names_in, read_file, remove, write_file_once

#: Parts of each source type. What an index was written with has to stay.
BUCKETS = 256
#: Times that an append is put onto a version that another writer has named meanwhile.
TRIES = 5


class NoIndexError(FileNotFoundError):
    """There is no index at a path, or no such version of it."""


class ChangedError(RuntimeError):
    """Another writer has named a version meanwhile."""


@dataclass(frozen=True)
class Version:
    """``parts``: (source_type, bucket, folder below the table, rows), at most BUCKETS of each source type for each
    write that is still in use. ``marks``: the last batch of each stream that is in it."""

    number: int
    dimension: int | None
    schema: T.StructType
    parts: tuple[tuple[str | None, int, str, int], ...]
    marks: dict[str, int]

    @property
    def count(self) -> int:
        return sum(p[3] for p in self.parts)


def _table(path: str) -> str:
    return f"{path.rstrip('/')}/chunks"


def _versions(path: str) -> str:
    return f"{path.rstrip('/')}/versions"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n) for n in names_in(spark, _versions(path)) if n.isdigit()]


def current_version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The last version of the index at ``path``, or that of a number; NoIndexError if there is none."""
    numbers = _numbers(spark, path)
    if not numbers or number is not None and number not in numbers:
        raise NoIndexError(f"[PATH_NOT_FOUND] no index{'' if number is None else f' of version {number}'} at {path}")
    number = numbers[-1] if number is None else number
    said = json.loads(read_file(spark, f"{_versions(path)}/{number:012}"))
    return Version(number, said["dimension"], T.StructType.fromJson(said["schema"]), tuple(map(tuple, said["parts"])), said["marks"])


def index_exists(spark: SparkSession, path: str) -> bool:
    return bool(_numbers(spark, path))


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    said = {"dimension": version.dimension if version.count else None, "schema": json.loads(version.schema.json()), "parts": version.parts, "marks": version.marks}
    if not write_file_once(spark, f"{_versions(path)}/{version.number:012}", json.dumps(said)):
        raise ChangedError(f"version {version.number} of {path} exists")


def _bucketed(df: DataFrame) -> DataFrame:
    key = "source_key" if "source_key" in df.columns else "chunk_id"
    return df.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int"))


def _write(df: DataFrame, path: str) -> tuple[tuple, int | None]:
    """Put rows into a folder of their own, those of a bucket together in as many files as they need; the
    parts made, and the dimension of the vectors."""
    spark, folder = df.sparkSession, f"write={uuid.uuid4().hex}"
    _bucketed(df).hint("rebalance", "source_type", "bucket").write.partitionBy("source_type", "bucket").parquet(f"{_table(path)}/{folder}")
    shape = T.StructType([f for f in df.schema.fields if f.name != "source_type"] + [T.StructField("source_type", T.StringType()), T.StructField("bucket", T.IntegerType())])
    made = spark.read.schema(shape).option("basePath", f"{_table(path)}/{folder}").parquet(f"{_table(path)}/{folder}")
    inside = F.regexp_extract(F.col("_metadata.file_path"), f"({folder}/[^/]+/[^/]+)/[^/]+$", 1)
    got = made.groupBy("source_type", "bucket", inside.alias("folder")).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).collect()  # a row for each part
    return tuple((r[0], r[1], r[2], r[3]) for r in got), max((r[4] for r in got if r[4] is not None), default=None)


def write_index(df: DataFrame, path: str, marks: dict[str, int] | None = None) -> None:
    """Replace the index by ``df``, as its next version."""
    parts, dimension = _write(df, path)
    numbers = _numbers(df.sparkSession, path)
    _commit(df.sparkSession, path, Version(numbers[-1] + 1 if numbers else 1, dimension, df.schema, parts, marks or {}))


def _read(spark: SparkSession, path: str, version: Version, parts: list | tuple | None = None) -> DataFrame:
    """The rows of a version, or of some of its parts, with their bucket."""
    names = [f.name for f in version.schema.fields]
    parts = version.parts if parts is None else parts
    shape = T.StructType([f for f in version.schema.fields if f.name != "source_type"] + [T.StructField("source_type", T.StringType()), T.StructField("bucket", T.IntegerType())])
    if not parts:
        return spark.createDataFrame([], shape).select(*names, "bucket")
    out = spark.read.schema(shape).option("basePath", _table(path)).parquet(*(f"{_table(path)}/{p[2]}" for p in parts))
    return out.select(*names, "bucket")


def load_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The index at ``path`` in its last version or that of a number, whatever is written meanwhile; an error if there is none."""
    return _read(spark, path, current_version(spark, path, version)).drop("bucket")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    now = current_version(spark, path)
    return spark.createDataFrame([(now.dimension if now.count else None, now.count)], "dimension int, count long")


def clear_index(spark: SparkSession, path: str) -> None:
    """Leave an empty index of the same columns, as its next version."""
    now = current_version(spark, path)
    _commit(spark, path, replace(now, number=now.number + 1, parts=(), dimension=None))


def vacuum_index(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` versions, and the parts that only these had. Readers of older
    versions fail from then on; files of writes that never came to a version stay."""
    numbers = _numbers(spark, path)
    old, kept = numbers[: -max(keep, 1)], numbers[-max(keep, 1) :]
    needed = {p[2] for n in kept for p in current_version(spark, path, n).parts}
    gone = {p[2] for n in old for p in current_version(spark, path, n).parts} - needed
    for n in old:  # first the names, so that no version lacks a part
        remove(spark, f"{_versions(path)}/{n:012}")
    for folder in sorted(gone):
        remove(spark, f"{_table(path)}/{folder}")


def _once(df: DataFrame) -> DataFrame:
    """Of rows with one chunk_id the last by what they hold."""
    row = F.struct(*df.columns)
    return df.groupBy("chunk_id").agg(F.max_by(row, F.to_json(row)).alias("row")).select("row.*")


def append_to_index(df: DataFrame, path: str, mode: str = "append", sources: DataFrame | None = None, mark: tuple[str, int] | None = None) -> None:
    """Add rows to the index, as its next version.

    ``overwrite`` replaces what there is of the source types in ``df``, ``append`` adds
    rows as they are, ``upsert`` replaces rows with equal chunk_id, ``replace`` all rows of the
    sources (source_type, source_key) in ``df`` or in ``sources``, so that a source that shrank or
    vanished leaves nothing behind. Both write anew only the buckets that these sources lie in; rows with
    equal chunk_ids have to have equal source_keys, and count once. Empty input changes nothing. With ``mark``, the name of a
    stream and the number of a batch, nothing is done if the index has that batch or a later one. Columns of ``df`` are those of the index;
    any that lack are null. If another writer comes first, an append is put onto its version, the others fail with ChangedError."""
    spark = df.sparkSession
    if mode not in ("append", "overwrite", "upsert", "replace"):
        raise ValueError(f"no mode {mode!r}")
    now = current_version(spark, path)
    if mark and now.marks.get(mark[0], -1) >= mark[1]:
        return
    marks = now.marks | dict([mark] if mark else [])
    if df.isEmpty() and (mode != "replace" or sources is None or sources.isEmpty()):
        if mark:
            _commit(spark, path, replace(now, number=now.number + 1, marks=marks))
        return
    if unknown := set(df.columns) - set(now.schema.names):
        raise ValueError(f"the index has no columns {sorted(unknown)}")
    df = df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in now.schema.fields))
    if mode == "append":
        made, dimension = _write(df, path)
        for n in range(TRIES):
            try:
                return _commit(spark, path, replace(now, number=now.number + 1, parts=now.parts + made, dimension=dimension or now.dimension, marks=now.marks | marks))
            except ChangedError:
                if n == TRIES - 1:
                    raise
                now = current_version(spark, path)
    if mode == "overwrite":
        made, dimension = _write(df, path)
        types = {p[0] for p in made}
        left = tuple(p for p in now.parts if p[0] not in types)
    else:
        new = materialize(_once(df), "new")
        keys = new.select("source_type", "source_key" if "source_key" in new.columns else "chunk_id")
        if mode == "replace" and sources is not None:
            keys = keys.unionByName(sources.select("source_type", "source_key"))
        touched = {tuple(r) for r in _bucketed(keys.withColumn("chunk_id", F.lit(None)) if "source_key" in keys.columns else keys).select("source_type", "bucket").distinct().collect()}  # BUCKETS of each source type at most
        gone = (new if mode == "upsert" else keys).select(*(["chunk_id"] if mode == "upsert" else ["source_type", "source_key"])).distinct()
        old = _read(spark, path, now, [p for p in now.parts if p[:2] in touched]).drop("bucket").join(gone, gone.columns, "left_anti")
        made, dimension = _write(old.select(*new.columns).unionByName(new), path)
        left = tuple(p for p in now.parts if p[:2] not in touched)
    _commit(spark, path, replace(now, number=now.number + 1, parts=left + made, dimension=dimension or now.dimension, marks=marks))


def index_stats(index: DataFrame) -> DataFrame:
    """total_chunks, demo_chunks, chm_chunks (everything else) and embedding_dimension."""
    demo = F.col("source_type").eqNullSafe(F.lit("demo"))
    return index.agg(F.count("*").alias("total_chunks"), F.count_if(demo).alias("demo_chunks"), F.count_if(~demo).alias("chm_chunks"), F.max(F.size("vector")).alias("embedding_dimension"))


def file_stats(files: DataFrame) -> DataFrame:
    """(grain, key, n): all files, by extension and by project, in one pass."""
    sums = files.groupingSets([[], ["ext"], ["project"]], "ext", "project").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    grain = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "ext").otherwise("project")
    return sums.select(grain.alias("grain"), F.when(F.col("g") == 1, F.col("ext")).when(F.col("g") == 2, F.col("project")).alias("key"), "n")
