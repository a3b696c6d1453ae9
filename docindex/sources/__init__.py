"""Reading pages, source projects and chunk files; writing chunks."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import CHUNK_COLUMNS
from ..session import attach_active, folders_in

# Suffixes of pages and of source files that are read, directories that are not
# entered, and encodings in the order in which they are tried.
HTML_SUFFIXES = (".html", ".htm", ".xhtml")
CODE_SUFFIXES = (".h", ".hpp", ".cpp", ".cc", ".cxx", ".ui", ".def", ".tcmd")
SKIP_DIRS = (".git", ".svn", ".vs", ".vscode", "Debug", "Release", "x64", "x86", "build", "out", "bin", "obj", "__pycache__", "node_modules", "GeneratedFiles")
HTML_ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")
TEXT_ENCODINGS = ("utf-8", "gbk", "latin-1")


def suffix(path: Column) -> Column:
    """The last suffix of a path's last part, in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def html_files(df: DataFrame, path_col: str = "path", exts: tuple[str, ...] = HTML_SUFFIXES) -> DataFrame:
    return df.where(suffix(F.col(path_col)).isin(*exts))


def _files(spark: SparkSession, path: str, exts: tuple[str, ...]) -> DataFrame:
    """The files below ``path`` with these suffixes, in any case; no others are opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _any_of(exts)).load(path)


def _any_of(exts: tuple[str, ...]) -> str:
    """A pattern for names with one of these suffixes in any case."""
    glob = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in exts)
    return f"*{{{glob}}}"


def _entered(spark: SparkSession, root: str, skip: tuple[str, ...]) -> list[str]:
    """``root`` and the folders below it, level by level; those with a name in ``skip`` and all that lies in them are not
    looked into. The list has folders only: Spark lists their files, in parallel where there are many."""
    out, level = [], [root.rstrip("/") or "/"]
    with ThreadPoolExecutor(16) as pool:
        while level:
            out += level
            below = chain.from_iterable(pool.map(lambda folder: folders_in(spark, folder), level))
            level = [f for f in below if f.rsplit("/", 1)[1] not in skip]
    return out


def _project_files(spark: SparkSession, root: str, skip: tuple[str, ...]) -> DataFrame:
    """The source files of the folders that a scan enters."""
    plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", f) for f in _entered(spark, root, skip)]  # names are no patterns
    return spark.read.format("binaryFile").option("pathGlobFilter", _any_of(CODE_SUFFIXES)).load(plain)


def read_html_pages(spark: SparkSession, path: str, exts: tuple[str, ...] = HTML_SUFFIXES) -> DataFrame:
    """(path, content) of the pages below ``path``; sort by path where order matters."""
    return html_files(_files(spark, path, exts), exts=exts).select("path", "content")


def decode_text(content: Column, encodings: tuple[str, ...] = HTML_ENCODINGS) -> Column:
    """Bytes as text in the first encoding that fits, with line ends made plain and
    without a byte order mark; null if none fits or there are no bytes."""
    attach_active()

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return pd.Series([one(v) for v in values], dtype=object)

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for encoding in encodings:
            try:
                text = bytes(raw).decode(encoding)
            except (UnicodeDecodeError, LookupError):
                continue
            return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
        return None

    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^\ufeff", ""), "\r\n?", "\n")
    if encodings[:1] != ("utf-8",):
        return decode(content)
    # Python only sees what isn't UTF-8.
    good = F.is_valid_utf8(content.cast("string"))
    return F.when(good, plain(content.cast("string"))).otherwise(decode(F.when(good, F.lit(None)).otherwise(content)))


def project_files(df: DataFrame, skip_dirs: tuple[str, ...] = ()) -> DataFrame:
    """Of rows with ``relative_path`` those that a project scan keeps, with ``ext``:
    known suffixes, in no directory of a skipped name (case counts)."""
    parts = F.split("relative_path", "/", -1)
    inside = F.slice(parts, 1, F.size(parts) - 1)
    skipped = F.array(*(F.lit(d) for d in (*SKIP_DIRS, *skip_dirs)))
    return df.withColumn("ext", suffix(F.col("relative_path"))).where(F.col("ext").isin(*CODE_SUFFIXES) & ~F.arrays_overlap(inside, skipped))


def _relative(path: Column, root: str) -> Column:
    """``path`` below ``root``; both may or may not name a scheme."""
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", root).rstrip("/")
    return F.substring(plain, len(base) + 2, 1_000_000)


def scan_project(spark: SparkSession, directory: str, project: str | None = None, skip_dirs: tuple[str, ...] = ()) -> DataFrame:
    """(project, relative_path, ext, content) of a project's source files; the
    project is called like its directory if no name is given. Skipped directories are never entered, so what they hold costs nothing."""
    named = _project_files(spark, directory, (*SKIP_DIRS, *skip_dirs)).select(F.lit(project or directory.rstrip("/").rsplit("/", 1)[-1]).alias("project"), _relative(F.col("path"), directory).alias("relative_path"), "content")
    kept = project_files(named, skip_dirs)
    return kept.select("project", "relative_path", "ext", decode_text(F.col("content"), HTML_ENCODINGS).alias("content"))


def scan_projects(spark: SparkSession, directories: dict[str, str] | list[str], names: list[str] | None = None, skip_dirs: tuple[str, ...] = ()) -> DataFrame:
    """Several projects, as {name: directory} or as directories with names or without."""
    if not isinstance(directories, dict):
        if names and len(names) != len(directories):
            raise ValueError("as many names as directories are needed")
        pairs = [*zip(names or [None] * len(directories), directories, strict=True)]
    else:
        pairs = [*directories.items()]
    if not pairs:
        raise ValueError("no project to scan")
    out = scan_project(spark, pairs[0][1], pairs[0][0], skip_dirs)
    for name, directory in pairs[1:]:
        out = out.unionByName(scan_project(spark, directory, name, skip_dirs))
    return out


def write_chunks(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chunks as JSON Lines."""
    df.select(*CHUNK_COLUMNS).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks written by ``write_chunks``."""
    return spark.read.schema(", ".join(f"{c} {t}" for c, t in CHUNK_COLUMNS.items())).json(path)


def write_chunk_array(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chunks as files that each hold one JSON array of {content, metadata}: what of a
    partition's rows isn't null. Partitions are files, so ``coalesce`` first for a single one."""
    fields = [c for c in CHUNK_COLUMNS if c not in ("chunk_id", "source_key", "chunk_no", "content") and c in df.columns]
    rows = df.select(F.to_json(F.struct("content", F.struct(*fields).alias("metadata"))).alias("value"))

    def array(batches):
        import pyarrow as pa

        ahead = "["
        for batch in batches:
            for row in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([ahead + row])], ["value"])
                ahead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if ahead == "," else "[]"])], ["value"])

    rows.mapInArrow(array, "value string").write.mode(mode).text(path)


def read_chunk_array(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of files that hold one JSON array of {content, metadata}, flattened."""
    fields = [c for c in CHUNK_COLUMNS if c not in ("chunk_id", "source_key", "chunk_no", "content")]
    schema = f"content string, metadata struct<{', '.join(f'{c}: {CHUNK_COLUMNS[c]}' for c in fields)}>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.select("content", "metadata.*")
