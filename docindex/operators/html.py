"""Cleaning of HTML pages to Markdown. One row in, one row out; no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..helpers import html_tree
from ..session import attach

_CLEANED = "title string, content string, headings array<string>, error string"


def clean_html(df: DataFrame, html_col: str = "html", key_col: str = "path", keep_links: bool = False, remove_boilerplate: bool = False, nested_tables: bool = True) -> DataFrame:
    """(source_file, title, content, headings, error) of each page.

    A page that can't be parsed has its message in ``error`` and null content; a null
    page counts as empty. ``nested_tables=False`` writes a nested table's text once,
    in the cell that it is in, instead of once more for each table around it."""
    attach(df.sparkSession)

    @F.pandas_udf(_CLEANED)
    def clean(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p) for p in pages], columns=["title", "content", "headings", "error"])

    def one(html: str | None) -> tuple:
        try:
            root = html_tree.parse((html or "").removeprefix("\ufeff"))
            title = html_tree.title_of(root)
            if remove_boilerplate:
                html_tree.drop_boilerplate(root)
            text, headings = html_tree.to_markdown(root, keep_links, nested_tables)
            return title, html_tree.tidy(text), headings, None
        except Exception as e:  # one bad page is a reject, not the end of the job
            return None, None, [], f"{type(e).__name__}: {e}"

    return df.withColumn("_c", clean(F.col(html_col))).select(F.col(key_col).alias("source_file"), "_c.title", "_c.content", "_c.headings", "_c.error")


def _entities(c: Column) -> Column:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def extract_title(html: Column) -> Column:
    """The title of pages of simple markup, without parsing them: the title
    element, else the first h1, else empty."""
    strip = lambda c: F.regexp_replace(_entities(c), r"(?U)^\s+|\s+$", "")
    title = strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    h1 = strip(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""))
    return F.coalesce(F.when(title != "", title), h1, F.lit(""))


def outline(cleaned: DataFrame) -> DataFrame:
    """(source_file, pos, heading) of cleaned pages, in document order."""
    return cleaned.select("source_file", F.posexplode("headings").alias("pos", "heading"))


def drop_empty(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with content, and the others (rejects, with what was wrong)."""
    empty = is_blank("content")
    if "error" not in cleaned.columns:
        cleaned = cleaned.withColumn("error", F.lit(None).cast("string"))
    good = cleaned.where(~empty & F.col("error").isNull()).drop("error")
    return good, cleaned.where(empty | F.col("error").isNotNull()).withColumn("error", F.coalesce("error", F.lit("empty")))


def tag_source(df: DataFrame, source_type: str) -> DataFrame:
    return df.withColumn("source_type", F.lit(source_type))
