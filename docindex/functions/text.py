"""Text functions over columns, built from Spark's own functions but for byte-pair counts.

``strip`` and friends follow Unicode white space; offsets and lengths count code points.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names that say nothing about a module.
SKIP_PARTS = ["html", "htm", "docs", "doc", "pages", "content", "extracted"]

#: A letter, digit or underscore in any script; the same to Java and RE2.
WORD = r"[\p{L}\p{N}_]"

# Signatures that name a symbol, in the order in which they are tried. The
# first one is a run of type words, then a name and parentheses; its possessive
# form takes words up to the name, so long prose costs neither stack nor time.
SYMBOL_PATTERNS = [
    rf"(?md)^\s*(?:(?!{WORD}++\s*+\()[\p{{L}}\p{{N}}_:*&<>]++\s++)++({WORD}++)\s*+\([^)]*\)",
    rf"(?md)^\s*def\s+({WORD}+)\s*\(",
    rf"(?md)^\s*class\s+({WORD}+)\s*[:\(]",
    rf"(?md)^\s*(?:async\s+)?function\s+({WORD}+)\s*\(",
    rf"(?md)^\s*(?:export\s+)?(?:const|let|var)\s+({WORD}+)\s*=\s*(?:async\s+)?\(",
    rf"(?md)^\s*({WORD}+)\s*:\s*function\s*\(",
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def clean_whitespace(c: Column | str) -> Column:
    """At most one empty line in a row, no white space at line ends, none around the text."""
    few = F.regexp_replace(_col(c), r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(few, r"(?Umd)[\s&&[^\n]]+$", ""))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def count_tokens(c: Column | str) -> Column:
    """Words of ASCII letters, digits and underscores, and other visible characters one by one.
    Pieces never span white space, so counts of texts joined by line breaks add up."""
    return F.size(F.regexp_extract_all(_col(c), F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n\f]"), F.lit(0)))


def count_bpe_tokens(c: Column | str, ranks_path: str) -> Column:
    """Tokens of a byte-level BPE vocabulary, whose ranks lie in a file of the driver's, which is sent to
    workers; null for null. Unlike ``count_tokens`` these counts don't add up over joined texts, so
    give ``chunk_documents_with`` a ``BpeCounter``."""
    from ..helpers.bpe import BpeCounter
    from ..session import attach_active

    attach_active()
    count = BpeCounter(ranks_path)

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        return pd.Series(count.many(texts[known].tolist()), index=texts.index[known], dtype="Int32").reindex(texts.index)

    return run(_col(c))


def extract_symbol(title: Column | str, content: Column | str) -> Column:
    """The first word (dots included) of the title, else the name in the first
    signature found in the content, else empty."""
    first = F.regexp_extract(_col(title), r"[\p{L}\p{N}_.]+", 0)
    tries = [F.when(first != "", first)]
    for pattern in SYMBOL_PATTERNS:
        name = F.regexp_extract(_col(content), pattern, 1)
        tries.append(F.when(name != "", name))
    return F.coalesce(*tries, F.lit(""))


def module_of(path: Column | str) -> Column:
    """The last two meaningful directories of a path."""
    parts = F.split(_col(path), "/", -1)
    parents = F.slice(parts, 1, F.size(parts) - 1)
    kept = F.filter(parents, lambda p: (p != "") & (p != ".") & ~F.lower(p).isin(SKIP_PARTS))
    return F.array_join(F.slice(kept, F.greatest(F.size(kept) - 1, F.lit(1)), 2), "/")


def chapter_of(path: Column | str) -> Column:
    """The path without its last suffix."""
    return F.regexp_replace(_col(path), r"([^/])\.[^./]+$", "$1")


def truncate(c: Column | str, n: int) -> Column:
    """At most ``n`` characters, the last three of them dots if anything was cut."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def content_hash(c: Column | str) -> Column:
    return F.substring(F.md5(_col(c).cast("binary")), 1, 12)


def clean_embed_text(c: Column | str, max_chars: int = 15_000) -> Column:
    """White space collapsed to single spaces, cut to ``max_chars``."""
    return F.substring(F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " ")), 1, max_chars)
