"""Section-aware chunking under a token budget, in built-in functions.

A document's sections, parts and chunks stay arrays in its row until the last
step, which makes rows of them; nothing is shuffled. Token counts add up over joined
texts (see ``count_tokens``), so packing keeps running sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chapter_of, count_tokens, extract_symbol, is_blank, module_of, strip

Counter = Callable[[Column], Column]
#: Marks cuts; taken out of texts before.
_CUT = "\u0001"


def sections_of(content: Column) -> Column:
    """Array of (section_title, section): cut at Markdown headings of levels 1 to 6,
    each section with its heading line. What precedes the first heading has an empty
    title; without headings the content is one section as it is."""
    marked = F.regexp_replace(F.replace(content, F.lit(_CUT), F.lit("")), r"(?md)^(#{1,6}\s+.+)$", _CUT + "$1")
    parts = F.split(marked, _CUT, -1)

    def one(part: Column, n: Column) -> Column:
        title = F.when(n > 0, strip(F.regexp_extract(part, r"(?d)^#{1,6}\s+(.+)", 1))).otherwise(F.lit(""))
        return F.struct(title.alias("section_title"), strip(part).alias("section"))

    whole = F.array(F.struct(F.lit("").alias("section_title"), F.element_at(parts, 1).alias("section")))
    return F.when(F.size(parts) == 1, whole).otherwise(F.filter(F.transform(parts, one), lambda s: s["section"] != ""))


def split_sections(df: DataFrame, content_col: str = "content") -> DataFrame:
    """A row for each section: the other columns, section_no, section_title, section."""
    others = [c for c in df.columns if c != content_col]
    return df.select(*others, F.posexplode(sections_of(F.col(content_col))).alias("section_no", "_s")).select(*others, "section_no", "_s.section_title", "_s.section")


def gate_sections(df: DataFrame, min_tokens: int, max_tokens: int, counter: Counter = count_tokens) -> DataFrame:
    """Add ``tokens`` and ``symbol``, drop sections that are small and name no symbol;
    ``oversized`` marks those that need cutting."""
    counted = df.withColumn("tokens", counter(F.col("section"))).withColumn("symbol", extract_symbol("section_title", "section"))
    return counted.where((F.col("tokens") >= min_tokens) | (F.col("symbol") != "")).withColumn("oversized", F.col("tokens") > max_tokens)


def _paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\n+", -1), strip), lambda p: p != "")


def pack_parts(section: Column, max_tokens: int, counter: Counter = count_tokens) -> Column:
    """A large section as an array of (content, tokens): paragraphs packed in order up
    to the budget, fenced blocks whole and with the paragraph before them if that
    fits. A single part over the budget stays as it is."""
    fence = r"(?s)```.*?```"
    part = lambda text, fenced: F.struct(text.alias("text"), F.lit(fenced).alias("fenced"))

    def around(gap: Column, block: Column) -> Column:
        before = F.transform(_paragraphs(gap), lambda p: part(p, False))
        return F.when(block.isNull(), before).otherwise(F.concat(before, F.array(part(block, True))))

    parts = F.flatten(F.zip_with(F.split(section, fence, -1), F.regexp_extract_all(section, F.lit(fence), F.lit(0)), around))
    counted = F.transform(parts, lambda p: F.struct(p["text"].alias("text"), counter(p["text"]).alias("n"), p["fenced"].alias("fenced")))
    chunk = lambda text, n: F.struct(text.alias("content"), n.alias("tokens"))
    none = F.array().cast("array<struct<content:string,tokens:int>>")

    def fits(last: Column, p: Column) -> Column:
        return last["tokens"] + p["tokens"] <= max_tokens

    single = F.transform(counted, lambda p: F.struct(p["text"].alias("content"), p["n"].alias("tokens"), p["fenced"].alias("fenced")))
    attached = _joined(
        single, none, lambda last, p: p["fenced"] & fits(last, p),
        lambda last, p: chunk(F.concat(last["content"], F.lit("\n"), p["content"]), last["tokens"] + p["tokens"]), lambda p: chunk(p["content"], p["tokens"]),
    )
    return _joined(attached, none, fits, lambda last, p: chunk(F.concat(last["content"], F.lit("\n\n"), p["content"]), last["tokens"] + p["tokens"]))


def _joined(items: Column, none: Column, fits: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column], one: Callable[[Column], Column] = lambda p: p) -> Column:
    """Items in order, each joined to the last result while it fits, else the next one. ``none`` is an
    empty array of results. The open result is held apart, so that only closed ones are copied when another closes."""
    zero = F.struct(none.alias("done"), F.get(none, F.lit(0)).alias("last"))

    def step(s: Column, p: Column) -> Column:
        state = lambda done, last: F.struct(done.alias("done"), last.alias("last"))
        return F.when(s["last"].isNull(), state(s["done"], one(p))).when(fits(s["last"], p), state(s["done"], join(s["last"], p))).otherwise(state(F.concat(s["done"], F.array(s["last"])), one(p)))

    return F.aggregate(items, zero, step, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))))


def split_large_section(df: DataFrame, max_tokens: int, counter: Counter = count_tokens) -> DataFrame:
    """Rows of ``gate_sections``; oversized ones cut, with the section's other columns: chunk_no, content, tokens."""
    whole = F.array(F.struct(F.col("section").alias("content"), F.col("tokens")))
    pieces = F.when(F.col("oversized"), pack_parts(F.col("section"), max_tokens, counter)).otherwise(whole)
    others = [c for c in df.columns if c not in ("section", "tokens", "oversized")]
    return df.select(*others, F.posexplode(pieces).alias("chunk_no", "_p")).select(*others, "chunk_no", "_p.content", "_p.tokens")


def merge_small(chunks: Column, min_tokens: int, max_tokens: int) -> Column:
    """An array of structs with content and tokens, in order: one under ``min_tokens``
    takes in its successor while both fit together, and keeps its own other
    fields. The last is never merged backwards."""

    def join(last: Column, c: Column) -> Column:
        return last.withField("content", F.concat(last["content"], F.lit("\n\n"), c["content"])).withField("tokens", last["tokens"] + c["tokens"])

    return _joined(chunks, F.slice(chunks, 1, 0), lambda last, c: (last["tokens"] < min_tokens) & (last["tokens"] + c["tokens"] <= max_tokens), join)


def merge_small_chunks(df: DataFrame, min_tokens: int, max_tokens: int, key: str = "source_file") -> DataFrame:
    """Merge rows (key, chunk_no, content, tokens, section_title, symbol) of each document;
    for chunks that are rows already. Documents are bounded, their chunks fit a row."""
    one = F.struct("chunk_no", "content", "tokens", "section_title", "symbol")
    merged = df.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_c")).select(key, F.posexplode(merge_small(F.col("_c"), min_tokens, max_tokens)).alias("chunk_no", "_m"))
    return merged.select(key, "chunk_no", "_m.content", "_m.tokens", "_m.section_title", "_m.symbol")


def chunk_id(source_type: Column, source_key: Column, chunk_no: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", source_type, source_key, chunk_no.cast("string")), 256)


def chunk_documents(df: DataFrame, max_tokens: int = 800, min_tokens: int = 50, token_counter: Counter | None = None) -> DataFrame:
    """Chunks of cleaned documents (source_file, title, content): source_file, title,
    module, chapter, chunk_no, content, tokens, section_title, symbol.

    Sections under ``min_tokens`` without a symbol go before anything is merged.
    Blank and null documents have no chunks. ``token_counter`` maps a column to its
    token count and has to add up over texts joined by line breaks."""
    count = token_counter or count_tokens

    def inside(s: Column) -> Column:
        text = s["section"]
        return F.struct(s["section_title"].alias("section_title"), text.alias("section"), count(text).alias("tokens"), extract_symbol(s["section_title"], text).alias("symbol"))

    def pieces(s: Column) -> Column:
        whole = F.array(F.struct(s["section"].alias("content"), s["tokens"].alias("tokens")))
        cut = F.when(s["tokens"] > max_tokens, pack_parts(s["section"], max_tokens, count)).otherwise(whole)
        return F.transform(cut, lambda p: F.struct(p["content"].alias("content"), p["tokens"].alias("tokens"), s["section_title"].alias("section_title"), s["symbol"].alias("symbol")))

    docs = df.where(~is_blank("content")).withColumn("_s", F.transform(sections_of(F.col("content")), inside))
    kept = F.filter("_s", lambda s: (s["tokens"] >= min_tokens) | (s["symbol"] != ""))
    docs = docs.select("source_file", "title", F.flatten(F.transform(kept, pieces)).alias("_p"))
    docs = docs.select("source_file", "title", F.posexplode(merge_small(F.filter("_p", lambda p: p["content"] != ""), min_tokens, max_tokens)).alias("chunk_no", "_c"))
    return docs.select("source_file", "title", module_of("source_file").alias("module"), chapter_of("source_file").alias("chapter"), "chunk_no", "_c.content", "_c.tokens", "_c.section_title", "_c.symbol")


def chunk_documents_with(df: DataFrame, count: Callable[[str], int], max_tokens: int = 800, min_tokens: int = 50) -> DataFrame:
    """``chunk_documents`` with a counter of strings, whose counts need not add up. A ``BpeCounter`` cuts and counts each part
    once and corrects the sums at the seams; any other function counts joined texts anew. Runs in Python, a document at a time."""
    from collections.abc import Iterator

    import pandas as pd

    from ..helpers.sections import chunk
    from ..session import attach

    attach(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source_file", "title", "chunk_no", "content", "tokens", "section_title", "symbol"]
        for batch in batches:
            rows = [(f, t, n, *c.values()) for f, t, text in batch.itertuples(index=False, name=None) for n, c in enumerate(chunk(text, max_tokens, min_tokens, count))]
            yield pd.DataFrame(rows, columns=names)

    chunks = df.where(~is_blank("content")).select("source_file", "title", "content").mapInPandas(run, "source_file string, title string, chunk_no int, content string, tokens int, section_title string, symbol string")
    return chunks.select("source_file", "title", module_of("source_file").alias("module"), chapter_of("source_file").alias("chapter"), "chunk_no", "content", "tokens", "section_title", "symbol")


#: The columns of the index, whatever a chunk comes from.
CHUNK_COLUMNS = {
    "chunk_id": "string", "source_key": "string", "chunk_no": "int", "content": "string", "source_type": "string",
    "source_file": "string", "title": "string", "module": "string", "chapter": "string", "section_title": "string",
    "demo_name": "string", "file_path": "string", "ext": "string", "chunk_type": "string", "language": "string", "hash": "string", "class_name": "string",
    "line_number": "int", "symbol": "string",
}


def to_chunks(df: DataFrame, source_type: str, key: Column) -> DataFrame:
    """The chunk schema of the index: missing columns are null, ids derive from source and number."""
    df = df.withColumn("source_type", F.lit(source_type)).withColumn("source_key", key)
    df = df.withColumn("chunk_id", chunk_id(F.col("source_type"), F.col("source_key"), F.col("chunk_no")))
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in CHUNK_COLUMNS.items()))
