"""A query for each operator, by id of the inventory, and what SQL says to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import text as t
from ..helpers.bpe import BpeCounter
from ..operators import chunking, code, embed, html, layout, prompts, search
from ..operators import index as idx
from ..session import load_table, new_path
from . import derived as d

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _md5(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.md5(col.cast("binary")).alias(name or f"{c}_md5")


# SQL fragments that several queries share.
_STRIP = r"regexp_replace({0}, '^[\s]+|[\s]+$', '', 'g')"
_TOKENS = r"len(regexp_extract_all({0}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n\f]'))"
_HTML_TEXT = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"


def strip_sql(x: str) -> str:
    return _STRIP.format(x)


def tokens_sql(x: str) -> str:
    return f"CAST({_TOKENS.format(x)} AS INTEGER)"


# Sources and sinks ------------------------------------------------------------


@query(f"SELECT page_id, path, strlen(html) AS n_bytes FROM ({d.PAGE_PATHS}) WHERE regexp_matches(lower(path), '[^/]\\.(html|htm|xhtml)$')")
def s1_html_pages(spark: SparkSession, sf: str) -> DataFrame:
    return sources.html_files(d.page_paths(spark, sf)).select("page_id", "path", F.octet_length("html").cast("long").alias("n_bytes"))


@query("SELECT doc_id, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_md5 FROM documents")
def s2_decode_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = load_table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\n", "\r\n").cast("binary").alias("raw"))
    return raw.select("doc_id", _md5(sources.decode_text(F.col("raw")), "text_md5"))


_SKIPPED = "'" + "', '".join(sources.SKIP_DIRS) + "'"
_SCAN = rf"""SELECT *, lower(regexp_extract(relative_path, '[^/](\.[^./]+)$', 1)) AS ext FROM ({d.PART_PATHS})
 WHERE lower(regexp_extract(relative_path, '[^/](\.[^./]+)$', 1)) IN ('.h', '.hpp', '.cpp', '.cc', '.cxx', '.ui', '.def', '.tcmd') AND NOT list_has_any(string_split(relative_path, '/')[:-2], [{_SKIPPED}])"""


@query(f"SELECT p_partkey, project, relative_path, ext FROM ({_SCAN})")
def s3_scan_project(spark: SparkSession, sf: str) -> DataFrame:
    return sources.project_files(d.part_paths(spark, sf)).select("p_partkey", "project", "relative_path", "ext")


@query(f"SELECT p_partkey, 'scan-' || project AS project, relative_path FROM ({_SCAN})")
def s4_scan_projects(spark: SparkSession, sf: str) -> DataFrame:
    kept = sources.project_files(d.part_paths(spark, sf))
    roots = spark.createDataFrame([(f"proj{n}", f"scan-proj{n}") for n in range(4)], "root string, name string")
    return kept.join(F.broadcast(roots), kept["project"] == roots["root"]).select("p_partkey", F.col("name").alias("project"), "relative_path")


_PACK_CTE = f"""
doc AS (SELECT source_file, title, content FROM ({d.MD_DOCS})),
para AS (SELECT source_file, title, unnest(list_filter(list_transform(regexp_split_to_array(content, '\\n\\n+'), lambda p: {strip_sql('p')}), lambda p: p <> '')) AS p, generate_subscripts(list_filter(list_transform(regexp_split_to_array(content, '\\n\\n+'), lambda p: {strip_sql('p')}), lambda p: p <> ''), 1) AS n FROM doc),
counted AS (SELECT *, {tokens_sql('p')} AS k FROM para),
packed AS (SELECT source_file, n, k AS used, 0 AS chunk FROM counted WHERE n = 1
  UNION ALL SELECT c.source_file, c.n, CASE WHEN r.used + c.k <= 800 THEN r.used + c.k ELSE c.k END, CASE WHEN r.used + c.k <= 800 THEN r.chunk ELSE r.chunk + 1 END FROM packed r JOIN counted c ON c.source_file = r.source_file AND c.n = r.n + 1),
whole AS (SELECT source_file, {tokens_sql('content')} AS k, {strip_sql('content')} AS content FROM doc),
pieces AS (SELECT p.source_file, p.chunk AS no, string_agg(c.p, chr(10) || chr(10) ORDER BY c.n) AS content, CAST(sum(c.k) AS INTEGER) AS tokens FROM packed p JOIN counted c USING (source_file, n) JOIN whole w USING (source_file) WHERE w.k > 800 GROUP BY ALL
  UNION ALL SELECT source_file, 0, content, k FROM whole WHERE k <= 800)"""
_MERGE_CTE = """,
merged AS (SELECT source_file, no, tokens AS used, 0 AS chunk FROM pieces WHERE no = 0
  UNION ALL SELECT c.source_file, c.no, CASE WHEN r.used < 50 AND r.used + c.tokens <= 800 THEN r.used + c.tokens ELSE c.tokens END, CASE WHEN r.used < 50 AND r.used + c.tokens <= 800 THEN r.chunk ELSE r.chunk + 1 END FROM merged r JOIN pieces c ON c.source_file = r.source_file AND c.no = r.no + 1),
final AS (SELECT p.source_file, CAST(m.chunk AS INTEGER) AS chunk_no, string_agg(p.content, chr(10) || chr(10) ORDER BY p.no) AS content, CAST(sum(p.tokens) AS INTEGER) AS tokens FROM merged m JOIN pieces p USING (source_file, no) GROUP BY ALL)"""
_CHUNKS_SQL = f"WITH RECURSIVE {_PACK_CTE}{_MERGE_CTE} "
_IDS = "SELECT sha256('chm' || chr(31) || source_file || chr(31) || chunk_no) AS chunk_id, source_file AS source_key, chunk_no, md5(content) AS content_md5, 'chm' AS source_type FROM final"


@query(_CHUNKS_SQL + _IDS)
def s5_chunk_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "chunks")
    sources.write_chunks(d.doc_chunks(spark, sf), path)
    return sources.read_chunks(spark, path).select("chunk_id", "source_key", "chunk_no", _md5("content"), "source_type")


def _small_index(spark: SparkSession, sf: str) -> DataFrame:
    e = load_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("chunk_id"), "label", F.when(F.col("label") % 2 == 0, "demo").otherwise("chm").alias("source_type"), F.concat(F.lit("k"), F.floor(F.col("vec_id") / 4).cast("string")).alias("source_key"), F.col("embedding").alias("vector"))


@query("SELECT 'append' AS step, CASE WHEN label % 2 = 0 THEN 'demo' ELSE 'chm' END AS source_type, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels FROM (SELECT * FROM embeddings UNION ALL SELECT * FROM embeddings WHERE label < 4) GROUP BY ALL "
       "UNION ALL SELECT 'upsert', CASE WHEN label % 2 = 0 THEN 'demo' ELSE 'chm' END, count(*), CAST(sum(CASE WHEN label < 4 THEN label + 100 ELSE label END) AS BIGINT) FROM embeddings GROUP BY ALL "
       "UNION ALL SELECT 'overwrite', CASE WHEN label % 2 = 0 THEN 'demo' ELSE 'chm' END, count(*), CAST(sum(label) AS BIGINT) FROM embeddings WHERE label % 2 = 1 OR label = 2 GROUP BY ALL "
       "UNION ALL SELECT 'replace', CASE WHEN label % 2 = 0 THEN 'demo' ELSE 'chm' END, count(*), CAST(sum(CASE WHEN vec_id % 8 = 0 THEN label + 100 ELSE label END) AS BIGINT) FROM embeddings WHERE vec_id % 8 = 0 OR (vec_id // 4, label % 2) NOT IN (SELECT (vec_id // 4, label % 2) FROM embeddings WHERE vec_id % 8 = 0) GROUP BY ALL")  # fmt: skip
def s6_append_to_index(spark: SparkSession, sf: str) -> DataFrame:
    rows, out = _small_index(spark, sf), None
    some = rows.where("label < 4")
    steps = {"append": (some, "append"), "upsert": (some.withColumn("label", F.col("label") + 100), "upsert"), "overwrite": (rows.where("label = 2"), "overwrite"), "replace": (rows.where("chunk_id % 8 = 0").withColumn("label", F.col("label") + 100), "replace")}
    for step, (more, mode) in steps.items():
        path = new_path(spark, "index")
        idx.write_index(rows, path)
        idx.append_to_index(more, path, mode)
        now = idx.load_index(spark, path).groupBy("source_type").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("labels")).select(F.lit(step).alias("step"), "source_type", "n", "labels")
        out = now if out is None else out.unionByName(now)
    return out


@query("SELECT 'saved' AS step, CAST(max(len(embedding)) AS INTEGER) AS dimension, count(*) AS count FROM embeddings UNION ALL SELECT 'cleared', NULL, 0")
def s7_index_files(spark: SparkSession, sf: str) -> DataFrame:
    kept, cleared = new_path(spark, "index"), new_path(spark, "index")
    for path in (kept, cleared):
        idx.write_index(_small_index(spark, sf), path)
    idx.clear_index(spark, cleared)
    return idx.read_manifest(spark, kept).select(F.lit("saved").alias("step"), "dimension", "count").unionByName(idx.read_manifest(spark, cleared).select(F.lit("cleared").alias("step"), "dimension", "count"))


# HTML -------------------------------------------------------------------------


def _cleaned(spark: SparkSession, sf: str, **options) -> DataFrame:
    return html.clean_html(load_table(spark, sf, "pages").withColumn("path", F.concat("url", F.lit("#"), F.col("page_id").cast("string"))), **options)


@query()
def h1_clean_html(spark: SparkSession, sf: str) -> DataFrame:
    return _cleaned(spark, sf).select("source_file", "title", F.size("headings").alias("n_headings"), F.length("content").alias("n_chars"), _md5("content"))


_TITLE = strip_sql(_HTML_TEXT.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))


@query(f"SELECT page_id, {_TITLE} AS title, {_TITLE} AS parsed FROM pages")
def h2_extract_title(spark: SparkSession, sf: str) -> DataFrame:
    """Titles by expression and from the parsed page."""
    pages = load_table(spark, sf, "pages")
    parsed = html.clean_html(pages, key_col="page_id").select(F.col("source_file").alias("page_id"), F.col("title").alias("parsed"))
    return pages.select("page_id", html.extract_title(F.col("html")).alias("title")).join(parsed, "page_id").select("page_id", "title", "parsed")


_H1S = "regexp_extract_all(html, '(?is)<h1>(.*?)</h1>', 1)"


@query(f"SELECT source_file, CAST(pos - 1 AS INTEGER) AS pos, {strip_sql(_HTML_TEXT.format('h'))} AS heading FROM (SELECT url || '#' || page_id AS source_file, unnest({_H1S}) AS h, generate_subscripts({_H1S}, 1) AS pos FROM pages)")
def h3_outline(spark: SparkSession, sf: str) -> DataFrame:
    return html.outline(_cleaned(spark, sf))


def _markup(spark: SparkSession, sf: str) -> DataFrame:
    p = load_table(spark, sf, "part")
    n, name = F.col("p_partkey").cast("string"), F.col("p_name")
    table = F.concat(F.lit("<table><tr><th>Name</th><th>Type</th></tr><tr><td>"), name, F.lit("|"), n, F.lit("</td></tr></table>"))
    lists = F.concat(F.lit("<ul><li>"), name, F.lit("<li>x<ol><li>"), n, F.lit("</li></ol></ul><ol><li>a</li><li>"), "p_brand", F.lit("</li></ol>"))
    rest = F.concat(F.lit("<pre>int f"), n, F.lit("();  \n</pre><code>x</code><p>see <a href='u/"), n, F.lit("'>"), name, F.lit("</a>now</p><a href='v'>link</a><br>tail"))
    return p.select(F.concat(F.lit("p"), n).alias("path"), F.concat(F.lit("<html><body>"), table, lists, rest, F.lit("</body></html>")).alias("html"))


_H4 = """SELECT 'p' || p_partkey AS source_file, '| Name | Type |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || '\\|' || p_partkey || ' |  |' || chr(10) || chr(10) ||
 '- ' || p_name || chr(10) || '- x' || p_partkey || chr(10) || chr(10) || '1. a' || chr(10) || '2. ' || p_brand || chr(10) || chr(10) ||
 '```' || chr(10) || 'int f' || p_partkey || '();' || chr(10) || '```' || chr(10) || chr(10) || '`x`' || chr(10) || chr(10) || 'see' || p_name || 'now' || chr(10) || chr(10) || '[link](v)' || chr(10) || chr(10) || 'tail' AS content FROM part"""


@query(_H4)
def h4_h7_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Code blocks, tables, lists, paragraphs and links."""
    return html.clean_html(_markup(spark, sf), keep_links=True).select("source_file", "content")


def _furnished(spark: SparkSession, sf: str, **options) -> DataFrame:
    """Parts as pages with navigation, a comment, an advertisement and headings, cleaned."""
    n, name = F.col("p_partkey").cast("string"), F.col("p_name")
    head = F.concat(F.lit("<html><head><title> "), name, F.lit(" &amp; "), n, F.lit(" </title><style>p{}</style></head><body><nav id='top'>Home</nav><!-- note --><h1>"), name, F.lit("</h1><h2> </h2>"))
    page = F.concat(head, F.lit("<p>one<br>two <b>"), n, F.lit("</b></p>tail<div class='box ad-wide'>buy</div><h3>T<i>"), "p_brand", F.lit("</i></h3></body></html>"))
    pages = load_table(spark, sf, "part").select(F.concat(F.lit("p"), n).alias("path"), page.alias("html"))
    return html.clean_html(pages, **options).select("source_file", "title", F.size("headings").alias("n_headings"), "content")


_FURNISHED = "SELECT 'p' || p_partkey AS source_file, p_name || ' & ' || p_partkey AS title, 2 AS n_headings, {0} || '# ' || p_name || chr(10) || chr(10) || 'onetwo' || p_partkey || chr(10) || chr(10) || 'tail' || {1} || chr(10) || chr(10) || '### T' || p_brand AS content FROM part"


@query(_FURNISHED.format("'Home' || chr(10) || 'note' || chr(10) || chr(10)", "chr(10) || 'buy'"))
def h1_clean_markup(spark: SparkSession, sf: str) -> DataFrame:
    return _furnished(spark, sf)


@query(_FURNISHED.format("''", "''"))
def h9_clean_markup(spark: SparkSession, sf: str) -> DataFrame:
    """The same without furniture."""
    return _furnished(spark, sf, remove_boilerplate=True)


_WS = "'  ' || chr(10) || replace(text, '. ', '.  ' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10)) || chr(10)"


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace({_WS}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ \\t\\r\\f\\v]+$', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM documents")
def h8_clean_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    messy = F.concat(F.lit("  \n"), F.replace("text", F.lit(". "), F.lit(".  \t\n\n\n\n")), F.lit("\n"))
    return load_table(spark, sf, "documents").select("doc_id", _md5(t.clean_whitespace(messy), "text_md5"))


@query()
def h9_remove_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    return _cleaned(spark, sf, remove_boilerplate=True).select("source_file", "title", F.length("content").alias("n_chars"), _md5("content"))


@query("SELECT doc_id, 'kept' AS state FROM documents WHERE doc_id % 7 > 1 AND text <> '' UNION ALL SELECT doc_id, 'empty' FROM documents WHERE NOT (doc_id % 7 > 1 AND text <> '')")
def h10_drop_empty(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 7 == 0, F.lit(" \n\t ")).when(F.col("doc_id") % 7 > 1, F.col("text"))
    good, bad = html.drop_empty(load_table(spark, sf, "documents").select("doc_id", text.alias("content")))
    return good.select("doc_id", F.lit("kept").alias("state")).unionByName(bad.select("doc_id", F.col("error").alias("state")))


@query("SELECT doc_id, 'chm' AS source_type FROM documents")
def h11_tag_source(spark: SparkSession, sf: str) -> DataFrame:
    return html.tag_source(load_table(spark, sf, "documents").select("doc_id"), "chm")


# Chunking ---------------------------------------------------------------------


@query(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def c1_count_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "documents").select("doc_id", t.count_tokens("text").alias("tokens"))


@query()
def c1_count_bpe_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a byte-pair vocabulary."""
    import public_tokenizers

    return load_table(spark, sf, "documents").select("doc_id", t.count_bpe_tokens("text", public_tokenizers.path("byte_bpe_50k.tiktoken")).alias("tokens"))


_HEADING = r"regexp_extract(part, '^#{1,6}\s+(.+)', 1)"
_SECTIONS = rf"""
marked AS (SELECT source_file, string_split(regexp_replace(content, '(?m)^(#{{1,6}}\s+.+)$', chr(1) || '\1', 'g'), chr(1)) AS parts FROM ({d.MD_MULTI})),
part_rows AS (SELECT source_file, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM marked),
sections AS (SELECT source_file, n, CAST(row_number() OVER (PARTITION BY source_file ORDER BY n) - 1 AS INTEGER) AS section_no, CASE WHEN n > 1 THEN {strip_sql(_HEADING)} ELSE '' END AS section_title, {strip_sql('part')} AS section
  FROM part_rows WHERE {strip_sql('part')} <> '')"""


@query(f"WITH {_SECTIONS} SELECT source_file, section_no, section_title, md5(section) AS section_md5 FROM sections")
def c2_split_sections(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.split_sections(d.md_multi(spark, sf)).select("source_file", "section_no", "section_title", _md5("section"))


_W = r"[\p{L}\p{N}_]"
_SYMBOL = rf"""CASE WHEN regexp_extract({{0}}, '[\p{{{{L}}}}\p{{{{N}}}}_.]+') <> '' THEN regexp_extract({{0}}, '[\p{{{{L}}}}\p{{{{N}}}}_.]+')
 WHEN regexp_extract({{1}}, '(?m)^\s*(?:[\p{{{{L}}}}\p{{{{N}}}}_:*&<>]+\s+)+([\p{{{{L}}}}\p{{{{N}}}}_]+)\s*\([^)]*\)', 1) <> '' THEN regexp_extract({{1}}, '(?m)^\s*(?:[\p{{{{L}}}}\p{{{{N}}}}_:*&<>]+\s+)+([\p{{{{L}}}}\p{{{{N}}}}_]+)\s*\([^)]*\)', 1)
 WHEN regexp_extract({{1}}, '(?m)^\s*def\s+(\w+)\s*\(', 1) <> '' THEN regexp_extract({{1}}, '(?m)^\s*def\s+(\w+)\s*\(', 1)
 WHEN regexp_extract({{1}}, '(?m)^\s*class\s+(\w+)\s*[:\(]', 1) <> '' THEN regexp_extract({{1}}, '(?m)^\s*class\s+(\w+)\s*[:\(]', 1)
 WHEN regexp_extract({{1}}, '(?m)^\s*(?:async\s+)?function\s+(\w+)\s*\(', 1) <> '' THEN regexp_extract({{1}}, '(?m)^\s*(?:async\s+)?function\s+(\w+)\s*\(', 1)
 WHEN regexp_extract({{1}}, '(?m)^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(', 1) <> '' THEN regexp_extract({{1}}, '(?m)^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(', 1)
 ELSE regexp_extract({{1}}, '(?m)^\s*(\w+)\s*:\s*function\s*\(', 1) END""".replace("{{{{", "{{").replace("}}}}", "}}")


def symbol_sql(title: str, content: str) -> str:
    return _SYMBOL.replace("{{", "\0").replace("}}", "\1").replace("{0}", title).replace("{1}", content).replace("\0", "{").replace("\1", "}")


@query(f"SELECT doc_id, {symbol_sql('ttl', 'body')} AS symbol FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '.x (a)' ELSE '' END AS ttl, CASE doc_id % 5 WHEN 0 THEN 'def f' || doc_id || ' (x)' || chr(10) || text WHEN 1 THEN 'let v' || doc_id || ' = async (' WHEN 2 THEN 'int  g' || doc_id || ' (a) ;' WHEN 3 THEN 'k' || doc_id || ': function(' ELSE text END AS body FROM documents)")
def c3_extract_symbol(spark: SparkSession, sf: str) -> DataFrame:
    docs, n = load_table(spark, sf, "documents"), F.col("doc_id").cast("string")
    title = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(".x (a)"))).otherwise(F.lit(""))
    r = F.col("doc_id") % 5
    body = F.when(r == 0, F.concat(F.lit("def f"), n, F.lit(" (x)\n"), "text")).when(r == 1, F.concat(F.lit("let v"), n, F.lit(" = async ("))).when(r == 2, F.concat(F.lit("int  g"), n, F.lit(" (a) ;"))).when(r == 3, F.concat(F.lit("k"), n, F.lit(": function("))).otherwise(F.col("text"))
    return docs.select("doc_id", title.alias("t"), body.alias("b")).select("doc_id", t.extract_symbol("t", "b").alias("symbol"))


_SKIP = "'" + "', '".join(t.SKIP_PARTS) + "'"


@query(f"SELECT path, array_to_string(list_filter(string_split(path, '/')[:-2], lambda p: p NOT IN ('', '.') AND lower(p) NOT IN ({_SKIP}))[-2:], '/') AS module FROM (SELECT source_file AS path FROM ({d.MD_DOCS}) UNION ALL SELECT path FROM ({d.PAGE_PATHS}) UNION ALL SELECT relative_path FROM ({d.PART_PATHS}))")
def c4_module_of(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("path", t.module_of("path").alias("module"))


@query(f"SELECT path, regexp_replace(path, '([^/])\\.[^./]+$', '\\1') AS chapter FROM (SELECT source_file AS path FROM ({d.MD_DOCS}) UNION ALL SELECT path FROM ({d.PAGE_PATHS}) UNION ALL SELECT relative_path FROM ({d.PART_PATHS}))")
def c5_chapter_of(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("path", t.chapter_of("path").alias("chapter"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return d.md_docs(spark, sf).select(F.col("source_file").alias("path")).unionByName(d.page_paths(spark, sf).select("path")).unionByName(d.part_paths(spark, sf).select(F.col("relative_path").alias("path")))


_GATED = f"""gated AS (SELECT *, {tokens_sql('section')} AS tokens, {symbol_sql('section_title', 'section')} AS symbol FROM sections)"""
_GATE = "tokens >= 200 OR symbol <> ''"


@query(f"WITH {_SECTIONS}, {_GATED} SELECT source_file, section_no, tokens, symbol, tokens > 800 AS oversized FROM (SELECT * REPLACE (CASE WHEN section_no % 2 = 0 THEN symbol ELSE '' END AS symbol) FROM gated) WHERE tokens >= 200 OR symbol <> ''")
def c6_gate_sections(spark: SparkSession, sf: str) -> DataFrame:
    # Titles of odd sections are taken away, so that some have no symbol.
    rows = chunking.split_sections(d.md_multi(spark, sf))
    odd = F.col("section_no") % 2 == 1
    rows = rows.withColumns({"section_title": F.when(odd, F.lit("")).otherwise(F.col("section_title")), "section": F.when(odd, F.regexp_replace("section", r"[()]", "")).otherwise(F.col("section"))})
    return chunking.gate_sections(rows, 200, 800).select("source_file", "section_no", "tokens", "symbol", "oversized")


ORACLE_SQL["c6_gate_sections"] = f"""WITH {_SECTIONS}, blind AS (SELECT * REPLACE (CASE WHEN section_no % 2 = 1 THEN '' ELSE section_title END AS section_title, CASE WHEN section_no % 2 = 1 THEN regexp_replace(section, '[()]', '', 'g') ELSE section END AS section) FROM sections),
 gated AS (SELECT *, {tokens_sql('section')} AS tokens, {symbol_sql('section_title', 'section')} AS symbol FROM blind)
 SELECT source_file, section_no, tokens, symbol, tokens > 800 AS oversized FROM gated WHERE {_GATE}"""


@query(f"WITH RECURSIVE {_PACK_CTE} SELECT source_file, CAST(no AS INTEGER) AS chunk_no, tokens, md5(content) AS content_md5 FROM pieces")
def c7_split_large_section(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.gate_sections(chunking.split_sections(d.md_docs(spark, sf)), 0, 800)
    return chunking.split_large_section(rows, 800).select("source_file", "chunk_no", "tokens", _md5("content"))


_C8 = f"""WITH RECURSIVE {_SECTIONS}, rows AS (SELECT source_file, section_no AS no, section AS content, {tokens_sql('section')} AS tokens, section_title FROM sections),
merged AS (SELECT source_file, no, tokens AS used, 0 AS chunk FROM rows WHERE no = 0
  UNION ALL SELECT c.source_file, c.no, CASE WHEN r.used < 400 AND r.used + c.tokens <= 2000 THEN r.used + c.tokens ELSE c.tokens END, CASE WHEN r.used < 400 AND r.used + c.tokens <= 2000 THEN r.chunk ELSE r.chunk + 1 END FROM merged r JOIN rows c ON c.source_file = r.source_file AND c.no = r.no + 1)
SELECT m.source_file, CAST(m.chunk AS INTEGER) AS chunk_no, CAST(sum(tokens) AS INTEGER) AS tokens, md5(string_agg(content, chr(10) || chr(10) ORDER BY r.no)) AS content_md5, arg_min(section_title, r.no) AS section_title FROM merged m JOIN rows r USING (source_file, no) GROUP BY ALL"""


@query(_C8.replace("GROUP BY ALL", "GROUP BY m.source_file, m.chunk"))
def c8_merge_small_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.split_sections(d.md_multi(spark, sf)).select("source_file", F.col("section_no").alias("chunk_no"), F.col("section").alias("content"), t.count_tokens("section").alias("tokens"), "section_title", F.lit("").alias("symbol"))
    return chunking.merge_small_chunks(rows, 400, 2000).select("source_file", "chunk_no", "tokens", _md5("content"), "section_title")


@query(_CHUNKS_SQL + f"SELECT f.source_file, f.chunk_no, f.tokens, md5(f.content) AS content_md5, d.title AS symbol, d.title AS section_title, regexp_replace(f.source_file, '([^/])\\.[^./]+$', '\\1') AS chapter FROM final f JOIN ({d.MD_DOCS}) d USING (source_file)")
def c9_chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(d.md_docs(spark, sf)).select("source_file", "chunk_no", "tokens", _md5("content"), "symbol", "section_title", "chapter")


@query(ORACLE_SQL["c9_chunk_documents"])
def c9_chunk_documents_with(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a counter of strings, as a BPE encoder would be."""
    import re

    pieces = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n\f]")
    return chunking.chunk_documents_with(d.md_docs(spark, sf), lambda s: len(pieces.findall(s))).select("source_file", "chunk_no", "tokens", _md5("content"), "symbol", "section_title", "chapter")


@query()
def c9_chunk_bpe_documents(spark: SparkSession, sf: str) -> DataFrame:
    """With a budget of byte-pair tokens."""
    import public_tokenizers

    counter = BpeCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return chunking.chunk_documents_with(d.md_docs(spark, sf), counter).select("source_file", "chunk_no", "tokens", _md5("content"), "symbol", "section_title", "chapter")


# Code -------------------------------------------------------------------------

_LINES = "lines AS (SELECT project, relative_path, string_split(content, chr(10)) AS ls, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM f)"
# Calls through an object, with a name space, and of capitalised names.
_PATTERNS = [r"(\w+)\s*(?:->|\.)\s*(\w+)\s*\([^)]*\)", r"(\w+(?:::\w+)+)\s*\([^)]*\)", r"\b([A-Z]\w+)\s*\([^)]*\)"]
_BEFORE = "string_split(m, '(')[1]"
_CALLS_SQL = f"""f AS ({d.CPP_FILES}), {_LINES}, live AS (SELECT * FROM lines WHERE NOT (trim(line) LIKE '//%' OR trim(line) LIKE '/*%')),
hits AS (SELECT project, relative_path, n, line, ls, 1 AS p, unnest(regexp_extract_all(line, '{_PATTERNS[0]}')) AS m, unnest(regexp_extract_all(line, '{_PATTERNS[0]}', 2)) AS g, generate_subscripts(regexp_extract_all(line, '{_PATTERNS[0]}'), 1) AS k FROM live
  UNION ALL SELECT project, relative_path, n, line, ls, 2, unnest(regexp_extract_all(line, '{_PATTERNS[1]}')), '', generate_subscripts(regexp_extract_all(line, '{_PATTERNS[1]}'), 1) FROM live
  UNION ALL SELECT project, relative_path, n, line, ls, 3, unnest(regexp_extract_all(line, '{_PATTERNS[2]}')), unnest(regexp_extract_all(line, '{_PATTERNS[2]}', 1)), generate_subscripts(regexp_extract_all(line, '{_PATTERNS[2]}'), 1) FROM live),
named AS (SELECT *, CASE WHEN contains(m, '::') THEN {_BEFORE} WHEN contains(m, '->') OR contains(m, '.') THEN g ELSE {_BEFORE} END AS api_name FROM hits),
calls AS (SELECT project, relative_path, api_name, CAST(n AS INTEGER) AS line_number, trim(line, ' ' || chr(9)) AS full_statement, any_value(ls) AS ls, min(p * 1000 + k) AS seq FROM named GROUP BY ALL)"""


@query(f"WITH {_CALLS_SQL} SELECT relative_path, api_name, line_number, full_statement FROM calls")
def d7_api_calls(spark: SparkSession, sf: str) -> DataFrame:
    return code.api_calls(d.cpp_files(spark, sf)).select("relative_path", "api_name", "line_number", "full_statement")


_CONTEXT = "array_to_string(ls[greatest(1, {0} - 5):{0} + 5], chr(10))"


@query(f"WITH f AS ({d.CPP_FILES}), {_LINES} SELECT relative_path, CAST(n AS INTEGER) AS line_number, {_CONTEXT.format('n')} AS context FROM lines")
def d8_with_context(spark: SparkSession, sf: str) -> DataFrame:
    files = d.cpp_files(spark, sf)
    rows = files.withColumn("line_number", F.explode(F.sequence(F.lit(1), F.size(F.split("content", "\n", -1)))))
    return code.with_context(rows).select("relative_path", "line_number", "context")


_FIRST = f"{_CALLS_SQL}, firsts AS (SELECT *, row_number() OVER (PARTITION BY relative_path, api_name ORDER BY line_number, seq) AS r FROM calls), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY relative_path ORDER BY line_number, seq) - 1 AS INTEGER) AS call_no FROM firsts WHERE r = 1)"


@query(f"WITH {_FIRST} SELECT relative_path, call_no, api_name, line_number FROM top WHERE call_no < 8")
def d9_first_calls(spark: SparkSession, sf: str) -> DataFrame:
    return code.first_calls(d.cpp_files(spark, sf), per_file=8).select("relative_path", "call_no", "api_name", "line_number")


_API_TEXT = f"'API 调用示例: ' || api_name || chr(10) || '文件: ' || relative_path || chr(10) || '工程: ' || project || chr(10) || '行号: ' || line_number || chr(10) || chr(10) || '调用上下文:' || chr(10) || '```cpp' || chr(10) || {_CONTEXT.format('line_number')} || chr(10) || '```' || chr(10) || chr(10) || '调用语句:' || chr(10) || full_statement || chr(10)"


@query(f"WITH {_FIRST} SELECT relative_path, call_no, {_API_TEXT} AS content FROM top WHERE call_no < 20")
def d11_format_api_calls(spark: SparkSession, sf: str) -> DataFrame:
    return code.format_api_calls(code.first_calls(d.cpp_files(spark, sf))).select("relative_path", "call_no", "content")


_DECLS = f"""f AS ({d.HEADER_FILES}), {_LINES}, decls AS (SELECT *, regexp_extract(line, '^\\s*((?:[\\w:*&<>]+\\s+)+\\w+\\s*\\([^)]*\\)(?:\\s*const)?)\\s*;', 1) AS signature, regexp_extract(line, '(\\w+)\\s*\\([^)]*\\)', 1) AS name FROM lines)"""


@query(f"WITH {_DECLS} SELECT relative_path, name, signature, CAST(n AS INTEGER) AS line_start FROM decls WHERE signature <> ''")
def d2_cpp_declarations(spark: SparkSession, sf: str) -> DataFrame:
    return code.cpp_declarations(d.header_files(spark, sf)).select("relative_path", "name", "signature", "line_start")


_SOURCE = "SELECT 'proj' || (s_suppkey % 3) AS project, 'src/w' || s_suppkey || '.cpp' AS relative_path, {0} FROM supplier"
_GET_BODY = r"""'{' || chr(10) || '  if (a) { return ''{''; }' || chr(10) || '  else if (x) {' || chr(10) || '    call();' || chr(10) || '  }' || chr(10) || '  return a;' || chr(10) || '}'"""


@query(_SOURCE.format("0 AS order_no, 'W' || s_suppkey AS name, 'class' AS kind, 'class W' || s_suppkey || ' : public Q' AS signature, '{' || chr(10) || '  int x;' || chr(10) || '}' AS body, CAST(NULL AS VARCHAR) AS class_name, 1 AS line_start, 3 AS line_end"))
def d3_cpp_classes(spark: SparkSession, sf: str) -> DataFrame:
    return code.cpp_classes(d.source_files(spark, sf)).drop("ext")


@query(_SOURCE.format(f"1 AS order_no, 'get' AS name, 'method' AS kind, 'int W' || s_suppkey || '::get(int a)' AS signature, {_GET_BODY} AS body, 'W' || s_suppkey AS class_name, 4 AS line_start, 11 AS line_end") + " UNION ALL " + _SOURCE.format("2, 'free' || s_suppkey, 'function', 'static void free' || s_suppkey || '()', '{}', NULL, 12, 12"))
def d4_d6_cpp_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Functions with bodies by matching braces, and their lines."""
    return code.cpp_functions(d.source_files(spark, sf)).drop("ext")


@query(f"WITH {_DECLS} SELECT relative_path, name, '文件: ' || relative_path || chr(10) || '工程: ' || project || chr(10) || chr(10) || signature AS content FROM decls WHERE signature <> ''")
def d10_format_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return code.format_symbols(code.cpp_declarations(d.header_files(spark, sf))).select("relative_path", "name", "content")


@query(f"WITH {_DECLS} SELECT f.relative_path, regexp_replace(regexp_replace(f.relative_path, '.*/', ''), '\\.[^.]*$', '') AS symbol, CASE WHEN length(f.content) > 200 THEN substr(f.content, 1, 197) || '...' ELSE f.content END AS content FROM f WHERE relative_path NOT IN (SELECT relative_path FROM decls WHERE signature <> '')")
def d12_header_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return code.header_fallback(d.header_files(spark, sf), 200).select("relative_path", "symbol", "content")


@query("SELECT doc_id, md5(CASE WHEN length(text) > 1500 THEN substr(text, 1, 1497) || '...' ELSE text END) AS text_md5 FROM documents")
def d13_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "documents").select("doc_id", _md5(t.truncate("text", 1500), "text_md5"))


@query("SELECT doc_id, substr(md5(text), 1, 12) AS hash FROM documents")
def d14_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "documents").select("doc_id", t.content_hash("text").alias("hash"))


_WIDGET = "SELECT 'ui/d' || s_suppkey || '.ui' AS relative_path, {0} FROM supplier"


@query(" UNION ALL ".join(_WIDGET.format(x) for x in (
    "0 AS node_no, CAST(NULL AS INTEGER) AS parent_no, 0 AS depth, 'Dlg' || s_suppkey AS object_name, 'QDialog' AS class_name, CAST(NULL AS INTEGER) AS row, CAST(NULL AS INTEGER) AS column, '{}' AS properties",
    "1, 0, 1, 'ok', 'QPushButton', 0, 1, '{\"text\":\"' || s_name || '\"}'", "2, 0, 1, 'f', 'QFrame', NULL, NULL, '{}'")))
def d15_ui_widgets(spark: SparkSession, sf: str) -> DataFrame:
    return code.ui_widgets(d.ui_files(spark, sf)).select("relative_path", "node_no", "parent_no", "depth", "object_name", "class_name", "row", "column", F.to_json("properties").alias("properties"))


@query("SELECT 'ui/d' || s_suppkey || '.ui' AS relative_path, 'ok' AS sender, 'clicked()' AS signal, 'Dlg' AS receiver, 'accept()' AS slot FROM supplier")
def d16_ui_connections(spark: SparkSession, sf: str) -> DataFrame:
    return code.ui_connections(d.ui_files(spark, sf)).select("relative_path", "sender", "signal", "receiver", "slot")


@query("SELECT 'ui/d' || s_suppkey || '.ui' AS relative_path, 'Dlg' || s_suppkey AS symbol, 'Qt UI 文件: ui/d' || s_suppkey || '.ui' || chr(10) || '工程: proj' || (s_suppkey % 3) || chr(10) || '类名: Dlg' || s_suppkey || chr(10) || chr(10) || '控件层级结构:' || chr(10) || '- QDialog (objectName: Dlg' || s_suppkey || ')' || chr(10) || '  - QPushButton (objectName: ok)' || chr(10) || '    text: ' || s_name || chr(10) || '  - QFrame (objectName: f)' || chr(10) || chr(10) || '信号槽连接:' || chr(10) || '  ok.clicked() -> Dlg.accept()' AS content FROM supplier")
def d17_ui_structure_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return code.ui_structure_chunks(d.ui_files(spark, sf)).select("relative_path", "symbol", "content")


_WIDGETS = "SELECT 'proj' AS project, 'ui/t' || (p_partkey // 30) AS relative_path, '.ui' AS ext, CAST(p_partkey AS INTEGER) AS node_no, CASE WHEN p_size % 7 = 0 THEN '' ELSE 'w' || p_partkey END AS object_name, CASE WHEN p_size % 5 = 0 THEN 'QFrame' ELSE 'QLabel' END AS class_name, p_name FROM part"


@query(f"SELECT relative_path, node_no, object_name AS symbol, 'UI 控件: ' || object_name || chr(10) || '类型: ' || class_name || chr(10) || '文件: ' || relative_path || chr(10) || chr(10) || '属性:' || chr(10) || '  text: ' || p_name || chr(10) AS content FROM (SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY node_no) AS r FROM ({_WIDGETS}) WHERE object_name <> '' AND class_name <> 'QFrame') WHERE r <= 10")
def d18_ui_widget_chunks(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    widgets = load_table(spark, sf, "part").select(F.lit("proj").alias("project"), F.concat(F.lit("ui/t"), F.floor(n / 30).cast("string")).alias("relative_path"), F.lit(".ui").alias("ext"), n.cast("int").alias("node_no"), F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("w"), n.cast("string"))).alias("object_name"), F.when(F.col("p_size") % 5 == 0, F.lit("QFrame")).otherwise(F.lit("QLabel")).alias("class_name"), F.create_map(F.lit("text"), "p_name").alias("properties"))
    return code.widget_chunks(widgets).select("relative_path", "node_no", "symbol", "content")


_EXPORTS = f"""f AS ({d.DEF_FILES}), tails AS (SELECT project, relative_path, regexp_split_to_array(content, '(?im)^\\s*EXPORTS\\s*$')[2] AS content FROM f), {_LINES.replace('FROM f)', 'FROM tails)')},
stripped AS (SELECT project, relative_path, n, {strip_sql('line')} AS s FROM lines), stops AS (SELECT relative_path, min(n) AS stop FROM stripped WHERE regexp_matches(s, '(?i)^(LIBRARY|NAME|DESCRIPTION|STACKSIZE|HEAPSIZE|VERSION|SECTIONS)\\b') GROUP BY 1),
exports AS (SELECT project, relative_path, n, s, CAST(row_number() OVER (PARTITION BY relative_path ORDER BY n) - 1 AS INTEGER) AS pos FROM stripped LEFT JOIN stops USING (relative_path) WHERE (stop IS NULL OR n < stop) AND s <> '' AND s NOT LIKE ';%' AND regexp_matches(s, '(?i)^(\\w+)(?:\\s*@\\s*([0-9]+))?(?:\\s+NONAME)?(?:\\s+(DATA))?(?:\\s+PRIVATE)?$'))"""


@query(f"WITH {_EXPORTS} SELECT relative_path, pos, regexp_extract(s, '^\\w+') AS name, TRY_CAST(regexp_extract(s, '@\\s*([0-9]+)', 1) AS INTEGER) AS ordinal, regexp_matches(s, '(?i)\\sDATA\\b') AS is_data FROM exports")
def d19_def_exports(spark: SparkSession, sf: str) -> DataFrame:
    return code.def_exports(d.def_files(spark, sf)).select("relative_path", "pos", "name", "ordinal", "is_data")


_EXPORT_TEXT = "'导出符号列表' || chr(10) || '文件: ' || relative_path || chr(10) || '工程: ' || project || chr(10) || chr(10) || '共 ' || count(*) || ' 个导出符号:' || chr(10) || string_agg('- ' || regexp_extract(s, '^\\w+'), chr(10) ORDER BY pos) FILTER (WHERE pos < 50) || chr(10) || CASE WHEN count(*) > 50 THEN '...' ELSE '' END || chr(10)"


@query(f"WITH {_EXPORTS} SELECT relative_path, 'exports' AS symbol, CAST(count(*) AS INTEGER) AS n_exports, {_EXPORT_TEXT} AS content FROM exports GROUP BY project, relative_path")
def d20_exports_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return code.exports_chunks(d.def_files(spark, sf)).select("relative_path", "symbol", "n_exports", "content")


_FIRST_WORDS = "'" + "', '".join(code._FIRST_WORDS) + "'"
_COMMANDS_SQL = f"""f AS ({d.SCRIPT_FILES}), {_LINES},
marked AS (SELECT project, relative_path, n, {strip_sql('line')} AS s FROM lines),
kinds AS (SELECT *, regexp_matches(s, '^(#|//|;)|(?i)^REM\\b') AS comment, {strip_sql("regexp_replace(s, '^#|^//|(?i)^REM\\b|^;', '')")} AS about FROM marked WHERE s <> ''),
flags AS (SELECT *, NOT comment AND (regexp_matches(s, '(?i)\\b(run|execute|build|compile|test|start|call|invoke)\\b|\\b(msbuild|devenv|cmake|make|nmake)\\b|\\b(python|node|npm|pip)\\b|\\.exe\\b|--\\w+|-[a-zA-Z]') OR lower(regexp_extract(s, '^\\S+')) IN ({_FIRST_WORDS})) AS command FROM kinds),
groups AS (SELECT *, coalesce(sum(CAST(command AS INTEGER)) OVER (PARTITION BY relative_path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM flags),
pending AS (SELECT *, last_value(CASE WHEN comment AND about <> '' THEN about END IGNORE NULLS) OVER (PARTITION BY relative_path, g ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS description FROM groups),
commands AS (SELECT project, relative_path, CAST(n AS INTEGER) AS line_number, s AS command, coalesce(description, '') AS description FROM pending WHERE command)"""


@query(f"WITH {_COMMANDS_SQL} SELECT relative_path, line_number, command, description FROM commands")
def d21_script_commands(spark: SparkSession, sf: str) -> DataFrame:
    return code.script_commands(d.script_files(spark, sf)).select("relative_path", "line_number", "command", "description")


_SCRIPT_TEXT = "'命令脚本: ' || relative_path || chr(10) || '工程: ' || project || chr(10) || chr(10) || '命令列表:' || chr(10) || string_agg(CASE WHEN description <> '' THEN chr(10) || '# ' || description || chr(10) ELSE '' END || command || chr(10), '' ORDER BY line_number)"
_STEM = "regexp_replace(regexp_replace(relative_path, '.*/', ''), '\\.[^.]*$', '')"


@query(f"WITH {_COMMANDS_SQL} SELECT relative_path, {_STEM} AS symbol, CAST(count(*) AS INTEGER) AS n_commands, {_SCRIPT_TEXT} AS content FROM commands GROUP BY project, relative_path HAVING count(*) >= 9")
def d22_script_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return code.script_chunks(d.script_files(spark, sf), 9).select("relative_path", "symbol", "n_commands", "content")


@query(f"WITH {_EXPORTS}, x AS (SELECT project, relative_path, {_EXPORT_TEXT} AS content FROM exports GROUP BY project, relative_path) SELECT 'demo' AS source_type, project AS demo_name, relative_path AS file_path, '.def' AS ext, 'exports' AS symbol, 'exports' AS chunk_type, 'cpp' AS language, substr(md5(content), 1, 12) AS hash FROM x")
def d23_code_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return code.with_code_metadata(code.exports_chunks(d.def_files(spark, sf)), "exports", "cpp").select("source_type", "demo_name", "file_path", "ext", "symbol", "chunk_type", "language", "hash")


_D1 = f"""WITH e AS (WITH {_EXPORTS} SELECT relative_path, 'exports' AS chunk_type, 0 AS chunk_no, 'exports' AS symbol, md5({_EXPORT_TEXT}) AS content_md5 FROM exports GROUP BY project, relative_path),
 s AS (WITH {_COMMANDS_SQL} SELECT relative_path, 'command', 0, {_STEM}, md5({_SCRIPT_TEXT}) FROM commands GROUP BY project, relative_path),
 a AS (WITH {_FIRST} SELECT relative_path, 'call_snippet', call_no, api_name, md5({_API_TEXT}) FROM top WHERE call_no < 20),
 h AS (WITH {_DECLS}, hd AS (SELECT relative_path, 'function' AS kind, CAST(row_number() OVER (PARTITION BY relative_path ORDER BY n) - 1 AS INTEGER) AS no, name, md5('文件: ' || relative_path || chr(10) || '工程: ' || project || chr(10) || chr(10) || signature) AS h FROM decls WHERE signature <> '')
   SELECT * FROM hd UNION ALL SELECT relative_path, 'function', 0, {_STEM}, md5(CASE WHEN length(content) > 2000 THEN substr(content, 1, 1997) || '...' ELSE content END) FROM f WHERE relative_path NOT IN (SELECT relative_path FROM hd))
SELECT * FROM e UNION ALL SELECT * FROM s UNION ALL SELECT * FROM a UNION ALL SELECT * FROM h"""


@query(_D1)
def d1_chunk_code(spark: SparkSession, sf: str) -> DataFrame:
    files = d.def_files(spark, sf)
    for more in (d.script_files, d.cpp_files, d.header_files):
        files = files.unionByName(more(spark, sf))
    return code.chunk_code(files).select("relative_path", "chunk_type", "chunk_no", "symbol", _md5("content"))


@query()
def d1_chunk_all_code(spark: SparkSession, sf: str) -> DataFrame:
    """Every kind of source file, definitions and widgets included."""
    return code.chunk_code(d.code_files(spark, sf)).select("relative_path", "chunk_type", "chunk_no", "symbol", "class_name", "line_number", _md5("content"))


# Embedding --------------------------------------------------------------------


@query("SELECT doc_id, md5(substr(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g'), 1, 15000)) AS text_md5 FROM documents")
def e1_clean_embed_text(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "documents").select("doc_id", _md5(t.clean_embed_text("text"), "text_md5"))


def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    return embed.embed_chunks(d.doc_chunks(spark, sf), embed.hashing_embedder(64))


@query()
def e2_embed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _embedded(spark, sf).select("chunk_id", F.size("vector").alias("dimension"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimension FROM embeddings WHERE len(embedding) - CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 0 END <> 64")
def e3_check_dimension(spark: SparkSession, sf: str) -> DataFrame:
    vectors = load_table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("vector"))
    return embed.check_dimension(vectors, 64).select("vec_id", (F.size("vector") + 1).alias("dimension"))


@query()
def e4_embed_queries(spark: SparkSession, sf: str) -> DataFrame:
    questions = load_table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return embed.embed_queries(questions, embed.hashing_embedder(64)).select("conv_id", "turn", F.size("vector").alias("dimension"))


def _letters(texts: list[str]):
    """How often each letter from a to z occurs: an embedding that SQL can follow."""
    import numpy as np

    return np.array([[t.count(chr(97 + n)) for n in range(26)] for t in texts], np.float32).reshape(-1, 26)


_CLEAN = r"substr(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^ | $', '', 'g'), 1, 15000)"
_LETTERS = "array_to_string(list_transform(range(26), lambda n: length(c) - length(replace(c, chr(CAST(97 + n AS INTEGER)), ''))), ',') AS letters"


def _counts() -> Column:
    return F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("letters")


@query(_CHUNKS_SQL + f"SELECT chunk_id, {_LETTERS} FROM (SELECT sha256('chm' || chr(31) || source_file || chr(31) || chunk_no) AS chunk_id, {_CLEAN.format('content')} AS c FROM final)")
def e2_embed_letters(spark: SparkSession, sf: str) -> DataFrame:
    return embed.embed_chunks(d.doc_chunks(spark, sf), _letters).select("chunk_id", _counts())


@query(ORACLE_SQL["e2_embed_letters"])
def e2_embed_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The same with each distinct text embedded once."""
    return embed.embed_distinct(d.doc_chunks(spark, sf), _letters).select("chunk_id", _counts())


@query(f"SELECT conv_id, turn, {_LETTERS} FROM (SELECT conv_id, turn, {_CLEAN.format('text')} AS c FROM conversations WHERE role = 'user')")
def e4_embed_letters(spark: SparkSession, sf: str) -> DataFrame:
    questions = load_table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return embed.embed_queries(questions, _letters).select("conv_id", "turn", _counts())


# Search -----------------------------------------------------------------------


@query("""WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings),
 u AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN norm > 0 THEN CAST(x AS DOUBLE) / norm ELSE CAST(x AS DOUBLE) END) AS v FROM n)
SELECT vec_id, list_sum(list_transform(v, lambda x: x * x)) > 0 AS nonzero, round(v[1], 5) AS first, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS length FROM u""")
def v1_l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    unit = load_table(spark, sf, "embeddings").select("vec_id", search.l2_normalize("embedding").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return unit.select("vec_id", (square > 0).alias("nonzero"), F.round(F.get("v", 0), 5).alias("first"), F.round(F.sqrt(square), 4).alias("length"))


_SCORED = f"""x AS ({d.VECTOR_INDEX}), q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, x.* EXCLUDE (vector), list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(vector AS DOUBLE[])) AS sim FROM q, x)"""
_EXACT = f"WITH {_SCORED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS INTEGER) AS rank FROM s WHERE {{0}})"


def _ranked(results: DataFrame) -> DataFrame:
    return results.select("query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


@query(_EXACT.format("TRUE") + " SELECT query_id, chunk_id, round(sim, 5) AS score, rank FROM r WHERE rank <= 10")
def v2_search(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search.search(d.vector_queries(spark, sf), d.vector_index(spark, sf), 10))


@query(ORACLE_SQL["v2_search"])
def v2_search_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The same over vectors laid out by centroids, of which far ones are skipped."""
    index = d.vector_index(spark, sf)
    return _ranked(layout.nearest_in(d.vector_queries(spark, sf), layout.lay_out(index.select("chunk_id", "vector"), 32), 10))


@query(_EXACT.format("label IN (1, 4, 6) AND source_type = 'chm'") + " SELECT query_id, chunk_id, round(sim, 5) AS score, rank FROM r WHERE rank <= 10")
def v3_filtered_search(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search.search(d.vector_queries(spark, sf), d.vector_index(spark, sf), 10, {"label": [1, 4, 6], "source_type": "chm"}))


_POST = f"WITH {_SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS near FROM s), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY near) AS INTEGER) AS rank FROM o WHERE near <= 30 AND {{0}})"


@query(_POST.format("source_type = 'demo'") + " SELECT query_id, chunk_id, round(sim, 5) AS score, rank FROM r WHERE rank <= 10")
def v4_v5_post_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Filtering after the search, ranks counted anew."""
    return _ranked(search.search(d.vector_queries(spark, sf), d.vector_index(spark, sf), 10, source="demo", filter_mode="post"))


@query(_EXACT.format("source_type = 'demo'") + " SELECT query_id, chunk_id, round(sim, 5) AS score, rank FROM r WHERE rank <= 5")
def v6_source_search(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search.search(d.vector_queries(spark, sf), d.vector_index(spark, sf), 5, source="demo"))


@query(f"SELECT count(*) AS total_chunks, count(*) FILTER (WHERE source_type = 'demo') AS demo_chunks, count(*) FILTER (WHERE source_type IS DISTINCT FROM 'demo') AS chm_chunks, CAST(max(len(vector)) AS INTEGER) AS embedding_dimension FROM ({d.VECTOR_INDEX})")
def v7_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return idx.index_stats(d.vector_index(spark, sf))


@query(f"WITH s AS ({_SCAN}) SELECT 'total' AS grain, NULL AS key, count(*) AS n FROM s UNION ALL SELECT 'ext', ext, count(*) FROM s GROUP BY ext UNION ALL SELECT 'project', project, count(*) FROM s GROUP BY project")
def v8_file_stats(spark: SparkSession, sf: str) -> DataFrame:
    return idx.file_stats(sources.project_files(d.part_paths(spark, sf)))


@query(_EXACT.format("TRUE") + " SELECT query_id, rank, CASE WHEN coalesce(source_type, 'chm') = 'chm' THEN 'CHM' ELSE 'Demo' END AS label, printf('%.4f', sim) AS score, substr(symbol, 1, 20) AS symbol, CASE WHEN length(file) > 35 THEN '...' || right(file, 32) ELSE file END AS file FROM (SELECT *, coalesce(nullif(file_path, ''), nullif(chapter, ''), source_file, '-') AS file FROM r) WHERE rank <= 10")
def v9_citations(spark: SparkSession, sf: str) -> DataFrame:
    return search.citations(search.search(d.vector_queries(spark, sf), d.vector_index(spark, sf), 10))


# Prompts ----------------------------------------------------------------------

_CONTEXT_SQL = """c AS (SELECT query_id, string_agg(CASE WHEN coalesce(source_type, 'chm') = 'chm' THEN '【CHM】' ELSE '【Demo】' END || ' [片段 ' || rank || ']' || CASE WHEN info <> '' THEN ' (' || info || ')' ELSE '' END || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
 FROM (SELECT *, concat_ws(', ', '符号: ' || nullif(symbol, ''), '标题: ' || nullif(title, ''), '章节: ' || nullif(chapter, ''), '工程: ' || nullif(demo_name, ''), '文件: ' || nullif(file_path, '')) AS info FROM r WHERE rank <= 5) GROUP BY query_id)"""


@query(_EXACT.format("TRUE") + f", {_CONTEXT_SQL} SELECT query_id, context FROM c")
def q1_format_context(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.format_context(search.search(d.vector_queries(spark, sf), d.vector_index(spark, sf), 5))


_HISTORY = """h AS (SELECT conv_id, turn, CASE WHEN len(l) > 0 THEN '【对话历史】' || chr(10) || array_to_string(l, chr(10)) || chr(10) || chr(10) ELSE '' END AS history FROM
 (SELECT conv_id, turn, coalesce(list(line) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS l FROM
 (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS line FROM conversations)))"""


@query(f"WITH {_HISTORY} SELECT conv_id, turn, md5(history) AS history_md5 FROM h")
def q2_history_section(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.history_section(load_table(spark, sf, "conversations")).select("conv_id", "turn", _md5("history"))


_PROMPT = "'【参考文档片段】' || chr(10) || {0} || chr(10) || chr(10) || coalesce(history, '') || '【用户问题】' || chr(10) || question || chr(10) || chr(10) || {1}"
_ANSWER = "'Answer from the passages above and mark what they do not say.'"
_SUGGEST = "'No passage was found; mark the whole answer as a suggestion.'"


@query(_EXACT.format("source_type = 'demo'") + f", {_CONTEXT_SQL}, {_HISTORY}, t AS (SELECT conv_id || ':' || turn AS query_id, (conv_id + turn) // 50 * 50 AS vec, text AS question, history FROM conversations JOIN h USING (conv_id, turn) WHERE role = 'user') SELECT t.query_id, CASE WHEN context IS NULL THEN {_PROMPT.format(chr(39) + '(no passages)' + chr(39), _SUGGEST)} ELSE {_PROMPT.format('context', _ANSWER)} END AS prompt FROM t LEFT JOIN c ON c.query_id = t.vec")
def q3_build_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn is a question, with what was said before and the passages of one of the vector queries."""
    talks = load_table(spark, sf, "conversations")
    questions, history = _questions(talks)
    found = prompts.format_context(search.search(d.vector_queries(spark, sf), d.vector_index(spark, sf), 5, source="demo")).withColumnRenamed("query_id", "vec")
    asked = talks.where("role = 'user'").select(_query_id().alias("query_id"), (F.floor((F.col("conv_id") + F.col("turn")) / 50) * 50).alias("vec"))
    return prompts.build_prompts(questions, asked.join(found, "vec").select("query_id", "context"), history)


def _query_id() -> Column:
    return F.concat_ws(":", "conv_id", "turn")


def _questions(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The user turns as questions, and the history of each."""
    questions = talks.where("role = 'user'").select(_query_id().alias("query_id"), F.col("text").alias("question"))
    history = prompts.history_section(talks).select(_query_id().alias("query_id"), "history").join(questions.select("query_id"), "query_id", "left_semi")
    return questions, history


@query("SELECT conv_id, turn, session_no, CAST(row_number() OVER (PARTITION BY conv_id, session_no ORDER BY turn) AS INTEGER) AS position FROM (SELECT *, sum(CAST(role = 'system' AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS session_no FROM conversations) WHERE role <> 'system'")
def q4_session_history(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.session_history(load_table(spark, sf, "conversations"), F.col("role") == "system").select("conv_id", "turn", "session_no", "position")


# All of it --------------------------------------------------------------------


@query()
def w1_w3_pages_to_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages to chunks to an index on disk, then prompts for all user turns."""
    pages = load_table(spark, sf, "pages").withColumn("path", F.concat("url", F.lit("#"), F.col("page_id").cast("string")))
    good, _ = html.drop_empty(html.clean_html(pages))
    model = embed.hashing_embedder(64)
    chunks = chunking.to_chunks(chunking.chunk_documents(good), "chm", F.col("source_file"))
    path = new_path(spark, "index")
    idx.write_index(embed.embed_chunks(chunks, model), path)
    questions, history = _questions(load_table(spark, sf, "conversations"))
    results = search.search(embed.embed_queries(questions, model).select("query_id", "vector"), idx.load_index(spark, path), 5, source="chm")
    return prompts.build_prompts(questions, prompts.format_context(results), history).select("query_id", F.length("prompt").alias("n_chars"), _md5("prompt"))
