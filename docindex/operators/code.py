"""Source projects as chunks: declarations and definitions, API calls with context,
widget trees, export lists and command scripts. A file's finds stay arrays in its row
until they become chunks, so files are read once and nothing is shuffled."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, content_hash, is_blank, strip, truncate
from ..helpers import cpp, qt_ui
from ..session import attach, attach_active

HEADERS, SOURCES = (".h", ".hpp"), (".cpp", ".cc", ".cxx")
FILE = ["project", "relative_path", "ext"]
_SYMBOL = "array<struct<order_no:int,name:string,kind:string,signature:string,body:string,class_name:string,line_start:int,line_end:int>>"
_UI = "class_name string, version string, widgets array<struct<node_no:int,parent_no:int,depth:int,object_name:string,class_name:string,row:int,column:int,properties:map<string,string>>>, connections array<struct<sender:string,signal:string,receiver:string,slot:string>>, tree string"


def _parsed(content: Column, parse) -> Column:
    attach_active()

    @F.pandas_udf(_SYMBOL)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([parse(t) if t is not None else [] for t in texts], dtype=object)

    return run(content)


def _definitions(content: Column, keywords: bool = True) -> Column:
    return _parsed(content, lambda t: cpp.definitions(t, keywords))


def _declarations(content: Column, keywords: bool = True) -> Column:
    return _parsed(content, lambda t: cpp.declarations(t, keywords))


def _rows(df: DataFrame, array: Column) -> DataFrame:
    return df.select(*FILE, F.explode(array).alias("_s")).select(*FILE, "_s.*")


def cpp_declarations(df: DataFrame, exclude_keywords: bool = True) -> DataFrame:
    """Function declarations of headers: project, relative_path, ext, name, signature, lines."""
    return _rows(df.where(F.col("ext").isin(*HEADERS)), _declarations(F.col("content"), exclude_keywords))


def cpp_symbols(df: DataFrame, exclude_keywords: bool = True) -> DataFrame:
    """Classes and functions that sources define, with bodies and lines, by ``order_no``."""
    return _rows(df.where(F.col("ext").isin(*SOURCES)), _definitions(F.col("content"), exclude_keywords))


def cpp_classes(df: DataFrame) -> DataFrame:
    return cpp_symbols(df).where(F.col("kind").isin("class", "struct"))


def cpp_functions(df: DataFrame, exclude_keywords: bool = True) -> DataFrame:
    return cpp_symbols(df, exclude_keywords).where(F.col("kind").isin("function", "method"))


# Calls through an object, with a name space, and of capitalised names.
_ARGUMENTS = r"\s*+\([^)]*\)"
_CALLS = [
    rf"(?<!{WORD})({WORD}++)\s*+(?:->|\.)\s*+({WORD}++){_ARGUMENTS}",
    rf"(?<!{WORD})({WORD}++(?:::{WORD}++)++){_ARGUMENTS}",
    rf"(?<!{WORD})([A-Z]{WORD}++){_ARGUMENTS}",
]


def _call_names(line: Column) -> Column:
    """Names called in a line, by pattern, then by place, each once."""
    before = lambda m: F.substring_index(m, "(", 1)
    every = lambda n, group: F.regexp_extract_all(line, F.lit(_CALLS[n]), F.lit(group))
    member = F.zip_with(every(0, 0), every(0, 2), lambda m, name: F.when(m.contains("::"), before(m)).otherwise(name))
    spaced = F.transform(every(1, 0), before)
    plain = F.zip_with(every(2, 0), every(2, 1), lambda m, name: F.when(~m.contains("::") & (m.contains("->") | m.contains(".")), name).otherwise(before(m)))
    return F.array_distinct(F.concat(member, spaced, plain))


def _calls(content: Column) -> Column:
    """Array of (api_name, line_number, full_statement) of a file."""

    def of(line: Column, n: Column) -> Column:
        said = strip(line)
        comment = said.startswith("//") | said.startswith("/*")
        names = F.when(comment, F.array().cast("array<string>")).otherwise(_call_names(line))
        return F.transform(names, lambda a: F.struct(a.alias("api_name"), (n + 1).alias("line_number"), said.alias("full_statement")))

    return F.flatten(F.transform(F.split(content, "\n", -1), of))


def api_calls(df: DataFrame) -> DataFrame:
    """A row for each name and line of sources: FILE, call_no, api_name, line_number, full_statement."""
    sources = df.where(F.col("ext").isin(*SOURCES) & F.col("content").isNotNull())
    return sources.select(*FILE, F.posexplode(_calls(F.col("content"))).alias("call_no", "_c")).select(*FILE, "call_no", "_c.*")


def _context(lines: Column, number: Column, around: int) -> Column:
    start = F.greatest(number - around, F.lit(1))
    return F.array_join(F.slice(lines, start, number + around - start + 1), "\n")


def _first_calls(content: Column, per_file: int) -> Column:
    return F.slice(
        F.aggregate(_calls(content), F.array().cast("array<struct<api_name:string,line_number:int,full_statement:string>>"), lambda done, c: F.when((F.size(done) >= per_file) | F.exists(done, lambda d: d["api_name"] == c["api_name"]), done).otherwise(F.concat(done, F.array(c)))),
        1,
        per_file,
    )


def first_calls(df: DataFrame, per_file: int = 20, context_lines: int = 5) -> DataFrame:
    """The first call of each name in a file, at most ``per_file``, with ``context``;
    the context is cut only for calls that stay."""
    sources = df.where(F.col("ext").isin(*SOURCES) & F.col("content").isNotNull())
    picked = sources.select(*FILE, F.split("content", "\n", -1).alias("_lines"), F.posexplode(_first_calls(F.col("content"), per_file)).alias("call_no", "_c"))
    return picked.select(*FILE, "call_no", "_c.*", _context(F.col("_lines"), F.col("_c.line_number"), context_lines).alias("context"))


def with_context(df: DataFrame, context_lines: int = 5) -> DataFrame:
    """Add to rows with ``content`` and ``line_number`` the lines around that line."""
    return df.withColumn("context", _context(F.split("content", "\n", -1), F.col("line_number"), context_lines))


# The labels of chunk texts.
def format_symbol(path: Column, project: Column, owner: Column, signature: Column, body: Column) -> Column:
    """The text of a declaration or definition."""
    nothing = F.lit(None).cast("string")
    return F.concat_ws("\n", F.concat(F.lit("文件: "), path), F.concat(F.lit("工程: "), project), F.when(owner != "", F.concat(F.lit("类: "), owner)), F.lit(""), signature, F.when(body != "", truncate(body, 1500)).otherwise(nothing))


def format_api_call(path: Column, project: Column, name: Column, number: Column, context: Column, statement: Column) -> Column:
    parts = [F.lit("API 调用示例: "), name, F.lit("\n文件: "), path, F.lit("\n工程: "), project, F.lit("\n行号: "), number.cast("string"), F.lit("\n\n调用上下文:\n```cpp\n"), context, F.lit("\n```\n\n调用语句:\n"), statement, F.lit("\n")]
    return F.concat(*parts)


def format_symbols(df: DataFrame) -> DataFrame:
    return df.withColumn("content", format_symbol(F.col("relative_path"), F.col("project"), F.col("class_name"), F.col("signature"), F.col("body")))


def format_api_calls(df: DataFrame) -> DataFrame:
    return df.withColumn("content", format_api_call(F.col("relative_path"), F.col("project"), F.col("api_name"), F.col("line_number"), F.col("context"), F.col("full_statement")))


def stem(path: Column) -> Column:
    """A file's name without directories and last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(.)\.[^.]*$", "$1")


def with_code_metadata(df: DataFrame, chunk_type: str, language: str) -> DataFrame:
    """The columns that a code chunk has besides content and symbol."""
    return df.withColumns({"source_type": F.lit("demo"), "demo_name": F.col("project"), "file_path": F.col("relative_path"), "chunk_type": F.lit(chunk_type), "language": F.lit(language), "hash": content_hash("content")})


# Export lists -----------------------------------------------------------------

# Section keywords and the form of an exported symbol.
_STOP = r"(?i)^(LIBRARY|NAME|DESCRIPTION|STACKSIZE|HEAPSIZE|VERSION|SECTIONS)\b"
_EXPORT = rf"(?i)^({WORD}+)(?:\s*@\s*([0-9]+))?(?:\s+NONAME)?(?:\s+(DATA))?(?:\s+PRIVATE)?$"


def _exports(content: Column) -> Column:
    """Array of (name, ordinal, is_data): lines after the first lone EXPORTS, up to the next section."""
    tail = F.get(F.split(content, r"(?im)^\s*EXPORTS\s*$", 2), 1)
    lines = F.filter(F.transform(F.split(F.coalesce(tail, F.lit("")), "\n", -1), strip), lambda s: (s != "") & ~s.startswith(";"))
    stop = F.array_position(F.transform(lines, lambda s: s.rlike(_STOP)), F.lit(True)).cast("int")
    ours = F.filter(F.when(stop > 0, F.slice(lines, 1, stop - 1)).otherwise(lines), lambda s: s.rlike(_EXPORT))
    group = lambda s, n: F.nullif(F.regexp_extract(s, _EXPORT, n), F.lit(""))
    return F.transform(ours, lambda s: F.struct(group(s, 1).alias("name"), group(s, 2).cast("int").alias("ordinal"), group(s, 3).isNotNull().alias("is_data")))


def def_exports(df: DataFrame) -> DataFrame:
    """FILE, pos, name, ordinal, is_data of module definition files."""
    rows = df.where("ext = '.def' and content is not null").select(*FILE, F.posexplode(_exports(F.col("content"))).alias("pos", "_e"))
    return rows.select(*FILE, "pos", "_e.*")


def _exports_text(path: Column, project: Column, names: Column, shown: int) -> Column:
    listed = F.array_join(F.transform(F.slice(names, 1, shown), lambda n: F.concat(F.lit("- "), n)), "\n")
    more = F.when(F.size(names) > shown, F.lit("...")).otherwise(F.lit(""))
    return F.concat(F.lit("导出符号列表\n文件: "), path, F.lit("\n工程: "), project, F.lit("\n\n共 "), F.size(names).cast("string"), F.lit(" 个导出符号:\n"), listed, F.lit("\n"), more, F.lit("\n"))


def exports_chunks(df: DataFrame, shown: int = 50) -> DataFrame:
    """One chunk for each file with exports: FILE, symbol, content, n_exports."""
    names = df.where("ext = '.def' and content is not null").withColumn("_n", F.transform(_exports(F.col("content")), lambda e: e["name"])).where(F.size("_n") > 0)
    return names.select(*FILE, F.lit("exports").alias("symbol"), _exports_text(F.col("relative_path"), F.col("project"), F.col("_n"), shown).alias("content"), F.size("_n").alias("n_exports"))


# Command scripts --------------------------------------------------------------

# Comment marks, signs of a command, first words of one.
_COMMENTS = [r"^\s*#", r"^\s*//", r"(?i)^\s*REM\b", r"^\s*;"]
_COMMAND = r"(?i)\b(run|execute|build|compile|test|start|call|invoke)\b|\b(msbuild|devenv|cmake|make|nmake)\b|\b(python|node|npm|pip)\b|\.exe\b|--\w+|-[a-zA-Z]"
_FIRST_WORDS = ["cd", "dir", "ls", "echo", "set", "export", "copy", "move", "del", "rm", "mkdir", "rmdir", "call", "start", "if", "for", "goto"]


def _commands(content: Column) -> Column:
    """Array of (line_number, command, description): a comment describes the next command."""

    def look(line: Column, n: Column) -> Column:
        said = strip(line)
        about = said
        for mark in _COMMENTS:
            about = strip(F.regexp_replace(about, mark, ""))
        comment = F.lit(False)
        for mark in _COMMENTS:
            comment |= said.rlike(mark)
        command = said.rlike(_COMMAND) | F.lower(F.regexp_extract(said, r"(?U)^\S+", 0)).isin(_FIRST_WORDS)
        return F.struct((n + 1).alias("line_number"), said.alias("said"), comment.alias("comment"), about.alias("about"), (~comment & command).alias("command"))

    start = F.struct(F.lit("").alias("pending"), F.array().cast("array<struct<line_number:int,command:string,description:string>>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        pending = F.when(line["comment"], F.when(line["about"] != "", line["about"]).otherwise(s["pending"])).when(line["command"], F.lit("")).otherwise(s["pending"])
        one = F.array(F.struct(line["line_number"].alias("line_number"), line["said"].alias("command"), s["pending"].alias("description")))
        return F.struct(pending.alias("pending"), F.when(line["command"], F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.transform(F.split(content, "\n", -1), look), start, step)["out"]


def script_commands(df: DataFrame) -> DataFrame:
    """FILE, line_number, command, description of command scripts."""
    return _rows(df.where("ext = '.tcmd' and content is not null"), _commands(F.col("content")))


def _script_text(path: Column, project: Column, commands: Column) -> Column:
    one = lambda c: F.concat(F.when(c["description"] != "", F.concat(F.lit("\n# "), c["description"], F.lit("\n"))).otherwise(F.lit("")), c["command"], F.lit("\n"))
    return F.concat(F.lit("命令脚本: "), path, F.lit("\n工程: "), project, F.lit("\n\n命令列表:\n"), F.array_join(F.transform(commands, one), ""))


def script_chunks(df: DataFrame, min_commands: int = 1) -> DataFrame:
    """One chunk for each script of at least ``min_commands`` commands: FILE, symbol, content, n_commands."""
    found = df.where("ext = '.tcmd' and content is not null").withColumn("_c", _commands(F.col("content"))).where(F.size("_c") >= max(min_commands, 1))
    return found.select(*FILE, stem(F.col("relative_path")).alias("symbol"), _script_text(F.col("relative_path"), F.col("project"), F.col("_c")).alias("content"), F.size("_c").alias("n_commands"))


# Widget files -----------------------------------------------------------------


def parse_ui(df: DataFrame, dedupe: bool = True) -> DataFrame:
    """Add ``ui`` to widget files (struct; null class_name where the file is no good)."""
    attach(df.sparkSession)

    @F.pandas_udf(_UI)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            got = qt_ui.parse(t, dedupe) if t is not None else None
            rows.append((None, None, [], [], None) if got is None else (got["class_name"], got["version"], got["widgets"], got["connections"], qt_ui.tree_text(got["widgets"])))
        return pd.DataFrame(rows, columns=["class_name", "version", "widgets", "connections", "tree"])

    return df.where("ext = '.ui'").withColumn("ui", run("content"))


def ui_widgets(df: DataFrame, dedupe: bool = True) -> DataFrame:
    """FILE, node_no, parent_no, depth, object_name, class_name, row, column, properties, in preorder."""
    return _rows(parse_ui(df, dedupe), F.col("ui.widgets"))


def ui_connections(df: DataFrame) -> DataFrame:
    return _rows(parse_ui(df), F.col("ui.connections"))


def _structure_text() -> Column:
    links = F.transform("ui.connections", lambda c: F.concat(F.lit("\n  "), c["sender"], F.lit("."), c["signal"], F.lit(" -> "), c["receiver"], F.lit("."), c["slot"]))
    tail = F.when(F.size("ui.connections") > 0, F.concat(F.lit("\n\n信号槽连接:"), F.array_join(links, ""))).otherwise(F.lit(""))
    return F.concat(F.lit("Qt UI 文件: "), F.col("relative_path"), F.lit("\n工程: "), F.col("project"), F.lit("\n类名: "), F.col("ui.class_name"), F.lit("\n\n控件层级结构:\n"), F.col("ui.tree"), tail)


def _structure_symbol() -> Column:
    return F.coalesce(F.nullif("ui.class_name", F.lit("")), stem(F.col("relative_path")))


def ui_structure_chunks(df: DataFrame, dedupe: bool = True) -> DataFrame:
    """The widget tree and connections of a file as text: FILE, symbol, content."""
    good = parse_ui(df, dedupe).where("ui.class_name is not null")
    return good.select(*FILE, _structure_symbol().alias("symbol"), _structure_text().alias("content"))


_PLAIN_WIDGETS = ["QWidget", "QFrame", "QGroupBox"]  # fixed values


def _important(widgets: Column, per_file: int) -> Column:
    return F.slice(F.filter(widgets, lambda w: (w["object_name"] != "") & ~w["class_name"].isin(_PLAIN_WIDGETS)), 1, per_file)


def _widget_text(path: Column, name: Column, kind: Column, properties: Column) -> Column:
    listed = F.array_join(F.transform(F.map_entries(properties), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"])), "\n")
    return F.concat(F.lit("UI 控件: "), name, F.lit("\n类型: "), kind, F.lit("\n文件: "), path, F.lit("\n\n属性:\n"), F.when(F.size(properties) > 0, listed).otherwise(F.lit("  (无)")), F.lit("\n"))


def widget_chunks(widgets: DataFrame, per_file: int = 10) -> DataFrame:
    """Of a widget table (FILE, node_no, object_name, class_name, properties) the first
    ``per_file`` named widgets of a file that aren't mere containers, as chunks."""
    one = F.struct("node_no", "object_name", "class_name", F.map_entries("properties").alias("properties"))
    files = widgets.where((F.col("object_name") != "") & ~F.col("class_name").isin(_PLAIN_WIDGETS)).groupBy(*FILE).agg(F.slice(F.array_sort(F.collect_list(one)), 1, per_file).alias("_w"))
    rows = files.select(*FILE, F.explode("_w").alias("w"))
    return rows.select(*FILE, F.col("w.node_no"), F.col("w.object_name").alias("symbol"), _widget_text(F.col("relative_path"), F.col("w.object_name"), F.col("w.class_name"), F.map_from_entries("w.properties")).alias("content"))


def ui_widget_chunks(df: DataFrame, per_file: int = 10) -> DataFrame:
    rows = parse_ui(df).select(*FILE, F.posexplode(_important(F.col("ui.widgets"), per_file)).alias("pos", "w"))
    return rows.select(*FILE, "pos", F.col("w.object_name").alias("symbol"), _widget_text(F.col("relative_path"), F.col("w.object_name"), F.col("w.class_name"), F.col("w.properties")).alias("content"))


# All of it --------------------------------------------------------------------


def header_fallback(df: DataFrame, max_chunk_size: int = 2000) -> DataFrame:
    """Headers that declare nothing, as one chunk each: FILE, symbol, content."""
    bare = df.where(F.col("ext").isin(*HEADERS) & ~F.coalesce(F.length("content") == 0, F.lit(True))).withColumn("_d", _declarations(F.col("content"))).where(F.size("_d") == 0)
    return bare.select(*FILE, stem(F.col("relative_path")).alias("symbol"), truncate("content", max_chunk_size).alias("content"))


def chunk_code(df: DataFrame, context_lines: int = 5, max_chunk_size: int = 2000, min_commands: int = 1) -> DataFrame:
    """Chunks of source files (project, relative_path, ext, content): FILE, chunk_no,
    symbol, content, chunk_type, language, class_name, line_number.

    Each file is read once and its finds become one array. Files of other types,
    blank, null or unreadable ones have no chunks."""
    files = df.where(~is_blank("content"))
    path, project, content, ext = F.col("relative_path"), F.col("project"), F.col("content"), F.col("ext")
    ours = lambda kinds: F.when(ext.isin(*kinds), content)
    parsed = files.withColumns({"_d": _declarations(ours(HEADERS)), "_s": _definitions(ours(SOURCES)), "_e": F.when(ext == ".def", F.transform(_exports(content), lambda e: e["name"])), "_m": F.when(ext == ".tcmd", _commands(content)), "_c": F.when(ext.isin(*SOURCES), _first_calls(content, 20)), "_l": F.when(ext.isin(*SOURCES), F.split(content, "\n", -1))})
    kind = "array<struct<symbol:string,content:string,chunk_type:string,language:string,class_name:string,line_number:int>>"
    null = F.lit(None).cast("string")

    def chunk(symbol: Column, text: Column, chunk_type: str, language: str, owner: Column = null, number: Column | None = None) -> Column:
        line = F.lit(None).cast("int") if number is None else number
        return F.struct(symbol.alias("symbol"), text.alias("content"), F.lit(chunk_type).alias("chunk_type"), F.lit(language).alias("language"), owner.alias("class_name"), line.alias("line_number"))

    symbols = lambda c: F.transform(c, lambda s: chunk(s["name"], format_symbol(path, project, s["class_name"], s["signature"], s["body"]), "function", "cpp", s["class_name"]))
    whole = F.array(chunk(stem(path), truncate(content, max_chunk_size), "function", "cpp"))
    calls = F.transform("_c", lambda c: chunk(c["api_name"], format_api_call(path, project, c["api_name"], c["line_number"], _context(F.col("_l"), c["line_number"], context_lines), c["full_statement"]), "call_snippet", "cpp", null, c["line_number"]))
    made = (
        F.when(ext.isin(*HEADERS), F.when(F.size("_d") > 0, symbols("_d")).otherwise(whole))
        .when(ext.isin(*SOURCES), F.concat(symbols("_s"), calls))
        .when((ext == ".def") & (F.size("_e") > 0), F.array(chunk(F.lit("exports"), _exports_text(path, project, F.col("_e"), 50), "exports", "cpp")))
        .when((ext == ".tcmd") & (F.size("_m") >= max(min_commands, 1)), F.array(chunk(stem(path), _script_text(path, project, F.col("_m")), "command", "tcmd")))
        .otherwise(F.array().cast(kind))
    )
    texts = parsed.where(ext != ".ui").select(*FILE, made.alias("_k"))
    # A widget file is parsed once: its structure, then its widgets.
    ui = parse_ui(files).withColumn("_w", F.transform(_important(F.col("ui.widgets"), 10), lambda w: F.struct(w["object_name"].alias("symbol"), _widget_text(path, w["object_name"], w["class_name"], w["properties"]).alias("content"))))
    first = F.when(F.col("ui.class_name").isNotNull(), F.array(F.struct(_structure_symbol().alias("symbol"), _structure_text().alias("content"))))
    ui = ui.where("ui.class_name is not null").select(*FILE, F.posexplode(F.concat(first, F.col("_w"))).alias("chunk_no", "_k"))
    widgets = ui.select(*FILE, "chunk_no", "_k.symbol", "_k.content", F.lit("ui_structure").alias("chunk_type"), F.lit("qt_ui").alias("language"), null.alias("class_name"), F.lit(None).cast("int").alias("line_number"))
    rows = texts.select(*FILE, F.posexplode("_k").alias("chunk_no", "_k")).select(*FILE, "chunk_no", "_k.*")
    return rows.unionByName(widgets)
