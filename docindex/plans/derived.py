"""Inputs that the given tables don't have as such: paths, Markdown documents
and source files, derived from their rows. Each has a twin in SQL, so that both
sides see the same bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_documents, to_chunks
from ..session import load_table


def _joined(*sorted_by: Column, line: Column, sep: str = "\n") -> Column:
    """Lines of a group in order, as one text; groups hold a fixed number of rows."""
    rows = F.array_sort(F.collect_list(F.struct(*(c.alias(f"k{n}") for n, c in enumerate(sorted_by)), line.alias("line"))))
    return F.array_join(F.transform(rows, lambda r: r["line"]), sep)


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files of different suffixes: page_id, path, html."""
    ext = F.element_at(F.array(*(F.lit(x) for x in (".html", ".HTM", ".xhtml", ".txt", ".tar.htm"))), (F.col("page_id") % 5 + 1).cast("int"))
    return load_table(spark, d, "pages").select("page_id", F.concat(F.lit("site/html/"), (F.col("page_id") % 7).cast("string"), F.lit("/p"), F.col("page_id").cast("string"), ext).alias("path"), "html")


PAGE_PATHS = "SELECT page_id, 'site/html/' || (page_id % 7) || '/p' || page_id || (['.html', '.HTM', '.xhtml', '.txt', '.tar.htm'])[CAST(page_id % 5 + 1 AS INTEGER)] AS path, html FROM pages"


def part_paths(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files of two projects: p_partkey, project, relative_path."""
    pick = lambda values, n: F.element_at(F.array(*(F.lit(x) for x in values)), (F.col("p_partkey") % n + 1).cast("int"))
    path = F.concat(pick(("src/", "build/", "src/Debug/", "Build/", "", "a/.git/b/", "lib/core/"), 7), F.lit("f"), F.col("p_partkey").cast("string"), pick((".h", ".cpp", ".CXX", ".ui", ".def", ".tcmd", ".obj", ".txt", ".hpp"), 9))
    return load_table(spark, d, "part").select("p_partkey", F.concat(F.lit("proj"), (F.col("p_size") % 4).cast("string")).alias("project"), path.alias("relative_path"))


PART_PATHS = "SELECT p_partkey, 'proj' || (p_size % 4) AS project, (['src/', 'build/', 'src/Debug/', 'Build/', '', 'a/.git/b/', 'lib/core/'])[CAST(p_partkey % 7 + 1 AS INTEGER)] || 'f' || p_partkey || (['.h', '.cpp', '.CXX', '.ui', '.def', '.tcmd', '.obj', '.txt', '.hpp'])[CAST(p_partkey % 9 + 1 AS INTEGER)] AS relative_path FROM part"


def md_docs(spark: SparkSession, d: str) -> DataFrame:
    """Each document as Markdown of one section: source_file, title, content."""
    content = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return load_table(spark, d, "documents").select(F.concat(F.lit("corpus/html/"), "lang", F.lit("/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".v1.md")).alias("source_file"), F.col("source").alias("title"), content.alias("content"))


MD_DOCS = "SELECT 'corpus/html/' || lang || '/' || source || '/d' || doc_id || '.v1.md' AS source_file, source AS title, '# ' || source || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents"

#: Documents in one of several sections.
MEMBERS = 5


def md_multi(spark: SparkSession, d: str) -> DataFrame:
    """Documents of several sections, each made of MEMBERS rows: source_file, title, content."""
    rows = load_table(spark, d, "documents").select(F.floor(F.col("doc_id") / MEMBERS).alias("g"), "doc_id", F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("s"))
    return rows.groupBy("g").agg(_joined(F.col("doc_id"), line=F.col("s"), sep="\n\n").alias("content")).select(F.concat(F.lit("multi/"), F.col("g").cast("string"), F.lit(".md")).alias("source_file"), F.lit("multi").alias("title"), "content")


MD_MULTI = "SELECT 'multi/' || (doc_id // 5) || '.md' AS source_file, 'multi' AS title, string_agg('## ' || doc_id || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10) ORDER BY doc_id) AS content FROM documents GROUP BY doc_id // 5"


def def_files(spark: SparkSession, d: str) -> DataFrame:
    """Parts as export lists, 60 to a file."""
    p = load_table(spark, d, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"))
    key = F.col("p_partkey").cast("string")
    line = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("  ; "), name)).when(F.col("p_partkey") % 13 == 0, F.concat(name, F.lit(" = other"))).when(F.col("p_size") % 3 == 0, F.concat(F.lit("  "), name, F.lit(" @"), key, F.lit(" DATA"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("\t"), name, F.lit(" @ "), key, F.lit(" NONAME PRIVATE"))).otherwise(name)
    rows = p.select(F.floor(F.col("p_partkey") / 60).alias("g"), "p_partkey", line.alias("line"))
    body = F.concat(F.lit("LIBRARY lib\n exports \n"), _joined(F.col("p_partkey"), line=F.col("line")), F.lit("\nVERSION 1.0\n  After @1\n"))
    files = rows.groupBy("g").agg(body.alias("content"))
    return files.select(F.concat(F.lit("proj"), (F.col("g") % 3).cast("string")).alias("project"), F.concat(F.lit("lib/x"), F.col("g").cast("string"), F.lit(".def")).alias("relative_path"), F.lit(".def").alias("ext"), "content")


DEF_FILES = """SELECT 'proj' || (g % 3) AS project, 'lib/x' || g || '.def' AS relative_path, '.def' AS ext,
 'LIBRARY lib' || chr(10) || ' exports ' || chr(10) || string_agg(line, chr(10) ORDER BY p_partkey) || chr(10) || 'VERSION 1.0' || chr(10) || '  After @1' || chr(10) AS content
 FROM (SELECT p_partkey // 60 AS g, p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '  ; ' || nm WHEN p_partkey % 13 = 0 THEN nm || ' = other' WHEN p_size % 3 = 0 THEN '  ' || nm || ' @' || p_partkey || ' DATA'
  WHEN p_size % 3 = 1 THEN chr(9) || nm || ' @ ' || p_partkey || ' NONAME PRIVATE' ELSE nm END AS line FROM (SELECT *, replace(p_name, ' ', '_') || p_partkey AS nm FROM part)) GROUP BY g"""


def script_files(spark: SparkSession, d: str) -> DataFrame:
    """Events as command scripts, 12 to a file."""
    e = load_table(spark, d, "events")
    n = F.col("event_id").cast("string")
    about = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("REM "), "event_type", F.lit("\n"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("  # "), "event_type", F.lit(" "), n, F.lit("\n"))).otherwise(F.lit(""))
    what = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("plain words "), n)).when(F.col("user_id") % 5 == 1, F.concat(F.lit("cd dir"), n)).when(F.col("user_id") % 5 == 2, F.concat(F.lit("tool"), n, F.lit(".exe now"))).otherwise(F.concat(F.lit("  run --id="), n))
    rows = e.select(F.floor(F.col("event_id") / 12).alias("g"), "event_id", F.concat(about, what).alias("line"))
    files = rows.groupBy("g").agg(_joined(F.col("event_id"), line=F.col("line")).alias("content"))
    return files.select(F.concat(F.lit("proj"), (F.col("g") % 3).cast("string")).alias("project"), F.concat(F.lit("run/s"), F.col("g").cast("string"), F.lit(".tcmd")).alias("relative_path"), F.lit(".tcmd").alias("ext"), "content")


SCRIPT_FILES = """SELECT 'proj' || (g % 3) AS project, 'run/s' || g || '.tcmd' AS relative_path, '.tcmd' AS ext, string_agg(line, chr(10) ORDER BY event_id) AS content
 FROM (SELECT event_id // 12 AS g, event_id, CASE event_id % 4 WHEN 0 THEN 'REM ' || event_type || chr(10) WHEN 1 THEN '  # ' || event_type || ' ' || event_id || chr(10) ELSE '' END ||
  CASE user_id % 5 WHEN 0 THEN 'plain words ' || event_id WHEN 1 THEN 'cd dir' || event_id WHEN 2 THEN 'tool' || event_id || '.exe now' ELSE '  run --id=' || event_id END AS line FROM events) GROUP BY g"""


def cpp_files(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sources full of calls, 25 to a file."""
    o = load_table(spark, d, "orders")
    n = F.col("o_orderkey")
    c = (F.col("o_custkey") % 40).cast("string")
    line = F.when(n % 6 == 0, F.concat(F.lit("  // Skip"), c, F.lit("(1)"))).when(n % 6 == 1, F.concat(F.lit("  obj->Get"), c, F.lit("(x); Bar (x);"))).when(n % 6 == 2, F.concat(F.lit("ns::Make"), c, F.lit("(A::B, 2);"))).when(n % 6 == 3, F.concat(F.lit("Outer"), c, F.lit("(o.inner(1));"))).when(n % 6 == 4, F.concat(F.lit("\tp.f(A::B); w"), c, F.lit(" = 1;"))).otherwise(F.lit("plain text"))
    rows = o.select(F.floor(n / 25).alias("g"), "o_orderkey", line.alias("line"))
    files = rows.groupBy("g").agg(_joined(F.col("o_orderkey"), line=F.col("line")).alias("content"))
    return files.select(F.concat(F.lit("proj"), (F.col("g") % 3).cast("string")).alias("project"), F.concat(F.lit("src/c"), F.col("g").cast("string"), F.lit(".cpp")).alias("relative_path"), F.lit(".cpp").alias("ext"), "content")


CPP_FILES = """SELECT 'proj' || (g % 3) AS project, 'src/c' || g || '.cpp' AS relative_path, '.cpp' AS ext, string_agg(line, chr(10) ORDER BY o_orderkey) AS content
 FROM (SELECT o_orderkey // 25 AS g, o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '  // Skip' || c || '(1)' WHEN 1 THEN '  obj->Get' || c || '(x); Bar (x);' WHEN 2 THEN 'ns::Make' || c || '(A::B, 2);'
  WHEN 3 THEN 'Outer' || c || '(o.inner(1));' WHEN 4 THEN chr(9) || 'p.f(A::B); w' || c || ' = 1;' ELSE 'plain text' END AS line FROM (SELECT *, o_custkey % 40 AS c FROM orders)) GROUP BY g"""


def header_files(spark: SparkSession, d: str) -> DataFrame:
    """Customers as headers, 20 to a file; every fifth file declares nothing."""
    t = load_table(spark, d, "customer")
    n = F.col("c_custkey").cast("string")
    seg = F.lower("c_mktsegment")
    line = F.when(F.floor(F.col("c_custkey") / 20) % 5 == 4, F.concat(F.lit("#define C"), n)).when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("static int "), seg, n, F.lit("(int a, char* b);"))).when(F.col("c_nationkey") % 3 == 1, F.concat(F.lit("class K"), n, F.lit(" {};"))).otherwise(F.concat(F.lit("  const std::string& "), seg, F.lit("_"), n, F.lit("() const;")))
    rows = t.select(F.floor(F.col("c_custkey") / 20).alias("g"), "c_custkey", line.alias("line"))
    files = rows.groupBy("g").agg(_joined(F.col("c_custkey"), line=F.col("line")).alias("content"))
    return files.select(F.concat(F.lit("proj"), (F.col("g") % 3).cast("string")).alias("project"), F.concat(F.lit("inc/h"), F.col("g").cast("string"), F.lit(".h")).alias("relative_path"), F.lit(".h").alias("ext"), "content")


HEADER_FILES = """SELECT 'proj' || (g % 3) AS project, 'inc/h' || g || '.h' AS relative_path, '.h' AS ext, string_agg(line, chr(10) ORDER BY c_custkey) AS content
 FROM (SELECT c_custkey // 20 AS g, c_custkey, CASE WHEN (c_custkey // 20) % 5 = 4 THEN '#define C' || c_custkey WHEN c_nationkey % 3 = 0 THEN 'static int ' || lower(c_mktsegment) || c_custkey || '(int a, char* b);'
  WHEN c_nationkey % 3 = 1 THEN 'class K' || c_custkey || ' {};' ELSE '  const std::string& ' || lower(c_mktsegment) || '_' || c_custkey || '() const;' END AS line FROM customer) GROUP BY g"""


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """Sources with definitions, one for each supplier."""
    s = load_table(spark, d, "supplier")
    n = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("class W"), n, F.lit(" : public Q {\n  int x;\n};\n\nint W"), n, F.lit("::get(int a) {\n  if (a) { return '{'; }\n  else if (x) {\n    call();\n  }\n  return a;\n}\nstatic void free"), n, F.lit("() {}\n"))
    return s.select(F.concat(F.lit("proj"), (F.col("s_suppkey") % 3).cast("string")).alias("project"), F.concat(F.lit("src/w"), n, F.lit(".cpp")).alias("relative_path"), F.lit(".cpp").alias("ext"), body.alias("content"))


def ui_files(spark: SparkSession, d: str) -> DataFrame:
    """Widget files, one for each supplier."""
    s = load_table(spark, d, "supplier")
    n = F.col("s_suppkey").cast("string")
    xml = F.concat(F.lit('<ui version="4.0"><class>Dlg'), n, F.lit('</class><widget class="QDialog" name="Dlg'), n, F.lit('"><layout><item row="0" column="1"><widget class="QPushButton" name="ok"><property name="text"><string>'), "s_name", F.lit('</string></property></widget></item><item><layout><item><widget class="QFrame" name="f"/></item></layout></item></layout></widget><connections><connection><sender>ok</sender><signal>clicked()</signal><receiver>Dlg</receiver><slot>accept()</slot></connection></connections></ui>'))
    return s.select(F.concat(F.lit("proj"), (F.col("s_suppkey") % 3).cast("string")).alias("project"), F.concat(F.lit("ui/d"), n, F.lit(".ui")).alias("relative_path"), F.lit(".ui").alias("ext"), xml.alias("content"))


def code_files(spark: SparkSession, d: str) -> DataFrame:
    out = def_files(spark, d)
    for more in (script_files, cpp_files, header_files, source_files, ui_files):
        out = out.unionByName(more(spark, d))
    return out


def vector_index(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as an index: chunk_id, vector, label and what a chunk says of itself."""
    e = load_table(spark, d, "embeddings")
    demo = F.col("label") % 3 == 0
    n = F.col("vec_id").cast("string")
    return e.select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label", F.when(demo, "demo").when(F.col("label") % 3 == 1, "chm").alias("source_type"),
        F.concat(F.lit("sym_of_a_rather_long_name_"), n).alias("symbol"), F.when(demo, F.lit("")).otherwise(F.concat(F.lit("title "), n)).alias("title"), F.when(~demo, F.concat(F.lit("chapter/of/some/length/"), n)).alias("chapter"),
        F.when(demo, F.concat(F.lit("proj"), n)).alias("demo_name"), F.when(demo, F.concat(F.lit("a/very/long/path/to/some/file/of/the/project/"), n, F.lit(".cpp"))).alias("file_path"), F.concat(F.lit("f"), n, F.lit(".html")).alias("source_file"), F.concat(F.lit("text of "), n).alias("content"),
    )


VECTOR_INDEX = """SELECT vec_id AS chunk_id, embedding AS vector, label, CASE WHEN label % 3 = 0 THEN 'demo' WHEN label % 3 = 1 THEN 'chm' END AS source_type, 'sym_of_a_rather_long_name_' || vec_id AS symbol,
 CASE WHEN label % 3 = 0 THEN '' ELSE 'title ' || vec_id END AS title, CASE WHEN label % 3 <> 0 THEN 'chapter/of/some/length/' || vec_id END AS chapter, CASE WHEN label % 3 = 0 THEN 'proj' || vec_id END AS demo_name,
 CASE WHEN label % 3 = 0 THEN 'a/very/long/path/to/some/file/of/the/project/' || vec_id || '.cpp' END AS file_path, 'f' || vec_id || '.html' AS source_file, 'text of ' || vec_id AS content FROM embeddings"""


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """The vectors with ids divisible by 50 as queries; these are the stated query set."""
    return load_table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of ``md_docs`` in the columns of the index."""
    return to_chunks(chunk_documents(md_docs(spark, d)), "chm", F.col("source_file"))
