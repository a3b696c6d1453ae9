import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})  # the driver has the package, its workers don't
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from docindex import sources
from docindex.operators import chunking, code, embed, html, search
pages = spark.createDataFrame([("a", "<h1>T</h1><p>x</p>")], "path string, html string")
assert html.clean_html(pages).first()["content"]
files = spark.createDataFrame([("p", "a.cpp", ".cpp", "int f(int a) {{ return g(a); }}"), ("p", "b.ui", ".ui", "<ui><class>D</class><widget class='Q' name='n'/></ui>")], "project string, relative_path string, ext string, content string")
assert code.chunk_code(files).count() > 1
assert spark.createDataFrame([(bytearray("é".encode("latin-1")),)], "b binary").select(sources.decode_text(F.col("b"), ("gbk", "latin-1"))).first()[0]
docs = spark.createDataFrame([("f", "t", "some words")], "source_file string, title string, content string")
assert chunking.chunk_documents_with(docs, len, 800, 0).count() == 1
made = embed.embed_chunks(docs.withColumn("chunk_id", F.lit("c")), embed.hashing_embedder(4))
assert search.nearest(made.select(F.lit(1).alias("query_id"), "vector"), made, 1).count() == 1
print("fine")
"""


def test_operators_send_the_package(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip() == "fine", got.stderr[-3000:]
