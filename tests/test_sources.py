import json

import pytest
from pyspark.sql import functions as F

from docindex import sources
from docindex.operators.chunking import CHUNK_COLUMNS
from docindex.operators.embed import hashing_embedder
from docindex.operators import index as idx
from docindex.operators.index import load_index
from docindex.session import new_path
from docindex.streaming import ingest_pages, store_pages


def test_pages_and_projects(spark, tmp_path):
    for name in ("a/x.html", "a/b/y.HTM", "a/z.txt", "p/src/m.cpp", "p/build/n.cpp", "p/Build/o.H", "q/k.def"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes("café\r\n".encode("latin-1") if name.endswith("m.cpp") else "é\r\n".encode())
    pages = sources.read_html_pages(spark, str(tmp_path / "a"))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in pages.collect()) == ["x.html", "y.HTM"]
    got = sources.scan_projects(spark, {"P": str(tmp_path / "p"), "Q": str(tmp_path / "q")}, skip_dirs=())
    rows = {(r["project"], r["relative_path"], r["ext"]): r["content"] for r in got.collect()}
    assert set(rows) == {("P", "src/m.cpp", ".cpp"), ("P", "Build/o.H", ".h"), ("Q", "k.def", ".def")}
    assert rows["Q", "k.def", ".def"] == "é\n"
    assert sources.scan_project(spark, str(tmp_path / "p"), skip_dirs=("src",)).count() == 1


def test_skipped_directories_are_not_entered(spark, tmp_path, monkeypatch):
    names = ["m.cpp", "a/b/c/n.h", "a/[x]{1}*/o.cpp", "a/x.txt", "build/deep/p.cpp", "a/.git/q.h", "a/own/r.h", "a/Build/s.H", "node_modules/t/u.cpp"]
    for name in names:
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text(name)
    real, listed = sources.folders_in, []
    monkeypatch.setattr(sources, "folders_in", lambda s, f: listed.append(f.rsplit("/p", 1)[1].strip("/")) or real(s, f))
    got = sources.scan_project(spark, str(tmp_path / "p"), skip_dirs=("own",))
    kept = {"m.cpp", "a/b/c/n.h", "a/[x]{1}*/o.cpp", "a/Build/s.H"}
    assert {r["relative_path"]: r["content"] for r in got.collect()} == {n: n for n in kept}
    assert sorted(listed) == ["", "a", "a/Build", "a/[x]{1}*", "a/b", "a/b/c"]
    assert len(got.inputFiles()) == len(kept)


def test_decoding(spark):
    raw = ["é\r\nx\ry".encode(), "﻿a".encode(), "中文".encode("gbk"), None, b""]
    df = spark.createDataFrame([(n, bytearray(r) if r is not None else None) for n, r in enumerate(raw)], "n int, raw binary")
    got = [r["t"] for r in df.select("n", sources.decode_text(F.col("raw")).alias("t")).orderBy("n").collect()]
    assert got == ["é\nx\ny", "a", "中文", None, ""]


def test_chunk_arrays(spark, tmp_path):
    path = tmp_path / "chunks.json"
    path.write_text(json.dumps([{"content": "c", "metadata": {"source_type": "demo", "symbol": "s", "line_number": 3}}], indent=2))
    (row,) = sources.read_chunk_array(spark, str(path)).collect()
    assert (row["content"], row["source_type"], row["symbol"], row["line_number"], row["title"]) == ("c", "demo", "s", 3, None)
    path = new_path(spark, "test-chunks")
    df = spark.createDataFrame([tuple(None if t == "int" else "é\n" for t in CHUNK_COLUMNS.values())], ", ".join(f"{c} {t}" for c, t in CHUNK_COLUMNS.items()))
    sources.write_chunks(df, path)
    assert sources.read_chunks(spark, path).collect() == df.collect()
    path = tmp_path / "arrays"
    sources.write_chunk_array(df.unionByName(df).coalesce(1), str(path))
    (part,) = path.glob("part-*")
    said = json.loads(part.read_text())
    assert len(said) == 2 and said[0]["content"] == "é\n" and said[0]["metadata"]["symbol"] == "é\n" and "line_number" not in said[0]["metadata"]
    assert [r["symbol"] for r in sources.read_chunk_array(spark, str(path)).collect()] == ["é\n"] * 2
    sources.write_chunk_array(df.limit(0).coalesce(1), str(tmp_path / "none"))
    assert sources.read_chunk_array(spark, str(tmp_path / "none")).count() == 0


def test_stream(spark, tmp_path):
    spark.createDataFrame([("u1", "<h1>Alpha</h1><p>one two</p>"), ("u2", "")], "path string, html string").write.parquet(str(tmp_path / "in/a"))
    out = str(tmp_path / "index")
    spark.createDataFrame([("u3", "<h1>Beta</h1><p>one</p>")], "path string, html string").write.parquet(str(tmp_path / "in/c"))
    for n in range(2):
        stream = spark.readStream.schema("path string, html string").parquet(str(tmp_path / "in/*"))
        ingest_pages(stream, out, str(tmp_path / "state"), hashing_embedder(8)).awaitTermination()
        assert sorted((r["source_file"], r["symbol"]) for r in load_index(spark, out).collect()) == [("u1", "Alpha"), ("u3", "Beta")][: 2 - n]
        if not n:  # the same again, and a page that has become empty
            spark.createDataFrame([("u1", "<h1>Alpha</h1><p>one two</p>"), ("u3", "")], "path string, html string").write.parquet(str(tmp_path / "in/b"))


def test_stream_of_changes(spark, tmp_path, monkeypatch):
    """Tombstones, a batch that fails half-way, and a checkpoint that is lost."""
    shape = "path string, html string, gone boolean, seen int"
    out, state = str(tmp_path / "index"), str(tmp_path / "state")
    put = lambda name, *rows: spark.createDataFrame(list(rows), shape).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run(checkpoint=state):
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in/*"))
        ingest_pages(stream, out, checkpoint, hashing_embedder(8), gone=F.col("gone"), order=F.col("seen")).awaitTermination()

    now = lambda: sorted((r["source_file"], r["symbol"]) for r in load_index(spark, out).collect())
    put("a", ("u1", "<h1>Alpha</h1>", False, 1), ("u2", "<h1>Beta</h1>", None, 1), ("u3", "<h1>Old</h1>", False, 1), ("u3", "<h1>New</h1>", False, 2))
    run()
    assert now() == [("u1", "Alpha"), ("u2", "Beta"), ("u3", "New")]
    put("b", ("u1", None, True, 3), ("u4", "<h1>Delta</h1>", False, 3), ("u5", "<h1>Gone</h1>", False, 3), ("u5", None, True, 4))
    with monkeypatch.context() as m:  # the files of the batch are written, its version isn't
        m.setattr(idx, "write_file_once", lambda *a: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivisionError"):
            run()
    assert now() == [("u1", "Alpha"), ("u2", "Beta"), ("u3", "New")]
    run()
    assert now() == [("u2", "Beta"), ("u3", "New"), ("u4", "Delta")]
    done = idx.current_version(spark, out)
    run()  # nothing new
    batch = spark.createDataFrame([("u9", "<h1>Late</h1>", False, 9)], shape)
    for number in (0, 1):  # batches that the index has already
        store_pages(batch, number, out, hashing_embedder(8), state)
    assert idx.current_version(spark, out) == done
    store_pages(batch, 2, out, hashing_embedder(8), state)
    assert ("u9", "Late") in now()
