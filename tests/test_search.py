import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docindex.operators import embed, prompts, search
from docindex.operators import index as idx
from docindex.session import new_path


@pytest.fixture(scope="module")
def small(spark):
    rows = [("a", [1.0, 0.0], "chm"), ("b", [0.0, 1.0], "demo"), ("c", [1.0, 1.0], "demo")]
    return spark.createDataFrame(rows, "chunk_id string, vector array<float>, source_type string")


def queries(spark, *vectors):
    return spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(vectors)], "query_id int, vector array<double>")


def found(df):
    return [(r["chunk_id"], round(r["score"], 4), r["rank"]) for r in df.orderBy("query_id", "rank").collect()]


def test_search(spark, small):
    q = queries(spark, (2, 0))
    assert found(search.search(q, small, 3)) == [("a", 1.0, 1), ("c", 0.7071, 2), ("b", 0.0, 3)]
    assert found(search.search(q, small, 9)) == found(search.search(q, small, 3))
    assert found(search.search(q, small, 1, source="demo")) == [("c", 0.7071, 1)]
    assert found(search.search(q, small, 1, {"source_type": ["demo", None]})) == [("c", 0.7071, 1)]
    assert found(search.search(q, small, 2, {"missing": 1})) == []
    assert found(search.search(queries(spark), small, 2)) == []
    assert found(search.search(q, small.limit(0), 2)) == []
    assert found(search.search(queries(spark, (0, 0)), small, 2)) == [("a", 0.0, 1), ("b", 0.0, 2)]


def test_post_filter_may_fall_short(spark):
    rows = [(f"m{n}", [1.0, 0.0], "chm") for n in range(3)] + [("c", [1.0, 1.0], "demo")]
    index = spark.createDataFrame(rows, "chunk_id string, vector array<float>, source_type string")
    q = queries(spark, (1, 0))
    assert found(search.search(q, index, 1, source="demo", filter_mode="post")) == []
    assert found(search.search(q, index, 1, source="demo")) == [("c", 0.7071, 1)]


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = np.round(rng.normal(size=(300, 8)), 1)
    m[250:] = m[:50]  # ties
    index = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(m)], "chunk_id long, vector array<double>").repartition(5)
    got = search.nearest(queries(spark, *m[:7]), index, 6).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(7):
        s = np.round(unit @ unit[q], 9)
        want = sorted(range(300), key=lambda i: (-s[i], i))[:6]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert np.allclose([r["score"] for r in mine], s[want])
        assert {r["chunk_id"] for r in mine[:2]} == set(want[:2])


def test_embedding(spark):
    df = spark.createDataFrame([("x", "a b"), ("y", None), ("z", "a  b\n")], "id string, content string")
    rows = {r["id"]: list(r["vector"]) for r in embed.embed_chunks(df, embed.hashing_embedder(8), batch_size=2).collect()}
    assert rows["x"] == rows["z"] and not any(rows["y"]) and len(rows["x"]) == 8
    assert embed.check_dimension(embed.embed_chunks(df, embed.hashing_embedder(8)), 8).count() == 0


def test_embedding_retries():
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return np.ones((len(texts), 2))

    assert embed._attempt(flaky, ["a"], 3, 0).shape == (1, 2) and len(calls) == 3
    with pytest.raises(ValueError):
        embed._attempt(lambda texts: np.ones((2, 2)), ["a"], 1, 0)


def test_index_modes(spark, small):
    path = new_path(spark, "test-index")
    idx.write_index(small, path)
    one = small.where("chunk_id = 'b'").withColumn("vector", F.array(F.lit(5.0), F.lit(5.0)).cast("array<float>"))
    for _ in range(2):  # an upsert changes nothing the second time
        idx.append_to_index(one, path, "upsert")
        now = {r["chunk_id"]: list(r["vector"]) for r in idx.load_index(spark, path).collect()}
        assert now == {"a": [1, 0], "b": [5, 5], "c": [1, 1]}
    idx.append_to_index(one, path, "append")
    assert idx.load_index(spark, path).count() == 4
    idx.append_to_index(one.limit(0), path, "overwrite")
    assert idx.read_manifest(spark, path).first()["count"] == 4
    assert idx.index_stats(idx.load_index(spark, path)).first().asDict() == {"total_chunks": 4, "demo_chunks": 3, "chm_chunks": 1, "embedding_dimension": 2}
    idx.clear_index(spark, path)
    assert idx.load_index(spark, path).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        idx.load_index(spark, path + "-none")


def test_sources_are_replaced(spark):
    path = new_path(spark, "test-index")
    rows = [(f"{s}{n}", s, t, [1.0, float(n)]) for s, t, many in (("p", "chm", 4), ("q", "chm", 2), ("p", "demo", 1)) for n in range(many)]
    schema = "chunk_id string, source_key string, source_type string, vector array<float>"
    idx.write_index(spark.createDataFrame(rows, schema), path)
    less = spark.createDataFrame([("p0", "p", "chm", [9.0, 9.0]), ("p0", "p", "chm", [8.0, 9.0])], schema)
    state = lambda: sorted((r["source_type"], r["chunk_id"], r["vector"][0]) for r in idx.load_index(spark, path).collect())
    for _ in range(2):
        idx.append_to_index(less, path, "replace")
        assert state() == [("chm", "p0", 9.0), ("chm", "q0", 1.0), ("chm", "q1", 1.0), ("demo", "p0", 1.0)]
    gone = spark.createDataFrame([("chm", "q"), ("chm", "new")], "source_type string, source_key string")
    idx.append_to_index(less.limit(0), path, "replace", gone)
    assert state() == [("chm", "p0", 9.0), ("demo", "p0", 1.0)]
    assert tuple(idx.read_manifest(spark, path).first()) == (2, 2)
    idx.append_to_index(spark.createDataFrame([("r0", "r", "chm", [3.0, 3.0])], schema), path, "overwrite")
    assert state() == [("chm", "r0", 3.0), ("demo", "p0", 1.0)]


def test_blocks_of_queries_and_scores(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = np.round(rng.normal(size=(400, 4)), 1)
    index = spark.createDataFrame([(f"c{n:03}", [float(x) for x in v]) for n, v in enumerate(m)], "chunk_id string, vector array<double>").repartition(3)
    q = queries(spark, *m[:40])
    whole = found(search.nearest(q, index, 5))
    monkeypatch.setattr(search, "CELLS", 300)
    assert found(search.nearest(q, index, 5)) == whole
    monkeypatch.setattr(search, "BLOCK_BYTES", 4 * 8 * 10)
    assert found(search.nearest(q, index, 5)) == whole and len(whole) == 200


def test_history(spark):
    rows = [(1, n, "system" if n == 7 else "user" if n % 2 == 0 else "assistant", "x" * (501 if n == 6 else 500) if n > 5 else str(n)) for n in range(9)]
    got = {r["turn"]: r["history"] for r in prompts.history_section(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got[0] == ""
    assert got[8].startswith("【对话历史】\n用户: 2\n助手: 3\n") and got[8].endswith("\n\n")
    assert f"用户: {'x' * 500}...\n助手: {'x' * 500}\n" in got[8]


def test_prompts(spark):
    questions = spark.createDataFrame([(1, "why {context}?"), (2, "how?")], "query_id int, question string")
    contexts = spark.createDataFrame([(1, "because {question}")], "query_id int, context string")
    got = {r["query_id"]: r["prompt"] for r in prompts.build_prompts(questions, contexts, template="C:{context} H:{history}Q:{question}", no_hit_template="Q:{question}").collect()}
    assert got == {1: "C:because {question} H:Q:why {context}?", 2: "Q:how?"}


def test_citation(spark):
    path = "x" * 36
    rows = [(1, 1, 0.5, "s" * 30, path, None, None, "demo"), (1, 2, 0.25, None, "", "", None, None)]
    df = spark.createDataFrame(rows, "query_id int, rank int, score double, symbol string, file_path string, chapter string, source_file string, source_type string")
    a, b = search.citations(df).orderBy("rank").collect()
    assert (a["label"], a["score"], a["symbol"], a["file"]) == ("Demo", "0.5000", "s" * 20, "..." + "x" * 32)
    assert (b["label"], b["symbol"], b["file"]) == ("CHM", "-", "-")


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in df.select(search.l2_normalize("v")).collect()]
    assert math.isclose(got[0][0], 0.6, abs_tol=1e-6) and got[1] == [0.0, 0.0]


def test_versions(spark, small, monkeypatch):
    path, small = new_path(spark, "test-index"), small.withColumn("source_key", F.col("chunk_id"))
    idx.write_index(small, path)
    state = lambda v=None: sorted(r["chunk_id"] for r in idx.load_index(spark, path, v).collect())
    bound = idx.load_index(spark, path)  # a reader that stays with its version
    first = idx.current_version(spark, path)
    more = small.where("chunk_id = 'a'").withColumn("chunk_id", F.lit("z"))

    def lost(*args):
        raise OSError("lost")

    # A write that stops between its files and its version leaves the old version whole.
    for mode in ("append", "upsert", "overwrite", "replace"):
        with monkeypatch.context() as m:
            m.setattr(idx, "write_file_once", lost)
            with pytest.raises(OSError, match="lost"):
                idx.append_to_index(more, path, mode)
        assert idx.current_version(spark, path) == first and state() == ["a", "b", "c"]
    idx.append_to_index(more, path, "append")
    idx.append_to_index(small.where("chunk_id = 'b'"), path, "upsert")
    assert state() == ["a", "b", "c", "z"] and state(first.number) == ["a", "b", "c"]
    assert sorted(r["chunk_id"] for r in bound.collect()) == ["a", "b", "c"]
    idx.clear_index(spark, path)
    assert state() == [] and idx.load_index(spark, path).columns == small.columns
    idx.vacuum_index(spark, path, 2)
    assert [v for v in range(1, 6) if v in idx._numbers(spark, path)] == [3, 4] and state(3) == ["a", "b", "c", "z"]
    with pytest.raises(idx.NoIndexError):
        idx.load_index(spark, path, 1)
    idx.vacuum_index(spark, path, 1)
    assert state() == []
    idx.append_to_index(more, path)
    assert state() == ["z"]
    with pytest.raises(ValueError, match="other"):
        idx.append_to_index(more.withColumn("other", F.lit(1)), path)


def test_two_writers(spark, small, monkeypatch):
    path = new_path(spark, "test-index")
    idx.write_index(small, path)
    real, other = idx._write, []

    def slow(df, at):
        out = real(df, at)
        if not other:  # someone else names a version first
            other.append(1)
            idx.append_to_index(small.where("chunk_id = 'c'").withColumn("chunk_id", F.lit("y")), path)
        return out

    monkeypatch.setattr(idx, "_write", slow)
    idx.append_to_index(small.where("chunk_id = 'a'").withColumn("chunk_id", F.lit("x")), path)
    assert sorted(r["chunk_id"] for r in idx.load_index(spark, path).collect()) == ["a", "b", "c", "x", "y"]
    other.clear()
    with pytest.raises(idx.ChangedError):
        idx.append_to_index(small.where("chunk_id = 'a'"), path, "upsert")


def test_marks(spark, small):
    path = new_path(spark, "test-index")
    idx.write_index(small, path, {"s": 0})
    more = small.where("chunk_id = 'a'").withColumn("chunk_id", F.lit("x"))
    for n in (0, 1, 1, 0):
        idx.append_to_index(more, path, mark=("s", n))
    assert idx.read_manifest(spark, path).first()["count"] == 4
    idx.append_to_index(more.limit(0), path, mark=("s", 2))
    assert idx.current_version(spark, path).marks == {"s": 2}


def test_each_text_is_embedded_once(spark, tmp_path):
    store, calls = str(tmp_path / "vectors"), tmp_path / "calls"
    calls.mkdir()

    def counting(texts):
        import uuid

        (calls / uuid.uuid4().hex).write_text("\n".join(texts))
        return np.array([[len(t), t.count("a")] for t in texts], np.float32).reshape(-1, 2)

    def asked():
        out = sorted(line for f in calls.iterdir() for line in f.read_text().split("\n"))
        for f in calls.iterdir():
            f.unlink()
        return out

    rows = [(n, ["a  b", "a b\n", "c", None, "", "long a " * 3][n % 6], 7) for n in range(3000)]
    df = spark.createDataFrame(rows, "vector int, content string, text_digest int").repartition(5)
    want = {"a  b": [3, 1], "a b\n": [3, 1], "c": [1, 0], None: [0, 0], "": [0, 0], "long a " * 3: [20, 3]}
    got = embed.embed_distinct(df, counting, store).collect()
    assert len(got) == 3000 and all(list(r["vector"]) == want[r["content"]] and r["text_digest"] == 7 for r in got)
    assert asked() == sorted(["a b", "c", "", "long a long a long a"])
    more = df.unionByName(spark.createDataFrame([(1, "new", 7)], df.schema))
    assert embed.embed_distinct(more, counting, store).count() == 3001
    assert asked() == ["new"]
    assert embed.embed_distinct(more, counting, store).count() == 3001 and asked() == []
    assert embed.embed_distinct(df.limit(0), counting).count() == 0
    assert embed.embed_chunks(df.limit(3), counting).columns == ["content", "text_digest", "vector"]
