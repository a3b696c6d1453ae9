import numpy as np
import pytest
from pyspark.sql import functions as F

from docindex.operators import layout, search


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


def frames(spark, vectors, queries):
    index = spark.createDataFrame([(f"c{n:05}", [float(x) for x in v]) for n, v in enumerate(vectors)] + [("none", None)], "chunk_id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(queries)], "query_id int, vector array<double>")
    return index, asked


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(layout, "BLOCK_BYTES", 8 * 8 * 40)
    monkeypatch.setattr(layout, "QUERIES", 7)


def test_the_same_with_less_work(spark, small_blocks):
    rng = np.random.default_rng(3)
    heart = rng.normal(size=(20, 8))
    # One cluster holds a third of all vectors; some vectors are equal, some are zeros.
    of = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 20, 3000))
    vectors = np.round(heart[of] + 0.1 * rng.normal(size=(3000, 8)), 3)
    vectors[100:140] = vectors[60]
    vectors[5:9] = 0
    queries = np.concatenate([vectors[::100], np.zeros((1, 8)), -vectors[:2]])
    index, asked = frames(spark, vectors, queries)
    laid = layout.lay_out(index, 20)
    assert laid.sizes.sum() == 3000 and laid.sizes[-1] == 4
    assert laid.blocks.agg(F.max(F.size("ids"))).first()[0] == 40
    for k in (1, 10):
        assert rows(layout.nearest_in(asked, laid, k)) == rows(search.nearest(asked, index, k))
    multiplied = 0
    real = layout._pairs

    def counted(*args):
        nonlocal multiplied
        out = real(*args)
        multiplied += out.agg(F.sum(F.size("names") * F.size("ids"))).first()[0]
        return out

    layout._pairs = counted
    try:
        few = asked.where("query_id < 30")  # the others are far from everything
        layout.nearest_in(few, laid, 10).collect()
    finally:
        layout._pairs = real
    assert multiplied < 0.35 * 30 * 3000


def test_edges(spark, small_blocks):
    rng = np.random.default_rng(5)
    index, asked = frames(spark, rng.normal(size=(30, 8)), rng.normal(size=(3, 8)))
    laid = layout.lay_out(index, 4)
    assert rows(layout.nearest_in(asked, laid, 50)) == rows(search.nearest(asked, index, 50))
    assert layout.nearest_in(asked.limit(0), laid, 5).count() == 0
    assert layout.nearest_in(asked, layout.lay_out(index.limit(0), 4), 5).count() == 0
    zeros, _ = frames(spark, np.zeros((5, 8)), [])
    assert [r[2] for r in rows(layout.nearest_in(asked.limit(1), layout.lay_out(zeros, 4), 3))] == ["c00000", "c00001", "c00002"]
    mixed = index.unionByName(spark.createDataFrame([("x", [1.0])], index.schema))
    with pytest.raises(ValueError, match="lengths"):
        layout.lay_out(mixed, 4)
