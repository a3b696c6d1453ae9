import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from docindex.llm import lexical

from .helpers import EDGES, documents, saved

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        ranked = []
        for doc, tf, n in held:
            m = 100 - 75 + (75 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in words(text) if t in tf)
            if score > 0:
                ranked.append((-score, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out)


def test_search_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "DOCS", 23)
    monkeypatch.setattr(lexical, "STEP", 2)
    monkeypatch.setattr(lexical, "BLOCK", 300)
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "B", "Straße", "ñandú", "x1", "日本", "w%d" % rng.randrange(40), "É"])
    docs = [(i, rng.choice([" ", ", ", "\n", "_"]).join(word() for _ in range(rng.choice([1, 3, 10, 60])))) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + EDGES[:7] + [(908, "word " * 500)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(12)] + [(50, None), (51, "!?"), (52, "nowhere"), (53, docs[7][1]), (54, "word WORD word")]
    saved(tmp_path, documents(spark, docs))
    sf = saved(tmp_path, spark.createDataFrame(items, "item_id long, text string"), "benchmark")
    got = lexical.op11_lexical(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == brute(docs, items)


def test_sql_twin(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.execute(lexical.OP11_SQL).fetchall())
    assert sorted(map(tuple, lexical.op11_lexical(spark, sf).collect())) == want


def test_reading_stops_early_and_finds_the_same():
    rng = np.random.default_rng(4)
    size, terms = 5000, 6
    own = [np.sort(rng.choice(size, n, replace=False)) for n in (3000, 2000, 500, 100, 40, 10)]
    tfs = np.concatenate([1 + rng.geometric(0.3, len(x)) for x in own])
    counts = np.array([len(x) for x in own])
    sizes = rng.integers(20, 900, size)
    weights = np.array([lexical.weight(size, n) for n in counts], np.int64)
    lists = lexical.Lists(sizes, np.arange(terms), counts, np.concatenate(own), tfs, weights, size, int(sizes.sum()))
    for query in ({5: 1, 4: 2}, {3: 1, 4: 1, 5: 1}, {0: 1, 1: 1, 2: 3}, {t: 1 for t in range(6)}, {9: 1}, {}):
        score = np.zeros(size, np.int64)
        for t, n in query.items():
            if t in lists.by_doc:
                score[lists.by_doc[t][0]] += n * lists.by_doc[t][2]
        order = [d for d in np.lexsort((np.arange(size), -score))[:10] if score[d] > 0]
        docs, scores, looked = lists.best(query, 10)
        assert docs.tolist() == order and scores.tolist() == score[order].tolist()
        held = len({int(d) for t in query if t in lists.by_doc for d in lists.by_doc[t][0]})
        assert looked <= held
        floor = int(scores[4]) if len(scores) > 4 else 0
        again, _, less = lists.best(query, 10, floor)
        assert again[:5].tolist() == order[:5] and less <= looked
    assert lists.best({0: 1}, 10)[2] < 200


@pytest.mark.parametrize("kind", ["string", "long"])
def test_ids_of_any_type_repeats_and_empty_tables(spark, kind):
    docs = spark.createDataFrame([("2", "a b", 1), ("10", "a b", 1), ("2", "a b", 1), (None, "a b", 1), ("3", "c", 2)], "doc_id string, text string, score int").withColumn("doc_id", lexical.F.col("doc_id").cast(kind))
    items = spark.createDataFrame([("q", "A")], "item_id string, text string")
    got = [tuple(r)[:3] for r in lexical.rank_documents(docs, items, 3).orderBy("rank").collect()]
    first = ["10", "2", "2"] if kind == "string" else [2, 2, 10]
    assert got == [("q", n, d) for n, d in enumerate(first, 1)]
    assert lexical.rank_documents(docs.where("false"), items).count() == 0
    assert lexical.rank_documents(docs, items.where("false")).count() == 0
