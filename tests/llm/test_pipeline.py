import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docindex import llm
from docindex.llm import secrets, toxicity

from .helpers import documents, saved
from .test_text_sets import brute_components, brute_tiles


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    say = lambda n: " ".join("w%d" % rng.randrange(900) for _ in range(n))
    item = say(20)
    rows = [(n, f"{say(rng.randrange(5, 40))}. {say(12)}") for n in range(250)]
    bad = {n for n in range(0, 250, 6)}
    rows = [(i, t + f". you {rng.choice(['grumbix', 'grumbosa'])} now" if i in bad else t) for i, t in rows]
    rows += [(300 + n, rows[n][1] + (" tail" if n % 2 else "")) for n in range(1, 30)]
    rows += [(400, say(5) + " " + item), (401, " ".join(item.split()[10:] + item.split()[:10])), (402, "password = abcdefghijklmnop " + say(4)), (403, None), (404, ""), (405, say(6000))]
    folder = tmp_path_factory.mktemp("corpus")
    saved(folder, documents(spark, rows).drop("key"))
    saved(folder, spark.createDataFrame([(i, int(i in bad)) for i in range(0, 250)], "doc_id long, toxic int").withColumn("quality", F.lit(1)), "labels")
    saved(folder, spark.createDataFrame([(1, item)], "item_id long, text string"), "benchmark")
    return rows, item, str(folder)


def plain_pipeline(spark, rows, item, sf, tokenizer):
    """The stages again, one document after the other."""
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))

    def toxic(text):
        clean = 1.0
        for s in re.findall(r"[^.!?\n]+", (text or "").lower()):
            known = {f for w in set(re.findall(r"[^\W\d_]+", s)) for f in toxicity.features(w)}
            z = model.bias + sum(model.weights.get(f, 0) * sum(f in toxicity.features(w) for w in set(re.findall(r"[^\W\d_]+", s))) for f in known)
            clean *= 1 - 1 / (1 + math.exp(-z))
        return 1 - clean >= 0.3

    rows = [r for r in rows if not toxic(r[1])]
    groups = brute_components(rows)
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    rows = [r for r in rows if brute_tiles(words(r[1]), words(item), 5) < 0.5 * len(words(item))]
    (assign, *_) = secrets.RULES
    rows = [(i, t and re.sub(assign.pattern, lambda m: "[SECRET]" if re.match(assign.check, m[0]) else m[0], t)) for i, t in rows]
    out = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    return sorted(out)


def test_pipeline(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, item, sf = corpus
    got = sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect())
    want = plain_pipeline(spark, rows, item, sf, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    assert got == want
    ids = {g[0] for g in got}
    assert not ids & {0, 6, 12, 400, 401} and {1, 2, 402, 403, 404, 405} <= ids and 301 not in ids


def test_stages_keep_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus[2]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus[2])
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), corpus[2]).count() == 0


def test_batches_are_bounded(spark, tmp_path):
    """Also those of few long texts; a session's own bound stays."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = documents(spark, [(i, "abcd efgh " * 40_000) for i in range(20)]).drop("key").coalesce(1)
    saved(tmp_path, spark.createDataFrame([], "doc_id long, toxic int"), "labels")
    saved(tmp_path, spark.createDataFrame([], "item_id long, text string"), "benchmark")
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(bound)
        stage(spark, docs.limit(0), str(tmp_path))
        sizes = docs.mapInArrow(lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) > 8_000_000 and max(r.n for r in sizes) < 2_000_000
    spark.conf.set(bound, "3m")
    corpus_pipeline.bound_batches(spark)
    assert spark.conf.get(bound) == "3m"
    spark.conf.unset(bound)


def test_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm.QUERIES)
    assert numbers == list(range(1, 14)) and set(llm.ORACLE_SQL) <= set(llm.QUERIES)
