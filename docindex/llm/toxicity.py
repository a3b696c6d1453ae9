"""Toxicity by multiple-instance learning: labels are known for documents,
sentences are what is scored. A sentence has the probability
``sigmoid(bias + sum of its features' weights)``; a document is toxic if any of
its sentences is, so its score is the noisy-or ``1 - prod(1 - p)``. Training
follows the gradient of that score through to the sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, load

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+").findall
#: A word counts as itself and by its beginnings of these lengths, as insults are inflected.
STEMS = (3, 4, 5)
#: A feature has to be so many times as frequent in toxic documents as in others.
RATIO = 3.0
#: And to occur in so many toxic documents.
LEAST = 3
#: Of those a feature in that share of the toxic documents counts; rarer ones have to be
#: certain, else they are learnt by heart, wrong labels included.
SHARE = 0.02
#: Chance that any feature at all is taken for certain though it is no more frequent in toxic documents.
ALPHA = 0.05
#: Features whose counts a task holds at once, but for those of one document.
COUNTED = 50_000
#: Words whose weights a task keeps.
KEPT = 100_000


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """A function from a text to (score, sentences as (start, end, p) with a known feature)."""
        weights, bias = self.weights, self.bias
        seen: dict[str, float] = {}
        soft_plus = lambda z: z if z > 30 else math.log1p(math.exp(z))
        empty = soft_plus(bias)

        def weight(word: str) -> float:
            if len(seen) > KEPT:
                seen.clear()
            seen[word] = w = sum(weights.get(f, 0.0) for f in features(word))
            return w

        def score(text: str) -> tuple[float, list[tuple[int, int, float]]]:
            lower = text.lower()
            if len(lower) != len(text):  # a few letters have longer lower cases; offsets must stay
                lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            loss, found = 0.0, []
            for m in _SENTENCE.finditer(lower):
                total = 0.0
                for w in {*_WORD(m[0])}:
                    v = seen.get(w)
                    total += weight(w) if v is None else v
                if total:
                    soft = soft_plus(bias + total)
                    loss += soft
                    found.append((m.start(), m.end(), -math.expm1(-soft)))
                else:
                    loss += empty
            return -math.expm1(-loss), found

        return score


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean documents a feature is, in parts: a feature may have several rows, which Spark sums."""
    clean: Counter = Counter()
    toxic: Counter = Counter()

    def part() -> pa.RecordBatch:
        words = [*(toxic.keys() | clean.keys())]
        out = pa.RecordBatch.from_pydict({"feature": pa.array(words, pa.string()), "n1": pa.array([toxic[w] for w in words], pa.int64()), "n0": pa.array([clean[w] for w in words], pa.int64())})
        toxic.clear()
        clean.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            (toxic if label.as_py() else clean).update({f for w in {*_WORD((text.as_py() or "").lower())} for f in features(w)})
            if len(toxic) + len(clean) > COUNTED:
                yield part()
    yield part()


def _surprise(n1: Column, n0: Column, share: float) -> Column:
    """Minus the logarithm of a bound (Chernoff's) on the chance that of ``n1 + n0``
    documents, each toxic with probability ``share``, ``n1`` or more are."""
    n = n1 + n0
    of = lambda k, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(F.lit(0.0))
    return F.when(n1 > n * share, of(n1, share) + of(n0, 1 - share)).otherwise(F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 16_000, max_features: int = 1_000, steps: int = 400, l2: float = 1e-5) -> Model:
    """Fit on labelled documents that aren't held out.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; rows with a null in
    any of these teach nothing. At most ``max_docs`` documents are used, those of
    the lowest hash of doc_id, and at most ``max_features`` features, those that are
    most typical of toxic documents; both bound what reaches
    the driver. Without labels of both classes the model scores every text 0."""
    attach(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") == 1).alias("toxic")).persist()
    try:
        n = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
        n1, n0 = n.get(True, 0), n.get(False, 0)
        if not n1 or not n0:
            return Model({}, -30.0)
        table = sample.mapInArrow(_counts, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).persist()
        p, q = (F.col("n1") + 0.5) / (n1 + 1), (F.col("n0") + 0.5) / (n0 + 1)
        gap = F.abs(p - q) / F.sqrt((F.col("n1") + F.col("n0") + 1) / (n1 + n0 + 2.0))
        least = math.log(max(table.count(), 1) / ALPHA)  # for the number of features tested
        certain = _surprise(F.col("n1"), F.col("n0"), n1 / (n1 + n0)) >= least
        telling = (F.col("n1") >= LEAST) & (p >= RATIO * q) & (certain | (F.col("n1") >= SHARE * n1))
        best = [r["feature"] for r in table.where(telling).orderBy(gap.desc(), "feature").limit(max_features).collect()]
        index = {f: i for i, f in enumerate(best)}

        def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for text, label in zip(batch.column(0), batch.column(1), strict=True):
                    bags: list[list[int]] = []
                    empty = 0
                    for m in _SENTENCE.finditer(text.as_py().lower()):
                        if bag := sorted({index[f] for w in {*_WORD(m[0])} for f in features(w) if f in index}):
                            bags.append(bag)
                        else:
                            empty += 1
                    out.append((label.as_py(), empty, bags))
                cols = [*zip(*out, strict=True)] if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.list_(pa.int32())))], ["toxic", "empty", "bags"])

        rows = sample.mapInArrow(compact, "toxic boolean, empty long, bags array<array<int>>").toArrow()
        table.unpersist()
    finally:
        sample.unpersist()
    return _descend(rows, best, steps, l2)


def _descend(rows: pa.Table, names: list[str], steps: int, l2: float) -> Model:
    """Adam on the mean log loss of the noisy-or."""
    y = rows.column("toxic").to_numpy().astype(float)
    empty = rows.column("empty").to_numpy().astype(float)
    bags = rows.column("bags").to_pylist()
    doc = np.array([d for d, b in enumerate(bags) for _ in b], np.int64)
    flat = [s for b in bags for s in b]
    sent = np.repeat(np.arange(len(flat)), [len(s) for s in flat]).astype(np.int64)
    feat = np.array([f for s in flat for f in s], np.int64)
    w, m, v = (np.zeros(len(names) + 1) for _ in range(3))
    w[-1] = -6.0
    for t in range(1, steps + 1):
        z = np.bincount(sent, w[feat], len(flat)) + w[-1]
        soft = np.bincount(doc, np.logaddexp(0, z), len(y)) + empty * np.logaddexp(0, w[-1])
        p = np.clip(-np.expm1(-soft), 1e-12, 1.0)
        pull = np.where(y > 0, -(1 - p) / p, 1.0) / len(y)
        gz = pull[doc] / (1 + np.exp(-z)) if len(z) else z
        g = np.append(np.bincount(feat, gz[sent], len(names)), gz.sum() + (pull * empty).sum() / (1 + np.exp(-w[-1])))
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model({f: float(x) for f, x in zip(names, w[:-1], strict=True) if abs(x) > 1e-6}, float(w[-1]))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", sentences_col: str = "sentences") -> DataFrame:
    """Add ``score`` (0 to 1) and ``sentences``, the spans (start, end, p; code
    points, end exclusive) of sentences with p of 0.1 or more. Other columns stay; any with
    the names of these two, which can be chosen, give way.
    Null and empty texts have no sentence: score 0."""
    from pyspark.sql import types as T

    attach(docs.sparkSession)
    docs = docs.select(*(c for c in docs.columns if c.lower() not in (score_col.lower(), sentences_col.lower())))
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(sentences_col, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            got = [score(t.as_py() or "") for t in batch.column(at)]
            spans = [[{"start": a, "end": b, "p": float(p)} for a, b, p in s if p >= 0.1] for _, s in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.float64()), pa.array(spans, kind)], [*batch.schema.names, score_col, sentences_col])

    return docs.mapInArrow(apply, schema)


#: From this score on a document counts as toxic.
THRESHOLD = 0.3


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("sentences").alias("n_toxic_sentences"))
