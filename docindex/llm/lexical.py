"""Ranked lexical search by the Best Position Algorithm.

Documents are cut into segments. A segment holds for each term of the queries a list of
its documents by falling impact, the share of a score that depends on the document.
All lists of a query are read in step from their tops; a document seen for
the first time is looked up in all the other lists at once (direct access), which
also says where it stands there. Each list keeps its best position: up to
there all of its documents have been seen. What no one has seen scores at most the sum of the impacts
behind the best positions, and a query ends when that is below its k-th score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import attach
from .common import drop, load, materialize

#: A segment ends with so many postings or documents, so a list of it fits in memory whatever the input.
POSTINGS, DOCS = 1 << 21, 1 << 16
#: Characters of queries that are answered in one pass over the documents.
BLOCK = 1 << 22
#: Rows read from each list before direct accesses are made and the threshold is looked at.
STEP = 32

# Letters stay, A-Z as a-z; other ASCII characters but digits and letters separate terms, in UTF-8 as in characters.
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8: maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_SPLIT).split()


SEGMENT = "ids array<{0}>, sizes array<long>, terms array<int>, counts array<int>, docs array<int>, tfs array<int>"


def write_segments(docs: DataFrame, vocabulary: dict[bytes, int], name: str = "segments") -> DataFrame:
    """The postings of ``vocabulary`` in ``docs`` (doc_id, text), a row for each segment, as a table.

    ``ids`` and ``sizes`` (terms with repeats) of its documents by id, nulls last, those without any
    term left out; ``terms`` that occur, ``counts`` of their documents, and ``docs`` (places in ``ids``) and ``tfs`` of all lists, one after the other."""
    attach(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        ids: list = []
        sizes: list[int] = []
        found: list[tuple[int, int, int]] = []
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                at = len(ids)
                ids.append(i)
                sizes.append(len(words))
                found += [(t, at, n) for w, n in Counter(words).items() if (t := number(w)) is not None]
                if len(found) >= POSTINGS or len(ids) >= DOCS:
                    yield _segment(ids, sizes, found, kind)
                    ids, sizes, found = [], [], []
        if ids:
            yield _segment(ids, sizes, found, kind)

    out = docs.select("doc_id", "text").mapInArrow(build, SEGMENT.format(docs.schema["doc_id"].dataType.simpleString()))
    return materialize(out, name)


def _segment(ids: list, sizes: list[int], found: list[tuple[int, int, int]], kind: pa.DataType) -> pa.RecordBatch:
    column = pa.array([i.as_py() for i in ids], kind)
    order = pc.sort_indices(column).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rows = np.array(found, np.int64).reshape(-1, 3)
    rows[:, 1] = place[rows[:, 1]]
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    own, counts = np.unique(rows[:, 0], return_counts=True)
    lists = [column.take(pa.array(order)), np.array(sizes, np.int64)[order], *(x.astype(np.int32) for x in (own, counts, rows[:, 1], rows[:, 2]))]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists], ["ids", "sizes", "terms", "counts", "docs", "tfs"])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Lists:
    """The impact lists of a segment. ``weights`` has the weight of each term number; ``n_docs`` and ``length``
    are the documents with terms and all their terms, of the whole corpus."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, length: int):
        m = 25 + 75 * sizes * n_docs // max(length, 1)
        impacts = np.repeat(weights[terms], counts) * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[docs]))
        lists = np.repeat(np.arange(len(terms)), counts)
        order = np.lexsort((docs, -impacts, lists))
        starts = np.cumsum(counts) - counts
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order)) - np.repeat(starts, counts)
        self.size = len(sizes)
        # By rank: documents and impacts; by document: the same documents with ranks and impacts, for direct access.
        self.by_rank = {int(t): (docs[order[s : s + n]], impacts[order[s : s + n]]) for t, s, n in zip(terms, starts, counts, strict=True)}
        self.by_doc = {int(t): (docs[s : s + n], ranks[s : s + n], impacts[s : s + n]) for t, s, n in zip(terms, starts, counts, strict=True)}

    def best(self, query: dict[int, int], k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores above 0 of the ``k`` best for ``query`` (term: occurrences), by falling score, then by place; those that
        score less than ``floor`` may lack. And how many documents were looked at."""
        own = [(t, n) for t, n in query.items() if t in self.by_rank]
        seen = np.zeros(self.size, bool)
        known = [np.zeros(len(self.by_rank[t][0]) + 1, bool) for t, _ in own]
        best = [0] * len(own)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step, looked = 0, STEP, 0
        while True:
            # Sorted access: the next rows of every list.
            new = [self.by_rank[t][0][depth : depth + step] for t, _ in own]
            depth, step = depth + step, 2 * step
            new = np.unique(np.concatenate(new)) if new else np.zeros(0, np.int64)
            new = new[~seen[new]]
            seen[new] = True
            looked += len(new)
            # Direct access: the documents' impacts and ranks in all lists.
            score = np.zeros(len(new), np.int64)
            for (t, n), marks in zip(own, known, strict=True):
                held, ranks, impacts = self.by_doc[t]
                at = np.minimum(np.searchsorted(held, new), len(held) - 1)
                there = held[at] == new
                score[there] += n * impacts[at[there]]
                marks[ranks[at[there]]] = True
            # Only the k best so far are kept; places are by id, so ties go to the smaller one.
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, score])
            top = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[top], scores[top]
            # Best positions move on over what has been seen, and the threshold is what stands behind them.
            threshold = 0
            for x, ((t, n), marks) in enumerate(zip(own, known, strict=True)):
                best[x] += int(np.argmin(marks[best[x] :]))
                impacts = self.by_rank[t][1]
                threshold += n * int(impacts[best[x]]) if best[x] < len(impacts) else 0
            kth = int(scores[k - 1]) if len(scores) >= k else 0
            if threshold < max(kth, floor) or threshold == 0:
                good = scores > 0
                return docs[good], scores[good], looked


RANKED = "item_id {0}, doc_id {1}, score long"


def _answer(segments: DataFrame, item_type: str, items: list, queries: list[dict[int, int]], weights: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """The ``k`` best of each segment; later segments of a task start from the scores of earlier ones."""
    shared = segments.sparkSession.sparkContext.broadcast((items, queries, weights))
    id_type = segments.schema["ids"].dataType.elementType.simpleString()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, queries, weights = shared.value
        tops = [np.zeros(0, np.int64)] * len(queries)
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].values
                rest = [c[row].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:]]
                lists = Lists(*rest, weights, n_docs, length)
                who, docs, scores = [], [], []
                for q, query in enumerate(queries):
                    floor = int(tops[q][-1]) if len(tops[q]) == k else 0
                    found, score, _ = lists.best(query, k, floor)
                    tops[q] = np.sort(np.concatenate([tops[q], score]))[::-1][:k]
                    who += [q] * len(found)
                    docs.append(found)
                    scores.append(score)
                if who:
                    keys = pa.array(items).take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([keys, ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], ["item_id", "doc_id", "score"])

    return segments.mapInArrow(answer, RANKED.format(item_type, id_type))


def _blocks(queries: DataFrame) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Queries in blocks of at most BLOCK characters, or one longer query; only one block at a time is held."""
    items, words, size = [], [], 0
    for row in queries.select("item_id", "text").toLocalIterator():
        if items and size + len(row[1] or "") > BLOCK:
            yield items, words
            items, words, size = [], [], 0
        items.append(row[0])
        words.append(terms(row[1]))
        size += len(row[1] or "")
    if items:
        yield items, words


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best of ``docs`` (doc_id, text) for each of ``queries`` (item_id, text): item_id,
    rank (from 1), doc_id, score; equal scores by doc_id, nulls last.

    Queries come in blocks of bounded size; the documents are read once for each block. Null texts and texts without any term
    are no documents and find nothing. Rows that share a doc_id are documents of their
    own, and so are queries that share an item_id: their ranks are numbered together, by score. Ids may be of any type that
    sorts, other columns are dropped."""
    spark = docs.sparkSession
    item_type, id_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, "item_id"), (docs, "doc_id")))
    out = None
    for items, words in _blocks(queries):
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        segments = write_segments(docs, vocabulary)
        n_docs, length = segments.select(F.size("ids").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
        counts = segments.select(F.explode(F.arrays_zip("terms", "counts")).alias("c")).groupBy("c.terms").agg(F.sum("c.counts")).collect()  # a row for each term of the block
        df = dict(map(tuple, counts))
        weights = np.array([weight(n_docs or 0, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        coded = [dict(Counter(vocabulary[w] for w in ws)) for ws in words]
        kind = queries.schema["item_id"].dataType
        numbers = spark.createDataFrame([(n, i) for n, i in enumerate(items)], f"n long, item_id {kind.simpleString()}")
        local = _answer(segments, "long", [*range(len(items))], coded, weights, n_docs or 0, length or 0, k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        few = local.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(16))).withColumn("r", F.row_number().over(W.partitionBy("item_id", "part").orderBy(*order))).where(F.col("r") <= k)
        few = few.select(F.col("item_id").alias("n"), "doc_id", "score").withColumn("rank", F.row_number().over(W.partitionBy("n").orderBy(*order))).where(F.col("rank") <= k)
        best = materialize(few.join(F.broadcast(numbers), "n").select("item_id", "rank", "doc_id", "score"), "ranked")
        drop(segments)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    return out


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS words FROM documents),
s AS (SELECT doc_id, len(words)::BIGINT AS n, words FROM d WHERE len(words) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS length FROM s),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(words) AS term FROM s) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*)::BIGINT AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(qtf * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // length))))::BIGINT AS score
  FROM q JOIN df USING (term) JOIN tf USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""
