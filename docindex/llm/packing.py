"""Best-fit packing of token pieces into sequences of a fixed length.

A histogram of piece lengths has at most ``capacity`` rows however large the
corpus is. Best-fit decreasing runs over these counts on the driver and gives,
for each length, runs of slots. Documents then take the slots: a piece's rank
among the pieces of its length picks the slot of that number.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, load, materialize

#: Rows that one task ranks at once.
RANKED = 20_000


class _Words(dict):
    """Ids of words as bytes, encoded when first seen."""

    #: Distinct words held at most, about 150 bytes each.
    KEPT = 200_000

    def __init__(self, model):
        super().__init__()
        # Byte-level vocabularies write bytes as characters: printable ones as
        # themselves, the others as those from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        byte = [chr(b if b in printable else next(others)) for b in range(256)]
        self.model, self.written = model, {c: "".join(byte[b] for b in chr(c).encode()) for c in range(256)}

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.KEPT:
            self.clear()
        ids = [t.id for t in self.model.tokenize(word.translate(self.written))]
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class WordEncoder:
    """Token ids of texts, as little-endian 32-bit bytes.

    The tokenizer cuts a text into words and its model encodes each word by itself, so
    the ids of a word are kept. Words are cut here for texts of Latin-1
    characters, which are their own NFC form; other texts go through the tokenizer
    whole, and so do those that hold the string of a special token, and all if it turns out to work in another way."""

    def __init__(self, path: str):
        import re

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        latin = [chr(i) for i in range(256)]
        of = lambda kind: "".join(re.escape(c) for c in latin if regex.fullmatch(kind, c))
        letters, numbers, blanks = of(r"\p{L}"), of(r"\p{N}"), of(r"[\t-\r \x85\xa0]")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blanks}{letters}{numbers}]+").findall
        self.ids = _Words(self.tokenizer.model)
        sample = "It's a Sample, 42 ÀÉ!? " + "".join(latin[33:])
        self.by_word = self._words(sample.lower()) == self._whole(sample)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, lower: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.words(lower)))

    def __call__(self, text: str) -> bytes:
        if self.by_word:
            try:
                text.encode("latin-1")
                lower = text.lower()
                if not any(s in lower for s in self.special):
                    return self._words(lower)
            except UnicodeEncodeError:
                pass
        return self._whole(text)


PIECES = "doc_id {0}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Cut every document (``doc_id``, ``text``; null text counts as empty) into
    pieces of at most ``capacity`` tokens, its ids followed by ``end_id``. Only a
    longer document is cut, and only its last piece may be shorter. An empty
    text is one piece of one token; repeated rows give repeated pieces. Ids may be of any
    type, other columns are dropped."""
    attach(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(tokenizer_path)
        schema = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows: list[tuple] = []
            owner: list[int] = []
            for doc, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[at : at + 4 * capacity]
                    owner.append(doc)
                    rows.append((k, at // 4, len(one) // 4, zlib.crc32(one)))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema.types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *cols], ["doc_id", *schema.names])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES.format(docs.schema["doc_id"].dataType.simpleString()))


def plan_best_fit(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best-fit decreasing over a histogram of lengths.

    Gives for each length runs (first rank, first sequence, pieces of this length
    in each sequence of the run, offset in the sequence), by rank. Sequences that
    hold the same lengths are handled as one group, and a length splits at most
    one group and opens one, so there are a few runs per length at any count."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, number of sequences)
    some = 0  # bit r is set if free[r] has groups
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        nonlocal some
        if n and room:
            free[room].append((first, n))
            some |= 1 << room

    for length in sorted(counts, reverse=True):
        left, out = counts[length], runs.setdefault(length, [])
        while left:
            fits = some >> length
            if not fits:
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            room = length + (fits & -fits).bit_length() - 1
            first, n = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
            each = min(room // length, left)
            take = min(n, left // each)
            out.append((counts[length] - left, first, each, capacity - room))
            left -= take * each
            put(room - each * length, first, take)
            put(room, first + take, n - take)
    return runs


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id``, ``piece`` and
    ``length`` (1 to ``capacity``): sequences are filled without gaps from offset 0.
    Other columns stay; any named like the two new ones give way. Give it a table that doesn't change when read again; it is read three times."""
    spark = pieces.sparkSession
    attach(spark)
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # a row per length
    runs = {n: np.array(r, np.int64).reshape(-1, 4) for n, r in plan_best_fit(counts, capacity).items()}
    # As an Arrow table it needs no Python worker; a list goes through workers of another kind, which stay beside those of the tasks.
    share = spark.createDataFrame(pa.table([pa.array([*c], pa.int64()) for c in zip(*((n, -(-c // RANKED)) for n, c in (counts or {0: 1}).items()), strict=True)], ["length", "parts"]))
    cols = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    rows = pieces.select(F.struct(*cols).alias("row"), "length", F.struct("doc_id", "piece", "ids_crc32").alias("key"))
    dealt = rows.join(F.broadcast(share), "length").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).drop("parts")
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = dealt.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("length", "part").orderBy("key")
    ranked = dealt.withColumn("rank", F.row_number().over(inside).cast("long") - 1).join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        out = np.empty((len(n), 2), np.int64)
        order = np.argsort(n, kind="stable")
        cuts = np.flatnonzero(np.diff(n[order])) + 1
        for at in np.split(order, cuts) if len(n) else []:
            run = runs[int(n[at[0]])]
            start, first, each, offset = run[np.searchsorted(run[:, 0], r[at], side="right") - 1].T
            k = r[at] - start
            out[at, 0], out[at, 1] = first + k // each, offset + k % each * n[at]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    return ranked.withColumn("slot", slot("length", "rank")).select("row.*", "slot.sequence_id", "slot.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048) -> DataFrame:
    """Pieces of ``docs`` with their places; tokens are counted once and kept as a
    table, so that ranks don't change if a task runs again."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(materialize(token_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
