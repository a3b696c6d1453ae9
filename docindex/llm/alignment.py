"""Aligning the tokens of two tokenizers over the same bytes.

A text's tokens under A and under B both tile its bytes, so their end offsets are
two sorted lists, and aligning them is merging these. The merge path is cut by
binary searches on its diagonals into pieces of equal work, whatever the lengths
of the texts in a batch; each piece emits the tokens that overlap, and what
lies across the borders of pieces is stitched into groups: the shortest
stretches at whose ends tokens of both end.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach
from .common import load, materialize, spare

#: Steps of the merge path in a piece.
PIECE = 1 << 16
#: Characters of text that are aligned at once; a longer text is by itself.
AT_ONCE = 1 << 20
#: Distinct words held by a task, and the longest of them.
KEPT, LONGEST = 250_000, 64

# How A's file says that texts are cut before merging, and the expression that this stands for.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> list[tuple[int, int]]:
    """Points (i, j) that cut the merge of the sorted ``a`` and ``b`` into pieces of ``piece``
    steps, from (0, 0) to both ends. Of equal values that in ``a`` comes first. Every
    point is found by a binary search of its own on its diagonal i + j."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        i = (low + high) // 2
        open_ = low < high
        # Is a[i] among the first d values of the merge? Then more of a belongs before the point.
        before = np.zeros(len(d), bool)
        before[open_] = a[i[open_]] <= b[d[open_] - 1 - i[open_]]
        low, high = np.where(open_ & before, i + 1, low), np.where(open_ & ~before, i, high)
    return [*zip(low.tolist(), (d - low).tolist(), strict=True)]


def piece_overlaps(a: np.ndarray, b: np.ndarray, first: tuple[int, int], last: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What one piece of the merge emits: the tokens of A and B (positions) that overlap, one pair
    for each step of the path, and whether they end together. A token of A is met at its own end
    by the B token that is open there, and the other way round; ends that agree give one pair, from A's side."""
    (i0, j0), (i1, j1) = first, last
    own_a, own_b = a[i0:i1], b[j0:j1]
    open_b = j0 + np.searchsorted(own_b, own_a, "left")
    open_a = i0 + np.searchsorted(own_a, own_b, "left")
    ends = np.zeros(len(own_a), bool)
    inside = open_b < len(b)
    ends[inside] = b[open_b[inside]] == own_a[inside]
    # B ends that agree with an end of A were emitted with that one, in this piece or the one before.
    done = np.zeros(len(own_b), bool)
    some = open_a < i1
    done[some] = a[open_a[some]] == own_b[some]
    if i0 and len(own_b):
        done |= own_b == a[i0 - 1]
    at = np.concatenate([own_a, own_b[~done]])
    order = np.argsort(at, kind="stable")
    left = np.concatenate([np.arange(i0, i1), open_a[~done]])[order]
    right = np.concatenate([open_b, np.arange(j0, j1)[~done]])[order]
    return left, right, np.concatenate([ends, np.zeros(int((~done).sum()), bool)])[order]


def align_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, together, group) for all overlapping pairs of tokens, from their end offsets
    (growing, the last ones equal). ``group`` counts on over the borders of pieces: a
    group that a piece leaves open is closed by a later one."""
    cuts = merge_path(a, b, piece)
    parts = [piece_overlaps(a, b, p, q) for p, q in zip(cuts, cuts[1:], strict=False)]
    left, right, together = (np.concatenate(x) if parts else np.zeros(0, int) for x in (zip(*parts, strict=True) if parts else [()] * 3))
    together = together.astype(bool)
    group = np.cumsum(together) - together
    return left, right, together, group


class TwoTokenizers:
    """Token ids under A and B. A space between two characters that are not blank is a place where both
    tokenizers start a token whatever stands around it (A's expression matches from there, none of
    B's pieces has a blank after another character), so a text is cut there and the ids of a word are kept."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.b = SentencePieceProcessor(model_file=b_path)
        self.encode_a = self._open_a(a_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        by_word = not any(re.search("[^▁]▁", p) for p in pieces)
        self.words = re.compile(r"(?<=\S) (?=\S)").split if by_word else lambda text: [text]
        #: Words to their ids, as bytes; and the words whose bytes a tokenizer doesn't give back.
        self.kept: tuple[dict[str, bytes], dict[str, bytes], set[str]] = {}, {}, set()

    def _open_a(self, path: str):
        """Texts to ids. If each merge makes the next token, merging by the rank of what is made is the same, which a faster
        library does; for other vocabularies, or texts cut in another way, the file's own tokenizer encodes."""
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        # Printable bytes are written as their own characters, the others as those from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        byte = {chr(n if n in printable else next(others)): n for n in range(256)}
        self.bytes_a = [b""] * own.get_vocab_size()
        for token, i in own.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in said["model"]["merges"]]
        vocabulary = said["model"]["vocab"]
        if all(vocabulary[t] == 256 + n for n, t in enumerate(merges)) and said["pre_tokenizer"] == PRE_TOKENIZER and not said["normalizer"]:
            import tiktoken

            ranks = {self.bytes_a[i]: i for i in range(256 + len(merges))}
            return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda text: own.encode(text, add_special_tokens=False).ids

    def _add(self, words: list[str], kept: tuple[dict, dict, set]) -> None:
        for word, right in zip(words, self.b.encode(words, num_threads=1), strict=True):
            left = self.encode_a(" " + word)
            kept[0][word], kept[1][word] = array("I", left).tobytes(), array("I", right).tobytes()
            whole = b" " + word.encode()
            if b"".join([self.bytes_b[i] for i in right]) != whole or b"".join([self.bytes_a[i] for i in left]) != whole:
                kept[2].add(word)

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids under A, with a space before it, and under B; none if the text is
        empty or either's bytes are others than those of the text with the space."""
        cut = [self.words(t) if t else [] for t in texts]
        every = {w for words in cut for w in words}
        kept = self.kept
        new = [w for w in every if w not in kept[0]]
        if len(kept[0]) + len(new) > KEPT:
            self.kept = kept = {}, {}, set()
            new = [*every]
        if new:
            self._add(new, kept)
        out = []
        for words, text in zip(cut, texts, strict=True):
            a, b = (np.frombuffer(b"".join(map(k.__getitem__, words)), np.uint32).astype(np.int64) for k in kept[:2])
            if kept[2] and not kept[2].isdisjoint(words):
                whole = b" " + text.encode()
                if any(b"".join(map(table.__getitem__, ids.tolist())) != whole for table, ids in ((self.bytes_a, a), (self.bytes_b, b))):
                    a = b = a[:0]
            out.append((a, b))
        for word in [w for w in new if len(w) > LONGEST]:
            for k in kept[:2]:
                k.pop(word)
        return out


def _group_texts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray, n_docs: int) -> list[str]:
    """For each document ``a1,a2|b1;a3|b2,b3``, from ids, the groups that they are in (counted over all documents)
    and how many tokens each document has."""
    written = [str(i) + mark for i in range(int(max(a.max(initial=0), b.max(initial=0))) + 1) for mark in (",", "|", ";")]
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[np.flatnonzero(np.diff(group_a, append=-1))] = 1
    mark_b[np.flatnonzero(np.diff(group_b, append=-1))] = 2
    n_groups = int(group_a[-1]) + 1 if len(a) else 0
    before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n_groups))])
    before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=n_groups))])
    keys = np.empty(len(a) + len(b), np.int64)
    keys[np.arange(len(a)) + before_b[group_a]] = 3 * a + mark_a
    keys[np.arange(len(b)) + before_a[group_b + 1]] = 3 * b + mark_b
    ends = np.cumsum(docs_a + docs_b)
    parts = [*map(written.__getitem__, keys.tolist())]
    return ["".join(parts[e - n : e])[:-1] for e, n in zip(ends.tolist(), (docs_a + docs_b).tolist(), strict=True)]


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, pairs array<struct<a:int,b:int,n:int>>, groups string"


def align_tokens(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Add to each row of ``docs`` how the tokens of its text under A (a byte-level vocabulary, the
    text with a space before it) and under B (pieces, which add that space) lie to each other.

    ``n_a`` and ``n_b`` tokens; ``n_groups``; ``groups``: the ids of A and B in each
    group, ``a1,a2|b1;a3|b2,b3``; ``n_links``: pairs of tokens that end together; ``pairs``: the distinct
    (a, b, n) of ids among these, with their number. Null and empty texts, and those whose bytes the
    tokens don't give back, have zeros, no pairs and an empty ``groups``. Repeated rows give
    repeated results. Columns of ``docs`` that have one of these names give way."""
    attach(docs.sparkSession)
    names = ["n_a", "n_b", "n_groups", "n_links", "pairs", "groups"]
    kept = [c for c in docs.columns if c == text or c.lower() not in names]
    mine = spare(kept, "aligned_text")
    rows = docs.select(F.col(text).alias(mine), *kept)
    fields = [f for f in rows.schema.fields[1:] if f.name.lower() not in names]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TwoTokenizers(a_path, b_path)
        for batch in batches:
            size, at = 0, 0
            lengths = pa.compute.utf8_length(batch.column(0)).fill_null(0).to_pylist()
            for n, length in enumerate([*lengths, None]):
                if length is None or size and size + length > AT_ONCE:
                    if n > at:
                        yield _aligned(batch.slice(at, n - at), encode, [f.name for f in fields])
                    size, at = 0, n
                size += length or 0

    return rows.select(*(F.col(f"`{c}`") for c in [mine, *(f.name for f in fields)])).mapInArrow(align, f"{shape}, {ALIGNED}" if fields else ALIGNED)


def _aligned(batch: pa.RecordBatch, encode: TwoTokenizers, names: list[str]) -> pa.RecordBatch:
    ids = encode([t or "" for t in batch.column(0).to_pylist()])
    n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
    a, b = (np.concatenate([x[k] for x in ids]) if ids else np.zeros(0, np.int64) for k in (0, 1))
    # One merge for all texts of the batch: each ends where tokens of both end.
    left, right, together, group = align_ends(np.cumsum(encode.size_a[a]), np.cumsum(encode.size_b[b]))
    group_a, group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    group_a[left], group_b[right] = group, group
    links = np.flatnonzero(together)
    owner = np.repeat(np.arange(len(ids)), n_a)[left[links]]
    n_links = np.bincount(owner, minlength=len(ids))
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    n_groups = np.array([group_a[e - 1] - group_a[e - n] + 1 if n else 0 for e, n in zip(ends_a.tolist(), n_a.tolist(), strict=True)], np.int64)
    # Distinct pairs of each text; ids are below 2 to the 20th, texts of a batch below 2 to the 24th.
    packed, count = np.unique(owner << 40 | a[left[links]] << 20 | b[right[links]], return_counts=True)
    offsets = np.searchsorted(packed >> 40, np.arange(len(ids) + 1)).astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array((packed >> 20 & 0xFFFFF).astype(np.int32)), pa.array((packed & 0xFFFFF).astype(np.int32)), pa.array(count.astype(np.int32))], names=["a", "b", "n"])
    pairs = pa.ListArray.from_arrays(pa.array(offsets), struct)
    texts = _group_texts(a, b, group_a, group_b, n_a, n_b, len(ids))
    new = [pa.array(x) for x in (n_a, n_b, n_groups, n_links)]
    return pa.RecordBatch.from_arrays([*batch.columns[1:], *new, pairs, pa.array(texts, pa.string())], [*names, "n_a", "n_b", "n_groups", "n_links", "pairs", "groups"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best) for every pair of ids that is linked anywhere: its links in all rows of
    ``aligned``, and whether no other pair of the same ``b`` has more.

    Tokens that end together are one the end of the other, so the vocabularies bound the number of pairs: a token of n bytes has at
    most n such partners that are no longer, which gives under a million for vocabularies of 50,000 and 32,000, however many texts there are."""
    counts = aligned.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Add to each row of ``aligned`` (a table) ``n_best``: its links whose pair is the best of its b, and
    ``count_sum``: the counts of the pairs of all its links. ``counts`` is broadcast: its size is bounded (see ``pair_counts``).
    ``pairs`` is dropped."""
    kept = [c for c in aligned.columns if c.lower() not in ("pairs", "n_best", "count_sum")]
    rows = aligned.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("kept"), "pairs")
    joined = rows.select("row", "kept", F.explode_outer("pairs").alias("link")).join(F.broadcast(counts), (F.col("link.a") == F.col("a")) & (F.col("link.b") == F.col("b")), "left")
    n = F.col("link.n").cast("long")
    best, total = (F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in (F.when(F.col("best"), n), n * F.col("count")))
    out = joined.groupBy("row").agg(F.first("kept").alias("kept"), best.alias("n_best"), total.alias("count_sum"))
    return out.select(*(F.col(f"kept.`{c}`") for c in kept), "n_best", "count_sum")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    aligned = align_tokens(load(spark, sf_dir, "documents").select("doc_id", "text"), a, b)
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    kept = materialize(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs"), "aligned")
    return score_links(kept, pair_counts(kept)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
