"""Counting the tokens of a byte-level BPE vocabulary, so that counts of joined texts add up.

Pairs are merged inside of pre-tokens only, so a text has the tokens of its pre-tokens. Joining
two texts changes pre-tokens around the seam and no others: these are cut and counted again, the rest is
taken from running sums.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

# Fixed value: how texts are cut before pairs are merged, for the vocabularies of 50,000 tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose counts a worker keeps, and the longest of them.
KEPT, LONGEST = 300_000, 64


def send(path: str) -> None:
    """Let the workers of the running application have the file too."""
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    if session is not None:
        session.sparkContext.addFile(path)


def _found(path: str) -> str:
    """The file where it lies here: under its own path, or sent by ``send``."""
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


@lru_cache(4)
def _ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(_found(path), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(8)
def encoding(ranks_path: str, pattern: str):
    """An encoding from a file of ranks: a token in base64 and its rank in each line."""
    import tiktoken

    return tiktoken.Encoding(ranks_path, pat_str=pattern, mergeable_ranks=_ranks(ranks_path), special_tokens={})


@lru_cache(8)
def _cutter(pattern: str):
    """The pattern for the ``regex`` library, with white space as the tokenizers' own library has it."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).finditer


class _Counts(dict):
    def __init__(self, ranks_path: str):
        super().__init__()
        self.whole = encoding(ranks_path, "(?s).+").encode_ordinary  # one pre-token at a time

    def __missing__(self, piece: str) -> int:
        n = len(self.whole(piece))
        if len(piece) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = n
        return n


@lru_cache(4)
def _counts(ranks_path: str) -> _Counts:
    return _Counts(ranks_path)


class Counted(NamedTuple):
    """A text with its tokens. ``ends`` and ``sums``: the ends of its pre-tokens and the tokens up to there; of a joined text only
    those of its last part, counted from ``tail`` on. ``tail``: what a text behind it may change, the last pre-token
    that isn't blank and what follows."""

    text: str
    tokens: int
    ends: list[int]
    sums: list[int]
    tail: str
    tail_tokens: int


class BpeCounter:
    """How many tokens a text has; strings of special tokens are ordinary text. Only the path of the vocabulary goes into
    tasks; the file is sent to workers that don't have it there."""

    def __init__(self, ranks_path: str, pattern: str = PATTERN):
        self.of = ranks_path, pattern
        send(ranks_path)

    def __call__(self, text: str) -> int:
        return len(encoding(*self.of).encode_ordinary(text))

    def many(self, texts: list[str]) -> list[int]:
        return [*map(len, encoding(*self.of).encode_ordinary_batch(texts, num_threads=1))]

    def measure(self, text: str) -> Counted:
        """Cut and count a text, once."""
        counts, pieces, ends = _counts(self.of[0]), [], []
        for m in _cutter(self.of[1])(text):
            pieces.append(m[0])
            ends.append(m.end())
        sums = [*accumulate(map(counts.__getitem__, pieces))]
        last = next((n for n in range(len(pieces) - 1, -1, -1) if not pieces[n].isspace()), 0)
        before = sums[last - 1] if last else 0
        total = sums[-1] if sums else 0
        return Counted(text, total, ends, sums, "".join(pieces[last:]), total - before)

    def join(self, left: Counted, between: str, right: Counted) -> Counted:
        """``left.text + between + right.text`` (``right`` from ``measure``), of which only the pre-tokens around the seam are counted."""
        counts = _counts(self.of[0])
        seam = len(left.tail) + len(between)
        near, at, pieces = left.tail + between + right.text, 0, []
        for m in _cutter(self.of[1])(near):
            pieces.append(m[0])
            at = m.end() - seam
            # Where a pre-token of both ends, or the right text starts, all that follows is as in the right text.
            if at == 0 or at > 0 and (n := bisect_left(right.ends, at)) < len(right.ends) and right.ends[n] == at:
                break
        n = bisect_left(right.ends, at) + 1 if at > 0 else 0
        before = right.sums[n - 1] if n else 0
        tokens = left.tokens - left.tail_tokens + sum(map(counts.__getitem__, pieces)) + right.tokens - before
        tail, tail_tokens = right.tail, right.tail_tokens
        if len(right.text) - len(tail) < at or not tail.strip():  # the new last pre-token lies at the seam, or all of the right text is blank
            own = "".join(pieces) + right.text[max(at, 0) :]
            fresh = self.measure(own)
            tail, tail_tokens = fresh.tail, fresh.tail_tokens
        return Counted(left.text + between + right.text, tokens, [], [], tail, tail_tokens)


class AnyCounter:
    """The same for any function of strings: joined texts are counted anew."""

    def __init__(self, count):
        self.count = count

    def measure(self, text: str) -> Counted:
        return Counted(text, self.count(text), [], [], "", 0)

    def join(self, left: Counted, between: str, right: Counted) -> Counted:
        return self.measure(left.text + between + right.text)
