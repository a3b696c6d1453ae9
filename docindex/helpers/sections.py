"""Chunking of one document with any token counter.

The rules are those of the column version in ``operators.chunking``; that one needs counts
that add up, here the counter says what a joined text has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import regex

from ..functions.text import SYMBOL_PATTERNS
from .bpe import AnyCounter, BpeCounter, Counted

Counter = AnyCounter | BpeCounter
_HEADING = regex.compile(r"^#{1,6}\s+(.+)$", regex.M)
_FENCE = regex.compile(r"```.*?```", regex.S)
_TITLE_SYMBOL = regex.compile(r"[\p{L}\p{N}_.]+")
_SYMBOLS = [regex.compile(p.replace("(?md)", "(?m)")) for p in SYMBOL_PATTERNS]


def sections(text: str) -> list[tuple[str, str]]:
    """(title, section) between headings."""
    found = [*_HEADING.finditer(text)]
    if not found:
        return [("", text)]
    cuts = [0, *(m.start() for m in found), len(text)]
    titles = ["", *(m[1].strip() for m in found)]
    return [(t, s) for t, a, b in zip(titles, cuts, cuts[1:], strict=False) if (s := text[a:b].strip())]


def symbol(title: str, text: str) -> str:
    if m := _TITLE_SYMBOL.search(title):
        return m[0]
    return next((m[1] for p in _SYMBOLS if (m := p.search(text))), "")


def _parts(text: str) -> Iterator[tuple[str, bool]]:
    at = 0
    for m in [*_FENCE.finditer(text), None]:
        for p in regex.split(r"\n\n+", text[at : m.start() if m else len(text)]):
            if p.strip():
                yield p.strip(), False
        if m:
            yield m[0], True
            at = m.end()


def pack(text: str, most: int, counter: Counter) -> list[Counted]:
    """A large section in pieces of at most ``most`` tokens, but for single larger parts."""
    parts: list[Counted] = []
    for part, fenced in _parts(text):
        one = counter.measure(part)
        if fenced and parts and (both := counter.join(parts[-1], "\n", one)).tokens <= most:
            parts[-1] = counter.measure(both.text)
        else:
            parts.append(one)
    out: list[Counted] = []
    for part in parts:
        if out and (both := counter.join(out[-1], "\n\n", part)).tokens <= most:
            out[-1] = both
        else:
            out.append(part)
    return out


def chunk(text: str, most: int, least: int, count: Callable[[str], int]) -> list[dict]:
    """Chunks (content, tokens, section_title, symbol) of a document. A ``count`` with ``measure`` and
    ``join``, such as ``BpeCounter``, counts every part once."""
    counter = count if hasattr(count, "join") else AnyCounter(count)
    pieces = []
    for title, section in sections(text.replace("\u0001", "")):
        name, one = symbol(title, section), counter.measure(section)
        if one.tokens > most:
            pieces += [(p, title, name) for p in pack(section, most, counter)]
        elif one.tokens >= least or name:
            pieces.append((one, title, name))
    out: list[dict] = []
    for one, title, name in pieces:
        if out and out[-1]["tokens"] < least:
            # Chunks below the budget only; what is put behind has to be measured whole.
            both = counter.join(out[-1]["counted"], "\n\n", one if one.ends or not one.text else counter.measure(one.text))
            if both.tokens <= most:
                out[-1] |= {"counted": both, "tokens": both.tokens}
                continue
        if one.text:
            out.append({"counted": one, "tokens": one.tokens, "section_title": title, "symbol": name})
    return [{"content": c["counted"].text, "tokens": c["tokens"], "section_title": c["section_title"], "symbol": c["symbol"]} for c in out]
