"""C++ sources: classes, functions and declarations with their lines and bodies."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

# What counts as a class, a function definition and a declaration.
# A match from the first of several empty lines is the one that counts, so later ones
# are not tried; blanks aren't given back, as no blank can follow.
_BEGIN = r"(?<!\n\n)^\s*+"
_TEMPLATE = r"(?:template\s*<[^>]*>\s*)?"
_DECLSPEC = r"__declspec\([^)]*\)"
#: Words that may precede a type are words of a type as well, so only what is in front of the last declspec has to be told apart.
_WORDS = r"(?:(?:static|virtual|inline|explicit|const|extern)\s+)*+"
_MORE_WORDS = r"(?:(?:static|virtual|inline|explicit|constexpr|override|const|extern)\s+)*+"
_TYPE = r"[\w:*&<>]+(?:\s+[\w:*&<>]+)*"
#: Up to the first parenthesis a function has nothing else; cheaper to look for.
_OPENS = r"(?=[\w:*&<>\s]*+\()"
CLASS = re.compile(rf"(?P<signature>{_BEGIN}{_TEMPLATE}(?P<kind>class|struct)\s+(?:{_DECLSPEC}\s+)?(?P<name>\w+)(?:\s*:\s*[^{{]+)?)\s*\{{", re.M)
FUNCTION = re.compile(rf"(?P<signature>{_BEGIN}{_TEMPLATE}{_OPENS}(?:{_MORE_WORDS}{_DECLSPEC}\s+)*{_TYPE}\s+(?P<name>(?:\w+::)*\w+)\s*\([^)]*\)(?:\s*const)?(?:\s*noexcept)?(?:\s*override)?)\s*\{{", re.M)
DECLARATION = re.compile(rf"(?P<signature>{_BEGIN}{_OPENS}(?:{_WORDS}{_DECLSPEC}\s+)*{_TYPE}\s+(?P<name>\w+)\s*\([^)]*\)(?:\s*const)?)\s*;", re.M)

#: Names that a definition can't have; "else if (x) {" looks like one.
KEYWORDS = frozenset("if for while switch catch return else do sizeof".split())
BODY_CHARS = 2000
_BRACE = re.compile(r"[{}\"']")


class Braces:
    """Where braces are closed, by one pass over the text.

    A search that starts at a brace counts only braces outside of quotes, as seen from its start. A quote either changes
    "outside" with "inside" of its kind or nothing, so it permutes the three states; hence whatever the start, the states after it are
    one of three sequences, those that begin outside, in single or in double quotes at the start of the text. For each of
    them a stack matches the braces that lie outside."""

    def __init__(self, text: str):
        states = ["", "'", '"']
        self.ends: list[dict[int, int]] = [{}, {}, {}]
        self.outside: dict[int, int] = {}
        open_: list[list[int]] = [[], [], []]
        for m in _BRACE.finditer(text):
            at, c = m.start(), m[0]
            if c in "\"'":
                if text[at - 1 : at] != "\\":
                    states = [c if not q else "" if q == c else q for q in states]
                continue
            own = states.index("")  # always one of them
            if c == "{":
                self.outside[at] = own
                open_[own].append(at)
            elif open_[own]:
                self.ends[own][open_[own].pop()] = at

    def closing(self, start: int) -> int:
        """Where the brace opened at ``start`` is closed, -1 if it isn't. Braces in quotes
        don't count; a quote after a backslash doesn't open or close one."""
        return self.ends[self.outside[start]].get(start, -1)


_START = re.compile(_BEGIN, re.M)
_RUN = re.compile(r"[\w:*&<>\s]*")
_TEMPLATE_HEAD = re.compile(r"template\s*<")
_SPACE = re.compile(r"\s*")


class _Scan:
    """The matches of FUNCTION or DECLARATION from left to right, each place tried once.

    Whether an attempt comes to something is decided before it is made, by what all lines up to one opening parenthesis share: what follows the
    parenthesis, and the word before it. So a long run of lines without punctuation is looked at once, not from each of its lines."""

    def __init__(self, text: str, pattern: re.Pattern, words: str, name: str, tail: str, templates: bool):
        self.text, self.pattern, self.templates = text, pattern, templates
        self.before, self.name, self.tail = re.compile(words), re.compile(name), re.compile(tail)
        self.closes = [m.start() for m in re.finditer(r"\)", text)]
        self.greater = [m.start() for m in re.finditer(">", text)] if templates else []
        self.run = (0, -1)
        self.ends_well: dict[int, bool] = {}
        self.words: dict[int, tuple[int, bool]] = {}
        self.failed: set[int] = set()

    def _next(self, places: list[int], at: int) -> int:
        n = bisect_left(places, at)
        return places[n] if n < len(places) else -1

    def _opening(self, at: int) -> int:
        """The parenthesis that ends the run of names and blanks at ``at``, -1 if something else does."""
        if not self.run[0] <= at < self.run[1]:
            self.run = at, _RUN.match(self.text, at).end()
        end = self.run[1]
        return end if self.text[end : end + 1] == "(" else -1

    def _hopeful(self, at: int) -> bool:
        """Whether a signature without a template may start at ``at``, which isn't blank."""
        text, p = self.text, self._opening(at)
        if p < 0 or p in self.failed:
            return False
        if text.endswith("__declspec", at, p) and self.before.match(text, at).end() == p - len("__declspec"):
            return True
        close = self._next(self.closes, p)
        if close not in self.ends_well:
            self.ends_well[close] = close >= 0 and self.tail.match(text, close) is not None
        if not self.ends_well[close]:
            return False
        if p not in self.words:
            first, end = self.run[0], p
            while end > first and text[end - 1].isspace():
                end -= 1
            start = end
            while start > first and not text[start - 1].isspace():
                start -= 1
            self.words[p] = start, self.name.fullmatch(text, start, end) is not None
        start, good = self.words[p]
        return good and at < start

    def __iter__(self) -> Iterator[re.Match]:
        text, done = self.text, 0
        for begin in _START.finditer(text):
            at = begin.end()
            if begin.start() < done or at == len(text):
                continue
            places = [at]
            if self.templates and (head := _TEMPLATE_HEAD.match(text, at)) and (end := self._next(self.greater, head.end())) >= 0:
                places.insert(0, _SPACE.match(text, end + 1).end())
            if any([p < len(text) and self._hopeful(p) for p in places]):
                m = self.pattern.match(text, begin.start())
                if m:
                    done = m.end()
                    yield m
                else:
                    self.failed |= {self._opening(p) for p in places if p < len(text)}


def _functions(text: str) -> Iterator[re.Match]:
    return iter(_Scan(text, FUNCTION, _MORE_WORDS, r"(?:\w+::)*\w+", r"\)(?:\s*const)?(?:\s*noexcept)?(?:\s*override)?\s*\{", True))


def _declarations(text: str) -> Iterator[re.Match]:
    return iter(_Scan(text, DECLARATION, _WORDS, r"\w+", r"\)(?:\s*const)?\s*;", False))


_CLASS_WORD = re.compile(r"(?:class|struct)\s")


def _classes(text: str) -> Iterator[re.Match]:
    """The matches of CLASS; only lines that start like one are tried, and none behind the last brace."""
    done, last, greater = 0, text.rfind("{"), [m.start() for m in re.finditer(">", text)]
    for begin in _START.finditer(text):
        at = begin.end()
        if at >= last:
            return
        if begin.start() < done:
            continue
        if head := _TEMPLATE_HEAD.match(text, at):
            n = bisect_left(greater, head.end())
            if n == len(greater):
                continue
            at = _SPACE.match(text, greater[n] + 1).end()
        if _CLASS_WORD.match(text, at) and (m := CLASS.match(text, begin.start())):
            done = m.end()
            yield m


def _record(text: str, lines: list[int], m: re.Match, kind: str, name: str, owner: str | None, order: int, braces: Braces | None) -> dict:
    first = bisect_right(lines, m.start())
    end = braces.closing(m.end() - 1) if braces else -1
    last = bisect_right(lines, end if end >= 0 else m.end() - 1) if braces else first
    code = text[m.end() - 1 : min(end + 1, m.end() - 1 + BODY_CHARS)] if end >= 0 else ""
    return {"order_no": order, "name": name, "kind": kind, "signature": m["signature"].strip(), "body": code, "class_name": owner, "line_start": first, "line_end": last}


def _lines(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def definitions(text: str, exclude_keywords: bool = True) -> list[dict]:
    """Classes, then functions and methods, each in the order of the text."""
    lines, braces = _lines(text), Braces(text)
    out = [_record(text, lines, m, m["kind"], m["name"], None, n, braces) for n, m in enumerate(_classes(text))]
    for m in _functions(text):
        owner, _, name = m["name"].rpartition("::")
        if not (exclude_keywords and name in KEYWORDS):
            out.append(_record(text, lines, m, "method" if owner else "function", name, owner or None, len(out), braces))
    return out


def declarations(text: str, exclude_keywords: bool = True) -> list[dict]:
    lines = _lines(text)
    found = (m for m in _declarations(text) if not (exclude_keywords and m["name"] in KEYWORDS))
    return [_record(text, lines, m, "function", m["name"], None, n, None) for n, m in enumerate(found)]
