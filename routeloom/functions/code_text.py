"""Reading code without a grammar: comments and string contents masked at equal length, brackets matched, arguments split."""

from __future__ import annotations

import bisect
import re
from array import array
from functools import lru_cache

OPEN, CLOSE = "([{", ")]}"


_QUOTES = {"go": "\"`'", "java": "\"'", "js": "\"'`", "ruby": "\"'", "python": "\"'", "groovy": "\"'"}
_BEGINS = {lang: re.compile(f"{'#' if lang in ('ruby', 'python') else r'//|/[*]'}|[{quotes}]") for lang, quotes in _QUOTES.items()}
_INK = re.compile(r"[^\n]")


def spans(text: str, language: str):
    """(kind, start, end) of comments and of the insides of strings, in order; an unclosed string ends with its line where the language has none over lines, kind ``open``."""
    begins = _BEGINS[language]
    i, n = 0, len(text)
    while m := begins.search(text, i):
        i, c = m.start(), m[0]
        if c in ("#", "//"):
            j = text.find("\n", i)
            j = n if j < 0 else j
            yield "comment", i, j
        elif c == "/*":
            j = text.find("*/", i)
            j = n if j < 0 else j + 2
            yield "comment", i, j
        else:
            j = i + 1
            while j < n and text[j] != c:
                if text[j] == "\\" and not (c == "`" and language == "go"):
                    j += 1
                elif text[j] == "\n" and c in "\"'" and language != "ruby":
                    break
                j += 1
            yield "string" if j < n and text[j] == c else "open", i + 1, min(j, n)
            j += 1
        i = j


def _blanked(text: str, places) -> str:
    """text with the places, given in order, as blanks."""
    out, at = [], 0
    for start, end in places:
        out += (text[at:start], _INK.sub(" ", text[start:end]))
        at = end
    return "".join([*out, text[at:]])


def mask(text: str, language: str) -> str:
    """text with comments and the insides of strings as blanks; line breaks stay, so every offset does."""
    # Of large texts none is kept: a worker that reads many would hold them all.
    return _masked(text, language) if len(text) <= 1 << 16 else _masked.__wrapped__(text, language)


@lru_cache(64)
def _masked(text: str, language: str) -> str:
    return _blanked(text, ((start, end) for _, start, end in spans(text, language)))


def masked_lines(text: str, language: str):
    """(line, masked line) of a text in order, made as they are asked for: neither the mask nor the lines of a large text are held."""
    inner, at = spans(text, language), 0
    place = next(inner, None)
    while at <= len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        out, done = [], at
        while place and place[1] < stop:
            start, end = max(place[1], done), min(place[2], stop)
            if start < end:
                out += (text[done:start], _INK.sub(" ", text[start:end]))
                done = end
            if place[2] > stop:
                break
            place = next(inner, None)
        yield text[at:stop], "".join([*out, text[done:stop]])
        at = stop + 1


def without_comments(text: str, language: str) -> str:
    """text with comments as blanks; what looks like one inside a string stays."""
    return _blanked(text, ((start, end) for kind, start, end in spans(text, language) if kind == "comment"))


def closing(masked: str, at: int) -> int:
    """Place of the bracket that closes the one at ``at``; the text's length if none does."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(masked, at):
        depth += 1 if m[0] in OPEN else -1
        if depth == 0:
            return m.start()
    return len(masked)


def split(masked: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of the top-level, comma-separated parts between start and end, trimmed; empty ones left out."""
    out, depth, a = [], 0, start
    for k in range(start, end + 1):
        c = masked[k] if k < end else ","
        depth += (c in OPEN) - (c in CLOSE)
        if c == "," and depth == 0 or k == end:
            x, y = a, k
            while x < y and masked[x].isspace():
                x += 1
            while y > x and masked[y - 1].isspace():
                y -= 1
            if x < y:
                out.append((x, y))
            a = k + 1
    return out


def arguments(text: str, masked: str, open_: int) -> tuple[list[str], int]:
    """Source of each argument of the call whose parenthesis opens at ``open_``, and where it closes."""
    end = closing(masked, open_)
    return [text[a:b] for a, b in split(masked, open_ + 1, end)], end


@lru_cache(1)
def _breaks(text: str) -> array:
    return array("q", (m.start() for m in re.finditer("\n", text)))


def line(text: str, at: int) -> int:
    """The line of a place, looked up among the text's line breaks, which are found once a text."""
    return bisect.bisect_left(_breaks(text), at) + 1


def literal(source: str, quotes: str = "\"'`") -> str | None:
    """The value of a plain string literal; None for anything else, templates with holes included."""
    if len(source) < 2 or source[0] not in quotes or source[-1] != source[0] or source[0] in source[1:-1].replace("\\" + source[0], ""):
        return None
    body = source[1:-1]
    if source[0] == "`" and "${" in body:
        return None
    return body if source[0] == "`" else re.sub(r"\\(.)", lambda m: m[0] if m[1] in "dwsbDWSB" else m[1], body)
