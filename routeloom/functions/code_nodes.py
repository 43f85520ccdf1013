"""Source text of JavaScript, Java, Go and Ruby as rows of a shallow syntax tree, and none but rows: what they mean is found by joins.

A node has a kind (word, string, mark, paren, bracket, brace, block, error), the
node around it, and its span. Words are dotted names; blocks are Ruby's, from
the keyword that opens them to their ``end``. Nothing fails: a bracket without
its partner, a string without its end and a block without its ``end`` give an
error node, and reading goes on.
"""

from __future__ import annotations

import bisect
import re

from .code_text import _blanked, spans

NODE = "repo string, rel_path string, language string, node int, parent int, nth int, kind string, text string, begin int, end int, line int, end_line int"
SCAN = {"nodejs": "js", "java": "java", "golang": "go", "ruby_on_rails": "ruby"}
#: Words that open a block in Ruby, those that do so at the start of a statement only, and those whose ``do`` opens no second one.
BLOCKS, BLOCKS_AT_START, WITH_DO = {"class", "module", "def", "begin", "case", "do"}, {"if", "unless", "while", "until", "for"}, {"while", "until", "for"}
_PARTS = re.compile(r"@{0,2}[A-Za-z_$][\w$]*(?:(?:\.|::|\?\.|&\.)@?[A-Za-z_$][\w$]*)*[?!]?|@[A-Za-z_][\w.]*|[()\[\]{}]|=>|->|:=|[,;=:<>|&*.]|['\"`]|\d[\w.]*|\n")
_PAIR = {")": "(", "]": "[", "}": "{"}
_KIND = {"(": "paren", "[": "bracket", "{": "brace"}


def nodes(text: str, language: str):
    """(node, parent, nth, kind, text, begin, end, line, end_line); node 0 is the file."""
    scan = SCAN[language]
    inside = list(spans(text, scan))
    code = _blanked(text, ((a, b) for _, a, b in inside))
    strings = {a - 1: (kind, a, b) for kind, a, b in inside if kind != "comment"}
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    out = [[0, -1, 0, "file", "", 0, len(text), 1, line(len(text))]]
    stack, children = [(0, "")], [0]
    start, looping, skip = True, -1, -1

    def add(kind, value, begin, end):
        parent = stack[-1][0]
        children[parent] += 1
        out.append([len(out), parent, children[parent], kind, value, begin, end, line(begin), line(max(begin, end - 1))])
        children.append(0)
        return len(out) - 1

    def close(at, end):
        out[stack.pop()[0]][6:9:2] = [end, line(at)]

    for m in _PARTS.finditer(code):
        t, at = m[0], m.start()
        if at < skip:
            continue
        if t == "\n":
            start = True
            continue
        if t in "'\"`" and len(t) == 1:
            kind, a, b = strings.get(at, ("open", at + 1, at + 1))
            add("string" if kind == "string" else "error", text[a:b], at, b + 1)
            skip = b + 1
        elif t in _KIND:
            stack.append((add(_KIND[t], "", at, len(text)), t))
        elif t in _PAIR:
            # A bracket closes its partner, and all that was left open inside it.
            deep = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][1] == _PAIR[t]), 0)
            if not deep or any(x[1] == "end" for x in stack[deep + 1 :]):
                add("error", t, at, at + 1)
            else:
                while len(stack) - 1 > deep:
                    out[stack[-1][0]][3] = "error"
                    close(at, at)
                close(at, at + 1)
        elif scan == "ruby" and t == "end" and (code[at - 1 : at] not in (".", ":")):
            if any(x[1] == "end" for x in stack):
                while stack[-1][1] != "end":
                    out[stack[-1][0]][3] = "error"
                    close(at, at)
                close(at, at + 3)
            else:
                add("error", t, at, at + 3)
        elif scan == "ruby" and (t in BLOCKS or (start and t in BLOCKS_AT_START)) and code[at - 1 : at] not in (".", ":") and not (t == "do" and looping == line(at)):
            if t in WITH_DO:
                looping = line(at)
            stack.append((add("block", t, at, len(text)), "end"))
            start = True
            continue
        else:
            add("word" if re.match(r"[@\w$]", t) else "mark", t, at, m.end())
        start = t in (";", "=", "|", "->", "(")
    while len(stack) > 1:
        out[stack.pop()[0]][3] = "error"
    return out
