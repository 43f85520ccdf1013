"""Facts of Go: router calls with the prefixes of their groups, routers that are passed on, handlers and methods.

A prefix is known as far as the file says. Where it begins at a parameter of the
function around it, the row names function and parameter (detail), and what
callers pass is found by joins.
"""

from __future__ import annotations

import bisect
import json
import re
from itertools import accumulate

from .code_text import arguments, closing, line, literal, mask
from .rows import fact

# Verbs of routers.
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
_CALL = re.compile(r"(?<![\w.])([A-Za-z_][\w.]*)\s*\.\s*(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Get|Post|Put|Delete|Patch|Head|Options|Any|All|Handle|HandleFunc|HandlerFunc|Match|Method|MethodFunc)\s*(?=\()")
_GROUP = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*:?=\s*([A-Za-z_][\w.]*)\s*\.\s*(Group|Route|PathPrefix|Subrouter)\s*(?=\()")
_CLOSURE = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*\.\s*(Route|Group)\s*(?=\()")
GROUPS = ("Group", "Route", "PathPrefix", "Subrouter")
_PASSED = re.compile(r"(?<![\w.])([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)(?=\()")
_GROUPED = re.compile(rf"([A-Za-z_]\w*)\.(?:{'|'.join(GROUPS)})\(\s*([\"`][^\"`]*[\"`])\s*\)")
_FUNC = re.compile(r"\bfunc\s*(?:\(\s*\w*\s*\*?\s*([A-Za-z_]\w*)[^)]*\)\s*)?([A-Za-z_]\w*)\s*(?=\()")
_METHODS = re.compile(r"(?:\s*\.\s*\w+\s*\([^()]*\))*?\s*\.\s*Methods\s*\(([^()]*)\)")


class Spans:
    """Tuples that begin with (begin, end), in order, asked by place without a look at each."""

    def __init__(self, spans: list[tuple]):
        self.spans, self.begins = spans, [x[0] for x in spans]
        self.reach = list(accumulate((x[1] for x in spans), max))

    def last(self, before: int, least: int) -> tuple | None:
        """The last one that begins before ``before`` and ends at ``least`` or later."""
        k = bisect.bisect_left(self.begins, before) - 1
        while k >= 0 and self.reach[k] >= least:
            if self.spans[k][1] >= least:
                return self.spans[k]
            k -= 1
        return None


def _after_func(code: str, at: int) -> bool:
    while at and code[at - 1].isspace():
        at -= 1
    return code.endswith("func", 0, at)


def joined(prefix: str, path: str) -> str:
    return re.sub("/{2,}", "/", (prefix.rstrip("/") + "/" + path.lstrip("/")) if prefix else path)


def extract(text: str, path: str):
    code = mask(text, "go")
    if not re.search(r"\bpackage\s", code):
        return
    for block in re.finditer(r"\bimport\s*(\([^)]*\)|[\w.]*\s*[\"`])", code):
        stop = block.end() if "(" in block[0] else text.find("\n", block.start())
        for alias, module in re.findall(r"([\w.]*)[ \t]*[\"`]([^\"`\n]+)[\"`]", text[block.start() + 6 : len(text) if stop < 0 else stop]):
            yield fact("import", name=alias or module.rsplit("/", 1)[-1], target=module, start_line=line(text, block.start()))
    groups: list[tuple[int, int, str, str, str]] = []  # begin, end, name, parent, path
    funcs = []
    for m in _FUNC.finditer(code):
        shut = closing(code, m.end())
        brace = code.find("{", shut)
        end = closing(code, brace) if brace >= 0 else m.end()
        params = [p.split()[0] for p in arguments(text, code, m.end())[0]]
        funcs.append((m.start(), end, m[2], params, line(text, m.start())))
        yield fact("go_func", name=m[2], owner=m[1], start_line=line(text, m.start()), end_line=line(text, end))
    around = Spans(funcs)
    scope = lambda at: around.last(at + 1, at) or (0, len(code), "", [], 0)
    for m in _GROUP.finditer(code):
        args, _ = arguments(text, code, m.end())
        p = literal(args[0]) if args else None
        if p is not None:
            groups.append((m.start(), scope(m.start())[1], m[1], m[2], p))
    for m in _CLOSURE.finditer(code):
        args, end = arguments(text, code, m.end())
        inner = re.match(r"func\s*\(\s*([A-Za-z_]\w*)", args[-1]) if args else None
        p = literal(args[0]) if len(args) == 2 else "" if len(args) == 1 else None
        if inner and p is not None:
            groups.append((m.end(), end, inner[1], m[1], p))

    named: dict[str, list] = {}
    for g in sorted(groups):
        named.setdefault(g[2], []).append(g)
    declared = {name: Spans(found) for name, found in named.items()}

    def prefix(name: str, at: int, seen: frozenset = frozenset()) -> tuple[str, str | None]:
        """Of the nearest enclosing declaration before the use, and the name it begins with; '' and none on a cycle."""
        best = declared[name].last(at, at) if name in declared else None
        if best in seen:
            return "", None
        if best is None:
            return "", name
        before, root = prefix(best[3], best[0], seen | {best})
        return joined(before, best[4]), root

    def origin(root: str | None, at: int) -> dict | None:
        """The parameter of the function around that a name is, as the function's line and the parameter's place."""
        _, _, name, params, first = scope(at)
        return {"func": first, "param": params.index(root)} if name and root in params else None

    for m in _PASSED.finditer(code):
        if _after_func(code, m.start()) or m[1].rsplit(".", 1)[-1] in GROUPS:
            continue
        for k, a in enumerate(arguments(text, code, m.end())[0]):
            group = _GROUPED.fullmatch(a)
            more = literal(group[2]) if group else ""
            if more is None or not (group or re.fullmatch(r"[A-Za-z_]\w*", a)):
                continue
            before, root = prefix(group[1] if group else a, m.start())
            src = origin(root, m.start())
            value = joined(before, more) if more else before
            if value or src:  # a router of its own without a prefix adds nothing
                qualifier, _, callee = m[1].rpartition(".")
                yield fact("go_pass", name=callee, owner=qualifier.rsplit(".", 1)[-1] or None, route=value, detail=json.dumps((src or {}) | {"arg": k}), start_line=line(text, m.start()))
    for m in _CALL.finditer(code):
        args, end = arguments(text, code, m.end())
        texts = [literal(a) for a in args]
        verb, at = m[2], 0
        if verb in ("Handle", "Method", "MethodFunc", "Match") and len(args) >= 3 and (texts[0] or args[0].rsplit("Method", 1)[-1]).upper() in VERBS:
            verbs, at = [(texts[0] or args[0].rsplit("Method", 1)[-1]).upper()], 1
        elif verb in ("Any", "All"):
            verbs = list(VERBS)
        elif verb in ("Handle", "HandleFunc", "HandlerFunc"):
            verbs = []
        else:
            verbs = [verb.upper()]
        if len(args) <= at + 1 and verb not in ("Any", "All") or len(args) <= at or not texts[at]:
            if verbs and len(args) > at + 1 and texts[at] is None and at == 0 and m[1].split(".")[-1].lower() in ("r", "router", "e", "app", "mux", "g", "group"):
                yield fact("reject", kind="go", detail="route is no literal", start_line=line(text, m.start()))
            continue
        route = texts[at]
        two = re.fullmatch(r"([A-Z]+) (/.*)", route)
        if two and two[1] in VERBS:
            verbs, route = [two[1]], two[2]
        if not route.startswith("/"):
            continue
        chain = _METHODS.match(text, end + 1)
        if chain:
            verbs = [x for x in VERBS if re.search(rf"\b(?:Method)?{x}\b", chain[1], re.I)] or verbs
        handler = args[-1] if re.fullmatch(r"[\w.]+", args[-1]) else None
        before, root = prefix(m[1], m.start())
        src = origin(root, m.start())
        for v in verbs or ["GET"]:
            yield fact("endpoint", kind="go", name=handler, method=v, route=joined(before, route), owner=m[1], target=handler, start_line=line(text, m.start()), end_line=line(text, end), detail=json.dumps(src) if src else None)
