"""Facts of Java: Spring mappings of controllers and their interfaces, classes with their methods."""

from __future__ import annotations

import json
import re

from .code_text import arguments, closing, line, literal, mask, split
from .rows import fact

# Annotations.
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": None}
CONTROLLERS = {"RestController", "Controller"}
COMPONENTS = {"Service", "Component"} | CONTROLLERS
_TYPE = re.compile(r"\b(class|interface|record|enum)\s+([A-Z]\w*)")
_ANNOTATION = re.compile(r"@([A-Z]\w*)\s*(\()?")
_METHOD = re.compile(r"([A-Za-z_]\w*)\s*\(")
NEGOTIATION, PREDICATES = ("consumes", "produces"), ("params", "headers")


def constants(text: str) -> dict[str, str]:
    return {m[1]: m[2] for m in re.finditer(r"static\s+final\s+String\s+(\w+)\s*=\s*\"([^\"]*)\"", text)}


def value(source: str, known: dict[str, str]) -> list[str] | None:
    """Strings of an annotation value: literals, arrays of them, known constants, their sums; None if unreadable."""
    source = source.strip()
    if source.startswith("{"):
        parts = [value(source[a:b], known) for a, b in split(mask(source, "java"), 1, len(source) - 1)]
        return None if None in parts else [x for p in parts for x in p]
    out = ""
    for term in re.split(r"\+(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", source):
        got = literal(term.strip(), '"')
        got = known.get(term.strip().split(".")[-1]) if got is None else got
        if got is None:
            return None
        out += got
    return [out]


def declared(code: str, at: int) -> int:
    """Where the declaration around ``at`` begins: after the last ; or brace outside parentheses."""
    depth = 0
    for k in range(at - 1, -1, -1):
        c = code[k]
        depth += (c == ")") - (c == "(")
        if c in ";{}" and depth == 0:
            return k + 1
    return 0


def annotations(text: str, code: str, start: int, end: int):
    """(name, {key: source}, start) of each annotation between start and end."""
    at = start
    while m := _ANNOTATION.search(code, at, end):
        fields, at = {}, m.end()
        if m[2]:
            args, at = arguments(text, code, m.end() - 1)
            for a in args:
                k = re.match(r"(\w+)\s*=\s*(?!=)", a)
                fields[k[1] if k else "value"] = a[k.end() :] if k else a
        yield m[1], fields, m.start()


def mapping(name: str, fields: dict, known: dict):
    """(verbs, paths or None, conditions, whether no verb was named)."""
    paths = value(fields.get("value") or fields.get("path") or '""', known)
    named = re.findall(r"\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|TRACE)\b", fields.get("method", ""))
    verbs = [MAPPINGS[name]] if MAPPINGS[name] else named
    conditions = {k: sorted(value(fields[k], known) or [fields[k]]) for k in (*NEGOTIATION, *PREDICATES) if k in fields}
    return verbs, paths, conditions, not verbs


def merged(outer: dict, inner: dict) -> dict:
    """Negotiation of the method replaces the class's; predicates add up."""
    out = dict(outer)
    for k, v in inner.items():
        out[k] = sorted(set(outer.get(k, [])) | set(v)) if k in PREDICATES else v
    return out


def joined(prefix: str, path: str) -> str:
    left, right = ("/" + prefix.strip("/") if prefix.strip("/") else ""), ("/" + path.lstrip("/") if path else "")
    return re.sub("/{2,}", "/", left + right) or "/"


def extract(text: str, path: str):
    code, known = mask(text, "java"), constants(text)
    package = (re.search(r"\bpackage\s+([\w.]+)", code) or [None, ""])[1]
    for m in re.finditer(r"\bimport\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", code):
        yield fact("import", name=m[1].rsplit(".", 1)[-1], target=m[1], start_line=line(text, m.start()))
    for t in _TYPE.finditer(code):
        brace = code.find("{", t.end())
        if brace < 0:
            continue
        stop = closing(code, brace)
        own = list(annotations(text, code, declared(code, t.start()), t.start()))
        names = {n for n, _, _ in own}
        mark = next(((n, f) for n, f, _ in own if n == "RequestMapping"), None)
        _, prefixes, outer, _ = mapping(*mark, known) if mark else ([], [""], {}, False)
        implements = re.findall(r"[A-Z][\w.]*", re.sub(r"<[^<>]*>", "", (re.search(r"\b(?:implements|extends)\b(.*)", code[t.end() : brace], re.S) or ["", ""])[1]))
        controller, interface = bool(names & CONTROLLERS), t[1] == "interface"
        yield fact("type", kind="interface" if interface else "class", name=t[2], owner=package, target=json.dumps(implements), route=None if prefixes is None else json.dumps(prefixes), method="controller" if controller else "component" if names & COMPONENTS else None, start_line=line(text, own[0][2] if own else t.start()), end_line=line(text, stop))
        feign = "FeignClient" in names
        at = brace + 1
        while at < stop:
            m = _METHOD.search(code, at, stop)
            if not m:
                break
            close = closing(code, m.end() - 1)
            after = re.compile(r"\s*(?:throws[\w\s.,]+)?([{;])").match(code, close + 1)
            if code[m.start() - 1 : m.start()] == "@" or not after or m[1] in ("if", "for", "while", "switch", "catch", "return", "new"):
                at = close + 1 if code[m.start() - 1 : m.start()] == "@" else m.end()
                continue
            lead = code.find("@", max(brace + 1, declared(code, m.start())), m.start())
            tail = closing(code, after.end() - 1) if after[1] == "{" else after.end()
            marks = [(n, f, a) for n, f, a in annotations(text, code, lead, m.start())] if lead >= 0 else []
            arity = len(split(code, m.end(), close))
            found = [x for x in marks if x[0] in MAPPINGS]
            yield fact("java_method", name=m[1], owner=t[2], kind="mapped" if found else "plain", start_line=line(text, marks[0][2] if marks else m.start()), end_line=line(text, tail), detail=str(arity))
            for n, f, a in found:
                verbs, paths, inner, unnamed = mapping(n, f, known)
                if feign or not (controller or interface):
                    continue
                if paths is None or prefixes is None:
                    yield fact("reject", kind="spring", name=m[1], owner=t[2], detail="unreadable mapping", start_line=line(text, a))
                    continue
                if unnamed:
                    yield fact("reject", kind="spring_default", name=m[1], owner=t[2], detail="no method named: GET", start_line=line(text, a))
                for p in prefixes or [""]:
                    for q in paths or [""]:
                        for v in verbs or ["GET"]:
                            yield fact("endpoint" if controller else "inherited", kind="spring", name=m[1], owner=t[2], method=v, route=joined(p, q), target=q, start_line=line(text, a), end_line=line(text, tail), detail=json.dumps(merged(outer, inner) | {"arity": [str(arity)]}, sort_keys=True))
            at = tail
