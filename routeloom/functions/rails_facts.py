"""Facts of Rails: the route language interpreted block by block, controller actions, ancestors."""

from __future__ import annotations

import json
import re

from .code_text import mask, masked_lines, split
from .rows import fact

# The actions of resources.
PLURAL = (("index", "GET", ""), ("create", "POST", ""), ("new", "GET", "/new"), ("edit", "GET", "/:id/edit"), ("show", "GET", "/:id"), ("update", "PATCH", "/:id"), ("update", "PUT", "/:id"), ("destroy", "DELETE", "/:id"))
SINGLE = (("create", "POST", ""), ("new", "GET", "/new"), ("edit", "GET", "/edit"), ("show", "GET", ""), ("update", "PATCH", ""), ("update", "PUT", ""), ("destroy", "DELETE", ""))
VERBS = ("get", "post", "put", "patch", "delete")
_OPENS = re.compile(r"\bdo\b(?:\s*\|[^|]*\|)?\s*$|^\s*(?:if|unless|case|begin|def|class|module|while)\b")
_END = re.compile(r"\s*end\b")
_GOES_ON = re.compile(r"(,|=>|\\|\(|\[)\s*$")


def singular(name: str) -> str:
    return name[:-3] + "y" if name.endswith("ies") else name[:-1] if name.endswith("s") else name


def names(source: str | None) -> list[str]:
    if source is None:
        return []
    words = re.search(r"%[iw]\[([^\]]*)\]", source)
    return words[1].split() if words else re.findall(r":(\w+)|['\"]([^'\"]*)['\"]", source) and [a or b for a, b in re.findall(r":(\w+)|['\"]([^'\"]*)['\"]", source)]


def positional(source: str) -> list[str]:
    """Names given before and between the options."""
    masked = mask(source, "ruby")
    return [x for a, b in split(masked, 0, len(masked)) if not re.search(r"^\s*\(?\s*\w+:\s|=>", source[a:b]) for x in names(source[a:b])]


def option(source: str, key: str) -> str | None:
    m = re.search(rf"(?:\b{key}:|:{key}\s*=>)\s*(%[iw]\[[^\]]*\]|\[[^\]]*\]|:\w+|'[^']*'|\"[^\"]*\"|\w+)", source)
    return m[1] if m else None


def one(source: str, key: str) -> str | None:
    got = names(option(source, key))
    return got[0] if got else None


class Scope:
    def __init__(self, path="", controller="", kind="", resource=None, member_path=None, module=""):
        self.path, self.controller, self.kind, self.resource, self.member, self.module = path, controller, kind, resource, member_path, module


def path(*parts: str) -> str:
    return "/" + "/".join(p.strip("/") for p in parts if p and p.strip("/"))


def _inside(lines):
    """The lines up to the ``end`` of a block that has begun."""
    depth = 1
    for n, t in lines:
        depth += bool(_OPENS.search(t)) - bool(_END.match(t))
        if not depth:
            return
        yield n, t


def statements(lines):
    """(number, text, block) of each statement; block: the lines between its ``do`` and ``end``, to be read once and before the next statement, or None."""
    lines = iter(lines)
    for n, text in lines:
        if _OPENS.search(text):
            body = _inside(lines)
            yield n, text, body
            for _ in body:  # what nobody read
                pass
        elif text.strip():
            yield n, text, None


def concerns_of(lines, found):
    for _, text, body in statements(lines):
        m = re.match(r"\s*concern\s+:(\w+)", text)
        if m and body is not None:
            found[m[1]] = list(body)
        elif body is not None:
            concerns_of(body, found)
    return found


def walk(lines, scope: Scope, concerns: dict, seen=()):
    for n, text, body in statements(lines):
        word = (re.match(r"\s*(\w+)", text) or ["", ""])[1]
        rest = text.strip()[len(word) :]
        first = names(rest.split(",")[0].split("=>")[0])
        arg = first[0] if first else None

        def put(verb, route, target):
            return fact("endpoint", kind="rails", method=verb, route=route, target=target, start_line=n, end_line=n)

        if word == "namespace" and arg and body is not None:
            yield from walk(body, Scope(path(scope.path, one(rest, "path") or arg), "", "", None, None, "/".join(filter(None, [scope.module, one(rest, "module") or arg]))), concerns, seen)
        elif word == "scope" and body is not None:
            where = one(rest, "path") or (arg if arg and not re.match(r"\s*\(?\s*\w+:", rest) else "")
            yield from walk(body, Scope(path(scope.path, where), one(rest, "controller") or scope.controller, scope.kind, scope.resource, scope.member, "/".join(filter(None, [scope.module, one(rest, "module")]))), concerns, seen)
        elif word in ("resources", "resource") and first:
            body = None if body is None else list(body)  # read for each name
            for name in positional(rest) or first:
                plural = word == "resources"
                param = one(rest, "param") or "id"
                controller = "/".join(filter(None, [scope.module, one(rest, "controller") or (name if plural else name + "s")]))
                base = path(scope.member if scope.resource else scope.path, one(rest, "path") or name)
                shallow = path(scope.path if not scope.resource else "", name) if "shallow: true" in rest else base
                only, but = option(rest, "only"), option(rest, "except")
                allowed = {a for a, _, _ in PLURAL} & (set(names(only)) if only else {a for a, _, _ in PLURAL}) - set(names(but))
                for action, verb, suffix in PLURAL if plural else SINGLE:
                    if action in allowed:
                        yield put(verb, path(shallow if "id" in suffix else base, suffix.replace(":id", ":" + param)), f"{controller}#{action}")
                inner = Scope(base, controller, "resource" if not plural else "resources", name, base if not plural else path(base, f":{singular(name)}_{param}"), scope.module)
                inner.on_member = base if not plural else path(base, ":" + param)
                if body is not None:
                    yield from walk(body, inner, concerns, seen)
                for c in names(option(rest, "concerns")):
                    if c in concerns and c not in seen:
                        yield from walk(concerns[c], inner, concerns, (*seen, c))
        elif word in ("member", "collection") and body is not None and scope.resource:
            at = getattr(scope, "on_member", scope.path) if word == "member" else scope.path
            yield from walk(body, Scope(at, scope.controller, "plain", scope.resource, scope.member, scope.module), concerns, seen)
        elif word == "concerns":
            for c in names(rest):
                if c in concerns and c not in seen:
                    yield from walk(concerns[c], scope, concerns, (*seen, c))
        elif word == "concern":
            continue
        elif word == "root":
            target = one(rest, "to") or arg
            if target:
                yield put("GET", path(scope.path) or "/", "/".join(filter(None, [scope.module, target])))
        elif word in VERBS or word == "match":
            verbs = [word.upper()] if word in VERBS else [v.upper() for v in names(option(rest, "via")) if v in VERBS] or ["GET", "POST"]
            rocket = re.search(r"['\"]([^'\"]+)['\"]\s*=>\s*['\"]([^'\"]+)['\"]", rest)
            target = one(rest, "to") or (rocket[2] if rocket else None)
            for name in [rocket[1]] if rocket else positional(rest):
                action = one(rest, "action") or name.strip("/").split("/")[-1]
                goal = ("/".join(filter(None, [scope.module, target])) if target and "#" in target else f"{scope.controller or '/'.join(filter(None, [scope.module, one(rest, 'controller')]))}#{target or action}" if scope.controller or one(rest, "controller") else "/".join(filter(None, [scope.module, name.strip("/").replace("/", "#", 1) if name.strip("/").count("/") == 1 else ""])))
                at = getattr(scope, "on_member", scope.path) if one(rest, "on") == "member" else scope.member if scope.kind == "resources" and one(rest, "on") != "collection" else scope.path
                for v in verbs:
                    yield put(v, path(at, name), goal or None)
        elif body is not None:
            yield from walk(body, scope, concerns, seen)


def joined_lines(text: str):
    """Numbered code lines, comments off, lines that end in a comma or operator joined with the next."""
    held, start = "", 0
    for n, (raw, plain) in enumerate(masked_lines(text, "ruby"), 1):
        cut = re.search(r"#(?![{])", plain)
        keep = "".join(r if p != " " or r in " \t" or _in_string(plain, raw, k) else " " for k, (r, p) in enumerate(zip(raw, plain))) if raw != plain and plain.strip() != raw.strip() else raw
        keep = keep[: cut.start()] if cut else keep
        start = start or n
        held += (" " if held else "") + keep.strip()
        if not _GOES_ON.search(plain.rstrip() if plain.strip() else " "):
            yield start, held
            held, start = "", 0
    if held:
        yield start, held


def _in_string(plain: str, raw: str, k: int) -> bool:
    """Whether a masked character lies inside quotes, not in a comment."""
    return any(q in plain[:k] and plain[:k].count(q) % 2 for q in "\"'")


ROUTE_FILE = r"(^|/)(config/)?routes(/.*)?\.rb$"


def concern_rows(text: str, path_: str):
    """The concerns that a route file defines, for the other files of its repository."""
    for name, body in concerns_of(joined_lines(text), {}).items():
        yield fact("concern", name=name, detail=json.dumps(body))


def extract(text: str, path_: str, shared: str | None = None):
    """``shared``: concerns of the repository's other route files, name to JSON lines, as JSON; a file's own ones go first."""
    if re.search(ROUTE_FILE, path_):
        others = {name: [tuple(x) for x in json.loads(body)] for name, body in json.loads(shared or "{}").items()}
        own = concerns_of(joined_lines(text), {}) if "concern" in text else {}
        yield from walk(joined_lines(text), Scope(), others | own)
        return
    stack: list = []
    private = False
    for n, text_ in joined_lines(text):
        t = text_.strip()
        m = re.match(r"(class|module)\s+([\w:]+)(?:\s*<\s*([\w:]+))?", t)
        if m:
            stack.append((m[1], m[2]))
            yield fact("ruby_class", kind=m[1], name="::".join(x for k, x in stack if k in ("class", "module")), target=m[3], start_line=n)
            private = False
            continue
        m = re.match(r"def\s+(self\.)?([\w?!=]+)", t)
        owner = "::".join(x for k, x in stack if k in ("class", "module"))
        if m:
            yield fact("ruby_method", kind="singleton" if m[1] else "private" if private else "instance", name=m[2], owner=owner, start_line=n)
            if not re.search(r"\bend\s*$|=\s", t[m.end() :]):
                stack.append(("def", m[2]))
            continue
        if re.match(r"(private|protected)\s*$", t):
            private = True
        m = re.match(r"include\s+(.+)", t)
        if m:
            yield fact("ruby_include", owner=owner, target=json.dumps([x.strip() for x in m[1].split(",")]), start_line=n)
        if re.match(r"end\b", t) and stack:
            stack.pop()
        elif _OPENS.search(t):
            stack.append(("block", ""))
    return
