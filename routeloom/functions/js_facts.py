"""Facts of JavaScript and TypeScript: Express calls, mounts, imports, NestJS controllers."""

from __future__ import annotations

import re

from .code_text import arguments, closing, line, literal, mask
from .rows import fact

# Verbs and how route objects are named.
VERBS = ("get", "post", "put", "delete", "patch", "options", "head", "all")
ROUTE_NAMES = {"app", "router", "route", "api", "controller", "server"}
ROUTE_ENDS = ("router", "routes", "route", "app", "server", "controller", "api")
ROUTE_STARTS = ("app", "api")
NO_ROUTE_ENDS = ("client", "service")
_CALL = re.compile(rf"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\.\s*({'|'.join(VERBS)})\s*(?=\()")
_CHAIN = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\.\s*route\s*(?=\()")
_NEXT = re.compile(rf"\s*\.\s*({'|'.join(VERBS)})\s*(?=\()")
_USE = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\.\s*use\s*(?=\()")
_MADE = re.compile(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:[\w$.]*\.)?(?:Router|express|fastify|Fastify)\s*\(")
_REQUIRE = re.compile(r"(?:const|let|var)\s+(\{[^}]*\}|[A-Za-z_$][\w$]*)\s*=\s*require\s*\(\s*(['\"])(.*?)\2\s*\)|import\s+(?:(\{[^}]*\})|([A-Za-z_$][\w$]*))[^'\";]*?from\s*(['\"])(.*?)\6", re.S)
_NEST_CLASS = re.compile(r"@Controller\s*(?=\()")
_MARK = r"@[\w.]+\s*\([^)]*\)"
#: A decorator, or a name before a parenthesis with nothing but decorators between.
_HANDLER = re.compile(rf"{_MARK}|([A-Za-z_$][\w$]*)(?:\s|{_MARK})*\(")
_NEST_METHOD = re.compile(r"@(Get|Post|Put|Delete|Patch|Options|Head|All)\s*(?=\()")


def looks_like_routes(name: str) -> bool:
    low = name.lower()
    return not low.endswith(NO_ROUTE_ENDS) and (low in ROUTE_NAMES or low.endswith(ROUTE_ENDS) or low.startswith(ROUTE_STARTS))


def extract(text: str, path: str):
    code = mask(text, "js")
    known = {m[1] for m in _MADE.finditer(code)}
    for m in _CALL.finditer(code):
        if m[1] not in known and not looks_like_routes(m[1]):
            continue
        args, end = arguments(text, code, m.end())
        if len(args) >= 2:  # one argument reads a setting
            route = literal(args[0])
            yield fact("endpoint" if route is not None else "reject", kind="express", name=args[-1][:60] if re.fullmatch(r"[\w$.]+", args[-1]) else None, method=m[2].upper(), route=route, owner=m[1], start_line=line(text, m.start()), end_line=line(text, end), detail=None if route is not None else "route is no literal")
    for m in _CHAIN.finditer(code):
        args, end = arguments(text, code, m.end())
        while args and (n := _NEXT.match(code, end + 1)):
            _, end = arguments(text, code, n.end())
            yield fact("endpoint", kind="express", method=n[1].upper(), route=literal(args[0]), owner=m[1], start_line=line(text, n.start() + 1), end_line=line(text, end))
    for m in _USE.finditer(code):
        args, _ = arguments(text, code, m.end())
        if len(args) >= 2 and literal(args[0]) is not None:
            for target in args[1:]:
                req = re.fullmatch(r"require\s*\(\s*(['\"])(.*?)\1\s*\)", target)
                if req:
                    yield fact("mount", owner=m[1], route=literal(args[0]), target=None, detail=req[2])
                elif re.fullmatch(r"[A-Za-z_$][\w$.]*", target):
                    yield fact("mount", owner=m[1], route=literal(args[0]), target=target.split(".")[0])
    for m in _REQUIRE.finditer(text):
        names, module = m[1] or m[4] or m[5], m[3] or m[7]
        for name in re.findall(r"([A-Za-z_$][\w$]*)(?:\s*(?::|as)\s*([A-Za-z_$][\w$]*))?", names.strip("{}")):
            yield fact("import", name=name[1] or name[0], target=module, detail=name[0] if names.startswith("{") else None, start_line=line(text, m.start()))
    for m in re.finditer(r"module\.exports\s*=\s*([A-Za-z_$][\w$]*)|export\s+default\s+([A-Za-z_$][\w$]*)", code):
        yield fact("export", name=m[1] or m[2])
    yield from nest(text, code)


def nest(text: str, code: str):
    for m in _NEST_CLASS.finditer(code):
        args, end = arguments(text, code, m.end())
        prefixes = [""]
        if args:
            a = args[0]
            inside = re.search(r"path\s*:\s*(\[[^\]]*\]|['\"`][^'\"`]*['\"`])", a) if a.startswith("{") else None
            a = inside[1] if inside else "" if a.startswith("{") else a
            prefixes = [literal(x.strip()) for x in a.strip("[]").split(",")] if a else [""]
        brace = code.find("{", end)
        name = re.search(r"class\s+([A-Za-z_$][\w$]*)", code[end : max(brace, end)])
        stop = closing(code, brace) if brace >= 0 else end
        for v in _NEST_METHOD.finditer(code, brace, stop):
            margs, mend = arguments(text, code, v.end())
            paths = [literal(x.strip()) for x in margs[0].strip("[]").split(",")] if margs else [""]
            handler = next((h for h in _HANDLER.finditer(code, mend + 1, stop) if h[1]), None)
            for p in prefixes:
                for q in paths:
                    if p is None or q is None:
                        yield fact("reject", kind="nest", detail="route is no literal", start_line=line(text, v.start()))
                        continue
                    route = "/" + "/".join(x for x in (p.strip("/"), q.strip("/")) if x)
                    yield fact("endpoint", kind="nest", name=f"{name[1] if name else ''}.{handler[1] if handler else ''}", method=v[1].upper(), route=route, start_line=line(text, v.start()), end_line=line(text, mend))
