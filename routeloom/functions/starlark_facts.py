"""Facts of Bazel files: functions, calls, constants and texts, with values as small expressions that are filled in later.

Starlark is Python's grammar, so Python's own parser reads it. An expression is
JSON: a string, null for what is unknown, or a list with a tag: ["name", x],
["join", parts], ["format", text, values], ["list", items], ["dict", pairs],
["at", value, key], ["args", positional, keywords].
"""

from __future__ import annotations

import ast
import json
import shlex

from .contract_facts import kind_of

#: Fixed: names of a call's attribute for the specification, best first, and of entries of a group.
SPECS, GROUP_SPECS, PACKAGES = ("spec_file", "spec", "input_spec", "inputSpec", "src", "openapi_spec"), ("spec_file", "spec"), ("api_package", "apiPackage")
COLUMNS = "what string, file string, name string, caller string, ordinal int, value string, target string"


def _expression(e, local: dict):
    look = lambda x: _expression(x, local)
    if isinstance(e, ast.Constant):
        return e.value if isinstance(e.value, str) else None
    if isinstance(e, ast.Name):
        return local.get(e.id, ["name", e.id])
    if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add):
        return ["join", [look(e.left), look(e.right)]]
    if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Mod):
        return ["format", look(e.left), [look(x) for x in (e.right.elts if isinstance(e.right, ast.Tuple) else [e.right])]]
    if isinstance(e, (ast.List, ast.Tuple)):
        return ["list", [look(x) for x in e.elts]]
    if isinstance(e, ast.Dict):
        return ["dict", [[look(k), look(v)] for k, v in zip(e.keys, e.values) if k is not None]]
    if isinstance(e, ast.Subscript):
        return ["at", look(e.value), look(e.slice)]
    if isinstance(e, ast.Call) and isinstance(e.func, ast.Attribute) and e.func.attr == "format":
        return ["format", look(e.func.value), [look(x) for x in e.args] + [["pair", k.arg, look(k.value)] for k in e.keywords if k.arg]]
    if isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and e.func.id in ("dict", "struct"):
        return ["dict", [[k.arg, look(k.value)] for k in e.keywords if k.arg]]
    return None


def extract(text: str, path: str):
    """Rows (what, file, name, caller, ordinal, value, target): def, call, text, const, load; caller '' is the file itself."""
    row = lambda what, name, caller="", ordinal=0, value=None, target=None: (what, path, name, caller, ordinal, json.dumps(value), target)
    count = 0

    def body(statements, caller, local):
        nonlocal count
        for s in statements:
            if isinstance(s, (ast.If, ast.For)):
                yield from body([ast.Expr(s.test if isinstance(s, ast.If) else s.iter)], caller, local)
                yield from body(s.body, caller, local)
                yield from body(s.orelse, caller, local)
                continue
            if isinstance(s, ast.FunctionDef):
                a = s.args
                named = [*a.posonlyargs, *a.args]
                plain = [None] * (len(named) - len(a.defaults)) + [_expression(d, {}) for d in a.defaults]
                params = [[p.arg, d] for p, d in zip(named, plain)] + [[p.arg, _expression(d, {}) if d else None] for p, d in zip(a.kwonlyargs, a.kw_defaults)]
                yield row("def", s.name, value=params)
                yield from body(s.body, s.name, {})
                continue
            for e in ast.walk(s):
                if isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and e.func.id == "load" and e.args:
                    label, *names = [x.value for x in e.args if isinstance(x, ast.Constant)]
                    for alias, name in [(n, n) for n in names] + [(k.arg, k.value.value) for k in e.keywords if isinstance(k.value, ast.Constant)]:
                        yield row("load", alias, target=label, value=name)
                elif isinstance(e, ast.Call) and isinstance(e.func, ast.Name):
                    count += 1
                    keywords = [[k.arg, _expression(k.value, local)] for k in e.keywords if k.arg]
                    yield row("call", e.func.id, caller, count, ["args", [_expression(x, local) for x in e.args], keywords])
            for e in _outermost(s):
                yield row("text", "", caller, value=_expression(e, local))
            if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
                value = _expression(s.value, local)
                local[s.targets[0].id] = value
                if not caller:
                    yield row("const", s.targets[0].id, value=value)

    yield from body(ast.parse(text).body, "", {})


def _outermost(statement):
    """Expressions that hold a ``-g`` in a string, the largest ones that are text or lists."""
    holds = lambda e: any(isinstance(x, ast.Constant) and isinstance(x.value, str) and ("-g" in x.value) for x in ast.walk(e))
    todo = [c for c in ast.iter_child_nodes(statement)]
    while todo:
        e = todo.pop()
        if not holds(e):
            continue
        is_text = isinstance(e, (ast.Constant, ast.BinOp, ast.List, ast.Tuple)) or (isinstance(e, ast.Call) and isinstance(e.func, ast.Attribute) and e.func.attr == "format")
        if is_text:
            yield e
        else:
            todo += ast.iter_child_nodes(e)


# --- filling in ---------------------------------------------------------------------------------


def filled(e, env: dict, depth: int = 0):
    """e with names of env replaced; what stays unknown is None."""
    if e is None or isinstance(e, str) or depth > 50:
        return e if isinstance(e, str) else None
    tag, deep = e[0], lambda x: filled(x, env, depth + 1)
    if tag == "name":
        return deep(env[e[1]]) if e[1] in env and env[e[1]] != e else None
    if tag == "join":
        parts = [deep(x) for x in e[1]]
        if all(isinstance(x, list) and x[0] == "list" for x in parts):
            return ["list", [y for x in parts for y in x[1]]]
        return "".join(parts) if all(isinstance(x, str) for x in parts) else None
    if tag == "format":
        text, values = deep(e[1]), [["pair", x[1], deep(x[2])] if isinstance(x, list) and x[0] == "pair" else deep(x) for x in e[2]]
        plain = [x for x in values if not isinstance(x, list) or x[0] != "pair"]
        if not isinstance(text, str) or not all(isinstance(x, str) for x in plain):
            return None
        try:
            named = {x[1]: x[2] for x in values if isinstance(x, list) and x[0] == "pair"}
            return text % tuple(plain) if "%s" in text else text.format(*plain, **named)
        except (TypeError, ValueError, IndexError, KeyError):
            return None
    if tag == "list":
        return ["list", [deep(x) for x in e[1]]]
    if tag == "dict":
        return ["dict", [[deep(k), deep(v)] for k, v in e[1]]]
    if tag == "at":
        base, key = deep(e[1]), deep(e[2])
        return next((v for k, v in base[1] if k == key), None) if isinstance(base, list) and base[0] == "dict" else None
    if tag == "args":
        return ["args", [deep(x) for x in e[1]], [[k, deep(v)] for k, v in e[2]]]
    return None


def bound(params, args, constants: dict) -> dict:
    """What the parameters of a function are when it is called with args, beside its file's constants."""
    env = dict(constants) | {p: filled(d, constants) for p, d in params}
    env |= {p: v for (p, _), v in zip(params, args[1])}
    return env | {k: v for k, v in args[2] if any(k == p for p, _ in params)}


def specs(args) -> list[list]:
    """[specification, package] of a call: of each dict of a group that names one, else of its own attributes."""

    def dicts(e):
        if isinstance(e, list) and e[0] == "dict":
            yield {k: v for k, v in e[1] if isinstance(k, str) and isinstance(v, str)}
        for x in (e[1] if isinstance(e, list) and e[0] == "list" else []):
            yield from dicts(x)

    first = lambda d, names: next((d[n] for n in names if isinstance(d.get(n), str) and d[n]), None)
    group = [d for v in [*args[1], *(v for _, v in args[2])] for d in dicts(v)]
    out = [[spec, first(d, PACKAGES[:1])] for d in group if (spec := first(d, GROUP_SPECS))]
    own = dict(args[2])
    return out or ([[first(own, SPECS), first(own, PACKAGES)]] if first(own, SPECS) else [])


def run_of(value) -> dict | None:
    """generator, kind, spec and package of a command that runs a generator: a command line, or a list of arguments."""
    if isinstance(value, str):
        line = value.replace("$(location ", "$(location=").replace("$(execpath ", "$(location=")
        try:
            words = shlex.split(line)
        except ValueError:
            words = line.split()
    else:
        words = [x for x in value[1] if isinstance(x, str)] if isinstance(value, list) and value[0] == "list" else []
    after = dict(zip(words, words[1:]))
    generator = after.get("-g", "")
    name = generator.strip("\"'")
    if not name or not all(c.isdigit() or c.islower() or c == "-" for c in name) or (isinstance(value, str) and "generate" not in words):
        return None
    spec = after.get("-i") or ""
    spec = spec.removeprefix("$(location=").split(")")[0] if spec.startswith("$(location") else spec or None
    return {"generator": name, "kind": kind_of(name), "spec": spec or None, "package": after.get("--api-package")}

