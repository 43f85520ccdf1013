"""Scalar functions on routes, keys, names, URLs and secrets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verbs and framework names that fix results.
VERBS = ("get", "post", "put", "delete", "patch", "options", "head", "trace")
FRAMEWORK_ALIASES = {"express": "nodejs", "expressjs": "nodejs", "nestjs": "nodejs", "node": "nodejs", "nodejs": "nodejs", "javascript": "nodejs", "typescript": "nodejs", "django": "python", "flask": "python", "fastapi": "python", "python": "python", "rails": "ruby_on_rails", "ruby": "ruby_on_rails", "ruby_on_rails": "ruby_on_rails", "go": "golang", "gin": "golang", "golang": "golang", "spring": "java", "spring_boot": "java", "springboot": "java", "java": "java"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def blank(c: Column) -> Column:
    """Null, or nothing but ASCII white space."""
    return c.isNull() | ~c.rlike(r"[^ \t\n\r\f\x0B]")


def one_slash(c: Column) -> Column:
    return F.regexp_replace(c, "/{2,}", "/")


def rooted(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("/")), c).otherwise(F.concat(F.lit("/"), c))


# --- routes ---------------------------------------------------------------------------------


def normalize_python(route: Column) -> Column:
    """``<int:pk>`` and ``<pk>`` to ``{pk}``, one leading slash, none doubled; null for null or ''."""
    return F.when(route.isNull() | (route == ""), None).otherwise(one_slash(rooted(F.regexp_replace(strip(route), r"<(?:[^:<>]+:)?([^<>]+)>", "{$1}"))))


def normalize_colon(route: Column) -> Column:
    """Go and Rails: ``:id`` to ``{id}``, one leading slash; '' for null."""
    return F.when(route.isNull() | (route == ""), "").otherwise(rooted(F.regexp_replace(strip(route), r":([A-Za-z_][A-Za-z0-9_]*)", "{$1}")))


def normalize_java(route: Column) -> Column:
    """Slashes only; '' for null."""
    return F.when(route.isNull() | (route == ""), "").otherwise(one_slash(rooted(strip(route))))


def normalize_express(route: Column) -> Column:
    """``:id(\\d+)?`` to ``{id}``: a constraint goes with its parentheses, however deep they nest; an unbalanced one stays as written.

    The route is cut where a parameter begins; each part is a name, perhaps a
    constraint, and what follows. Depth is counted over the characters of the
    part, in which a backslash takes the next one along.
    """
    name = r"^:([A-Za-z_][A-Za-z0-9_]*)"

    def end_of_constraint(rest):
        """How many characters a balanced constraint at the start of rest has; 0 where there is none."""
        start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

        def step(state, c):
            opens, closes = (c == "(") & ~state["escaped"], (c == ")") & ~state["escaped"]
            depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
            at = state["at"] + 1
            return F.struct(depth.alias("depth"), ((c == "\\") & ~state["escaped"]).alias("escaped"), at.alias("at"), F.when((state["end"] == 0) & (depth == 0), at).otherwise(state["end"]).alias("end"))

        return F.when(rest.startswith("("), F.aggregate(F.split(rest, "(?!^)"), start, step)["end"]).otherwise(F.lit(0))

    def part(p):
        said = F.regexp_extract(p, name, 1)
        rest = F.substring(p, F.length(said) + 2, F.length(p))
        end = end_of_constraint(rest)
        after = F.substring(rest, end + 1, F.length(rest))
        whole = F.concat(F.lit("{"), said, F.lit("}"), F.when(after.startswith("?"), F.substring(after, F.lit(2), F.length(after))).otherwise(after))
        return F.when(said == "", p).when(rest.startswith("(") & (end == 0), p).otherwise(whole)

    # A colon inside a constraint begins no parameter: pieces are put together while parentheses are open.
    pieces = F.split(route, r"(?=:[A-Za-z_])")

    def put(done, p):
        last = F.element_at(done, -1)
        bare = F.regexp_replace(F.array_join(last, ""), r"\\.", "")
        open_ = F.length(F.regexp_replace(bare, r"[^(]", "")) > F.length(F.regexp_replace(bare, r"[^)]", ""))
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.array(p))))
        return F.when(F.size(done) == 0, F.array(F.array(p))).when(open_, joined).otherwise(F.concat(done, F.array(F.array(p))))

    def together(ps):
        # Where the parentheses never close, each piece is read by itself.
        whole = part(F.array_join(ps, ""))
        return F.when(whole == F.array_join(ps, ""), F.array_join(F.transform(ps, part), "")).otherwise(whole)

    plain = F.array_join(F.transform(F.aggregate(pieces, F.array().cast("array<array<string>>"), put), together), "")
    return F.when(~F.contains(route, F.lit(":")), route).otherwise(plain)


def normalize(framework: Column, route: Column) -> Column:
    """The normaliser of the row's framework, but for Express, whose constraints nest."""
    return F.when(framework == "python", normalize_python(route)).when(framework == "java", normalize_java(route)).otherwise(normalize_colon(route))


def join_route(prefix: Column, path: Column) -> Column:
    """Prefix and path with one slash between; '/' if both are empty."""
    side = lambda c: F.when(strip(F.coalesce(c, F.lit(""))) == "", "").otherwise(rooted(strip(c)))
    joined = one_slash(F.concat(F.regexp_replace(side(prefix), "/+$", ""), side(path)))
    return F.when(joined == "", "/").otherwise(joined)


def join_segments(prefix: Column, segment: Column) -> Column:
    """Rails: both stripped of slashes, empty ones left out, one leading slash."""
    bare = lambda c: F.nullif(F.regexp_replace(F.coalesce(c, F.lit("")), "^/+|/+$", ""), F.lit(""))
    return F.concat(F.lit("/"), F.concat_ws("/", bare(prefix), bare(segment)))


def shape(route: Column) -> Column:
    """Parameters collapsed to ``{}``."""
    return F.regexp_replace(route, r"\{[^}]*\}", "{}")


def route_shape(method: Column, route: Column) -> Column:
    return F.struct(F.upper(method).alias("method"), shape(route).alias("shape"))


def regex_route(pattern: Column) -> Column:
    """``^users/(?P<pk>..)/$`` to ``users/<pk>/``; null where regex syntax is left."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(pattern), r"\(\?P<(\w+)>[^()]*\)", "<$1>"), r"^\^+", ""), r"\$+$", "")
    return F.when(plain.rlike(r"[()\[\]\\*+?|{}^$]"), None).otherwise(plain)


def endpoint_key(method: Column, route: Column) -> Column:
    """``METHOD /path``; UNKNOWN without a method."""
    verb = F.upper(F.coalesce(F.nullif(method, F.lit("")), F.lit("UNKNOWN")))
    return F.trim(F.concat_ws(" ", verb, F.coalesce(route, F.lit(""))))


def split_key(key: Column) -> Column:
    parts = F.split(key, " ", 2)
    return F.struct(F.when(blank(key), "UNKNOWN").otherwise(parts[0]).alias("method"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("route"))


def effective_method(method: Column, http_method: Column) -> Column:
    return F.coalesce(F.nullif(method, F.lit("")), F.nullif(http_method, F.lit("")))


# --- names ----------------------------------------------------------------------------------


def camelize(name: Column) -> Column:
    parts = F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda p: p != "")
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30))), "")
    return F.concat(F.lower(F.left(joined, F.lit(1))), F.substring(joined, 2, 1 << 30))


def singular(name: Column) -> Column:
    return F.when(F.endswith(name, F.lit("ies")), F.concat(F.regexp_replace(name, "ies$", ""), F.lit("y"))).otherwise(F.regexp_replace(name, "s$", ""))


def display_name(name: Column) -> Column:
    """snake_case, kebab-case and camelCase to Title Case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "[_-]", " "), "([a-z])([A-Z])", "$1 $2")
    return F.initcap(spaced)


def join_controllers(prefix: Column, controller: Column) -> Column:
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^/+|/+$", "")
    return F.concat_ws("/", F.nullif(bare(prefix), F.lit("")), F.nullif(bare(controller), F.lit("")))


def split_action(target: Column) -> Column:
    parts = F.split(target, "#")
    two = F.size(parts) == 2
    return F.struct(F.when(two, parts[0]).alias("controller"), F.when(two, F.get(parts, F.lit(1))).alias("action"))


def canonical_framework(name: Column) -> Column:
    low = F.lower(strip(name))
    table = F.create_map(*[F.lit(x) for kv in FRAMEWORK_ALIASES.items() for x in kv])
    return F.coalesce(table[low], low)


# --- URLs, secrets, configuration -----------------------------------------------------------


def sanitize_url(url: Column) -> Column:
    """A remote's public URL without user info, query, fragment and ``.git``; '' for what is none."""
    u = strip(F.coalesce(url, F.lit("")))
    bare = lambda c: F.when(c.endswith(".git"), F.substring(c, F.lit(1), F.length(c) - 4)).otherwise(c)
    # user@host:path, as ssh writes it
    path = F.split_part(u, F.lit("git@github.com:"), F.lit(2))
    path = bare(F.when(path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path))
    ssh = F.when(u.startswith("git@github.com:") & (path != ""), F.concat(F.lit("https://github.com/"), path))
    # scheme://user@host/path?query#fragment
    scheme = F.split_part(u, F.lit("://"), F.lit(1))
    plain = F.substring_index(F.substring_index(F.substring(u, F.length(scheme) + 4, F.length(u)), "?", 1), "#", 1)
    authority = F.split_part(plain, F.lit("/"), F.lit(1))
    host, rest = F.substring_index(authority, "@", -1), F.substring(plain, F.length(authority) + 1, F.length(plain))
    rest = bare(F.rtrim(rest, F.lit("/")))
    web = F.when(scheme.isin("http", "https") & (F.instr(u, "://") > 0) & (host != "") & (rest != ""), F.concat(scheme, F.lit("://"), host, rest))
    return F.coalesce(ssh, web, F.lit(""))


def mask_secret(value: Column) -> Column:
    v = strip(F.coalesce(value, F.lit("")))
    n = F.length(v)
    return F.when(n == 0, "not set").when(n <= 10, F.rpad(F.lit(""), n, "*")).otherwise(F.concat(F.left(v, F.lit(6)), F.lit("..."), F.right(v, F.lit(4))))


def clean_value(value: Column) -> Column:
    v = strip(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(F.lower(v) == "null", "").otherwise(v)


def first_set(*values: Column) -> Column:
    """Configuration precedence: the first value that is not blank."""
    return F.coalesce(*(F.nullif(clean_value(v), F.lit("")) for v in values))


def json_block(text: Column) -> Column:
    """From the first brace to the last; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


# --- texts of source and build files ---------------------------------------------------------


def contained(folder: Column, raw: Column) -> Column:
    """A reference from a folder as a path inside the repository; null for schemes, absolute paths and what leads out of it."""
    ref = strip(raw)
    outside = ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | ref.rlike(r"^[/\\\\]")
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), ref), "/"), lambda p: ~p.isin("", "."))

    def step(done, p):
        up = p == ".."
        # Once outside, outside for good: a null stays null.
        return F.when(done.isNull() | (up & (F.size(done) == 0)), F.lit(None).cast("array<string>")).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))

    walked = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~outside, F.nullif(F.array_join(walked, "/"), F.lit("")))


def uncommented(line: Column) -> Column:
    """A line up to its first ``#`` with an even number of quotes of either kind before it."""
    pieces = F.split(line, "#", -1)
    odd = lambda text, quote: F.length(F.regexp_replace(text, f"[^{quote}]", "")) % 2 == 1
    start = F.struct(F.get(pieces, F.lit(0)).alias("text"), F.lit(False).alias("done"))

    def step(state, piece):
        open_ = odd(state["text"], '"') | odd(state["text"], "'")
        more = ~state["done"] & open_
        return F.struct(F.when(more, F.concat_ws("#", state["text"], piece)).otherwise(state["text"]).alias("text"), (state["done"] | ~open_).alias("done"))

    return F.aggregate(F.slice(pieces, 2, 1 << 30), start, step)["text"]


def options(text: Column, keys) -> Column:
    """The first value of each option in a build text; options that do not occur are left out.

    A value follows its key and a sign (``=``, ``:``, ``=>``, ``>``, as element, map and property are written), quoted or not.
    """

    def value(after):
        signed = F.ltrim(F.regexp_replace(after, r"^\s+", ""))
        told = F.regexp_replace(F.ltrim(signed, F.lit("=>:")), r"^\s+", "")
        bare = F.when(told.startswith("'") | told.startswith('"'), F.substring(told, F.lit(2), F.length(told))).otherwise(told)
        return F.when(F.left(signed, F.lit(1)).isin("=", ">", ":"), F.nullif(F.regexp_extract(bare, r"^[\w-]+", 0), F.lit("")))

    def first(key):
        after = F.slice(F.split(text, key), 2, 1 << 30)
        return F.get(F.filter(F.transform(after, value), lambda v: v.isNotNull()), F.lit(0))

    pairs = [x for k in keys for x in (F.lit(k), first(k))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def hints(text: Column, pattern: str) -> Column:
    """Distinct matches of a pattern's group, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1)))


# --- hashes ---------------------------------------------------------------------------------


def content_hash(path: Column, content: Column) -> Column:
    """First 16 hex digits of sha256(path, NUL, bytes)."""
    return F.left(F.sha2(F.concat(F.encode(path, "UTF-8"), F.lit(bytearray(b"\x00")), content.cast("binary")), 256), F.lit(16))


def context_hash(body: Column, blocks: Column) -> Column:
    """sha256 of the body and its distinct, non-blank blocks in order."""
    return F.sha2(F.array_join(F.concat(F.array(F.coalesce(body, F.lit(""))), dedupe_blocks(blocks)), "\n\n"), 256)


def dedupe_blocks(blocks: Column) -> Column:
    """Blank blocks dropped; of equal ones the first stays."""
    return F.array_distinct(F.filter(blocks, lambda b: b.rlike(r"\S")))
