"""Endpoints of every language as one table: file facts, then joins for mounts, inheritance, handlers and actions.

Endpoint rows: repo, rel_path, pos, kind, name, method, route, start_line, end_line, conditions.
Reject rows keep the reason; nothing is dropped without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import go_facts, js_facts, rails_facts, spring_facts
from ..functions import scalars as s
from ..functions.rows import extracted
from ..operators import dedupe
from ..operators.closure import composed, in_order, settled, transitive
from . import syntax
from .origins import origins
from .python_routes import python_endpoints

COLUMNS = ["repo", "rel_path", "pos", "kind", "name", "method", "route", "start_line", "end_line", "conditions"]
#: Suffixes that a Node import may leave out, in the order they are tried.
NODE_SUFFIXES = ["", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts", "/index.jsx", "/index.tsx"]


def _as_endpoints(rows: DataFrame) -> DataFrame:
    have = rows if "conditions" in rows.columns else rows.withColumn("conditions", F.lit(None).cast("string"))
    return have.select(*COLUMNS)


def nodejs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Express routes once for each distinct mount of their router (in this file, or where it is imported), and Nest routes."""
    first = settled(extracted(files, js_facts.extract))
    # A second tier for files that the first could not read: those with errors are asked for, and only those.
    silent = files.join(first.where("what = 'endpoint'").select("repo", "rel_path").distinct(), ["repo", "rel_path"], "left_anti").where(F.col("text").rlike(r"(?i)\b(get|post|put|delete|patch|options|head|all)\s*\("))
    errors = syntax.nodes(silent).where("kind = 'error'").select("repo", "rel_path").distinct()
    facts = settled(first.unionByName(syntax.fallback(silent, first, errors)))
    mounts = facts.where("what = 'mount'")
    imports = facts.where("what = 'import'").select("repo", "rel_path", F.col("name").alias("target"), F.col("target").alias("module"))
    far = mounts.where("target is not null").join(imports, ["repo", "rel_path", "target"]).select("repo", "rel_path", "route", "module")
    far = far.unionByName(mounts.where("detail is not null").select("repo", "rel_path", "route", F.col("detail").alias("module"))).where("module like '.%'")
    folder = F.regexp_replace("rel_path", "[^/]*$", "")
    base = s.contained(folder, F.col("module"))  # null where it leads out of the repository
    tried = far.distinct().withColumn("_id", F.xxhash64("repo", "rel_path", "route", "module")).select("*", F.posexplode(F.array(*(F.concat(base, F.lit(x)) for x in NODE_SUFFIXES))).alias("_n", "_path"))
    hit = tried.join(files.select("repo", F.col("rel_path").alias("_path")).distinct(), ["repo", "_path"]).groupBy("repo", "_id", F.col("route").alias("prefix")).agg(F.min_by("_path", "_n").alias("rel_path"))
    exported = hit.select("repo", "rel_path", "prefix").distinct()
    exports = facts.where("what = 'export'").select("repo", "rel_path", F.col("name").alias("owner"))
    outer = exported.join(exports, ["repo", "rel_path"]).select("repo", "rel_path", "owner", "prefix")
    inner = mounts.where("target is not null").join(imports.select("repo", "rel_path", "target"), ["repo", "rel_path", "target"], "left_anti").select("repo", "rel_path", F.col("target").alias("owner"), F.col("route").alias("prefix"))
    prefixes = outer.unionByName(inner).distinct()
    rows = facts.where("what = 'endpoint' and route is not null").join(prefixes, ["repo", "rel_path", "owner"], "left")
    rows = rows.withColumn("route", F.when(F.col("prefix").isNull(), F.col("route")).otherwise(s.join_route(F.col("prefix"), F.col("route")))).withColumn("route", s.normalize_express(F.col("route")))
    return _as_endpoints(rows), facts.where("what = 'reject'")


def java(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Controller mappings, and those a controller inherits from interfaces by method name and arity, the nearest interface first."""
    facts = settled(extracted(files, spring_facts.extract))
    own = facts.where("what = 'endpoint'").withColumn("conditions", F.col("detail"))
    types = facts.where("what = 'type'").select("repo", "rel_path", "name", F.concat_ws(".", F.nullif("owner", F.lit("")), "name").alias("full"), F.col("owner").alias("package"), F.explode_outer(F.from_json("target", "array<string>")).alias("parent"), "method")
    imports = facts.where("what = 'import'").select("repo", "rel_path", F.col("name").alias("parent"), F.col("target").alias("_imp"))
    known = types.select("repo", F.col("full").alias("dst")).distinct()
    cand = types.where("parent is not null").join(imports, ["repo", "rel_path", "parent"], "left").withColumn("dst", F.coalesce("_imp", F.when(F.instr("parent", ".") > 0, F.col("parent")).otherwise(F.concat_ws(".", F.nullif("package", F.lit("")), "parent"))))
    edges = cand.join(known, ["repo", "dst"]).select(F.concat_ws("\x00", "repo", "full").alias("src"), F.concat_ws("\x00", "repo", "dst").alias("dst")).distinct()
    controllers = types.where("method = 'controller'").select("repo", "rel_path", "name", F.concat_ws("\x00", "repo", "full").alias("root")).distinct()
    reach = transitive(controllers.select("root", F.col("root").alias("node")), edges).where("depth > 0")
    plain = facts.where("what = 'java_method' and kind = 'plain'").select("repo", "rel_path", F.col("owner").alias("_class"), "name", F.col("detail").alias("arity"), "start_line", "end_line", "pos")
    full = types.select("repo", F.col("rel_path").alias("_file"), F.col("name").alias("_type"), F.concat_ws("\x00", "repo", "full").alias("node")).distinct()
    above = facts.where("what = 'inherited'").select("repo", F.col("rel_path").alias("_file"), F.col("owner").alias("_type"), "name", "method", "route", F.get_json_object("detail", "$.arity[0]").alias("arity"), F.col("detail").alias("conditions"))
    got = reach.join(full, "node").join(above, ["repo", "_file", "_type"]).join(controllers.select("root", "rel_path", F.col("name").alias("_class")), "root").join(plain, ["repo", "rel_path", "_class", "name", "arity"])
    nearest = got.groupBy("repo", "rel_path", "_class", "name", "arity").agg(F.min("depth").alias("depth"))
    got = got.join(nearest, ["repo", "rel_path", "_class", "name", "arity", "depth"]).withColumn("kind", F.lit("spring"))
    rows = _as_endpoints(own).unionByName(_as_endpoints(got)).withColumn("route", s.normalize_java(F.col("route")))
    used = reach.select("node").distinct()
    lost = facts.where("what = 'inherited'").join(full.withColumnRenamed("_file", "rel_path").withColumnRenamed("_type", "owner"), ["repo", "rel_path", "owner"]).join(used, "node", "left_anti").select(*facts.columns).withColumn("detail", F.lit("interface of no controller"))
    return rows, facts.where("what = 'reject'").unionByName(lost)


def passed_prefixes(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(node, prefix): the prefixes of the routers that callers, in any file, pass for a function's parameter.

    A call means the function of its name in its own folder, or in the folder that
    its qualifier was imported from, or one that has the qualifier's name, or else
    the only one in the repository. From callers
    whose router is their own the prefix is what their file says; where it begins
    at their own parameter, what their callers pass comes before it.
    """
    folder = F.regexp_replace("rel_path", "/?[^/]*$", "")
    place = lambda name: F.get_json_object("detail", f"$.{name}")
    defs = facts.where("what = 'go_func'").select("repo", "name", folder.alias("folder"), F.concat_ws("\x00", "repo", "rel_path", F.col("start_line").cast("string")).alias("func"))
    defs = defs.withColumn("last", F.regexp_extract("folder", "([^/]*)$", 1))
    calls = facts.where("what = 'go_pass'").select("repo", "rel_path", "name", "owner", folder.alias("folder"), F.coalesce("route", F.lit("")).alias("value"), place("arg").alias("arg"), F.when(place("func").isNotNull(), F.concat_ws("\x00", "repo", "rel_path", place("func"), place("param"))).alias("src"))
    calls = calls.withColumn("id", F.xxhash64(*calls.columns))
    here = defs.groupBy("repo", "folder", "name").agg(F.min("func").alias("func"))
    named = defs.groupBy("repo", F.col("last").alias("owner"), "name").agg(F.min("func").alias("func"))
    only = defs.groupBy("repo", "name").agg(F.count("*").alias("n"), F.min("func").alias("func")).where("n = 1")
    columns = [*calls.columns, "func"]
    ways = calls.where("owner is null").join(here, ["repo", "folder", "name"]).select(*columns, F.lit(0).alias("rank"))
    taken = facts.where("what = 'import'").select("repo", "rel_path", F.col("name").alias("owner"), F.col("target").alias("module"), F.lit("golang").alias("language"))
    origin = origins(taken, files).select("repo", "rel_path", "module", F.regexp_replace("origin", "/?[^/]*$", "").alias("from"))
    package = taken.join(origin, ["repo", "rel_path", "module"]).groupBy("repo", "rel_path", "owner").agg(F.min("from").alias("from"))
    meant = calls.join(package, ["repo", "rel_path", "owner"]).join(here.withColumnRenamed("folder", "from"), ["repo", "from", "name"])
    ways = ways.unionByName(meant.select(*columns, F.lit(1).alias("rank"))).unionByName(calls.join(named, ["repo", "owner", "name"]).select(*columns, F.lit(2).alias("rank"))).unionByName(calls.join(only, ["repo", "name"]).select(*columns, F.lit(3).alias("rank")))
    best = ways.groupBy("id", "src", "value", "arg").agg(F.min_by("func", F.struct("rank", "func")).alias("func"))
    edges = settled(best.select("src", F.concat_ws("\x00", "func", "arg").alias("dst"), "value"))
    # What begins at a parameter that nobody passes anything for begins with nothing.
    fed = edges.select(F.col("dst").alias("src")).distinct()
    loose = edges.where("src is not null").join(fed, "src", "left_anti").select(F.col("dst").alias("node"), "value")
    starts = edges.where("src is null").select(F.col("dst").alias("node"), "value").unionByName(loose)
    return composed(starts, edges.where("src is not null"), s.join_route).select("node", F.col("value").alias("prefix"))


def golang(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Router calls, once for each prefix that callers pass for the router, with the span of their handler: of the same file first, then the same folder, then by path; unknown handlers are rejected with a reason."""
    facts = settled(extracted(files, go_facts.extract))
    folder = F.regexp_replace("rel_path", "/?[^/]*$", "")
    node = F.when(F.col("detail").isNotNull(), F.concat_ws("\x00", "repo", "rel_path", F.get_json_object("detail", "$.func"), F.get_json_object("detail", "$.param")))
    found = facts.where("what = 'endpoint'").withColumn("node", node).join(passed_prefixes(facts, files), "node", "left")
    found = found.withColumn("route", F.when(F.coalesce("prefix", F.lit("")) == "", F.col("route")).otherwise(s.join_route(F.col("prefix"), F.col("route"))))
    calls = found.withColumn("symbol", F.regexp_extract("target", r"(\w+)$", 1)).withColumn("folder", folder)
    defs = facts.where("what = 'go_func'").select("repo", F.col("name").alias("symbol"), F.col("rel_path").alias("file"), folder.alias("_folder"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    # Of each name the first of a file, of a folder, and of the repository: no name meets all its namesakes.
    first = lambda *key: defs.groupBy(*key, "symbol").agg(F.min(F.struct("file", "_s", "_e")).alias("h"))
    own = first("repo", "file").withColumnsRenamed({"file": "rel_path", "h": "h0"})
    near = first("repo", "_folder").withColumnsRenamed({"_folder": "folder", "h": "h1"})
    far = first("repo").withColumnRenamed("h", "h2")
    best = calls.join(own, ["repo", "rel_path", "symbol"], "left").join(near, ["repo", "folder", "symbol"], "left").join(far, ["repo", "symbol"], "left").withColumn("h", F.coalesce("h0", "h1", "h2"))
    known = F.col("h.file").isNotNull()
    rows = best.where(known | F.col("target").isNull()).select("repo", F.coalesce("h.file", "rel_path").alias("rel_path"), "pos", "kind", "name", "method", s.normalize_colon(F.col("route")).alias("route"), F.coalesce("h._s", "start_line").alias("start_line"), F.coalesce("h._e", "end_line").alias("end_line"))
    missing = best.where(~known & F.col("target").isNotNull()).select("repo", "rel_path", "pos", "kind", "name", "method", "route", "start_line", "end_line").withColumn("detail", F.lit("handler not found")).withColumn("what", F.lit("reject"))
    return _as_endpoints(rows), facts.where("what = 'reject'").select("repo", "rel_path", "pos", "kind", "name", "method", "route", "start_line", "end_line", "detail", "what").unionByName(missing)


def rails(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes with the controller action that serves them, own or of an ancestor; routes without one are rejected.

    Ancestors are asked as Ruby asks them: a class's modules, the one of the last
    include statement first and in order of arguments within one, each with its
    own, then its superclass. Concerns of a repository's route files are shared.
    """
    routes = files.where(F.col("rel_path").rlike(rails_facts.ROUTE_FILE) & F.contains("text", F.lit("concern")))
    found = extracted(routes, rails_facts.concern_rows).where("what = 'concern'")
    shared = found.groupBy("repo", "name").agg(F.min_by("detail", F.struct("rel_path", "pos")).alias("detail")).groupBy("repo").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "detail")))).alias("shared"))
    facts = settled(extracted(files.join(shared, "repo", "left"), rails_facts.extract, "shared"))
    routes = facts.where("what = 'endpoint'").withColumn("a", s.split_action(F.col("target")))
    classes = facts.where("what = 'ruby_class'")
    parents = classes.where("target is not null").select("repo", F.col("name").alias("src"), F.col("target").alias("dst"), F.lit(1 << 30).alias("rank"))
    mixed = facts.where("what = 'ruby_include'").select("repo", F.col("owner").alias("src"), F.posexplode(F.from_json("target", "array<string>")).alias("_arg", "dst"), "start_line")
    mixed = mixed.select("repo", "src", "dst", ((F.lit(1_000_000) - F.col("start_line")) * 100 + F.col("_arg")).cast("int").alias("rank"))
    key = lambda c: F.concat_ws("\x00", "repo", c)
    edges = parents.unionByName(mixed).groupBy(key("src").alias("src"), key("dst").alias("dst")).agg(F.min("rank").alias("rank"))
    # app/controllers/api/posts_controller.rb serves api/posts; the class name is the camelised path.
    wanted = F.concat(F.array_join(F.transform(F.split(F.col("a.controller"), "/"), lambda x: F.array_join(F.transform(F.split(x, "_"), F.initcap), "")), "::"), F.lit("Controller"))
    routes = routes.withColumn("class", wanted)
    reach = in_order(routes.where("class is not null").select(key("class").alias("root"), key("class").alias("node")).distinct(), edges)
    actions = facts.where("what = 'ruby_method' and kind = 'instance'").select(key("owner").alias("node"), F.col("name").alias("action"), F.col("rel_path").alias("file"), F.col("start_line").alias("_s"))
    # Only what some route asks for: a base's actions do not meet all the classes below it.
    asked = routes.where("class is not null").select(key("class").alias("root"), F.col("a.action").alias("action")).distinct()
    served = asked.join(reach, "root").join(actions, ["node", "action"]).groupBy("root", "action").agg(F.min_by(F.struct("file", "_s"), F.struct("place", "file", "_s")).alias("h"))
    rows = routes.withColumn("root", key("class")).withColumn("action", F.col("a.action")).join(served, ["root", "action"], "left")
    good = rows.where("h is not null").select("repo", F.col("h.file").alias("rel_path"), "pos", "kind", F.col("target").alias("name"), "method", s.normalize_colon(F.col("route")).alias("route"), F.col("h._s").alias("start_line"), F.col("h._s").alias("end_line"))
    lost = rows.where("h is null").select(*facts.columns).withColumn("detail", F.lit("no action serves the route"))
    return _as_endpoints(good), lost


def merge_variants(endpoints: DataFrame) -> DataFrame:
    """A row for each repo, method and route: the first job, and how many others have other conditions."""
    key = ["repo", "method", "route"]
    once = endpoints.where("route is not null").groupBy(*key, "conditions").agg(F.min(F.struct("rel_path", "pos", "kind", "name", "start_line", "end_line")).alias("w"))
    per = once.groupBy(*key).agg(F.min(F.struct("w", "conditions")).alias("f"), (F.count("*") - 1).alias("variants"))
    return per.select(*key, "f.w.rel_path", "f.w.pos", "f.w.kind", "f.w.name", "f.w.start_line", "f.w.end_line", "f.conditions", "variants")


def code_endpoints(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (repo, rel_path, language, text) -> endpoints of all languages, one a repo, method and route; reject counts by reason."""
    lanes = {"nodejs": nodejs, "java": java, "golang": golang, "ruby_on_rails": rails}
    # At most a row a language: the lanes of languages without files are left out.
    present = {r.language for r in files.where(F.col("language").isin("python", *lanes)).select("language").distinct().collect()}
    none = files.limit(0)
    rows = _as_endpoints(python_endpoints(files.where("language = 'python'"))) if "python" in present or not present else None
    bad = none.select("repo", "language", F.lit(None).cast("string").alias("reason"))
    for name, lane in lanes.items():
        if name in present:
            found, lost = lane(files.where(F.col("language") == name))
            rows = found if rows is None else rows.unionByName(found)
            bad = bad.unionByName(lost.select("repo", F.lit(name).alias("language"), F.col("detail").alias("reason")))
    unrouted = rows.where("route is null").select("repo", F.lit("any").alias("language"), F.lit("no route").alias("reason"))
    return merge_variants(rows), bad.unionByName(unrouted).groupBy("repo", "language", "reason").agg(F.count("*").alias("n"))


def framework(files: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """The framework most of a repo's files point to; of equal ones, the first listed."""
    hits = F.filter(F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(n).alias("framework"), F.lit(-k).alias("order"))) for k, (n, p) in enumerate(patterns))), lambda x: x.isNotNull())
    counts = files.select("repo", F.explode(hits).alias("h")).groupBy("repo", "h.framework", "h.order").agg(F.count("*").alias("n"))
    return dedupe.last_wins(counts.withColumn("rank", F.struct("n", "order")), ["repo"], "rank", ["framework"]).select("repo", "framework")
