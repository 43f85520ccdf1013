"""Python endpoints: decorated routes with their prefixes, and Django URL configurations, by joins over file facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import python_facts
from ..functions import scalars as s
from ..functions.rows import ENDPOINT, extracted
from ..operators.closure import settled


def joined(prefix: Column, route: Column) -> Column:
    """A prefix before a route with one slash between; either alone as it is."""
    both = F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), F.regexp_replace(route, "^/+", ""))
    return F.when(F.coalesce(prefix, F.lit("")) == "", route).when(route.isNull(), prefix).otherwise(s.rooted(both))


def module_paths(file: Column, module: Column) -> Column:
    """Where an imported module may lie, best first: from each folder above the file down to the root, as a file or a package."""
    folders = F.slice(F.split(file, "/"), 1, F.size(F.split(file, "/")) - 1)
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    inner = F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/")
    deep = F.when(dots > 0, F.array(F.size(folders) - dots + 1)).otherwise(F.sequence(F.size(folders), F.lit(0)))
    bases = F.transform(F.filter(deep, lambda n: n >= 0), lambda n: F.array_join(F.filter(F.concat(F.slice(folders, F.lit(1), n), F.array(inner)), lambda x: x != ""), "/"))
    return F.flatten(F.transform(bases, lambda b: F.array(F.concat(b, F.lit(".py")), F.concat(F.when(b == "", "").otherwise(F.concat(b, F.lit("/"))), F.lit("__init__.py")))))


def resolve(refs: DataFrame, files: DataFrame, module: Column, key: list[str]) -> DataFrame:
    """refs with ``origin``: the first existing file of their module, by one equi-join on the candidates."""
    tried = refs.withColumn("_m", module).select("*", F.posexplode(module_paths(F.col("rel_path"), F.col("_m"))).alias("_try", "_path"))
    hit = tried.join(files.select("repo", F.col("rel_path").alias("_path")).distinct(), ["repo", "_path"])
    best = hit.groupBy(*key).agg(F.min_by("_path", "_try").alias("origin"))
    return refs.join(best, key)


def imported(refs: DataFrame, facts: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """refs with (origin, symbol): the file and name that a possibly dotted name was imported from."""
    known = facts.where("what = 'import'").select("repo", "rel_path", F.col("name").alias("_bound"), F.col("target").alias("_module"), F.col("detail").alias("_there")).distinct()
    head, last = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"([^.]*)$", 1)
    whole = refs.withColumn("_bound", F.col(name)).withColumn("_rest", F.lit(None).cast("string"))
    parts = refs.where(F.instr(name, ".") > 0).withColumn("_bound", head).withColumn("_rest", last)
    got = whole.unionByName(parts).join(known, ["repo", "rel_path", "_bound"])
    # A dotted name's module is the import itself, or a name inside it.
    module = F.when(F.col("_rest").isNull(), F.col("_module")).when(F.col("_there").isNull(), F.col("_module")).otherwise(F.concat(F.col("_module"), F.when(F.col("_module").rlike(r"^\.*$"), "").otherwise("."), F.col("_there")))
    symbol = F.coalesce("_rest", "_there")
    got = got.where(symbol.isNotNull()).withColumn("symbol", symbol).withColumn("_full", module).drop("_bound", "_rest", "_module", "_there")
    return resolve(got, files, F.col("_full"), ["repo", "rel_path", "pos"]).drop("_full")


def decorated(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Decorator routes with the prefix of their blueprint or router: a registration replaces a blueprint's own prefix and goes before a router's."""
    defs = facts.where("what = 'definition'").groupBy("repo", "rel_path", "name").agg(F.max_by("kind", "pos").alias("kind"), F.max_by("route", "pos").alias("own"))
    regs = facts.where("what = 'registration'")
    here = regs.groupBy("repo", "rel_path", "name").agg(F.max_by("kind", "pos").alias("kind_r"), F.max_by("route", "pos").alias("mount"))
    far = imported(regs.join(defs.select("repo", "rel_path", "name"), ["repo", "rel_path", "name"], "left_anti"), facts, files, "name")
    far = far.groupBy("repo", F.col("origin").alias("rel_path"), F.col("symbol").alias("name")).agg(F.max_by("kind", F.struct("rel_path", "pos")).alias("kind_f"), F.max_by("route", F.struct("rel_path", "pos")).alias("mount_f"))
    key = ["repo", "rel_path", "name"]
    all_ = defs.join(here, key, "full").join(far, key, "full")
    mount, kind = F.coalesce("mount", "mount_f"), F.coalesce("kind_r", "kind_f", "kind")
    prefix = F.when(kind == "blueprint", F.coalesce(mount, F.col("own"))).otherwise(joined(mount, F.col("own")))
    index = all_.select("repo", "rel_path", F.col("name").alias("owner"), prefix.alias("prefix")).where("prefix is not null")
    rows = facts.where("what = 'endpoint'").join(index, ["repo", "rel_path", "owner"], "left")
    return rows.withColumn("route", F.when(F.col("route").isNotNull(), joined(F.col("prefix"), F.col("route")))).select(*ENDPOINT)


def django(facts: DataFrame, files: DataFrame, most: int = 64) -> DataFrame:
    """URL configurations walked from those that no other includes (all, if each is included), with a visited list on every path."""
    p = facts.where("what = 'pattern'").withColumn("step", F.when(F.col("detail") == "regex", s.regex_route(F.col("route"))).otherwise(F.col("route"))).where("step is not null")
    inc = p.where("kind in ('include', 'include_ref')")
    by_name = resolve(inc.where("kind = 'include'"), files, F.col("target"), ["repo", "rel_path", "pos"]).select("repo", "rel_path", "pos", "step", "origin")
    ref = imported(inc.where("kind = 'include_ref'").withColumn("target", F.concat(F.col("target"), F.lit("._"))), facts, files, "target").select("repo", "rel_path", "pos", "step", "origin")
    edges = settled(by_name.unionByName(ref))
    confs = p.select("repo", "rel_path").distinct()
    roots = confs.join(edges.select("repo", F.col("origin").alias("rel_path")).distinct(), ["repo", "rel_path"], "left_anti")
    lost = confs.join(roots.select("repo").distinct(), "repo", "left_anti")
    front = settled(roots.unionByName(lost).select("repo", "rel_path", F.lit("").alias("prefix"), F.array("rel_path").alias("seen")))
    reached = front
    for _ in range(most):
        front = front.join(edges, ["repo", "rel_path"]).where(~F.array_contains("seen", F.col("origin")))
        front = settled(front.select("repo", F.col("origin").alias("rel_path"), joined(F.col("prefix"), F.col("step")).alias("prefix"), F.concat("seen", F.array("origin")).alias("seen")))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    else:
        raise RecursionError(f"includes nest deeper than {most}")
    at = reached.select("repo", "rel_path", "prefix").distinct()
    view = p.where("kind = 'view'").select("repo", "rel_path", "pos", "step", "target", F.lit("view").alias("as_"))
    registered = facts.where("what = 'router'").select("repo", "rel_path", "pos", F.col("owner").alias("_o"), F.col("route").alias("_r"), F.col("target").alias("_t"))
    routers = p.where("kind = 'router'").select("repo", "rel_path", F.col("target").alias("_o"), "step").join(registered, ["repo", "rel_path", "_o"])
    routers = routers.select("repo", "rel_path", "pos", joined(F.col("step"), F.col("_r")).alias("step"), F.col("_t").alias("target"), F.lit("router").alias("as_"))
    refs = view.unionByName(routers)
    away = imported(refs, facts, files, "target")
    local = refs.join(away.select("repo", "rel_path", "pos", "as_"), ["repo", "rel_path", "pos", "as_"], "left_anti").where(F.instr("target", ".") == 0).withColumn("origin", F.col("rel_path")).withColumn("symbol", F.col("target"))
    refs = away.unionByName(local).join(at, ["repo", "rel_path"])
    serves = facts.where("what = 'serves'").select("repo", F.col("rel_path").alias("origin"), F.col("owner").alias("symbol"), "kind", "name", "method", "start_line", "end_line")
    hit = refs.join(serves, ["repo", "origin", "symbol"]).where((F.col("as_") == "view") == (F.col("kind") == "view"))
    route = s.rooted(joined(F.col("prefix"), F.col("step")))
    base = F.concat(F.regexp_replace(route, "/+$", ""), F.lit("/"))
    full = F.when(F.col("kind") == "collection", base).when(F.col("kind") == "detail", F.concat(base, F.lit("<pk>/"))).otherwise(route)
    return hit.select("repo", F.col("origin").alias("rel_path"), "pos", F.lit("function").alias("kind"), "name", "method", full.alias("route"), "start_line", "end_line").dropDuplicates(["repo", "rel_path", "start_line", "end_line", "route", "method"])


def python_endpoints(files: DataFrame) -> DataFrame:
    """files (repo, rel_path, text) -> endpoints with normalised routes; rows without a route stay, with null."""
    facts = settled(extracted(files, python_facts.extract))
    rows = decorated(facts, files).unionByName(django(facts, files))
    return rows.withColumn("route", s.normalize_python(F.col("route")))
