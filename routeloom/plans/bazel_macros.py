"""Generator runs of Bazel files: calls are followed into the functions they name, arguments bound on the way, until a generator is run.

A frame is a call with what it was called with. Each round joins frames to the
functions that their names mean (of their own file, loaded, or else the only one
known), binds parameters, and joins the calls and the command texts of those
functions; texts that run a generator are runs, calls are the next frames. The
files on the way are the proof. The first call on the way that names a
specification decides it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions import starlark_facts as sf
from ..operators.closure import forget, settled

RUNS = "repo string, build_file string, generator string, kind string, raw string, api_package string, proof array<string>"
_FRAME = "repo string, build_file string, file string, name string, args string, specs string, proof array<string>, seen array<string>"


def _mapped(rows: DataFrame, each, schema: str) -> DataFrame:
    """rows, through a function from a row as a dict to tuples of schema."""
    names = [c.split()[0] for c in _columns(schema)]

    def run(parts):
        for p in parts:
            yield pd.DataFrame([x for r in p.to_dict("records") for x in each(r)], columns=names)

    return rows.mapInPandas(run, schema)


def _columns(schema: str) -> list[str]:
    return [x.strip() for x in schema.split(",")]


def facts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (repo, rel_path, text) -> facts of those that can be read, and (repo, rel_path, error) of the others."""
    schema = f"repo string, error string, {sf.COLUMNS}"

    def run(parts):
        for p in parts:
            out = []
            for repo, path, text in zip(p["repo"], p["rel_path"], p["text"]):
                try:
                    out += [(repo, None, *x) for x in sf.extract(text, path)]
                except (SyntaxError, ValueError, RecursionError) as e:  # not Starlark, or null bytes, or nested beyond the parser
                    out.append((repo, str(e) or type(e).__name__, None, path, None, None, None, None, None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _columns(schema)])

    found = settled(files.select("repo", "rel_path", "text").mapInPandas(run, schema))
    return found.where("error is null").drop("error"), found.where("error is not null").select("repo", F.col("file").alias("rel_path"), "error")


def _resolved(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, file, name -> def_file, def_name, params) of every function that a file can call, and constants (repo, file, constants)."""
    defs = found.where("what = 'def'").groupBy("repo", F.col("file").alias("def_file"), F.col("name").alias("def_name")).agg(F.max("value").alias("params"))
    inside = F.regexp_replace(F.regexp_replace(F.when(F.col("target").startswith(":"), F.concat(F.regexp_extract("file", r"^(.*/)?", 0), F.expr("substring(target, 2)"))).otherwise(F.regexp_replace("target", "^//", "")), ":", "/"), "^/", "")
    loads = found.where("what = 'load' and not startswith(target, '@')").select("repo", "file", "name", inside.alias("def_file"), F.expr("trim(BOTH '\"' FROM value)").alias("def_name"))
    used = found.where("what = 'call'").select("repo", "file", "name").distinct()
    loaded = loads.join(defs, ["repo", "def_file", "def_name"]).withColumn("rank", F.lit(1))
    own = used.join(defs, (used.repo == defs.repo) & (used.file == defs.def_file) & (used["name"] == defs.def_name)).select(used.repo, used.file, used["name"], "def_file", "def_name", "params").withColumn("rank", F.lit(0))
    # A name that no load explains: where just one file of the repository has it.
    only = defs.groupBy("repo", "def_name").agg(F.count("*").alias("n"), F.max("def_file").alias("def_file"), F.max("params").alias("params")).where("n = 1")
    known = used.join(only, (used.repo == only.repo) & (used["name"] == only.def_name)).select(used.repo, used.file, used["name"], "def_file", "def_name", "params").withColumn("rank", F.lit(2))
    order = ["repo", "file", "name", "def_file", "def_name", "params", "rank"]
    ways = own.select(order).unionByName(loaded.select(order)).unionByName(known.select(order))
    best = ways.groupBy("repo", "file", "name").agg(F.min_by(F.struct("def_file", "def_name", "params"), F.struct("rank", "def_file")).alias("d")).select("repo", "file", "name", "d.*")
    plain = found.where("what = 'const'").select("repo", "file", "name", "value")
    others = loads.join(plain.select("repo", F.col("file").alias("def_file"), F.col("name").alias("def_name"), "value"), ["repo", "def_file", "def_name"]).select("repo", "file", "name", "value")
    constants = plain.unionByName(others).groupBy("repo", "file").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", F.col("value")))))).alias("constants"))
    return best, constants


def _constants(text) -> dict:
    return {k: json.loads(v) for k, v in json.loads(text).items()} if isinstance(text, str) else {}


def runs(files: DataFrame, most: int = 32) -> tuple[DataFrame, DataFrame]:
    """(repo, build_file, generator, kind, raw, api_package, proof): generator runs and the specification each names; and files that cannot be read."""
    found, unread = facts(files)
    best, constants = _resolved(found)
    best, constants = settled(best), settled(constants)
    texts = found.where("what = 'text'").select("repo", "file", F.col("caller").alias("def_name"), F.col("value").alias("text"))
    calls = found.where("what = 'call'").select("repo", "file", F.col("caller").alias("def_name"), "name", F.col("value").alias("call"))

    def inline(r):
        got = sf.run_of(sf.filled(json.loads(r["text"]), _constants(r["constants"])))
        if got and got["spec"]:
            yield r["repo"], r["file"], got["generator"], got["kind"], got["spec"], got["package"], [r["file"]]

    def first(r):
        args = sf.filled(json.loads(r["call"]), _constants(r["constants"]))
        yield r["repo"], r["file"], r["file"], r["name"], json.dumps(args), json.dumps(sf.specs(args)), [r["file"]], []

    def reached(r):
        env = sf.bound(json.loads(r["params"]), json.loads(r["args"]), _constants(r["constants"]))
        got = sf.run_of(sf.filled(json.loads(r["text"]), env))
        if got:
            for spec, package in json.loads(r["specs"]) or [[got["spec"], got["package"]]]:
                yield r["repo"], r["build_file"], got["generator"], got["kind"], spec, package or got["package"], list(r["proof"])

    def deeper(r):
        env = sf.bound(json.loads(r["params"]), json.loads(r["args"]), _constants(r["constants"]))
        args = sf.filled(json.loads(r["call"]), env)
        yield r["repo"], r["build_file"], r["file"], r["name"], json.dumps(args), json.dumps(json.loads(r["specs"]) or sf.specs(args)), list(r["proof"]), list(r["seen"])

    known = lambda df: df.join(constants, ["repo", "file"], "left")
    every = _mapped(known(texts.where("def_name = ''")), inline, RUNS)
    # Only calls that lead to a function of the repository are frames.
    tops = calls.where("def_name = ''").join(best.select("repo", "file", "name"), ["repo", "file", "name"], "left_semi")
    frames = settled(_mapped(known(tops), first, _FRAME))
    inner = calls.where("def_name <> ''").join(best.select("repo", "file", "name"), ["repo", "file", "name"], "left_semi")
    for _ in range(most):
        if frames.isEmpty():
            return every.where("raw is not null").distinct(), unread
        entered = frames.join(best, ["repo", "file", "name"]).withColumn("here", F.concat_ws("\x00", "def_file", "def_name")).where("not array_contains(seen, here)")
        entered = entered.withColumn("seen", F.concat("seen", F.array("here"))).withColumn("proof", F.array_union("proof", F.array("def_file"))).drop("file", "name", "here").withColumnRenamed("def_file", "file")
        entered = settled(known(entered))
        every = every.unionByName(_mapped(entered.join(texts, ["repo", "file", "def_name"]), reached, RUNS))
        forget(frames)
        frames = settled(_mapped(entered.join(inner, ["repo", "file", "def_name"]), deeper, _FRAME))
    raise RecursionError(f"macros nested deeper than {most}")


def places(raw: Column, file: Column) -> Column:
    """Where a label or path of a file may lie, best first: labels have one place, those of other repositories none; paths the package, its resources, the root."""
    folder = F.regexp_extract(file, r"^(?:(.*)/)?", 1)
    resources = F.concat_ws("/", F.nullif(folder, F.lit("")), F.lit("src/main/resources"))
    root = F.lit("")
    label = scalars.contained(root, F.replace(F.substring(raw, 3, F.length(raw)), F.lit(":"), F.lit("/")))
    own = scalars.contained(folder, F.substring(raw, 2, F.length(raw)))
    free = F.array(scalars.contained(folder, raw), scalars.contained(resources, raw), scalars.contained(root, raw))
    return F.array_compact(F.when(raw.startswith("@"), F.array().cast("array<string>")).when(raw.startswith("//"), F.array(label)).when(raw.startswith(":"), F.array(own)).otherwise(free))


def evidence(files: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """runs with rel_path, the specification as a file that the repository has (runs without one are left out); and unreadable files."""
    found, unread = runs(files)
    tried = found.select("*", F.posexplode(places(F.col("raw"), F.col("build_file"))).alias("place", "rel_path"))
    # A file is there under its own path, or under a link to a folder above it.
    links = tree.where("is_symlink").select("repo", F.col("rel_path").alias("link"))
    above = tried.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("rel_path", "/"))), lambda n: F.array_join(F.slice(F.split("rel_path", "/"), F.lit(1), n), "/"))).alias("link"))
    there = tried.join(tree.select("repo", "rel_path").distinct(), ["repo", "rel_path"], "left_semi").unionByName(above.join(links, ["repo", "link"], "left_semi").select(*tried.columns))
    held = there.distinct()
    best = held.groupBy("repo", "build_file", "generator", "kind", "raw", "api_package", "proof").agg(F.min_by("rel_path", "place").alias("rel_path"))
    return best.drop("raw"), unread
