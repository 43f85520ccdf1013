"""Generator runs of Maven files, with properties taken from the parents of a pom.

A pom names its parent by coordinates and by where it lies. Parents are joined
by place, if the file there has these coordinates, else by coordinates that one
pom of the repository has. Properties are then laid over one another along the
chain, nearest first, by pointer doubling: a pom that knows the properties of
2^k ancestors takes over what the last of them knows, so a chain of any length
takes the logarithm of its length in joins. A chain longer than the table is a
circle: its poms keep their own properties, and are named.
"""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xml.etree.ElementTree import ParseError

from ..functions import maven_facts as mf
from ..functions.contract_facts import contained, kind_of
from ..operators.closure import dealt, forget, settled

_RUN = "struct<generator: string, input: string, skip: string, api_package: string, provisional: boolean>"
POM = f"repo string, rel_path string, group_id string, artifact_id string, version string, parent_group string, parent_artifact string, parent_version string, parent_path string, properties map<string, string>, runs array<{_RUN}>, error string"
RUNS = "repo string, build_file string, generator string, kind string, api_package string, provisional boolean, places array<string>, proof array<string>, error string"


_POM_COLUMNS = ["repo", "rel_path", "group_id", "artifact_id", "version", "parent_group", "parent_artifact", "parent_version", "parent_path", "properties", "runs", "error"]


def poms(files: DataFrame) -> DataFrame:
    """files (repo, rel_path, text) -> the facts of each pom; error says why one cannot be read."""

    def run(parts):
        for p in parts:
            out = []
            for repo, path, text in zip(p["repo"], p["rel_path"], p["text"]):
                try:
                    got = mf.pom(text, path)
                except (ParseError, ValueError, RecursionError) as e:  # malformed XML proves nothing, and is named
                    got = {"error": str(e) or type(e).__name__}
                if got:
                    out.append({"repo": repo, "rel_path": path} | got)
            d = pd.DataFrame(out, columns=_POM_COLUMNS).astype(object)
            yield d.where(d.notna(), None)

    return dealt(files.select("repo", "rel_path", "text"), "repo", "rel_path").mapInPandas(run, POM)


def parents(found: DataFrame) -> DataFrame:
    """poms -> (repo, rel_path, parent): the pom of the same repository that each one names as its parent; those without one are left out."""
    child = found.where("parent_artifact is not null").select("repo", "rel_path", "parent_group", "parent_artifact", "parent_version", "parent_path")
    other = found.where("artifact_id is not null").select("repo", F.col("rel_path").alias("parent"), "group_id", "artifact_id", "version")
    told = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike(r"[\[(,$]")  # noqa: E731 (neither a range nor an expression)
    same = F.col("parent_group").eqNullSafe(F.col("group_id")) & ~(told("parent_version") & told("version") & (F.col("parent_version") != F.col("version")))
    placed = child.where("parent_path is not null").join(other.withColumn("parent_path", F.col("parent")).withColumn("parent_artifact", F.col("artifact_id")), ["repo", "parent_path", "parent_artifact"]).where(same)
    placed = placed.select("repo", "rel_path", "parent")
    # Who has these coordinates is counted before poms ask for them, so many children of one parent stay rows, not pairs.
    asked = child.join(placed, ["repo", "rel_path"], "left_anti")
    only = other.withColumn("parent_artifact", F.col("artifact_id")).groupBy("repo", "parent_artifact", "group_id").agg(F.count("*").alias("n"), F.min("parent").alias("parent"), F.min("version").alias("version")).where("n = 1")
    return placed.unionByName(asked.join(only, ["repo", "parent_artifact"]).where(same).select("repo", "rel_path", "parent"))


def overlaid(found: DataFrame) -> DataFrame:
    """poms -> (repo, rel_path, parent, set, circle): every property that holds in a pom, with the file that sets it; the nearest one wins."""
    own = F.transform_values("properties", lambda _, v: F.struct(v.alias("value"), F.col("rel_path").alias("file")))
    start = settled(found.where("error is null").join(parents(found), ["repo", "rel_path"], "left").select("repo", "rel_path", "parent", F.col("parent").alias("at"), own.alias("set")))
    longest = start.groupBy("repo").count().agg(F.max("count")).first()[0] or 0
    now = start
    for _ in range(int(longest).bit_length() + 1):
        if now.where("at is not null").isEmpty():
            break
        far = now.select("repo", F.col("rel_path").alias("at"), F.col("at").alias("next"), F.col("set").alias("more"))
        step = now.join(far, ["repo", "at"], "left").withColumn("more", F.map_filter("more", lambda k, _: ~F.map_contains_key(F.col("set"), k)))
        new = settled(step.select("repo", "rel_path", "parent", F.col("next").alias("at"), F.when(F.col("more").isNull(), F.col("set")).otherwise(F.map_concat("set", "more")).alias("set")))
        if now is not start:
            forget(now)
        now = new
    plain = start.select("repo", "rel_path", F.col("set").alias("plain"))
    circle = F.col("at").isNotNull()
    return now.join(plain, ["repo", "rel_path"]).select("repo", "rel_path", F.when(~circle, F.col("parent")).alias("parent"), F.when(circle, F.col("plain")).otherwise(F.col("set")).alias("set"), circle.alias("circle"))


def _run(r: dict):
    """Runs of a pom with their expressions filled in: places are where the specification may lie, best first; error says what was left open."""
    folder = posixpath.dirname(r["rel_path"])
    held = dict(r["set"])
    project = {"groupId": r["group_id"], "artifactId": r["artifact_id"], "version": r["version"], "parent.groupId": r["parent_group"], "parent.artifactId": r["parent_artifact"], "parent.version": r["parent_version"]}
    env = {k: v["value"] for k, v in held.items()} | {f"{p}.{k}": v for p in ("project", "pom") for k, v in project.items() if v}
    here = dict.fromkeys(mf.BASEDIRS, ".")
    above = [posixpath.relpath(posixpath.dirname(r["parent"]) or ".", folder or ".")] if r["parent"] else []
    for run in r["runs"]:
        used: set[str] = set()

        def fill(value, at="."):
            text, names = mf.filled(value or "", env | here | {"project.parent.basedir": at})
            used.update(names)
            return text

        if fill(run["skip"]).strip().lower() == "true":
            continue
        generator, package = fill(run["generator"]).strip(), fill(run["api_package"]) or None
        # A parent's folder is meant where there is a parent; a pom's own is what some write it for.
        inputs = list(dict.fromkeys(fill(run["input"], at) for at in (*above, ".")))
        places = [p for v in inputs if v and "${" not in v and (p := contained(folder, v))]
        proof = [r["rel_path"], *sorted({held[n]["file"] for n in used if n in held} - {r["rel_path"]})]
        error = None if places or not run["input"] else f"input not resolved: {run['input']}"
        yield r["repo"], r["rel_path"], generator, kind_of(generator), package, bool(run["provisional"]), places, proof, error


def evidence(files: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Generator runs by the specification they read (repo, rel_path, build_file, generator, kind, api_package, provisional, proof); and poms that cannot be read, inputs left open and parents in a circle (repo, rel_path, error).

    proof names the pom and those ancestors whose properties were used.
    """
    found = settled(poms(files))
    # Parents matter only where a run has something to fill in.
    asks = F.exists("runs", lambda r: F.concat_ws("", r["input"], r["generator"], r["skip"], r["api_package"]).contains("${"))
    asking = found.where(asks).select("repo").distinct()
    wide = settled(overlaid(found.join(asking, "repo", "left_semi")))
    builds = found.where((F.size("runs") > 0) & F.col("rel_path").rlike(r"(^|/)pom\.xml$")).join(wide, ["repo", "rel_path"], "left")
    own = F.transform_values("properties", lambda _, v: F.struct(v.alias("value"), F.col("rel_path").alias("file")))
    builds = builds.withColumn("set", F.coalesce("set", own)).drop("properties", "error")

    def run(parts):
        for p in parts:
            yield pd.DataFrame([x for r in p.astype(object).where(p.notna(), None).to_dict("records") for x in _run(r)], columns=[c.split()[0] for c in RUNS.split(", ")])

    made = settled(dealt(builds, "repo", "rel_path").mapInPandas(run, RUNS))
    one = made.where("size(places) = 1").withColumn("rel_path", F.col("places")[0])
    tried = made.where("size(places) > 1").select("*", F.monotonically_increasing_id().alias("run")).select("*", F.posexplode("places").alias("place", "rel_path"))
    there = tried.join(tree.select("repo", "rel_path").distinct().withColumn("there", F.lit(True)), ["repo", "rel_path"], "left")
    # The first place that has a file; where none has, the pom's own folder, which comes last.
    order = F.struct(F.col("there").isNull(), F.when(F.col("there").isNull(), -F.col("place")).otherwise(F.col("place")))
    columns = ["repo", "build_file", "generator", "kind", "api_package", "provisional", "proof"]
    many = there.groupBy("run", *columns).agg(F.min_by("rel_path", order).alias("rel_path"))
    rejects = found.where("error is not null").select("repo", "rel_path", "error").unionByName(made.where("error is not null").select("repo", F.col("build_file").alias("rel_path"), "error")).unionByName(wide.where("circle").select("repo", "rel_path", F.lit("parents run in a circle").alias("error")))
    return one.select("rel_path", *columns).unionByName(many.select("rel_path", *columns)), rejects.distinct()
