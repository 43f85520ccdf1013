"""The merged OpenAPI document and the run report, and a thin command line."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.repo_tree import CODE_IGNORED, code_files, read_tree, repo_name, tracked_files
from . import incremental as inc
from . import incremental_run
from .code_lane import code_endpoints
from .contract_lane import reconcile, run_lane

EXIT_OK, EXIT_ERROR, EXIT_PARTIAL = 0, 1, 2


def openapi(title: str, host: str, operations: DataFrame, generated_at: str, commit: str = "", components: DataFrame | None = None) -> dict:
    """operations (route, method, operation json, source_id, conflict, conditions) and components (category, name, body) as one document: written for a reader, so gathered."""
    paths: dict = {}
    for r in operations.orderBy("route", "method").toLocalIterator():
        if r.route in ("/*", "*"):
            continue
        op = json.loads(r.operation or "{}")
        if r.source_id:
            op["x-source"] = [r.source_id]
        if r.conflict:
            op["x-conflict"] = list(r.conflict)
        if r.conditions:
            op["x-routing-conditions"] = json.loads(r.conditions)
        paths.setdefault(r.route, {})[r.method.lower()] = op
    doc = {"openapi": "3.0.0", "info": {"title": title, "version": "1.0.0", "x-generated-at": generated_at, "x-commit-reference": commit}, "servers": [{"url": host}], "paths": paths}
    for r in components.orderBy("category", "name").toLocalIterator() if components is not None else ():
        doc.setdefault("components", {}).setdefault(r.category, {})[r.name] = json.loads(r.body)
    return doc


def write_json(path: str, value: dict) -> None:
    """Whole or not at all."""
    with open(tmp := f"{path}.tmp", "w") as f:
        json.dump(value, f, indent=2, sort_keys=False)
    os.replace(tmp, path)


def analyse(spark: SparkSession, root: str) -> dict:
    """Both lanes of one tree: merged operations, what is superseded, what is left to document, rejects and verdicts."""
    tree = read_tree(spark, root).cache()
    endpoints, rejects = code_endpoints(code_files(tree, CODE_IGNORED))
    lane = run_lane(tree, overrides=own(overrides(spark, root), root), tracked=own(tracked_files(spark, root), root))
    merged = reconcile(lane["rows"], endpoints)
    return merged | {"files": code_files(tree, CODE_IGNORED), "rejects": rejects, "verdicts": lane["verdicts"], "endpoints": endpoints, "components": lane["components"], "overrides": lane["overrides"]}


def own(rows: DataFrame | None, root: str) -> DataFrame | None:
    """rows as those of the tree's repository."""
    return None if rows is None else rows.withColumn("repo", F.lit(repo_name(root)))


def overrides(spark: SparkSession, root: str, name: str = "contract_overrides.yaml") -> DataFrame | None:
    """The entries of a tree's overrides file, in its order; None without one or where it is not a list of specs."""
    import yaml

    try:
        with open(os.path.join(root, name)) as f:
            doc = yaml.safe_load(f)
    except (OSError, yaml.YAMLError):
        return None
    specs = doc.get("specs") if isinstance(doc, dict) else None
    rows = [(str(x["path"]), str(x["action"]), x.get("eligibility_hash"), x.get("prefix")) for x in specs or () if isinstance(x, dict) and x.get("action") in ("include", "exclude") and x.get("path")]
    return spark.createDataFrame(rows, "rel_path string, action string, eligibility_hash string, prefix string").coalesce(1) if rows else None


def profile(found: dict) -> dict:
    v = found["verdicts"].groupBy("status", "reason").agg(F.count("*").alias("n")).collect()
    return {"contracts": [{"status": r.status, "reason": r.reason, "n": r.n} for r in sorted(v)], "rejects": [r.asDict() for r in found["rejects"].collect()], "superseded": found["superseded"].count(), "to_generate": found["to_generate"].count(), "conflicts": found["operations"].where(F.size("conflict") > 0).count()}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="HTTP operations of a source tree.")
    p.add_argument("path")
    p.add_argument("--output", default="openapi.json")
    p.add_argument("--host", default="http://localhost")
    p.add_argument("--incremental", metavar="STATE", help="folder that keeps operations between runs: endpoints are described by the model, those that changed only")
    p.add_argument("--base", help="with --incremental: what the files are compared with; without it, uncommitted changes count")
    p.add_argument("--model", metavar="MODULE:FUNCTION", help="what answers a prompt; an offline outline without it")
    a = p.parse_args(argv)
    if not os.path.isdir(a.path):
        print(f"no such folder: {a.path}", file=sys.stderr)
        return EXIT_ERROR
    spark = SparkSession.builder.appName("routeloom").getOrCreate()
    found = analyse(spark, a.path)
    todo = found["to_generate"].withColumn("source_id", F.concat(F.lit("code:"), "rel_path"))
    status, code = EXIT_OK, todo.withColumn("operation", F.lit(None).cast("string"))
    if a.incremental:
        call = incremental_run.outline
        if a.model:
            module, _, name = a.model.partition(":")
            call = getattr(importlib.import_module(module), name)
        try:
            made = incremental_run.run(spark, a.path, os.path.abspath(a.incremental), found, found["files"], call, a.base)
        except RuntimeError as e:  # not one endpoint was described
            print(e, file=sys.stderr)
            return EXIT_ERROR
        told = made["report"].first().asDict() if made["report"] is not None else {}
        print(f"{made['mode']} run" + "".join(f", {n} {k}" for k, n in told.items()))
        status = EXIT_PARTIAL if told.get("failed") else EXIT_OK
        code = inc.keyed(todo).join(made["operations"].select("key", "operation"), "key", "left")
    code = code.select("route", "method", "operation", "source_id", F.array().cast("array<string>").alias("conflict"), "conditions")
    every = found["operations"].select("route", "method", "operation", "source_id", "conflict", "conditions").unionByName(code)
    doc = openapi(os.path.basename(os.path.abspath(a.path)), a.host, every, datetime.now(timezone.utc).isoformat(), components=found["components"])
    write_json(a.output, doc)
    write_json(os.path.join(os.path.dirname(os.path.abspath(a.output)), "repo_profile.json"), profile(found))
    print(f"{sum(map(len, doc['paths'].values()))} operations on {len(doc['paths'])} routes")
    return status if doc["paths"] else EXIT_PARTIAL


if __name__ == "__main__":
    sys.exit(main())
