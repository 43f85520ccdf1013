"""References replaced by what they refer to, to any depth: bottom-up, by levels of the reference graph.

A component whose references are all inlined is built next, from their finished
bodies, so each one is built once however many refer to it and however deep it
stands. What is left when no more is ready refers to a cycle, or to nothing.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contract_facts as cf
from ..operators.closure import dealt, forget, settled

INLINED = "repo string, key string, body string"


def _substituted(value, found: dict):
    """value with each object that has a reference replaced in whole, as references replace what stands beside them."""
    if isinstance(value, dict):
        ref = value.get("$ref")
        return found[ref] if isinstance(ref, str) and ref in found else {k: _substituted(v, found) for k, v in value.items()}
    return [_substituted(v, found) for v in value] if isinstance(value, list) else value


def inline(components: DataFrame, most_bytes: int = cf.MAX_DOCUMENT, most: int = cf.MAX_DEPTH) -> DataFrame:
    """components (repo, key, body: JSON) -> repo, key, body, level, error: ``cycle`` or ``unresolved`` (body null) for what cannot be inlined.

    level: the longest chain of references below. A body beyond ``most_bytes`` and
    chains beyond ``most`` raise: inlining may double at every level.
    """

    def refer(parts):
        for p in parts:
            out = [(repo, key, ref) for repo, key, body in zip(p["repo"], p["key"], p["body"]) for ref in sorted(set(cf.references(json.loads(body))))]
            yield pd.DataFrame(out, columns=["repo", "key", "ref"])

    def build(parts):
        for p in parts:
            out = []
            for repo, key, body, found in zip(p["repo"], p["key"], p["body"], p["found"]):
                made = json.dumps(_substituted(json.loads(body), {x["ref"]: json.loads(x["target"]) for x in found}))
                if len(made) > most_bytes:
                    raise ValueError(f"{key} of {repo} is {len(made)} bytes when inlined")
                out.append((repo, key, made))
            yield pd.DataFrame(out, columns=["repo", "key", "body"])

    components = components.select("repo", "key", "body")
    edges = settled(dealt(components, "repo", "key").mapInPandas(refer, "repo string, key string, ref string"))
    wanted = settled(edges.groupBy("repo", "key").agg(F.count("*").alias("n")))
    front = settled(components.join(wanted, ["repo", "key"], "left_anti").withColumn("level", F.lit(0)))
    done, level, met, before = front, 0, None, None
    while not front.isEmpty():
        level += 1
        if level > most:
            raise RecursionError(f"references deeper than {most}")
        # Ready: all references are done, one of them since the last round. Edges meet what is new only; what met before is kept as counts.
        new = front.select("repo", F.col("key").alias("ref"), F.octet_length("body").alias("bytes"))
        near = edges.join(new, ["repo", "ref"]).groupBy("repo", "key").agg(F.count("*").alias("have"), F.sum("bytes").alias("bytes"))
        if met is not None:
            near = near.unionByName(met).groupBy("repo", "key").agg(F.sum("have").alias("have"), F.sum("bytes").alias("bytes"))
        near = settled(near.join(wanted, ["repo", "key"]))
        ready, met = near.where("have = n").select("repo", "key", "bytes"), near.where("have < n").select("repo", "key", "have", "bytes")
        finished = done.select("repo", F.col("key").alias("ref"), F.col("body").alias("target"))
        large = ready.where(F.col("bytes") > most_bytes).first()
        if large:
            raise ValueError(f"{large.key} of {large.repo} takes in {large.bytes} bytes")
        bodies = edges.join(ready, ["repo", "key"], "left_semi").join(finished, ["repo", "ref"]).groupBy("repo", "key").agg(F.collect_list(F.struct("ref", "target")).alias("found"))
        front = settled(dealt(components.join(bodies, ["repo", "key"]), "repo", "key").mapInPandas(build, INLINED).withColumn("level", F.lit(level)))
        done = done.unionByName(front)
        if before is not None:
            forget(before)
        before = near
    left = components.join(done, ["repo", "key"], "left_anti").select("repo", "key")
    gone = edges.join(components.select("repo", F.col("key").alias("ref")), ["repo", "ref"], "left_anti").select("repo", "key").distinct().withColumn("gone", F.lit(True))
    # What refers to something missing, directly or through others, is unresolved; the rest runs in circles.
    lost = settled(gone.select("repo", "key"))
    fresh = lost
    while not fresh.isEmpty():
        above = edges.join(fresh.select("repo", F.col("key").alias("ref")), ["repo", "ref"], "left_semi").select("repo", "key").distinct()
        fresh = settled(above.join(lost, ["repo", "key"], "left_anti"))
        lost = lost.unionByName(fresh)
    bad = left.join(lost.distinct().withColumn("gone", F.lit(True)), ["repo", "key"], "left").select("repo", "key", F.lit(None).cast("string").alias("body"), F.lit(None).cast("int").alias("level"), F.when(F.col("gone"), "unresolved").otherwise("cycle").alias("error"))
    return done.select("repo", "key", "body", "level", F.lit(None).cast("string").alias("error")).unionByName(bad)
