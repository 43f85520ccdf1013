"""An incremental run of one tree from end to end: what changed, which endpoints depend on it, their source context, the model, the state.

The context of an endpoint is what its handler calls: definitions of its own
file, and those of files that its file imports. It is hashed, so an endpoint
whose file changed but whose context did not costs no call.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import context, joins
from ..operators.closure import settled
from ..sources.repo_tree import changed_files
from . import incremental as inc
from . import model_calls, state_tables, syntax
from .origins import origins

HEAD = "###"


def outline(prompt: str) -> str:
    """The model's place in offline runs: each endpoint of the prompt with an empty operation."""
    paths: dict = {}
    for method, route in re.findall(rf"^{HEAD} ([A-Z]+) (\S+)$", prompt, re.M):
        paths.setdefault(route, {})[method.lower()] = {"responses": {}}
    return json.dumps({"paths": paths})


def _cached_metadata(spark: SparkSession, files: DataFrame, root: str | None) -> dict[str, DataFrame]:
    """Symbols, calls and imports of files, parsed only where path and content are not in the cache of the last run; what is alive is stored."""
    kinds = {name: df.schema for name, df in syntax.metadata(files.limit(0)).items() if name != "errors"}

    def parse(rows: DataFrame) -> DataFrame:
        made = syntax.metadata(rows)
        parts = None
        for name in kinds:
            part = made[name].groupBy("rel_path").agg(F.to_json(F.collect_list(F.struct("*"))).alias("json")).select("rel_path", F.lit(name).alias("what"), "json")
            parts = part if parts is None else parts.unionByName(part)
        facts = parts.groupBy("rel_path").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("what", "json")))).alias("facts"))
        return rows.select("rel_path", "hash").join(facts, "rel_path", "left").select("rel_path", "hash", F.coalesce("facts", F.lit("{}")).alias("facts"))

    old = state_tables.read(spark, root, "cache", state_tables.CACHE) if root else None
    facts, alive = state_tables.cached_facts(files, old, parse, s.content_hash(F.col("rel_path"), F.encode("text", "UTF-8")))
    if root:
        alive = settled(alive)
        state_tables.write(alive, root, "cache", state_tables.CACHE)
        facts = alive
    told = facts.select(F.from_json("facts", "map<string,string>").alias("m"))
    return {name: told.select(F.explode(F.from_json(F.element_at("m", F.lit(name)), f"array<{schema.simpleString()}>")).alias("x")).select("x.*") for name, schema in kinds.items()}


def sources(endpoints: DataFrame, files: DataFrame, meta: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """endpoints (key, rel_path, pos, route, method, start_line, end_line) -> jobs (with section and context_hash), blocks (rel_path, pos, block) of each file, imports (for the index)."""
    texts = files.select("rel_path", "text")
    handlers = endpoints.select("key", "rel_path", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    definitions = meta["symbols"].select("rel_path", "name", "kind", "start_line", "end_line")
    calls = meta["calls"].select("rel_path", "name", F.col("start_line").alias("start"), F.col("start_line").alias("end"))
    called = joins.contained(calls, handlers, ["rel_path"], "start", "end", 256).select("o.key", "i.rel_path", "i.name").distinct()
    away = origins(meta["imports"], files).select("rel_path", "origin").distinct()
    far = called.join(away, "rel_path").join(definitions.select(F.col("rel_path").alias("origin"), "name").distinct(), ["origin", "name"])
    far = far.select("key", F.row_number().over(Window.partitionBy("key").orderBy("origin", "name")).alias("pos"), F.col("origin").alias("rel_path"), "name")
    found = context.assemble(handlers, calls, definitions, far, texts)
    bodies = context.blocks(handlers.select("key", F.lit(0).alias("pos"), "rel_path", F.col("start").alias("start_line"), F.col("end").alias("end_line")), texts).select("key", F.col("blocks")[0].alias("body"))
    jobs = endpoints.join(bodies, "key", "left").join(found, "key", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<string>")))
    jobs = jobs.withColumn("section", F.concat(F.lit(f"{HEAD} "), F.upper("method"), F.lit(" "), "route", F.lit("\n"), F.coalesce("body", F.lit("")))).withColumn("context_hash", s.context_hash(F.col("section"), F.col("blocks")))
    jobs = settled(jobs.select("key", "rel_path", "pos", "route", F.upper("method").alias("method"), "section", "context_hash", "blocks"))
    shared = jobs.select("rel_path", F.col("pos").alias("job"), F.posexplode("blocks").alias("i", "block")).select("rel_path", F.struct("job", "i").alias("pos"), "block")
    used = context.imported_definitions(far, definitions).join(endpoints.select("key", F.col("rel_path").alias("own")), "key")
    index = used.select("key", F.col("own").alias("rel_path"), F.col("rel_path").alias("import_path"), "name", "start_line", "end_line")
    return jobs.drop("blocks"), shared, index


def run(spark: SparkSession, root: str, state: str, found: dict, files: DataFrame, call: Callable[[str], str] = outline, base: str | None = None, tokens=inc.approximate_tokens) -> dict:
    """found: what ``report.analyse`` says of the tree; state: a folder that keeps operations, index, cache and replies between runs.

    Returns mode, operations (key, route, method, operation), made, failed and report (null where no call was needed).
    """
    routed = inc.keyed(found["to_generate"]).groupBy("key").agg(F.min(F.struct("rel_path", "pos", "route", "method", "start_line", "end_line")).alias("w")).select("key", "w.*")
    # A route's first line is its place in the file: positions of facts may repeat once prefixes are applied.
    numbered = routed.withColumn("pos", F.row_number().over(Window.partitionBy("rel_path").orderBy("start_line", "key")))
    endpoints = settled(numbered)
    jobs, blocks, imports = sources(endpoints, files, _cached_metadata(spark, files, state))
    reports: list[DataFrame] = []

    def generate(keys: DataFrame) -> DataFrame:
        asked, twins = inc.mirrors(jobs.join(keys, "key", "left_semi"))
        got = model_calls.generated(asked, blocks, tokens, call, f"{state.rstrip('/')}/model")
        reports.append(got["report"])
        return inc.with_mirrors(got["made"], twins)

    out = state_tables.run(spark, state, jobs.select("key", "pos", "rel_path", "context_hash"), imports, changed_files(spark, root, base), generate)
    return out | {"report": reports[0] if reports else None}
