"""Runs as maintenance of state tables: which endpoints to make again, in which batches, and how results merge."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import budget, context, joins, merge, specs, state

RETRIES, WAITS = 2, (1, 4)
# The tag that a model fills with blanks, under its present and its former name.
AUTH_TAGS = ("x-auth-tag", "auth_tag")


def keyed(endpoints: DataFrame) -> DataFrame:
    return endpoints.withColumn("key", s.endpoint_key(F.col("method"), F.col("route")))


def plan(endpoints: DataFrame, stored: DataFrame, dependencies: DataFrame, changed: DataFrame | None) -> dict:
    """What this run must do. endpoints: key, rel_path, context_hash; stored: the same, of the last run; dependencies: key, rel_path.

    Returns mode (full, fast or partial), and for partial: removed and dirty
    keys, and skipped ones, whose recomputed context equals the stored one.
    An empty extraction never deletes: it is a full run of nothing.
    """
    if changed is None or endpoints.isEmpty():
        return {"mode": "full"}
    diff = merge.key_diff(stored.select("key").distinct(), endpoints.select("key").distinct(), "key")
    files = endpoints.select("rel_path").distinct()
    touched = state.dirty_one_hop(endpoints.select("key", "rel_path").unionByName(stored.select("key", "rel_path")), dependencies, changed, "key", "rel_path")
    dirty = diff.where("status = 'added'").select("key").unionByName(touched.join(diff.where("status = 'kept'"), "key", "left_semi")).distinct()
    removed = diff.where("status = 'removed'").select("key")
    if dirty.isEmpty() and removed.isEmpty():
        return {"mode": "fast" if state.missing_paths(stored, files, "rel_path").isEmpty() else "full"}
    if state.must_regenerate(dirty, endpoints.select("key").distinct()).first().full:
        return {"mode": "full"}
    same = state.unchanged(endpoints.select("key", "context_hash"), stored.groupBy("key").agg(F.max("context_hash").alias("context_hash")), "key", "context_hash", True)
    return {"mode": "partial", "removed": removed, "dirty": dirty.join(same, "key", "left_anti"), "skipped": dirty.join(same, "key", "left_semi")}


def batches(jobs: DataFrame, tokens) -> DataFrame:
    """jobs (rel_path, pos, section) with a batch number per file: sections cut to the cap of a handler, then greedy by their token prices."""
    cut = context.truncate(F.col("section"), budget.HANDLER_TOKENS, tokens)
    rows = jobs.withColumn("section", cut).withColumn("cost", tokens(F.col("section")).cast("long"))
    packed = budget.pack_batches(rows, "rel_path", "pos", "cost")
    # Each job takes the number of the last batch that begins at it or before.
    begins = packed.select("rel_path", F.col("first").cast("long").alias("pos"), F.lit(0).alias("kind"), "batch")
    jobs_at = rows.select("rel_path", F.col("pos").cast("long").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast(begins.schema["batch"].dataType).alias("batch")).distinct()
    near = joins.nearest_before(begins.unionByName(jobs_at), ["rel_path"], ["pos", "kind"], F.col("kind") == 1, F.col("kind") == 0, "batch")
    return rows.join(near.select("rel_path", "pos", F.col("nearest").alias("batch")), ["rel_path", "pos"])


def mirrors(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs to ask for, PUT jobs that take the result of the PATCH job of the same file and route)."""
    twin = specs.mirrored(jobs, ["rel_path", "route"], "method", "PATCH", "PUT")
    return jobs.join(twin.select("key", "rel_path").distinct(), ["key", "rel_path"], "left_anti"), twin


def with_mirrors(done: DataFrame, twins: DataFrame) -> DataFrame:
    """done (key, route, method, operation) with the operations of mirrored jobs, copied from their PATCH."""
    source = done.where(F.upper("method") == "PATCH").select("route", "operation")
    copied = twins.select("key", "route", F.upper("method").alias("method")).distinct().join(source, "route").select("key", "route", "method", "operation")
    return done.unionByName(copied.join(done.select("key"), "key", "left_anti"))


def prompts(jobs: DataFrame, blocks: DataFrame, tokens) -> DataFrame:
    """One prompt a batch: its sections, then the file's context blocks (distinct, in order) as far as the budget goes."""
    sections = jobs.groupBy("rel_path", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "section"))), lambda x: x["section"]), "\n\n").alias("body"), F.sum("cost").alias("used"), F.array_sort(F.collect_list("key")).alias("keys"))
    shared = blocks.groupBy("rel_path").agg(s.dedupe_blocks(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"])).alias("blocks"))
    j = sections.join(shared, "rel_path", "left")
    start = F.struct(F.col("used").cast("long").alias("used"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))

    def add(acc, block):
        cost = tokens(block).cast("long") + budget.SEPARATOR
        fits = acc["open"] & (acc["used"] + cost <= budget.EFFECTIVE)
        return F.struct(F.when(fits, acc["used"] + cost).otherwise(acc["used"]).alias("used"), fits.alias("open"), F.when(fits, F.concat(acc["kept"], F.array(block))).otherwise(acc["kept"]).alias("kept"))

    fitted = F.aggregate(F.coalesce("blocks", F.array().cast("array<string>")), start, add)
    return j.withColumn("f", fitted).select("rel_path", "batch", "keys", F.concat_ws("\n\n", "body", F.array_join("f.kept", "\n\n")).alias("prompt"), (F.size(F.coalesce("blocks", F.array().cast("array<string>"))) - F.size("f.kept")).alias("dropped"))


def generate(requests: DataFrame, call: Callable[[str], str], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests (rel_path, batch, keys, prompt) with reply: null where no attempt gave a JSON object with a map of paths. Each prompt is asked once (``model_calls``)."""
    from .model_calls import answered

    return answered(requests, call, wait=wait)


def cleaned(operation):
    """An operation's JSON text with its fields under their present names and without a blank auth tag; others come back as they are.

    Where both names of a field stand, the present one wins; null for what is no JSON object.
    """
    names = F.json_object_keys(operation)
    fields = F.from_json(operation, "map<string,variant>")
    blank = lambda k, v: k.isin(*AUTH_TAGS) & specs.without_blanks(F.array(v.cast("string"))).isNull()
    told = F.arrays_overlap(names, F.array(*(F.lit(x) for x in dict.fromkeys((*specs.LEGACY_FIELDS, *AUTH_TAGS)))))
    new = F.to_json(specs.rename_fields(F.map_filter(fields, lambda k, v: ~F.coalesce(blank(k, v), F.lit(False))), specs.LEGACY_FIELDS))
    return F.when(told, new).when(names.isNotNull(), operation)


def replies(answered: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(operations: key, route, method, operation; keys that failed): replies joined to what was asked, extras ignored.

    A request takes the operation under its own method and route; else one of the same
    shape, parameter names aside, that is nobody's own, the first as the reply has them.
    A prompt with one request takes the reply's first operation, whatever path the
    model wrote it under.
    """
    batch = ["rel_path", "batch"]
    paths = answered.where("reply is not null").select(*batch, F.posexplode(F.from_json(F.get_json_object("reply", "$.paths"), "map<string,string>")).alias("p", "path", "item"))
    ops = paths.select(*batch, "p", "path", F.posexplode(F.from_json("item", "map<string,string>")).alias("v", "verb", "operation")).withColumn("operation", cleaned(F.col("operation")))
    ops = ops.withColumn("at", F.struct("p", "v")).withColumn("route", s.normalize_colon(F.col("path"))).withColumn("method", F.upper("verb"))
    first = specs.first_operation(ops, batch, "at", "verb", "operation").select(*batch, F.col("operation").alias("only"))
    ops = ops.where("operation is not null").groupBy(*batch, "route", "method").agg(F.min(F.struct("at", "operation")).alias("said"))
    asked = jobs.select("key", *batch, "route", F.upper("method").alias("method")).distinct()
    got = asked.join(ops, [*batch, "route", "method"], "left")
    free = ops.join(asked.select(*batch, "route", "method").distinct(), [*batch, "route", "method"], "left_anti")
    shaped = specs.answered(got.where("said is null").drop("said"), free, batch, "route", "method", "said")
    got = got.where("said is not null").unionByName(shaped)
    one = asked.groupBy(*batch).agg(F.count_distinct("key").alias("n")).where("n = 1").join(first, batch).select(*batch, "only")
    got = got.join(one, batch, "left").withColumn("operation", F.coalesce("said.operation", "only"))
    done = got.where("operation is not null").groupBy("key").agg(F.min("route").alias("route"), F.min("method").alias("method"), F.max("operation").alias("operation"))
    return done, joins.supersede(got.select("key").distinct(), done, ["key"])[1]


def merge_run(old: DataFrame, made: DataFrame, removed: DataFrame, failed: DataFrame) -> DataFrame:
    """The operation table after a run: removed keys go, failed ones too (they read as new next time), made ones replace."""
    return merge.upsert(old.join(removed.select("key"), "key", "left_anti"), made, "key", failed)


def coverage(endpoints: DataFrame, made: DataFrame, skipped: DataFrame, failed: DataFrame) -> DataFrame:
    """One row of counts."""
    rows = endpoints.select("key", F.lit("extracted").alias("what")).distinct()
    for name, part in (("generated", made), ("unchanged", skipped), ("failed", failed)):
        rows = rows.unionByName(part.select("key", F.lit(name).alias("what")).distinct())
    return rows.agg(*(F.count_if(F.col("what") == n).alias(n) for n in ("extracted", "generated", "unchanged", "failed")))


def stub(prompt: str) -> str:
    """The model's place in tests and offline runs: the empty answer."""
    return '{"paths": {}}'


def approximate_tokens(text):
    """ceil(characters / 4): a price without a vocabulary."""
    return F.ceil(F.length(text) / 4)
