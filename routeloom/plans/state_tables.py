"""State between runs as parquet tables: operations, index and parse cache, each read, migrated, replaced and stamped.

A table is written beside the old one and its name switched in a pointer file,
so a run that fails leaves the state of the last one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import dedupe, merge, specs, state
from ..operators.closure import settled

INDEX = "key string, rel_path string, imports array<struct<rel_path:string,name:string,start_line:int,end_line:int>>, context_hash string"
OPERATIONS = "key string, route string, method string, operation string"
CACHE = "rel_path string, hash string, facts string"
# Information fields that older runs wrote under other names.
LEGACY_INFO = {"generated_at": "x-generated-at", "commit_reference": "x-commit-reference", "github_repo_url": "x-github-repo-url"}


def _pointer(spark: SparkSession, root: str, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}.current")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def read(spark: SparkSession, root: str, name: str, kind: str) -> DataFrame | None:
    """The table as the last run left it; None before the first run or where it cannot be read."""
    store, path = _pointer(spark, root, name)
    if not store.exists(path):
        return None
    version = spark.read.text(path.toString()).first()
    try:
        return spark.read.schema(kind).parquet(f"{root.rstrip('/')}/{name}-{version[0]}") if version else None
    except Exception:  # a state that cannot be read means a full run, not a failed one
        return None


def write(df: DataFrame, root: str, name: str, kind: str) -> None:
    """Replace the table: written whole first, then pointed to."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    columns = [c.split()[0] for c in _split(kind)]
    df.select(*columns).write.parquet(f"{root.rstrip('/')}/{name}-{version}")
    store, path = _pointer(spark, root, name)
    out = store.create(path, True)
    out.write(bytearray(version.encode()))
    out.close()
    # The version before stays for its readers; older ones go.
    versions = [x for x in store.listStatus(path.getParent()) if x.getPath().getName().startswith(f"{name}-")]
    for old in sorted(versions, key=lambda x: x.getModificationTime())[:-2]:
        if not old.getPath().getName().endswith(version):
            store.delete(old.getPath(), True)


def _split(kind: str) -> list[str]:
    out, depth = [""], 0
    for c in kind:
        depth += (c == "<") - (c == ">")
        out[-1:] = [out[-1] + c] if c != "," or depth else [out[-1], ""]
    return [x.strip() for x in out]


def _canonical(rows: DataFrame, normalise, current: DataFrame | None) -> DataFrame:
    """rows (key) with method, route and the canonical route; keys that this run has are canonical as they stand."""
    rows = rows.withColumn("_m", F.upper(s.split_key(F.col("key"))["method"])).withColumn("_r", s.split_key(F.col("key"))["route"]).withColumn("_c", normalise(F.col("_r")))
    if current is None:
        return rows
    now = current.select("key").distinct().withColumn("_now", F.lit(True))
    return rows.join(now, "key", "left").withColumn("_c", F.when(F.col("_now"), F.col("_r")).otherwise(F.col("_c"))).drop("_now")


def migrate(operations: DataFrame, normalise, current: DataFrame | None = None) -> DataFrame:
    """Stored operations under canonical keys and with their fields under present names: a spelling that is canonical already wins, then the first by key."""
    from .incremental import cleaned

    rows = _canonical(operations, normalise, current).withColumn("operation", F.coalesce(cleaned(F.col("operation")), "operation"))
    kept = dedupe.canonical_union(rows, "_r", F.col("_c"), "_m", "key", "operation")
    return kept.select(s.endpoint_key(F.col("_m"), F.col("canonical")).alias("key"), F.col("canonical").alias("route"), F.col("_m").alias("method"), "operation")


def migrate_index(index: DataFrame, normalise, current: DataFrame | None = None) -> DataFrame:
    """The index likewise, a row for each key and file."""
    rows = _canonical(index, normalise, current).withColumn("_s", F.struct("_m", "rel_path")).withColumn("_p", F.struct("imports", "context_hash"))
    kept = dedupe.canonical_union(rows, "_r", F.col("_c"), "_s", "key", "_p")
    return kept.select(s.endpoint_key(F.col("_s._m"), F.col("canonical")).alias("key"), "_s.rel_path", "_p.imports", "_p.context_hash")


def build_index(endpoints: DataFrame, imports: DataFrame) -> DataFrame:
    """endpoints (key, pos, rel_path, context_hash), imports (key, rel_path, import_path, name, start_line, end_line) -> INDEX, a row per key and file.

    Imports of a file are distinct; a key's context hash is the last one that is not null, in order of pos.
    """
    hashes = endpoints.where("context_hash is not null").groupBy("key").agg(F.max_by("context_hash", "pos").alias("context_hash"))
    files = endpoints.where("rel_path is not null").select("key", "rel_path").distinct()
    edges = imports.where("name is not null and start_line is not null and end_line is not null").groupBy("key", "rel_path").agg(F.array_sort(F.collect_set(F.struct(F.col("import_path").alias("rel_path"), "name", "start_line", "end_line"))).alias("imports"))
    none = F.expr("cast(array() as array<struct<rel_path:string,name:string,start_line:int,end_line:int>>)")
    return files.join(edges, ["key", "rel_path"], "left").join(hashes, "key", "left").select("key", "rel_path", F.coalesce("imports", none).alias("imports"), "context_hash")


def dependencies(index: DataFrame) -> DataFrame:
    """key, rel_path: the files that an index says a key depends on besides its own."""
    return index.select("key", F.explode("imports.rel_path").alias("rel_path")).distinct()


def cached_facts(files: DataFrame, cache: DataFrame | None, parse, hash_: Column) -> tuple[DataFrame, DataFrame]:
    """files (rel_path, text) -> facts of all of them, parsed only where path and hash are not cached, and the cache to store: what is alive."""
    now = files.withColumn("hash", hash_)
    if cache is None:
        fresh = parse(now)
        return fresh, fresh
    known, missing = state.cache_misses(now, cache, ["rel_path", "hash"])
    alive = cache.join(known.select("rel_path", "hash"), ["rel_path", "hash"], "left_semi").unionByName(parse(missing))
    return alive, alive


def run(spark: SparkSession, root: str, endpoints: DataFrame, imports: DataFrame, changed: DataFrame | None, generate) -> dict:
    """One incremental run: diff, dirty, skip or escalate, generate, merge, store. generate(keys) -> operations (key, route, method, operation).

    Returns mode and the tables made, failed and operations.
    """
    from .incremental import merge_run, plan

    stored, index = read(spark, root, "operations", OPERATIONS), read(spark, root, "index", INDEX)
    if stored is not None and index is not None:
        # What older runs wrote with other spellings of a route is the same endpoint, not one gone and one new.
        stored, index = settled(migrate(stored, s.normalize_colon, endpoints)), settled(migrate_index(index, s.normalize_colon, endpoints))
    step = {"mode": "full"} if stored is None or index is None else plan(endpoints, index.select("key", "rel_path", "context_hash"), dependencies(index), changed)
    every = endpoints.select("key").distinct()
    if step["mode"] == "fast":
        return {"mode": "fast", "operations": stored}
    asked = every if step["mode"] == "full" else step["dirty"]
    # Written once: what is stored, returned and counted as failed is the same answer.
    asked = settled(asked)
    made = settled(generate(asked))
    failed = settled(asked.join(made.select("key"), "key", "left_anti"))
    check_generated(asked, made)
    operations = made if step["mode"] == "full" else merge_run(stored, made, step["removed"], failed)
    fresh = build_index(endpoints.join(failed, "key", "left_anti"), imports)
    write(operations, root, "operations", OPERATIONS)
    write(fresh, root, "index", INDEX)
    return {"mode": step["mode"], "made": made, "failed": failed, "operations": read(spark, root, "operations", OPERATIONS)}


def check_generated(asked: DataFrame, made: DataFrame) -> None:
    """A run that asked for operations and got none is an error, not an empty specification."""
    if made.isEmpty() and not asked.isEmpty():
        raise RuntimeError("no operation was generated")
