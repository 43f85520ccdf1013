"""Change detection between runs: dirtiness by one dependency hop, hash skips, escalation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dirty_one_hop(endpoints: DataFrame, dependencies: DataFrame, changed: DataFrame, key: str, file: str) -> DataFrame:
    """Keys whose own file or a file they depend on (no further) is among the changed ones."""
    touched = endpoints.select(key, file).unionByName(dependencies.select(key, file))
    return touched.join(changed.select(file).distinct(), file, "left_semi").select(key).distinct()


def must_regenerate(dirty: DataFrame, total: DataFrame) -> DataFrame:
    """One row: numbers of keys, and whether more than half are dirty."""
    d, t = dirty.agg(F.count("*").alias("dirty")), total.agg(F.count("*").alias("total"))
    return d.join(F.broadcast(t)).select("dirty", "total", (2 * F.col("dirty") > F.col("total")).alias("full"))  # one row by one row


def same_hashes(jobs: DataFrame, stored: DataFrame, key: str, hash_: str) -> DataFrame:
    """Keys whose context hashes all equal the stored one, with the number of their jobs."""
    both = jobs.join(stored.select(key, F.col(hash_).alias("_stored")), key)
    same = both.groupBy(key).agg(F.count("*").alias("jobs"), F.bool_and(F.coalesce(F.col(hash_) == F.col("_stored"), F.lit(False))).alias("_same"))
    return same.where("_same").select(key, "jobs")


def unchanged(jobs: DataFrame, stored: DataFrame, key: str, hash_: str, single_only: bool) -> DataFrame:
    """Keys whose context hashes all equal the stored one; with ``single_only``, of one job at most."""
    same = same_hashes(jobs, stored, key, hash_)
    return (same.where("jobs = 1") if single_only else same).select(key)


def missing_paths(indexed: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Indexed paths that no longer exist."""
    return indexed.select(path).distinct().join(files.select(path).distinct(), path, "left_anti")


def ordered_hash(df: DataFrame, keys: list[str], part, name: str) -> DataFrame:
    """Per key sha256 of its parts in sorted order, one after the other."""
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), ""), 256).alias(name))


def cache_misses(current: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose content is cached, and rows to parse."""
    known = cache.select(*keys).distinct()
    return current.join(known, keys, "left_semi"), current.join(known, keys, "left_anti")
