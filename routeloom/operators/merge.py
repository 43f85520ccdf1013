"""Set differences and keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Every key of either side as removed, added or kept: one aggregation over the union, no join."""
    both = old.select(key, F.lit(1).alias("_o"), F.lit(0).alias("_n")).unionByName(new.select(key, F.lit(0).alias("_o"), F.lit(1).alias("_n")))
    got = both.groupBy(key).agg(F.max("_o").alias("_o"), F.max("_n").alias("_n"))
    return got.select(key, F.when((F.col("_o") == 1) & (F.col("_n") == 1), "kept").when(F.col("_o") == 1, "removed").otherwise("added").alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str, failed: DataFrame) -> DataFrame:
    """old without what failed or was made anew, and what was made anew and did not fail."""
    bad = failed.select(key).distinct()
    gone = bad.unionByName(new.select(key)).distinct()
    return old.join(gone, key, "left_anti").unionByName(new.join(bad, key, "left_anti"))


def replace_sourced(current: DataFrame, rebuilt: DataFrame, sourced: Column) -> DataFrame:
    """Delete the rows that ``sourced`` marks, then add the rebuilt ones."""
    return current.where(~F.coalesce(sourced, F.lit(False))).unionByName(rebuilt)


def remove_keys(rows: DataFrame, removed: DataFrame, path: str, verb: str) -> DataFrame:
    """Without removed (path, verb); a removed verb UNKNOWN takes the whole path."""
    whole = removed.where(F.upper(verb) == "UNKNOWN").select(path).distinct()
    one = removed.where(F.upper(verb) != "UNKNOWN").select(path, F.lower(verb).alias(verb)).distinct()
    return rows.join(whole, path, "left_anti").join(one, [path, verb], "left_anti")


def union_paths(parts: list[DataFrame]) -> DataFrame:
    """Every path of several one-column tables, once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def action_algebra(base: Column, only: Column, excluded: Column) -> Column:
    """base, cut to ``only`` where given, without ``excluded``."""
    return F.array_except(F.when(only.isNull(), base).otherwise(F.array_intersect(base, only)), F.coalesce(excluded, F.array().cast("array<string>")))
