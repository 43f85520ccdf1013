"""First-wins, last-wins and variant deduplication.

First and last are aggregates over an explicit position (``min_by``/``max_by``),
so every row is combined before the shuffle and no group is sorted or collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], pos: str, payload: list[str]) -> DataFrame:
    """A row per key with the payload of its lowest position."""
    return df.groupBy(*keys).agg(F.min(F.struct(pos, *payload)).alias("_w")).select(*keys, *(F.col(f"_w.{c}").alias(c) for c in (pos, *payload)))


def last_wins(df: DataFrame, keys: list[str], pos: str, payload: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.struct(pos, *payload)).alias("_w")).select(*keys, *(F.col(f"_w.{c}").alias(c) for c in (pos, *payload)))


def grouped(df: DataFrame, keys: list[str], pos: str, payload: list[str]) -> DataFrame:
    """Per key its rows in order of position. A group is one row, so only for keys whose groups are bounded: an endpoint's or a file's."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, *(c for c in payload if c != pos)))).alias("rows"))


def exact_dedupe(df: DataFrame, text: str, key: str) -> DataFrame:
    """Groups of equal text by sha256: the lowest key and the group's size; null texts take no part."""
    rows = df.where(F.col(text).isNotNull())
    return rows.groupBy(F.sha2(text, 256).alias("text_hash")).agg(F.min(key).alias("keeper"), F.count("*").alias("copies"))


def merge_variants(df: DataFrame, key: str, signature: str, pos: str) -> DataFrame:
    """Per key its distinct signatures in order of first appearance; the first is the row itself, the rest variants."""
    once = df.groupBy(key, signature).agg(F.min(pos).alias("_p"))
    parts = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", signature))).alias("_v"))
    names = F.transform("_v", lambda x: x[signature])
    return parts.select(key, names[0].alias("signature"), F.slice(names, 2, 1 << 30).alias("variants"))


def canonical_union(df: DataFrame, raw: str, canonical, sub: str, pos: str, payload: str) -> DataFrame:
    """Union of spellings by canonical key: a row already spelt so wins, then the lowest position."""
    rows = df.withColumn("_k", canonical).withColumn("_legacy", (F.col(raw) != F.col("_k")).cast("int"))
    won = rows.groupBy("_k", sub).agg(F.min(F.struct("_legacy", pos, payload)).alias("_w"), F.count("*").alias("spellings"))
    return won.select(F.col("_k").alias("canonical"), sub, F.col(f"_w.{payload}").alias(payload), F.col("_w._legacy").alias("legacy"), "spellings")


def conflict_winner(df: DataFrame, key: list[str], order: str, owner: str) -> DataFrame:
    """Per key the row of lowest order wins; owners other than the winner's are the conflict."""
    won = df.groupBy(*key).agg(F.min(F.struct(order, owner)).alias("_w"), F.collect_set(owner).alias("_o"))
    lost = F.array_except("_o", F.array(F.col(f"_w.{owner}")))
    return won.select(*key, F.col(f"_w.{order}").alias("won_by"), F.col(f"_w.{owner}").alias("winner"), F.size(lost).alias("losers"))
