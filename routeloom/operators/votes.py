"""Votes and intersections over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def strict_majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys where one value has more than half of the rows, and that value."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("votes"))
    top = counts.groupBy(key).agg(F.max(F.struct("votes", value)).alias("_t"), F.sum("votes").alias("total"))
    return top.where(2 * F.col("_t.votes") > F.col("total")).select(key, F.col(f"_t.{value}").alias("winner"), F.col("_t.votes").alias("votes"), "total")


def plurality(df: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value of each key; null where several tie."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("votes"))
    top = counts.groupBy(key).agg(F.max("votes").alias("votes"))
    tied = counts.join(top, [key, "votes"]).groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias("_v"))
    return tied.select(key, F.when(F.col("_n") == 1, F.col("_v")).alias("winner"))


def poisoned_intersection(df: DataFrame, key: str, member: str, value: str, rows_per_task: int = 1 << 20) -> DataFrame:
    """Per key the values that every member has; null if any value of the key is null (unreadable).

    A task takes about ``rows_per_task`` rows, so what it holds does not grow with the table.
    """
    df = df.select(key, member, value)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows_per_task + 1)
    # One exchange by key and member serves both the distinct rows and the mark on one row of each member.
    rows = df.repartition(tasks, key, member).dropDuplicates([key, member, value])
    one = F.row_number().over(Window.partitionBy(key, member).orderBy(value)) == 1
    pairs = rows.withColumn("_one", one.cast("int")).repartition(tasks, key, value).groupBy(key, value).agg(F.count("*").alias("_m"), F.sum("_one").alias("_t"))
    got = pairs.repartition(tasks, key).groupBy(key).agg(F.collect_list(F.struct(F.col("_m").alias("m"), F.col(value).alias("v"))).alias("_s"), F.sum("_t").alias("_t"), F.bool_or(F.col(value).isNull()).alias("_p"))
    common = F.array_sort(F.transform(F.filter("_s", lambda x: x["m"] == F.col("_t")), lambda x: x["v"]))
    return got.select(key, F.when(F.col("_p"), None).otherwise(F.array_join(common, ",")).alias("common"))
