"""The endpoint state kept up to date from a stream of commits' extractions: one merge per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedupe


STATE = "key string, seq long, operation string"


def _committed(spark, state_path: str) -> list[int]:
    """Numbers of the batches whose folder is whole: Spark's own mark is written last."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(state_path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return []
    names = [f.getPath().getName().removeprefix("v=") for f in fs.listStatus(jpath)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/v={n}/_SUCCESS")))


def merge_batch(state_path: str):
    """foreachBatch function: batch (key, seq, operation; a null operation removes) into parquet state folders numbered by batch.

    The highest seq of a key wins, in whichever batch it comes, and of equal ones
    the later batch. What is removed stays in the state as a row without an
    operation, so a late row with a lower seq does not bring it back. A batch that
    is replayed starts from the same whole folder and writes its own again;
    readers take the highest folder that is whole.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = max((n for n in _committed(spark, state_path) if n < number), default=None)
        new = batch.select("key", F.col("seq").cast("long").alias("seq"), "operation", F.lit(1).alias("late"))
        if last is not None:
            new = new.unionByName(spark.read.schema(STATE).parquet(f"{state_path}/v={last}").withColumn("late", F.lit(0)))
        won = dedupe.last_wins(new.withColumn("rank", F.struct("seq", "late")), ["key"], "rank", ["seq", "operation"])
        won.select("key", "seq", "operation").write.mode("overwrite").parquet(f"{state_path}/v={number}")

    return run


def maintain(stream: DataFrame, state_path: str, checkpoint: str):
    return stream.writeStream.foreachBatch(merge_batch(state_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, state_path: str) -> DataFrame:
    """key, operation: the state after the last whole batch; empty before the first."""
    done = _committed(spark, state_path)
    rows = spark.read.schema(STATE).parquet(f"{state_path}/v={done[-1]}") if done else spark.createDataFrame([], STATE)
    return rows.where("operation is not null").select("key", "operation")


def windowed_counts(events: DataFrame, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Tumbling counts by event type with a watermark, on a stream or a table."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
