"""Model calls as a durable table: each prompt is asked once, whatever is retried, lost or read again.

Replies are keyed by the prompt's digest. A task writes every reply to a journal
in the shared folder before it asks for the next one, so a task that is run again
finds what its last attempt paid for; when all are answered they are appended to
the table of replies, and everything after reads that table. Replies that could
not be used are remembered for their own run only, so the next one asks again.
(Two attempts of one task at the same time would both ask: leave speculation off
for the stage.)
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import settled, shared_folder
from . import incremental as inc

REPLY = "digest string, reply string, run string"
#: Calls at a time.
PARALLEL = 5


def usable(text: str | None) -> str | None:
    """The JSON object of a reply, from its first brace to its last, if it has a map of paths."""
    a, b = (text or "").find("{"), (text or "").rfind("}")
    try:
        doc = json.loads(text[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return None
    return text[a : b + 1] if isinstance(doc, dict) and isinstance(doc.get("paths"), dict) else None


def ask(prompt: str, call: Callable[[str], str], wait: Callable[[float], None]) -> str | None:
    """A usable reply; None once the attempts are spent. Errors of the service are waited out within an attempt."""

    def once():
        for pause in (*inc.WAITS, None):
            try:
                return call(prompt)
            except Exception:  # whatever the client raises, the call has failed
                if pause is None:
                    return None
                wait(pause)

    return next((u for _ in range(inc.RETRIES) if (u := usable(once()))), None)


class Journal:
    """A file for each prompt in a folder that all workers see."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(uri)

    def read(self, digest: str) -> tuple[bool, str | None]:
        from pyarrow import fs

        path = f"{self.folder}/{digest}"
        if self.store.get_file_info(path).type != fs.FileType.File:
            return False, None
        with self.store.open_input_stream(path) as f:
            return True, json.loads(f.read())

    def write(self, digest: str, reply: str | None) -> None:
        """Whole or not at all: written aside, then moved."""
        self.store.create_dir(self.folder, recursive=True)
        aside = f"{self.folder}/{digest}-{uuid.uuid4().hex}"
        with self.store.open_output_stream(aside) as f:
            f.write(json.dumps(reply).encode())
        self.store.move(aside, f"{self.folder}/{digest}")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def replies(spark: SparkSession, root: str) -> DataFrame:
    """The table as far as it has been written."""
    path = f"{root.rstrip('/')}/replies"
    return spark.read.schema(REPLY).parquet(path) if _exists(spark, path) else spark.createDataFrame([], REPLY)


def answered(requests: DataFrame, call: Callable[[str], str], root: str | None = None, run: str | None = None, wait: Callable[[float], None] = time.sleep, parallel: int = PARALLEL) -> DataFrame:
    """requests (with prompt) and reply: null where no attempt gave a usable one. root: where the replies of all runs are kept (a URI)."""
    spark = requests.sparkSession
    root = (root or f"{shared_folder(spark)}/model-{uuid.uuid4().hex}").rstrip("/")
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    run = run or uuid.uuid4().hex
    keyed = requests.drop("reply").withColumn("digest", F.sha2("prompt", 256))
    known = replies(spark, root).where(F.col("reply").isNotNull() | (F.col("run") == run))
    missing = settled(keyed.groupBy("digest").agg(F.min("prompt").alias("prompt")).join(known.select("digest").distinct(), "digest", "left_anti"))
    if not missing.isEmpty():
        journal = f"{root}/journal-{run}"

        def each(parts):
            book = Journal(journal)
            for p in parts:
                out = []
                for digest, prompt in zip(p["digest"], p["prompt"]):
                    done, reply = book.read(digest)
                    if not done:
                        reply = ask(prompt, call, wait)
                        book.write(digest, reply)
                    out.append((digest, reply, run))
                yield pd.DataFrame(out, columns=["digest", "reply", "run"])

        missing.repartition(parallel, "digest").mapInPandas(each, REPLY).write.mode("append").parquet(f"{root}/replies")
        where = spark._jvm.org.apache.hadoop.fs.Path(journal)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    found = replies(spark, root).where(F.col("reply").isNotNull() | (F.col("run") == run)).groupBy("digest").agg(F.min("reply").alias("reply"))
    return keyed.join(found, "digest", "left").drop("digest")


def generated(jobs: DataFrame, blocks: DataFrame, tokens, call: Callable[[str], str], root: str | None = None, run: str | None = None, wait: Callable[[float], None] = time.sleep) -> dict[str, DataFrame]:
    """jobs (key, rel_path, pos, route, method, section) -> made (key, route, method, operation), failed (key, reason), report (one row of counts).

    Batches first; the endpoints of a batch whose reply could not be used are then
    asked for one by one. An endpoint that a usable reply leaves out has failed.
    """
    run = run or uuid.uuid4().hex
    packed = settled(inc.batches(jobs, tokens))
    first = settled(answered(inc.prompts(packed, blocks, tokens), call, root, run, wait))
    done, _ = inc.replies(first, packed)
    bad = first.where("reply is null").select("rel_path", "batch")
    alone = settled(packed.join(bad, ["rel_path", "batch"], "left_semi").withColumn("batch", (-1 - F.col("pos")).cast("long")))
    second = settled(answered(inc.prompts(alone, blocks, tokens), call, root, run, wait)) if not alone.isEmpty() else first.limit(0)
    again, _ = inc.replies(second, alone)
    made = settled(done.unionByName(again).groupBy("key").agg(F.min(F.struct("operation", "route", "method")).alias("w")).select("key", "w.route", "w.method", "w.operation"))
    silent = alone.join(second.where("reply is null").select("rel_path", "batch"), ["rel_path", "batch"], "left_semi").select("key", F.lit("no usable reply").alias("reason"))
    left = packed.select("key").distinct().join(made.select("key"), "key", "left_anti").join(silent.groupBy("key").agg(F.min("reason").alias("reason")), "key", "left")
    failed = settled(left.select("key", F.coalesce("reason", F.lit("left out of the reply")).alias("reason")))
    return {"made": made, "failed": failed, "report": counted({"generated": made, "failed": failed, "asked_alone": alone})}


def counted(parts: dict[str, DataFrame]) -> DataFrame:
    """One row: how many keys each part has."""
    rows = None
    for name, part in parts.items():
        one = part.select("key", F.lit(name).alias("what")).distinct()
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*(F.count_if(F.col("what") == n).alias(n) for n in parts))
