"""Spark plumbing that the operators share: reading tables, cutting lineage, broadcasting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; where it is unset and all run on this machine, one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="routeloom-")
        where = _own[app]
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._routeloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    path = getattr(df, "_routeloom_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names, in any case: an operator's result takes their place."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in taken)) if taken & {c.lower() for c in df.columns} else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, or what it becomes by leading underscores until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
