"""What changed between two snapshots of source trees, by digests of folders: only folders that differ are looked into.

A folder's digest is that of all files below it: two sums of hashes of their paths
and contents, and their number, so it adds up in any order, before any shuffle,
and no folder's files are gathered. A table has a row for each file and each
folder, dealt by depth, and two tables are compared level by level: of folders
that differ the children are joined, equal ones are never listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closure import settled, shared_folder

NODES = ["repo", "depth", "parent", "path", "is_folder", "digest"]


def nodes(tree: DataFrame) -> DataFrame:
    """tree (repo, rel_path, content, is_symlink) -> repo, depth, parent, path, is_folder, digest: files, folders and the root ('', of depth 0)."""
    said = F.sha2(F.concat(F.when(F.col("is_symlink"), F.lit("link:")).otherwise(F.lit("file:")).cast("binary"), F.coalesce("content", F.lit("").cast("binary"))), 256)
    files = tree.select("repo", F.col("rel_path").alias("path"), said.alias("digest"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    whole = lambda salt: F.xxhash64(F.lit(salt), "path", "digest").cast("decimal(20,0)")
    folders = files.withColumn("folder", F.explode(above)).groupBy("repo", F.col("folder").alias("path")).agg(F.concat_ws(":", F.sum(whole(1)).cast("string"), F.sum(whole(2)).cast("string"), F.count("*").cast("string")).alias("digest"))
    every = files.withColumn("is_folder", F.lit(False)).unionByName(folders.withColumn("is_folder", F.lit(True)))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    return every.withColumn("depth", depth).withColumn("parent", F.when(F.col("depth") > 0, F.regexp_replace("path", "/?[^/]*$", ""))).select(*NODES)


def stored(tree: DataFrame, path: str | None = None) -> DataFrame:
    """nodes of a tree as a table dealt by depth, at ``path`` or in the shared folder."""
    import uuid

    spark = tree.sparkSession
    path = path or f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    rows = nodes(tree)
    rows.repartition("depth", "repo", "parent").write.partitionBy("depth").parquet(path)
    return spark.read.parquet(path).select(*NODES)


def changed(old: DataFrame, new: DataFrame, most: int = 256) -> DataFrame:
    """Two tables of nodes -> repo, rel_path, status (added, removed, changed) of files. A path that was a file and is a folder now is removed, and its files are added."""
    out, front = None, None
    key = ["repo", "path", "is_folder"]
    for depth in range(most):
        sides = []
        for name, table in (("before", old), ("after", new)):
            rows = table.where(F.col("depth") == depth)
            rows = rows if front is None else rows.join(front.withColumnRenamed("path", "parent"), ["repo", "parent"], "left_semi")
            sides.append(rows.select(*key, F.col("digest").alias(name)))
        differ = settled(sides[0].join(sides[1], key, "full").where(~F.col("before").eqNullSafe(F.col("after"))))
        status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
        files = differ.where("not is_folder").select("repo", F.col("path").alias("rel_path"), status.alias("status"))
        out = files if out is None else out.unionByName(files)
        front = differ.where("is_folder").select("repo", "path")
        if front.isEmpty():
            return out
    raise RecursionError(f"folders deeper than {most}")
