"""Paths led through the links of a tree, as the file system would: the first link of a path is replaced by its target, and the result is looked up again.

Each round joins the prefixes of all open paths with the links once and rewrites
the shortest one that is a link. A path that leaves the repository on the way has
escaped, one that is rewritten more than ``most`` times runs in circles (the
number that systems use).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators.closure import forget, settled

MOST = 40


def _prefixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def real_paths(paths: DataFrame, links: DataFrame, most: int = MOST) -> DataFrame:
    """paths (repo, path), links (repo, rel_path, target) -> repo, path, real, error: ``escaped`` or ``cycle`` (real null). Paths are as they are inside the repository, without dots."""
    known = settled(links.groupBy("repo", F.col("rel_path").alias("link")).agg(F.min("target").alias("target")))
    ended, open_ = None, settled(paths.select("repo", "path").distinct().withColumn("now", F.col("path")))
    for _ in range(most + 1):
        tried = open_.select("*", F.posexplode(_prefixes(F.col("now"))).alias("n", "link"))
        hit = tried.join(known, ["repo", "link"]).groupBy("repo", "path").agg(F.min_by(F.struct("link", "target"), "n").alias("l"))
        step = open_.join(hit, ["repo", "path"], "left")
        rest = F.substring("now", F.length("l.link") + 1, F.length("now"))
        folder = F.regexp_replace("l.link", "/?[^/]*$", "")
        # A target is read from the folder of its link, then the rest of the path follows.
        moved = settled(step.select("repo", "path", "now", F.col("l").isNull().alias("done"), F.when(F.col("l").isNotNull(), s.contained(folder, F.concat(F.regexp_replace("l.target", "/+$", ""), rest))).alias("next")))
        done = moved.where("done").select("repo", "path", F.col("now").alias("real"), F.lit(None).cast("string").alias("error"))
        out = moved.where("not done and next is null").select("repo", "path", F.lit(None).cast("string").alias("real"), F.lit("escaped").alias("error"))
        part = done.unionByName(out)
        ended = part if ended is None else ended.unionByName(part)
        forget(open_)
        open_ = settled(moved.where("not done and next is not null").select("repo", "path", F.col("next").alias("now")))
        if open_.isEmpty():
            return ended
    return ended.unionByName(open_.select("repo", "path", F.lit(None).cast("string").alias("real"), F.lit("cycle").alias("error")))
