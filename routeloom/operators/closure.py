"""Closures over edge tables: breadth-first loops of joins against what was seen.

Each round joins the frontier only and drops what was visited. Rounds are written
to the checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_own: dict[str, str] = {}


def shared_folder(spark) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and all run on this machine, one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="routeloom-")
        where = _own[app]
    return where.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """df dealt to all cores: rows that are small but long to work on else stand in a few tasks, as bytes alone are weighed."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *key)


def forget(df: DataFrame) -> None:
    """Delete what ``settled`` wrote, once nothing reads it any more."""
    path = getattr(df, "_settled_path", None)
    if path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def transitive(roots: DataFrame, edges: DataFrame, most: int = 128) -> DataFrame:
    """roots (root, node), edges (src, dst) -> (root, node, depth): every node reachable, at its least depth.

    Diamonds are visited once; cycles end by the visited test; beyond ``most``
    rounds it raises. Roots are numbered in their order, and 64 of them share a
    row for each node they reach, a bit each, so what is joined and written is
    up to 64 times less than the pairs; these are made as the result is read.
    """
    # Neighbours in order reach much the same, so numbers follow the order.
    named = settled(roots.select("root").distinct().orderBy("root").withColumn("id", F.monotonically_increasing_id()))
    block = F.expr("id div 64").alias("block")
    names = settled(named.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("id", "root"))).alias("names")))
    pairs = roots.select(F.col("root").alias("_r"), "node")
    bit = F.expr("shiftleft(1L, cast(id % 64 as int))")
    front = settled(pairs.join(named, pairs["_r"].eqNullSafe(named["root"])).groupBy(block, "node").agg(F.bit_or(bit).alias("word")))
    # An edge from what is neither a root's node nor the end of an edge is never gone.
    held = pairs.select("node").unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    edges = settled(edges.select("src", "dst").join(held, edges["src"] == held["node"], "left_semi").distinct())
    seen = _rounds(front, edges, most)
    reached = seen.join(names, "block").select("node", "depth", F.explode(F.filter("names", lambda x: F.bit_get("word", (x["id"] % 64).cast("int")) == 1)).alias("_n"))
    return reached.select(F.col("_n.root").alias("root"), "node", "depth")


def _rounds(front: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """front (block, node, word), edges (src, dst) -> (block, node, word, depth): the bits that come to each node, at their least depths."""
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, most + 2):
        step = front.join(edges, front["node"] == edges["src"]).select("block", F.col("dst").alias("node"), "word", F.lit(0).cast("long").alias("old"))
        both = step.unionByName(seen.select("block", "node", F.lit(0).cast("long").alias("word"), F.col("word").alias("old")))
        met = both.groupBy("block", "node").agg(F.bit_or("word").alias("word"), F.bit_or("old").alias("old"))
        front = settled(met.select("block", "node", F.col("word").bitwiseAND(F.bitwise_not("old")).alias("word")).where("word <> 0"))
        if front.isEmpty():
            break
        if depth > most:
            raise RecursionError(f"deeper than {most}")
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen


#: Sweeps of 64 pivots at most; roots and nodes of a class in a row; pairs that a task makes.
SWEEPS, ROOTS, NODES, TASK_PAIRS = 8, 256, 4096, 1 << 25


def reachable(roots: DataFrame, edges: DataFrame, most: int = 128) -> DataFrame:
    """roots (root, node), edges (src, dst) -> (root, node): the pairs of ``transitive`` without depths, where they are far more than the tables' rows.

    64 nodes of many edges are pivots. A root that reaches a pivot reaches all
    that the pivot does: roots get a word of the pivots they reach, nodes one of
    the pivots that reach them, and a pair whose words share a bit is in the
    result. Such pairs are classes of roots times classes of nodes, crossed only
    as the result is read, by as many tasks as they need. An edge whose ends'
    words share a bit leads to no other pair, so the search goes on over the
    edges that are left: with other pivots while these take an eighth of them
    or more, then root by root.
    """
    pairs = settled(roots.select("root", "node").distinct())
    left = settled(edges.where("src is not null").select("src", "dst").distinct())
    before, sweeps = left.count(), []
    while before and len(sweeps) < SWEEPS:
        try:
            sweep = _sweep(left, most)
        except RecursionError:  # the search root by root tells whether a root's chain is too long
            break
        back, ahead = sweep
        edge = left.join(back, left["src"] == back["node"], "left").drop("node").withColumnRenamed("word", "_b").join(ahead, left["dst"].eqNullSafe(ahead["node"]), "left")
        rest = settled(edge.where("coalesce(_b & word, 0) = 0").select("src", "dst"))
        now = rest.count()
        if now == before:
            break
        sweeps.append(sweep)
        left, before, gain = rest, now, before - now
        if gain * 8 < now + gain:
            break
    if not sweeps:
        return transitive(pairs, left, most).select("root", "node")
    each = range(len(sweeps))
    starts, ends = pairs, None
    for k, (back, ahead) in enumerate(sweeps):
        starts = starts.join(back.withColumnRenamed("word", f"b{k}"), "node", "left")
        own = ahead.select("node", *(F.col("word").alias(f"r{i}") if i == k else F.lit(0).cast("long").alias(f"r{i}") for i in each))
        ends = own if ends is None else ends.unionByName(own)
    starts = settled(starts.groupBy("root").agg(*(F.bit_or(F.coalesce(f"b{k}", F.lit(0))).alias(f"b{k}") for k in each)))
    ends = settled(ends.groupBy("node").agg(*(F.bit_or(f"r{k}").alias(f"r{k}") for k in each)))
    others = transitive(pairs, left, most).select("root", "node")
    meet = " or ".join(f"coalesce(b{k} & r{k}, 0) <> 0" for k in each)
    words = starts.withColumnRenamed("root", "_root")
    others = others.join(words, others["root"].eqNullSafe(words["_root"]))
    words = ends.withColumnRenamed("node", "_node")
    others = others.join(words, others["node"].eqNullSafe(words["_node"]), "left").where(f"not ({meet})").select("root", "node")
    return _crossed(starts, ends, len(sweeps)).unionByName(others)


def _sweep(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(node, word) twice: which of 64 pivots a node reaches, and which of them reach it."""
    degree = edges.groupBy(F.col("src").alias("node")).count().withColumnRenamed("count", "n")
    into = edges.groupBy(F.col("dst").alias("node")).count()
    top = degree.join(into, "node").orderBy(F.desc(F.col("n") * F.col("count")), "node").limit(64)
    pivots = settled(top.agg(F.collect_list("node").alias("all")).select(F.posexplode("all").alias("bit", "node")).select(F.lit(0).cast("long").alias("block"), "node", F.expr("shiftleft(1L, bit)").alias("word")))
    one = lambda e: settled(_rounds(pivots, e, most).groupBy("node").agg(F.bit_or("word").alias("word")))
    return one(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src is not null")), one(edges)


def _crossed(starts: DataFrame, ends: DataFrame, sweeps: int) -> DataFrame:
    """starts (root, b0, b1, ...), ends (node, r0, r1, ...) -> (root, node): every pair of which a b and the r of its number share a bit, once."""
    spark = starts.sparkSession
    b, r = ([f"{x}{k}" for k in range(sweeps)] for x in "br")

    def classes(df, words):
        bits = F.filter(F.sequence(F.lit(0), F.lit(64 * sweeps - 1)), lambda p: F.bit_get(F.get(F.array(*words), F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1)
        # Written first: Spark would else look for bits in every row, not in each class.
        return settled(df.groupBy(*words).count()).withColumn(f"bits_{words[0]}", bits).withColumn("bit", F.explode(f"bits_{words[0]}"))

    def rows(df, value, words, most):
        numbered = df.where(" or ".join(f"{w} <> 0" for w in words)).orderBy(*words, value).withColumn("_id", F.monotonically_increasing_id())
        inside = F.collect_list(F.struct(value))  # a list of the values themselves would lose null
        return numbered.groupBy(*words, F.expr(f"_id div {most}")).agg(inside.alias("_all")).select(*words, F.transform("_all", lambda x: x[value]).alias(f"{value}s"))

    # Pairs of classes meet by each bit that they share; the lowest one counts.
    met = classes(starts, b).withColumnRenamed("count", "_roots").join(classes(ends, r).withColumnRenamed("count", "_nodes"), "bit")
    met = settled(met.where(F.array_min(F.array_intersect("bits_b0", "bits_r0")) == F.col("bit")).select(*b, *r, (F.col("_roots") * F.col("_nodes")).alias("_pairs")))
    total = met.agg(F.sum("_pairs").cast("long")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, min(total // TASK_PAIRS, 20_000))
    both = rows(starts, "root", b, ROOTS).join(met.drop("_pairs"), b).join(settled(rows(ends, "node", r, NODES)), r)

    def run(batches):
        for batch in batches:
            for some, nodes in zip(batch.column("roots"), batch.column("nodes")):
                some, nodes = some.values, nodes.values
                step = max(1, (1 << 16) // len(nodes))
                for i in range(0, len(some), step):
                    part = some.slice(i, step)
                    yield pa.RecordBatch.from_arrays([part.take(pa.array(np.repeat(np.arange(len(part)), len(nodes)))), pa.concat_arrays([nodes] * len(part))], names=["root", "node"])

    # In Arrow, as Spark's explode makes an object of each pair.
    return both.select("roots", "nodes").repartition(tasks).mapInArrow(run, StructType([starts.schema["root"], ends.schema["node"]]))


def chase(start: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Single out-edge chains: start (key, node) -> (key, node, error): where each chain ends; ``cycle`` where it does not.

    Pointer doubling: after k rounds a pointer spans 2^k edges, and rounds stop
    when no pointer moves among nodes that are not known to end. A chain that
    is longer than the table has rows is a cycle, so the number of rounds is
    the logarithm of the table's size, whatever the chains' lengths.
    """
    jump = settled(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    stuck = edges.select(F.col("src").alias("_s")).distinct()
    for _ in range(max(1, min(most_rounds, int(jump.count()).bit_length()))):
        far = jump.select(F.col("a").alias("b"), F.col("b").alias("c"))
        new = settled(jump.join(far, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")))
        forget(jump)
        jump = new.drop("moved")
        jump._settled_path = new._settled_path
        if new.where("moved").isEmpty():
            break
    ends = start.join(jump, start["node"] == jump["a"], "left").select("key", F.coalesce("b", "node").alias("node"))
    return ends.join(stuck, ends["node"] == stuck["_s"], "left").select("key", F.when(F.col("_s").isNull(), F.col("node")).alias("node"), F.when(F.col("_s").isNotNull(), "cycle").alias("error"))


def in_order(roots: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """roots (root, node), edges (src, dst, rank) -> (root, node, place): what is reachable, by the ranks of the edges on the way there.

    Places order as a walk does that takes edges by rank and each one's own before
    the next; a node reached twice has the earlier place. Chains beyond ``most`` raise.
    """
    front = settled(roots.select("root", "node", F.array().cast("array<int>").alias("place"), F.array("node").alias("seen")))
    every = front
    for _ in range(most):
        step = front.join(edges, front["node"] == edges["src"]).where(~F.array_contains("seen", F.col("dst")))
        front = settled(step.select("root", F.col("dst").alias("node"), F.concat("place", F.array(F.col("rank").cast("int"))).alias("place"), F.concat("seen", F.array("dst")).alias("seen")))
        if front.isEmpty():
            return every.groupBy("root", "node").agg(F.min("place").alias("place"))
        every = every.unionByName(front)
    raise RecursionError(f"chains longer than {most}")


def composed(starts: DataFrame, edges: DataFrame, put, most: int = 64) -> DataFrame:
    """starts (node, value), edges (src, dst, value) -> (node, value): every value that some way to the node composes, edge by edge, with ``put(before, step)``.

    A way that would come to a node again ends there, so cycles add nothing; ways
    of more than ``most`` edges raise.
    """
    front = settled(starts.select("node", "value", F.array("node").alias("seen")).distinct())
    every = front
    steps = edges.select("src", "dst", F.col("value").alias("step")).distinct()
    for _ in range(most):
        way = front.join(steps, front["node"] == steps["src"]).where(~F.array_contains("seen", F.col("dst")))
        front = settled(way.select(F.col("dst").alias("node"), put(F.col("value"), F.col("step")).alias("value"), F.concat("seen", F.array("dst")).alias("seen")).distinct())
        if front.isEmpty():
            return every.select("node", "value").distinct()
        every = every.unionByName(front)
    raise RecursionError(f"ways longer than {most}")


def propagate(facts: DataFrame, uses: DataFrame, most: int = 64) -> DataFrame:
    """Macro propagation to a fixpoint: facts (name, value), uses (caller, callee) -> (name, value): a caller takes on its callees' values."""
    roots = facts.select(F.concat_ws("\x00", "name", "value").alias("root"), F.col("name").alias("node"), "value")
    reach = transitive(roots.select("root", "node"), uses.select(F.col("callee").alias("src"), F.col("caller").alias("dst")), most)
    return reach.join(roots.select("root", "value").distinct(), "root").select(F.col("node").alias("name"), "value").distinct()
