"""Operator 12: mixing sources to target weights.

The words of each source are summed; the mix shall have ``share`` times all
words, dealt to the sources by weight, but none takes more than ``most`` times
its own words. The targets are where the rising level stops: with a level L, a
source's target is the lesser of its limit and weight * L, and L is such that
the targets add up. L is found in rounds, each one aggregate over the table of
sources: what the full ones cannot take goes to the others by weight until none
is above its limit. A source's repetition rate is target / words, and each of
its documents comes floor(rate) times, and once more where a hash of the seed,
its id and its text falls below the fraction.

The hash alone decides, so reruns, retries and other partitionings agree.
Nothing is shuffled but one row a source and task, and the rates, one row a
source, meet the documents in their scan: they are broadcast when the table of
sources was measured to be small, and beyond that joined with both sides salted,
so that a source with a third of all rows is dealt over many tasks.

Nulls: a null text has no words, is taken as often as its hash says and adds
nothing; documents without a source are a source of their own, the last one;
null ids are hashed as such. Repeated rows (id and text) are taken alike. An
empty table has no sources and gives no rows. Columns of docs that have the name
of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import forget, table, unused, without, written

#: Weights by rank of the source, repeating; the mix's words in all words; the most of a source's words.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Rates are broadcast up to so many sources and so many bytes of their names.
FEW, SHORT = 500_000, 16 << 20
SALTS = 64
RESULT = ("size", "source_size", "weight", "target", "rate", "copies", "taken")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def ranked(names: DataFrame, column: str) -> DataFrame:
    """names, one row each, with rank from 0 in the order of code points, null last: sorted ranges, numbered by what the ranges before hold."""
    spark = names.sparkSession
    low = F.col(column)
    parts = written(names.repartitionByRange(low.asc_nulls_last()).sortWithinPartitions(low.asc_nulls_last()).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    before, start = 0, []
    for part, n in sorted(parts.groupBy("part").count().collect()):  # one row for each shuffle partition
        start.append((part, before))
        before += n
    begins = spark.createDataFrame(start, "part int, before long")
    return parts.join(F.broadcast(begins), "part").withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")


def by_rank(weights: Sequence[int]):
    return lambda rank: F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (rank % len(weights) + 1).cast("int")).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (source, source_size, weight), all longs but the source, with target double.

    Each round is one aggregate: the sources that the level would fill beyond
    their limit count with their limit. The level only rises, so a full source
    stays full, and it rises while some source becomes full: it is done when the
    number of full ones stays.
    """
    limit, level, full = F.col("source_size") * F.lit(most), 0.0, -1
    while True:
        over = limit <= F.col("weight") * F.lit(level)
        total, capped, free, now = sizes.agg(F.sum("source_size"), F.sum(F.when(over, limit).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if not free or now == full:
            break
        full, level = now, max(level, (share * total - capped) / free)
    return sizes.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(float(level))))


def rates(docs: DataFrame, source: str, size: str, weights: Sequence[int] | DataFrame = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: source, source_size, weight, target, rate. ``weights``: by rank, repeating, or a table (source, weight); sources that the table lacks weigh nothing."""
    sums = written(docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size")), "sizes")
    if isinstance(weights, DataFrame):
        given = weights.groupBy(F.col("source").alias("other")).agg(F.max("weight").cast("long").alias("weight"))
        weighed = sums.join(given, F.col("source").eqNullSafe(F.col("other")), "left").drop("other").fillna(0, ["weight"])
    else:
        weighed = ranked(sums, "source").withColumn("weight", by_rank(weights)(F.col("rank"))).drop("rank")
    sizes = written(weighed, "weights")
    forget(sums)
    return targets(sizes, share, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def chance(seed: int, doc_id: str, text: str) -> Column:
    """A number in [0, 1) that the row decides: the first 52 bits of a digest of seed, id and text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_rates(docs: DataFrame, source: str, found: DataFrame) -> DataFrame:
    """docs with the columns of their source's row; no row is moved while the table of sources is small."""
    other = unused(docs, "other_source")
    found = found.withColumnRenamed("source", other)
    n, length = found.agg(F.count("*"), F.sum(F.octet_length(other))).first()
    if n <= FEW and (length or 0) <= SHORT:
        return docs.join(F.broadcast(found), F.col(source).eqNullSafe(F.col(other)), "left").drop(other)
    salt, key = unused(docs, "salt"), unused(docs, "source_key")
    dealt = docs.withColumn(salt, F.pmod(F.xxhash64(*(c for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType))), F.lit(SALTS)))
    copies = found.withColumn(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, (F.col(salt) == F.col(key)) & F.col(source).eqNullSafe(F.col(other)), "left").drop(other, salt, key)


def copies(docs: DataFrame, weights: Sequence[int] | DataFrame = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """docs, all columns, with size, source_size, weight, target, rate, copies (how often the mix takes the document) and taken, its words in the mix."""
    docs = without(docs, *RESULT).withColumn("size", words(F.col("text")))
    found = rates(docs.select(F.col("source").alias("source"), "size"), "source", "size", weights, share, most)
    out = with_rates(docs, "source", found)
    whole = F.floor("rate")
    out = out.withColumn("copies", (whole + F.when(chance(seed, "doc_id", "text") < F.col("rate") - whole, 1).otherwise(0)).cast("int"))
    return out.withColumn("taken", F.col("size") * F.col("copies")).select(*(c for c in docs.columns if c != "size"), *RESULT)


def mix(docs: DataFrame, weights: Sequence[int] | DataFrame = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """The mix itself: each document as often as it is taken, with copy, from 1. Replaces a column of that name."""
    docs = without(docs, "copy")
    out = copies(docs, weights, share, most, seed).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop(*RESULT)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "source", "text")
    return copies(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "weight")


#: The level in closed form: with sources by limit / weight, it is the highest of what each number of full ones would give.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM s),
r AS (SELECT *, sum(2 * source_size) OVER o AS capped, sum(weight) OVER o AS gone, sum(weight) OVER () AS all_weight, sum(source_size) OVER () AS total FROM w
      WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max(level) AS level FROM (SELECT (1.5::DOUBLE * total - capped) / (all_weight - gone) AS level FROM r WHERE all_weight > gone UNION ALL SELECT 1.5::DOUBLE * total / all_weight FROM r)),
t AS (SELECT source, source_size, weight, least((2 * source_size)::DOUBLE, weight * level) AS target FROM w, l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('0:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || md5(d.body)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS chance
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies FROM c)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, weight FROM n
"""
