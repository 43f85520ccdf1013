"""Source context of endpoints: calls and imports resolved to definitions, definitions to text, text cut to token budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins

# Which kind of definition an imported name means first, and what marks a cut text.
KINDS = ("class", "type", "module", "function", "variable")
MARKER = "\n... truncated"


def lines(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, both included) of a text; '' where there are none."""
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(F.split(text, "\n", -1), first, F.greatest(end - first + 1, F.lit(0))), "\n")


def truncate(text: Column, most: int, tokens: Callable[[Column], Column], marker: str = MARKER, longest: int = 30) -> Column:
    """The longest prefix of at most ``most`` tokens and the marker; the text itself if it has no more.

    ``tokens`` prices a text (more text, no fewer tokens); the place is found by
    bisection in at most ``longest`` steps, for texts of up to 2**longest characters.
    """
    start = F.struct(F.lit(0).alias("low"), F.length(text).alias("high"))

    def step(state, _):
        middle = F.ceil((state["low"] + state["high"]) / 2).cast("int")
        fits = tokens(F.substring(text, 1, middle)) <= most
        return F.struct(F.when(fits, middle).otherwise(state["low"]).alias("low"), F.when(fits, state["high"]).otherwise(F.greatest(middle - 1, state["low"])).alias("high"))

    cut = F.aggregate(F.sequence(F.lit(1), F.lit(longest)), start, step)["low"]
    return F.when(text.isNull() | (tokens(text) <= most), text).otherwise(F.concat(F.substring(text, 1, cut), F.lit(marker)))


def imported_definitions(imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """imports (key, pos, rel_path, name), definitions (rel_path, name, kind, start_line, end_line) -> imports with kind and lines.

    Of several definitions of a name in the file, the kind that stands first in
    ``KINDS`` counts, then the first in the source; an import without one is left out.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)), F.lit(len(KINDS) + 1))
    found = joins.ranked_lookup(imports, "key", definitions, ["rel_path", "name"], [rank, F.col("start_line")], ["kind", "start_line", "end_line"])
    return found.where("start_line is not null")


def called_definitions(handlers: DataFrame, calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """handlers (key, rel_path, start, end), calls (rel_path, name, start, end), definitions as above -> key, rel_path, name and lines of what each handler calls in its own file.

    Calls lie inside the handler; of definitions with one name the last in the
    source counts; a handler is no context of its own.
    """
    inside = joins.contained(calls, handlers, ["rel_path"], "start", "end").select(F.col("o.key").alias("key"), F.col("i.rel_path").alias("rel_path"), F.col("i.name").alias("name"), F.col("o.start").alias("_own")).distinct()
    last = definitions.groupBy("rel_path", "name").agg(F.max(F.struct("start_line", "end_line")).alias("_d")).select("rel_path", "name", "_d.start_line", "_d.end_line")
    return inside.join(last, ["rel_path", "name"]).where(F.col("start_line") != F.col("_own")).drop("_own")


def blocks(spans: DataFrame, files: DataFrame) -> DataFrame:
    """spans (key, pos, rel_path, start_line, end_line), files (rel_path, text) -> key, blocks: each key's texts in order, blank and repeated ones once dropped.

    A file's distinct spans are gathered first, so its text meets one row, not one for each endpoint.
    """
    wanted = spans.groupBy("rel_path").agg(F.collect_set(F.struct("start_line", "end_line")).alias("_s"))
    cut = files.join(wanted, "rel_path").select("rel_path", F.explode(F.transform("_s", lambda x: F.struct(x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), lines(F.col("text"), x["start_line"], x["end_line"]).alias("block")))).alias("x"))
    found = spans.join(cut.select("rel_path", "x.*"), ["rel_path", "start_line", "end_line"])
    kept = found.where(F.col("block").rlike(r"\S")).groupBy("key", "block").agg(F.min("pos").alias("pos"))
    return kept.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]).alias("blocks"))


def assemble(handlers: DataFrame, calls: DataFrame, definitions: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """The context of each handler: what it calls in its own file, then what it imports: key, blocks."""
    own = called_definitions(handlers, calls, definitions).select("key", F.struct(F.lit(0), "start_line").alias("pos"), "rel_path", "start_line", "end_line")
    far = imported_definitions(imports, definitions).select("key", F.struct(F.lit(1), "pos").alias("pos"), "rel_path", "start_line", "end_line")
    return blocks(own.select("key", F.col("pos").cast("struct<a:int,b:int>").alias("pos"), "rel_path", "start_line", "end_line").unionByName(far.select("key", F.col("pos").cast("struct<a:int,b:int>").alias("pos"), "rel_path", "start_line", "end_line")), files)
