"""Operations of specifications as rows: first operation, legacy fields, re-keying, references onto namespaced components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import VERBS, shape

# Operation fields that older runs and models wrote under other names.
LEGACY_FIELDS = {"api_description": "description", "authorization_tag": "x-authorization-tag", "module_tag": "x-module-tag", "auth_tag": "x-auth-tag", "sensitive_information": "x-sensitive-information"}
_REFERENCE = r'"\$ref"\s*:\s*"([^"]*)"'


def first_operation(items: DataFrame, key: list[str], pos: str, verb: str, body: str) -> DataFrame:
    """Of each key's entries in authored order, the first whose name is a verb and whose body is not null."""
    real = items.where(F.lower(verb).isin(*VERBS) & F.col(body).isNotNull())
    return real.groupBy(*key).agg(F.min(F.struct(pos, F.lower(verb).alias(verb), body)).alias("_o")).select(*key, f"_o.{verb}", f"_o.{body}")


def rename_fields(fields: Column, renames: dict[str, str]) -> Column:
    """A map with legacy names replaced; what already stands under the new name wins. New names must differ."""
    new = F.create_map(*(F.lit(x) for pair in renames.items() for x in pair))
    old = [F.lit(x) for x in renames]
    moved = F.map_filter(fields, lambda k, v: k.isin(*old) & ~F.map_contains_key(fields, F.coalesce(new[k], k)))
    return F.map_concat(F.map_filter(fields, lambda k, v: ~k.isin(*old)), F.transform_keys(moved, lambda k, v: new[k]))


def without_blanks(tags: Column) -> Column:
    """Tags trimmed, blank and null ones dropped; null for none."""
    kept = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(kept) > 0, kept)


def rekey(operations: DataFrame, route: str, verb: str, canonical: Column, pos: str, payload: str) -> DataFrame:
    """Operations by canonical route, wildcards dropped; of those that fall together the last in order stays."""
    rows = operations.where(~F.col(route).isin("/*", "*")).withColumn("_k", canonical)
    last = rows.groupBy("_k", verb).agg(F.max(F.struct(pos, payload)).alias("_l"))
    return last.select(F.col("_k").alias(route), verb, f"_l.{payload}")


def mirrored(operations: DataFrame, by: list[str], verb: str, of: str, to: str) -> DataFrame:
    """Rows of verb ``to`` that repeat the ``of`` row of the same ``by`` values: they take its result and need no request of their own."""
    source = operations.where(F.upper(verb) == of).select(*by).distinct()
    return operations.where(F.upper(verb) == to).join(source, by, "left_semi")


def answered(asked: DataFrame, replies: DataFrame, on: list[str], route: str, method: str, payload: str) -> DataFrame:
    """Requests with the reply to the same method and route (parameter names aside), null where none came; replies to nothing asked fall away.

    Of several replies to one request the first in order of ``payload`` counts.
    """
    keyed = lambda d: d.withColumn("_m", F.upper(method)).withColumn("_r", shape(F.col(route)))
    best = keyed(replies).groupBy(*on, "_m", "_r").agg(F.min(payload).alias(payload))
    return keyed(asked).join(best, [*on, "_m", "_r"], "left").drop("_m", "_r")


def references(doc: Column) -> Column:
    """The distinct targets of ``$ref`` in a JSON text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(doc, F.lit(_REFERENCE), 1))


def rewrite_references(docs: DataFrame, key: str, doc: str, renames: DataFrame) -> DataFrame:
    """docs with the targets of ``$ref`` replaced by renames (key, old, new), all at once; others stay.

    The renames of one specification are gathered to a map beside its document.
    """
    table = renames.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("old", "new"))).alias("_n"))
    joined = docs.join(table, key, "left")
    around = F.split(F.col(doc), _REFERENCE, -1)
    found = F.regexp_extract_all(F.col(doc), F.lit(_REFERENCE), 1)
    new = F.transform(found, lambda r: F.concat(F.lit('"$ref": "'), F.coalesce(F.col("_n")[r], r), F.lit('"')))
    text = F.array_join(F.flatten(F.zip_with(around, F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return joined.withColumn(doc, text).drop("_n")


def namespaced(components: DataFrame, key: str, pointer: str) -> DataFrame:
    """components (key, pointer) -> key, old, new: the name with the key before it, so names of several specifications do not meet."""
    prefix = F.regexp_replace(F.regexp_replace(F.col(key).cast("string"), r"\.[A-Za-z]+$", ""), "[^A-Za-z0-9]+", "_")
    new = F.regexp_replace(F.col(pointer), r"([^/]*)$", "")
    return components.select(key, F.col(pointer).alias("old"), F.concat(new, prefix, F.lit("_"), F.regexp_extract(pointer, r"([^/]*)$", 1)).alias("new"))


def closure_components(operations: DataFrame, components: DataFrame, key: str, doc: str, pointer: str) -> DataFrame:
    """The components that operations of their specification refer to, directly or through one another: key, pointer."""
    from .closure import transitive

    name = lambda k, p: F.concat_ws("\x00", F.col(k).cast("string"), p)
    roots = operations.select(F.col(key).cast("string").alias("root"), F.explode(references(F.col(doc))).alias("_p")).select("root", name("root", F.col("_p")).alias("node"))
    edges = components.select(name(key, F.col(pointer)).alias("src"), F.col(key).cast("string").alias("_k"), F.explode(references(F.col(doc))).alias("_p")).select("src", name("_k", F.col("_p")).alias("dst"))
    reached = transitive(roots, edges).select(F.col("root").alias("_root"), F.get(F.split("node", "\x00"), F.lit(1)).alias("_p"))
    return components.join(reached, (components[key].cast("string") == F.col("_root")) & (components[pointer] == F.col("_p")), "left_semi").select(key, pointer)
