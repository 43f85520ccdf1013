"""Where imported names come from: modules of Java, Go, Ruby and Python matched to files of the repository by an index of path suffixes.

A dotted name says the end of a path, under a source root that nobody declared.
Each file is indexed once under every suffix of its path, as long as the path is
deep, and a name asks for its prefixes (``a.b.C.Inner`` may be file ``a/b/C``): the longest one
that is indexed counts, then the file with the fewest folders above, then the
first by path. Go turns it round: the end of an import path is a folder's whole
path, the longest one counts. One equi-join each, no probe for each folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins

#: Endings of source files, by language.
ENDINGS = {"java": r"\.java$", "ruby_on_rails": r"\.rb$", "python": r"(?:/__init__)?\.py$"}


def suffixes(files: DataFrame) -> DataFrame:
    """files (repo, rel_path, language) -> (name, language, rel_path, above): repo and every suffix of the path without its ending, and how many folders stand above the suffix."""
    bare = F.col("rel_path")
    for language, ending in ENDINGS.items():
        bare = F.when(F.col("language") == language, F.regexp_replace("rel_path", ending, "")).otherwise(bare)
    parts = F.split(bare, "/")
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct((i - 1).alias("above"), F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("end")))
    return files.where(F.col("language").isin(*ENDINGS)).select("repo", "language", "rel_path", F.explode(cut).alias("s")).select(F.concat_ws("/", "repo", "s.end").alias("name"), "language", "rel_path", "s.above")


def folders(files: DataFrame) -> DataFrame:
    """Folders of Go files: (name, rel_path, folder): repo and the folder's parts in reverse; rel_path is its first file."""
    go = files.where("language = 'golang'").withColumn("folder", F.regexp_replace("rel_path", "/?[^/]*$", "")).where("folder <> ''")
    return go.groupBy("repo", "folder").agg(F.min("rel_path").alias("rel_path")).select(F.concat_ws("/", F.col("repo"), F.array_join(F.reverse(F.split("folder", "/")), "/")).alias("name"), "rel_path", "folder")


def _parts(module: Column, language: Column, file: Column) -> Column:
    """What to look for, without the repository: a name's parts from its front, a Go path's from its end; a relative name as a whole path."""
    folder = F.slice(F.split(file, "/"), 1, F.size(F.split(file, "/")) - 1)
    dotted = F.split(F.regexp_replace(module, r"\.\*$", ""), r"\.")
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    up = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - dots + 1, F.lit(0)))
    below = F.filter(F.concat(up, F.split(F.regexp_replace(module, r"^\.+", ""), r"\.")), lambda x: x != "")
    python = F.when(dots > 0, below).otherwise(dotted)
    ruby = F.filter(F.split(F.regexp_replace(module, r"\.rb$", ""), "/"), lambda x: ~x.isin("", "."))
    return F.when(language == "java", dotted).when(language == "python", python).when(language == "ruby_on_rails", ruby).when(language == "golang", F.reverse(F.split(module, "/")))


def origins(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (repo, rel_path, language, module) -> the same with origin (a file; of a Go package its first) and length, how many parts of the name say so; those that lead nowhere in the repository are left out.

    Ruby's names are whole: a prefix of them is another file.
    """
    key = F.concat_ws("\x00", "repo", "rel_path", "language", "module")
    rows = imports.select("repo", "rel_path", "language", "module").distinct().withColumn("id", key).withColumn("_parts", _parts(F.col("module"), F.col("language"), F.col("rel_path"))).where("_parts is not null and size(_parts) > 0")
    rows = rows.withColumn("parts", F.concat(F.array("repo"), "_parts")).drop("_parts")
    ends = suffixes(files)
    found = None
    for language in (*ENDINGS, "golang"):
        mine = rows.where(F.col("language") == language)
        known = folders(files) if language == "golang" else ends.where(F.col("language") == language)
        hit = joins.longest_prefix(mine, "id", "parts", "/", known, "name")
        above = F.lit(0) if language == "golang" else F.col("above")
        # Of equal suffixes the least deep file; first for each name, so that a common name meets one row.
        best = known.groupBy("name").agg(F.min_by("rel_path", F.struct(above.alias("above"), "rel_path")).alias("origin"))
        part = hit.join(best, "name").select("id", "origin", F.col("length") - 1)
        found = part if found is None else found.unionByName(part)
    found = found.toDF("id", "origin", "length")
    out = rows.join(found, "id").where((F.col("language") != "ruby_on_rails") | (F.col("length") == F.size("parts") - 1))
    return out.select("repo", "rel_path", "language", "module", "origin", F.col("length").cast("int").alias("length"))
