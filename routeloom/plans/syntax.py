"""Symbols, calls and imports of source files in five languages, found by joins over syntax nodes; and routes of files that cannot be read whole.

Nodes are a table (``functions/code_nodes``). What stands beside a node is a
window over its siblings, what stands in it a join on its parent, the symbol
around a call an interval join. Python's own parser gives its rows directly.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code_nodes, js_facts, python_facts, scalars
from ..functions.rows import BLOCK
from ..functions.rows import COLUMNS as FACTS
from ..functions.rows import extracted
from ..operators import joins
from ..operators.closure import settled

#: Words that declare what the next word names, by language, and words before a parenthesis that call nothing.
DECLARES = {
    "nodejs": {"function": "function", "class": "class", "interface": "type", "enum": "type", "namespace": "module", "const": "variable", "let": "variable", "var": "variable"},
    "java": {"class": "class", "interface": "interface", "enum": "type", "record": "type"},
    "golang": {"func": "function", "type": "type", "var": "variable", "const": "variable", "package": "module"},
    "ruby_on_rails": {"class": "class", "module": "module", "def": "function"},
}
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "func", "def", "typeof", "await", "throw", "new", "do", "else", "try", "synchronized", "elsif", "unless", "until", "when", "and", "or", "not", "case", "select", "go", "defer", "range", "super", "constructor", "import", "yield")
SYMBOLS = ["repo", "rel_path", "language", "kind", "name", "start_line", "end_line", "begin", "end"]
_FILE = ["repo", "rel_path"]


def nodes(files: DataFrame) -> DataFrame:
    """files (repo, rel_path, language, text) -> a row a syntax node; Python is left to its own parser."""
    columns = [c.split() for c in code_nodes.NODE.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32()}

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[kind]) for v, (_, kind) in zip(zip(*rows), columns)], [name for name, _ in columns])

    def run(parts):
        # A task holds the nodes of one file and of less than a block, however many files a batch has.
        rows = []
        for p in parts:
            for k in range(p.num_rows):
                repo, path, language, text = (c[k].as_py() for c in p.columns)
                for n in code_nodes.nodes(text or "", language):
                    rows.append((repo, path, language, *n))
                    if len(rows) == BLOCK:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    return files.where(F.col("language").isin(*code_nodes.SCAN)).select(*_FILE, "language", "text").mapInArrow(run, code_nodes.NODE)


def beside(n: DataFrame, most: int = 3) -> DataFrame:
    """Nodes with their neighbours: kind, text and line of the ``most`` after (k1, t1, ..) and before them (k_1, t_1, ..), and the next brace (or Ruby's block) before a semicolon."""
    w = Window.partitionBy(*_FILE, "parent").orderBy("nth")
    out = n
    for i in range(1, most + 1):
        for sign, step in (("", F.lead), ("_", F.lag)):
            out = out.withColumns({f"{c}{sign}{i}": step(col, i).over(w) for c, col in (("k", "kind"), ("t", "text"), ("l", "line"))})
    later = w.rowsBetween(1, Window.unboundedFollowing)
    brace = F.first(F.when(F.col("kind") == "brace", F.struct("nth", "end", "end_line", "node")), ignorenulls=True).over(later)
    stop = F.min(F.when((F.col("kind") == "mark") & (F.col("text") == ";"), F.col("nth"))).over(later)
    return out.withColumn("_brace", brace).withColumn("_stop", stop).withColumn("body", F.when(F.col("_stop").isNull() | (F.col("_brace.nth") < F.col("_stop")), F.col("_brace"))).drop("_brace", "_stop")


def _declared(language: Column, word: Column) -> Column:
    table = F.create_map(*(F.lit(x) for lang, words in DECLARES.items() for w, kind in words.items() for x in (f"{lang} {w}", kind)))
    return table[F.concat_ws(" ", language, word)]


def symbols(n: DataFrame, b: DataFrame) -> DataFrame:
    """Declarations with the lines and the span of their bodies. n: nodes, b: the same with neighbours."""
    word = F.col("kind") == "word"
    told = b.where(word & (F.col("k1") == "word")).withColumn("what", _declared(F.col("language"), F.col("text"))).where("what is not null")
    # A variable and Go's package end with their line; others reach to the end of their body.
    has_body = ~F.col("what").isin("variable", "module") & F.col("body").isNotNull()
    plain = told.select(*_FILE, "language", F.when(F.col("language") == "golang", F.when(F.col("k2") == "word", F.when(F.col("t2") == "struct", "class").when(F.col("t2") == "interface", "interface").otherwise(F.col("what"))).otherwise(F.col("what"))).otherwise(F.col("what")).alias("kind"), F.col("t1").alias("name"), F.col("line").alias("start_line"), F.when(has_body, F.col("body.end_line")).otherwise(F.col("line")).alias("end_line"), "begin", F.when(has_body, F.col("body.end")).otherwise(F.col("end")).alias("end"), F.col("body.node").alias("inside"))
    # Methods: a name, its parameters and a body, right inside the body of a class; in Go a receiver stands before the name.
    bodies = plain.where("kind in ('class', 'interface', 'type') and inside is not null").select(*_FILE, F.col("inside").alias("parent"), F.col("name").alias("owner"))
    named = b.where(word & (F.col("k1") == "paren") & ~F.col("text").isin(*NO_CALLS) & ~F.col("text").contains("."))
    methods = named.where("language in ('java', 'nodejs') and body is not null").join(bodies, [*_FILE, "parent"])
    received = named.where("language = 'golang' and k_1 = 'paren' and t_2 = 'func' and body is not null")
    wide = methods.unionByName(received, allowMissingColumns=True)
    methods = wide.select(*_FILE, "language", F.lit("method").alias("kind"), F.col("text").alias("name"), F.col("line").alias("start_line"), F.col("body.end_line").alias("end_line"), "begin", F.col("body.end").alias("end"))
    # Ruby: the block's first word is its name.
    blocks = n.where("kind = 'block' and text in ('class', 'module', 'def')").select(*_FILE, "language", F.col("node").alias("parent"), "text", "line", "end_line", "begin", "end")
    heads = n.where("nth = 1 and kind = 'word'").select(*_FILE, "parent", F.col("text").alias("head"))
    ruby = blocks.join(heads, [*_FILE, "parent"]).select(*_FILE, "language", _declared(F.col("language"), F.col("text")).alias("kind"), F.regexp_replace("head", r"^self\.", "").alias("name"), F.col("line").alias("start_line"), "end_line", "begin", "end")
    return plain.select(*SYMBOLS).unionByName(methods.select(*SYMBOLS)).unionByName(ruby.select(*SYMBOLS))


def calls(b: DataFrame, found: DataFrame) -> DataFrame:
    """repo, rel_path, language, name (its last part), target (the whole), start_line, begin, caller: the innermost symbol around it."""
    last = F.regexp_extract("text", r"([\w$]+[?!]?)$", 1)
    here = b.where("kind = 'word' and k1 = 'paren' and l1 = line").withColumn("name", last).where(~F.col("name").isin(*NO_CALLS) & (F.col("name") != "") & ~F.startswith(F.col("text"), F.lit("@")))
    # A declaration is no call: it is named, or it has a body in a class.
    own = found.where("kind in ('function', 'method')").select(*_FILE, "name", F.col("start_line").alias("line")).distinct()
    rows = here.join(own, [*_FILE, "name", "line"], "left_anti")
    points = rows.select(*_FILE, "language", "name", F.col("text").alias("target"), F.col("line").alias("start_line"), F.col("begin").alias("at"))
    bodies = found.where("kind not in ('variable') and end_line > start_line").select(*_FILE, "begin", "end")
    around = joins.innermost(points, bodies, _FILE, "at", "begin", "end", 4096)
    named = found.where("kind not in ('variable') and end_line > start_line").groupBy(*_FILE, "begin", "end").agg(F.min("name").alias("caller"))
    return around.join(named, [*_FILE, "begin", "end"], "left").select(*_FILE, "language", "name", "target", "start_line", F.col("at").alias("begin"), "caller")


def imports(n: DataFrame, b: DataFrame) -> DataFrame:
    """repo, rel_path, language, module, start_line."""
    text = F.col("language")
    string = b.where("kind = 'string'")
    js = string.where((text == "nodejs") & F.col("t_1").isin("from", "import") & (F.col("k_1") == "word"))
    direct = string.where(((text == "golang") & ((F.col("t_1") == "import") | ((F.col("t_2") == "import") & (F.col("k_1") == "word")))) | ((text == "ruby_on_rails") & F.col("t_1").isin("require", "require_relative", "load")))
    # A relative name of Ruby is led to the root, so that it reads like the others.
    relative = (text == "ruby_on_rails") & (F.col("t_1") == "require_relative")
    direct = direct.withColumn("text", F.when(relative, scalars.contained(F.regexp_replace("rel_path", "/?[^/]*$", ""), F.col("text"))).otherwise(F.col("text"))).where("text is not null")
    java = b.where((text == "java") & (F.col("kind") == "word") & (F.col("text") == "import") & (F.col("k1") == "word")).withColumn("text", F.when(F.col("t1") == "static", F.col("t2")).otherwise(F.col("t1")))
    # In parentheses: require('x'), import ( "a" "b" ).
    openers = b.where(((text == "nodejs") & (F.col("kind") == "paren") & F.col("t_1").isin("require", "import")) | ((text == "golang") & (F.col("kind") == "paren") & (F.col("t_1") == "import"))).select(*_FILE, F.col("node").alias("parent"))
    inside = n.where("kind = 'string'").join(openers, [*_FILE, "parent"], "left_semi")
    columns = [*_FILE, "language", F.col("text").alias("module"), F.col("line").alias("start_line")]
    out = js.select(*columns)
    for part in (direct, java, inside):
        out = out.unionByName(part.select(*columns))
    return out


def _python(files: DataFrame) -> DataFrame:
    return extracted(files.where("language = 'python'"), python_facts.extract).withColumn("language", F.lit("python"))


def metadata(files: DataFrame) -> dict[str, DataFrame]:
    """symbols, calls, imports and errors (files with nodes that do not fit) of files in all five languages."""
    # Written once: every table below reads them several times.
    n = settled(nodes(files))
    b = settled(beside(n))
    found = symbols(n, b)
    py = settled(_python(files))
    own = py.where("what = 'symbol'").select(*_FILE, "language", "kind", "name", "start_line", "end_line")
    called = py.where("what = 'call'").select(*_FILE, "language", "name", "target", "start_line")
    taken = py.where("what = 'import'").select(*_FILE, "language", F.coalesce("target", "name").alias("module"), "start_line")
    errors = n.where("kind = 'error'").groupBy(*_FILE, "language").agg(F.min("line").alias("line"), F.count("*").alias("n"))
    broken = py.where("what = 'reject'").select(*_FILE, "language", F.lit(1).alias("line"), F.lit(1).cast("long").alias("n"))
    return {
        "symbols": found.select(*own.columns).unionByName(own),
        "calls": calls(b, found).select(*called.columns, "caller").unionByName(called, allowMissingColumns=True),
        "imports": imports(n, b).unionByName(taken),
        "errors": errors.unionByName(broken),
    }


# --- a second tier for files that the first could not read -----------------------------------------


def route_lines(files: DataFrame) -> DataFrame:
    """repo, rel_path, line, text: the lines of files that name a verb."""
    verbs = "|".join(js_facts.VERBS)
    lines = files.select(*_FILE, F.posexplode(F.split("text", "\n")).alias("line", "said")).withColumn("line", F.col("line") + 1)
    return lines.where(F.col("said").rlike(rf"(?i)\b({verbs}|controller)\s*\("))


def _routed(name: Column) -> Column:
    low = F.lower(name)
    ends = lambda parts: F.array_contains(F.array(*(F.endswith(low, F.lit(p)) for p in parts)), True)
    starts = F.array_contains(F.array(*(F.startswith(low, F.lit(p)) for p in js_facts.ROUTE_STARTS)), True)
    return ~ends(js_facts.NO_ROUTE_ENDS) & (low.isin(*js_facts.ROUTE_NAMES) | ends(js_facts.ROUTE_ENDS) | starts)


def fallback(files: DataFrame, facts: DataFrame, errors: DataFrame) -> DataFrame:
    """Facts ``endpoint`` of Node files for which the first tier found none: Nest decorators in any of them, calls of route objects line by line in those with errors."""
    some = facts.where("what = 'endpoint'").select(*_FILE).distinct()
    lines = route_lines(files.join(some, _FILE, "left_anti"))
    quoted = r"\(\s*(?:['\"`]([^'\"`]*)['\"`])?"
    tag = F.regexp_extract("said", r"@(Controller|Get|Post|Put|Delete|Patch|Options|Head|All)\s*\(", 1)
    tags = lines.withColumn("tag", tag).where("tag <> ''").withColumn("path", F.regexp_extract("said", r"@\w+\s*" + quoted, 1)).withColumn("file", F.concat_ws("\x00", *_FILE))
    under = joins.nearest_before(tags, ["file"], ["line"], F.col("tag") != "Controller", F.col("tag") == "Controller", "path").where("nearest is not null")
    parts = F.filter(F.array(F.trim(F.col("nearest"), F.lit("/")), F.trim(F.col("path"), F.lit("/"))), lambda x: x != "")
    nest = under.select(*_FILE, "line", F.upper("tag").alias("method"), F.concat(F.lit("/"), F.array_join(parts, "/")).alias("route"), F.lit("nest").alias("kind"), F.lit(None).cast("string").alias("owner"))
    pattern = rf"\b([A-Za-z_$][\w$]*)\s*\.\s*({'|'.join(js_facts.VERBS)})\s*" + r"\(\s*['\"`]([^'\"`]*)['\"`]\s*,"
    each = lambda k: F.regexp_extract_all("said", F.lit(pattern), F.lit(k))
    broken = lines.join(errors.select(*_FILE).distinct(), _FILE, "left_semi").join(nest.select(*_FILE).distinct(), _FILE, "left_anti")
    said = broken.withColumn("c", F.explode(F.arrays_zip(each(1).alias("o"), each(2).alias("v"), each(3).alias("r")))).where(_routed(F.col("c.o")) & ~F.contains(F.col("c.r"), F.lit("${")))
    express = said.select(*_FILE, "line", F.upper("c.v").alias("method"), F.col("c.r").alias("route"), F.lit("express").alias("kind"), F.col("c.o").alias("owner"))
    rows = nest.unionByName(express).withColumn("pos", F.row_number().over(Window.partitionBy(*_FILE).orderBy("line", "method", "route")))
    filled = {"what": F.lit("endpoint"), "start_line": F.col("line"), "end_line": F.col("line"), "detail": F.lit("second tier")}
    have = {*rows.columns, *filled}
    kinds = dict(facts.dtypes)
    return rows.withColumns(filled | {c: F.lit(None) for c in FACTS if c not in have}).select(*(F.col(c).cast(kinds[c]) for c in FACTS))
