"""Context assembly, truncation, specifications and state between runs on small constructed tables."""

import tempfile

from pyspark.sql import functions as F

from routeloom.functions import contract_facts as cf
from routeloom.functions import scalars as s
from routeloom.operators import context, joins, specs
from routeloom.plans import incremental, state_tables


def test_assemble(spark):
    files = spark.createDataFrame([("a.py", "def one():\n    two()\n    util()\n\ndef two():\n    pass\n\ndef two():\n    return 2\n"), ("b.py", "class util:\n    x = 1\n\ndef util():\n    pass\n")], "rel_path string, text string")
    handlers = spark.createDataFrame([("GET /one", "a.py", 1, 3)], "key string, rel_path string, start int, end int")
    calls = spark.createDataFrame([("a.py", "two", 2, 2), ("a.py", "util", 3, 3), ("a.py", "one", 2, 2), ("a.py", "two", 9, 9)], "rel_path string, name string, start int, end int")
    defs = spark.createDataFrame([("a.py", "one", "function", 1, 3), ("a.py", "two", "function", 5, 6), ("a.py", "two", "function", 8, 9), ("b.py", "util", "function", 4, 5), ("b.py", "util", "class", 1, 2)], "rel_path string, name string, kind string, start_line int, end_line int")
    imports = spark.createDataFrame([("GET /one", 0, "b.py", "util"), ("GET /one", 1, "b.py", "absent")], "key string, pos int, rel_path string, name string")
    got = context.assemble(handlers, calls, defs, imports, files).collect()
    assert [(r.key, r.blocks) for r in got] == [("GET /one", ["def two():\n    return 2", "class util:\n    x = 1"])]


def test_truncate(spark):
    price = lambda c: F.ceil(F.length(c) / 4)
    rows = spark.createDataFrame([(k, "é" * k) for k in (0, 1, 40, 41, 999)] + [(-1, None)], "k int, t string")
    for r in rows.select("k", context.truncate(F.col("t"), 10, price).alias("t")).collect():
        assert r.t == (None if r.k < 0 else "é" * r.k if r.k <= 40 else "é" * 40 + context.MARKER)


def test_references(spark):
    doc = '{"a": {"$ref":"#/components/schemas/A"}, "b": [{"$ref" : "#/components/schemas/B"}, {"$ref": "#/components/schemas/A"}], "c": "$ref"}'
    docs = spark.createDataFrame([("x/pets.yaml", doc), ("y.yaml", "{}")], "spec string, doc string")
    comps = spark.createDataFrame([("x/pets.yaml", "#/components/schemas/A"), ("x/pets.yaml", "#/components/schemas/B")], "spec string, pointer string")
    # Names that are swapped are replaced at once, not one after the other.
    names = specs.namespaced(comps, "spec", "pointer").collect()
    assert {(r.old, r.new) for r in names} == {(f"#/components/schemas/{n}", f"#/components/schemas/x_pets_{n}") for n in "AB"}
    swap = spark.createDataFrame([("x/pets.yaml", f"#/components/schemas/{a}", f"#/components/schemas/{b}") for a, b in ("AB", "BA")], "spec string, old string, new string")
    got = {r.spec: r.doc for r in specs.rewrite_references(docs, "spec", "doc", swap).collect()}
    assert got == {"x/pets.yaml": '{"a": {"$ref": "#/components/schemas/B"}, "b": [{"$ref": "#/components/schemas/A"}, {"$ref": "#/components/schemas/B"}], "c": "$ref"}', "y.yaml": "{}"}


def test_normalize_express(spark):
    want = {"/u/:id": "/u/{id}", "/u/:id(\\d+)?/x": "/u/{id}/x", "/:a(x(y(z)w)|\\))/:b?": "/{a}/{b}", "/:a(x(y/:b": "/:a(x(y/{b}", "": "", "/plain": "/plain", "/:a-:b": "/{a}-{b}", "/:deep" + "(x" * 12 + ":y" + ")" * 12 + "?/:z": "/{deep}/{z}", "/:a(b:c)/:d?x": "/{a}/{d}x"}
    rows = spark.createDataFrame([(k,) for k in want] + [(None,)], "r string")
    assert {r.r: r.n for r in rows.select("r", s.normalize_express(F.col("r")).alias("n")).collect()} == want | {None: None}


def test_build_facts():
    assert cf.uncommented('a = "x # y"  # gone\n# all\nb = "it\'s # kept') == 'a = "x # y"  \n\nb = "it\'s # kept'
    line = "//go:generate go run oapi-codegen --config cfg.yaml -generate types,chi-server -o out.go api/spec.yaml\n"
    (got,) = cf.go_generate(line, "svc")
    assert (got["kind"], got["spec"], got["config"], got["output"]) == ("server", "svc/api/spec.yaml", "svc/cfg.yaml", "svc/out.go")
    assert not list(cf.go_generate("//go:generate oapi-codegen -config only.yaml\n", ""))
    assert next(cf.go_generate("//go:generate oapi-codegen -generate gin,types spec.json\n", ""))["kind"] == "unknown"
    (got,) = cf.gradle('task {\n // generatorName = "go"\n /* generatorName = "java" */\n generatorName = "spring"\n inputSpec = "https://x/y.yaml" // note\n}', "")
    assert got["generator"] == "spring" and got["spec"] is None


def test_numbered(spark):
    df = spark.createDataFrame([(k * 37 % 1000, k) for k in range(1000)], "a int, b int").repartition(5)
    got = sorted((r.n, r.a) for r in joins.numbered(df, ["a"], "n").collect())
    assert got == [(k + 1, k) for k in range(1000)]


def _endpoints(spark, rows):
    return spark.createDataFrame(rows, "key string, pos int, rel_path string, context_hash string")


def test_runs(spark):
    """A full run, a fast one, a partial one, one that fails and one that cannot read its state."""
    root = "file://" + tempfile.mkdtemp()
    none = spark.createDataFrame([], "key string, rel_path string, import_path string, name string, start_line int, end_line int")
    imports = spark.createDataFrame([("GET /a", "a.py", "lib.py", "f", 1, 2)], none.schema)
    changed = lambda *p: spark.createDataFrame([(x,) for x in p], "rel_path string")
    asked = []

    def generate(keys):
        got = sorted(r.key for r in keys.collect())
        asked.append(got)
        return spark.createDataFrame([(k, k.split(" ")[1], "GET", f'{{"made": {len(asked)}}}') for k in got if k != "GET /bad"], state_tables.OPERATIONS)

    one = _endpoints(spark, [("GET /a", 0, "a.py", "h1"), ("GET /b", 1, "b.py", "h2"), ("GET /c", 2, "c.py", "h3"), ("GET /d", 3, "d.py", "h4")])
    assert state_tables.run(spark, root, one, imports, changed(), generate)["mode"] == "full" and asked == [["GET /a", "GET /b", "GET /c", "GET /d"]]
    assert state_tables.run(spark, root, one, imports, changed(), generate)["mode"] == "fast" and len(asked) == 1
    two = _endpoints(spark, [("GET /a", 0, "a.py", "h1x"), ("GET /b", 1, "b.py", "h2"), ("GET /c", 2, "c.py", "h3"), ("GET /bad", 3, "d.py", "h5")])
    got = state_tables.run(spark, root, two, imports, changed("lib.py", "b.py"), generate)
    # /a depends on lib.py, /b is touched but its context is the same, /d went and /bad came.
    assert got["mode"] == "full" or asked[-1] == ["GET /a", "GET /bad"]
    kept = {r.key: r.operation for r in got["operations"].collect()}
    assert set(kept) == {"GET /a", "GET /b", "GET /c"} and {r.key for r in got["failed"].collect()} == {"GET /bad"}
    index = {r.key for r in state_tables.read(spark, root, "index", state_tables.INDEX).collect()}
    assert index == {"GET /a", "GET /b", "GET /c"}  # what failed reads as new next time
    try:
        state_tables.check_generated(two, two.limit(0))
        raise AssertionError("an empty run passed")
    except RuntimeError:
        pass


def test_migrate(spark):
    rows = spark.createDataFrame([("GET /u/:id", "/u/:id", "GET", "old"), ("GET /u/{id}", "/u/{id}", "GET", "new"), ("POST /x", "/x", "POST", "x")], state_tables.OPERATIONS)
    got = {(r.key, r.operation) for r in state_tables.migrate(rows, s.normalize_colon).collect()}
    assert got == {("GET /u/{id}", "new"), ("POST /x", "x")}


def test_sections_are_cut(spark):
    jobs = spark.createDataFrame([("a.py", k, "x" * n, f"k{k}") for k, n in enumerate((10, 40_000, 12))], "rel_path string, pos int, section string, key string")
    got = {r.pos: r.section for r in incremental.batches(jobs, incremental.approximate_tokens).collect()}
    assert got[0] == "x" * 10 and got[1] == "x" * 8000 + context.MARKER and got[2] == "x" * 12


def test_migrate_keeps_what_this_run_has(spark):
    """Keys of this run stay as they are spelt, others become canonical; the index follows; legacy fields go to their present names."""
    kind = "key string, route string, method string, operation string"
    old = spark.createDataFrame([("GET /a/:id", "/a/:id", "GET", '{"api_description": "x", "auth_tag": " "}'), ("POST /v/b:cancel", "/v/b:cancel", "POST", '{"z": 1}'), ("GET /c/:x", "/c/:x", "GET", "{}"), ("GET /c/{x}", "/c/{x}", "GET", '{"own": 1}')], kind)
    now = spark.createDataFrame([("GET /a/{id}",), ("POST /v/b:cancel",)], "key string")
    got = {r.key: (r.route, r.operation) for r in state_tables.migrate(old, s.normalize_colon, now).collect()}
    assert got == {"GET /a/{id}": ("/a/{id}", '{"description":"x"}'), "POST /v/b:cancel": ("/v/b:cancel", '{"z": 1}'), "GET /c/{x}": ("/c/{x}", '{"own": 1}')}
    index = spark.createDataFrame([("GET /a/:id", "x.go", [], "h"), ("POST /v/b:cancel", "y.py", None, None), ("GET /c/:x", "z.go", [], "old"), ("GET /c/{x}", "z.go", [], "own")], state_tables.INDEX)
    moved = {(r.key, r.rel_path, r.context_hash) for r in state_tables.migrate_index(index, s.normalize_colon, now).collect()}
    assert moved == {("GET /a/{id}", "x.go", "h"), ("POST /v/b:cancel", "y.py", None), ("GET /c/{x}", "z.go", "own")}


def test_run_after_an_older_spelling(spark, tmp_path):
    """A state whose keys are spelt otherwise needs no new operation."""
    root = str(tmp_path / "state")
    state_tables.write(spark.createDataFrame([("GET /a/:id", "/a/:id", "GET", "{}")], state_tables.OPERATIONS), root, "operations", state_tables.OPERATIONS)
    state_tables.write(spark.createDataFrame([("GET /a/:id", "x.go", [], "h")], state_tables.INDEX), root, "index", state_tables.INDEX)
    endpoints = spark.createDataFrame([("GET /a/{id}", 1, "x.go", "h")], "key string, pos long, rel_path string, context_hash string")
    none = spark.createDataFrame([], "rel_path string")

    def never(keys):
        raise AssertionError("asked")

    got = state_tables.run(spark, root, endpoints, spark.createDataFrame([], "key string, rel_path string, import_path string, name string, start_line int, end_line int"), none, never)
    assert got["mode"] == "fast" and [r.key for r in got["operations"].collect()] == ["GET /a/{id}"]
