import json

from pyspark.sql import functions as F

from routeloom.functions import contract_facts as cf
from routeloom.plans.contract_lane import reconcile, run_lane
from routeloom.sources.repo_tree import read_tree


def spec(paths, ids=True, **more):
    item = lambda p, v: {"operationId": f"{v}{p.strip('/').title().replace('/', '').replace('{', '').replace('}', '')}"} if ids else {}
    return json.dumps({"openapi": "3.0.1", "paths": {p: {v: item(p, v) | {"responses": {}} for v in vs} for p, vs in paths.items()}} | more)


POM = "<project xmlns='x'><properties><spec>src/api.json</spec></properties><build><plugins><plugin><artifactId>openapi-generator-maven-plugin</artifactId><configuration><generatorName>{}</generatorName><inputSpec>${{project.basedir}}/${{spec}}</inputSpec><apiPackage>gen.api</apiPackage></configuration></plugin></plugins></build></project>"
CONTROLLER = "package app;\nimport gen.api.PetsApi;\n@RestController\n@RequestMapping(\"/v1\")\npublic class PetsController implements PetsApi {\n public void getPets() {}\n}\n"

REPOS = {
    "served": {"pom.xml": POM.format("spring"), "src/api.json": spec({"/pets": ["get", "post"], "/pets/{id}": ["delete"]}), "PetsController.java": CONTROLLER},
    "client": {"pom.xml": POM.format("java"), "src/api.json": spec({"/away": ["get"]})},
    "docs": {"docs/api.yaml": "openapi: 3.0.0\npaths:\n  /x:\n    get:\n      operationId: getX\n", "C.java": "@RestController\npublic class C {\n @GetMapping(\"/x\")\n public void getX() {}\n}\n"},
    "nothing": {"vendor/api.yaml": "openapi: 3.0.0\npaths:\n  /y:\n    get: {}\n", "old.json": "{\"swagger\": \"2.0\"}", "bad.yaml": "openapi: 3\n  - x: ["},
    "connexion": {"app.py": "app = connexion.App(__name__, specification_dir='spec/')\n# app.add_api('no.yaml')\napp.add_api('notes.yaml', base_path='/v9')\n", "spec/notes.yaml": "openapi: 3.0.0\npaths:\n  /notes:\n    get: {}\n"},
    "go": {"gen.go": "package x\n//go:generate oapi-codegen -generate chi-server -o out.gen.go api.yaml\n", "out.gen.go": "package x\n", "api.yaml": "openapi: 3.0.0\npaths:\n  /w:\n    get: {}\n"},
    "go_provisional": {"gen.go": "package x\n//go:generate oapi-codegen -config cfg.yaml -o no.gen.go api.yaml\n", "cfg.yaml": "generate:\n  gin-server: true\n", "api.yaml": "openapi: 3.0.0\npaths:\n  /w:\n    get: {}\n"},
    "bazel": {"BUILD": "api(\n  name = \"a\",\n  spec = \"api.yaml\",\n)\n", "d.bzl": "def inner(name):\n  run([\"-g\", \"spring\"])\ndef api(name, spec):\n  inner(name)\n", "api.yaml": "openapi: 3.0.0\npaths:\n  /b:\n    get: {}\n"},
    "refs": {"build.gradle": "openApiGenerate {\n generatorName = \"spring\"\n inputSpec = \"$rootDir/api.json\"\n}\n", "api.json": spec({"/ok": ["get"]}, components={"schemas": {"A": {"$ref": "#/components/schemas/B"}, "B": {"properties": {"a": {"$ref": "#/components/schemas/A"}, "c": {"$ref": "parts.yaml#/C"}}}}}).replace("\"responses\": {}", "\"responses\": {\"200\": {\"$ref\": \"#/components/schemas/A\"}}").replace("\"/ok\":", "\"/bad\": {\"get\": {\"responses\": {\"200\": {\"$ref\": \"#/components/schemas/Gone\"}}}}, \"/out\": {\"get\": {\"x\": {\"$ref\": \"https://away/x\"}}}, \"/sec\": {\"get\": {\"security\": [{\"key\": []}]}}, \"/ok\":"), "parts.yaml": "C:\n  type: object\n"},
}


def run(spark, tmp_path, **more):
    for name, files in REPOS.items():
        for p, t in files.items():
            (tmp_path / name / p).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name / p).write_text(t)
    return run_lane(read_tree(spark, [str(tmp_path / n) for n in REPOS]), **more)


def test_lane(spark, tmp_path):
    got = run(spark, tmp_path)
    verdict = {r.repo: (r.status, r.reason) for r in got["verdicts"].collect()}
    assert verdict == {"served": ("served", "live_server"), "client": ("excluded", "client_generator"), "docs": ("excluded", "covers_routed_handlers"), "nothing": ("excluded", "no_server_evidence"), "connexion": ("served", "live_server"), "go": ("served", "live_server"), "go_provisional": ("candidate", "provisional_evidence"), "bazel": ("served", "live_server"), "refs": ("served", "live_server")}
    rows = {(r.repo, r.method, r.route) for r in got["rows"].collect()}
    assert rows == {("served", "GET", "/v1/pets"), ("served", "POST", "/v1/pets"), ("served", "DELETE", "/v1/pets/{id}"), ("connexion", "GET", "/v9/notes"), ("go", "GET", "/w"), ("bazel", "GET", "/b"), ("refs", "GET", "/ok")}
    errors = {r.spec_path: r.error for r in got["operations"].where("repo = 'refs' and error is not null").collect()}
    assert set(errors) == {"/bad", "/out", "/sec"}
    closure = next(r.closure for r in got["rows"].where("repo = 'refs'").collect())
    assert "parts.yaml#/C" in closure and len(closure) == 3
    # Every reference of a published operation, and of what it refers to, meets a published component.
    named = {(r.repo, f"#/components/{r.category}/{r["name"]}"): r.body for r in got["components"].collect()}
    used = {(r.repo, ref) for r in got["rows"].collect() for ref in cf.references(json.loads(r.operation))} | {(repo, ref) for (repo, _), body in named.items() for ref in cf.references(json.loads(body))}
    assert used <= set(named) and len([k for k in named if k[0] == "refs"]) == 3
    buckets = {(r.repo, r.bucket) for r in got["docs"].where("repo = 'nothing'").collect()}
    assert buckets == {("nothing", "contracts"), ("nothing", "swagger2"), ("nothing", "parse_errors")}
    # Overrides: by the hash just computed, an include lifts the candidate; a stale one does not; an exclude always holds.
    h = {r.repo: r.eligibility for r in got["verdicts"].collect()}
    o = spark.createDataFrame([("api.yaml", "include", h["go_provisional"], "/p"), ("src/api.json", "exclude", None, None), ("none.yaml", "include", None, None)], "rel_path string, action string, eligibility_hash string, prefix string")
    again = run(spark, tmp_path, overrides=o)
    assert {(r.repo, r.route) for r in again["rows"].collect()} == {("connexion", "/v9/notes"), ("go", "/w"), ("bazel", "/b"), ("refs", "/ok"), ("go_provisional", "/p/w")}
    assert ("none.yaml", "unmatched") in {(r.rel_path, r.state) for r in again["overrides"].collect()}


def test_reconcile(spark):
    contract = spark.createDataFrame([("r", "a.yaml", "GET", "/u/{id}", "A"), ("r", "b.yaml", "get", "/u/{userId}", "B"), ("r", "a.yaml", "POST", "/u", "C")], "repo string, rel_path string, method string, route string, operation string")
    code = spark.createDataFrame([("r", "x.java", "get", "/u/{x}", "{}", 3), ("r", "y.java", "GET", "/u/{y}", None, 1), ("r", "y.java", "PUT", "/u", None, 9)], "repo string, rel_path string, method string, route string, conditions string, start_line int")
    got = reconcile(contract, code)
    ops = {(r.method, r.route): (r.operation, r.conflict, r.conditions) for r in got["operations"].collect()}
    assert ops == {("GET", "/u/{id}"): ("A", ["spec:b.yaml#get /u/{userId}"], "{}"), ("POST", "/u"): ("C", [], None)}
    assert got["superseded"].count() == 2 and [r.method for r in got["to_generate"].collect()] == ["PUT"]


def test_inlining(spark):
    """Diamonds built once, cycles and what leads to them refused, siblings of a reference go with it, a bound on size."""
    from routeloom.plans.inlining import inline

    ref = lambda k: {"$ref": k}
    bodies = {"a": {"x": [ref("b"), ref("c")]}, "b": {"d": ref("d")}, "c": {"d": {"$ref": "d", "description": "goes"}}, "d": {"type": "object"}, "e": {"f": ref("f")}, "f": {"e": ref("e")}, "g": ref("e"), "h": {"gone": ref("no")}, "i": {"h": ref("h"), "a": ref("a")}}
    df = spark.createDataFrame([("r", k, json.dumps(v)) for k, v in bodies.items()], "repo string, key string, body string")
    got = {r.key: (json.loads(r.body) if r.body else None, r.level, r.error) for r in inline(df).collect()}
    d = {"type": "object"}
    assert got["a"] == ({"x": [{"d": d}, {"d": d}]}, 2, None) and got["c"] == ({"d": d}, 1, None) and got["d"] == (d, 0, None)
    assert {k: v[2] for k, v in got.items() if v[2]} == {"e": "cycle", "f": "cycle", "g": "cycle", "h": "unresolved", "i": "unresolved"}
    import pytest

    with pytest.raises(Exception, match="bytes"):
        inline(df, most_bytes=30).count()
