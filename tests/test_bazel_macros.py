"""Macros followed with their arguments, labels, groups, and evidence kept apart by repository."""

import json

from pyspark.sql import functions as F

from routeloom.functions import contract_facts as cf
from routeloom.plans import bazel_macros
from routeloom.plans.contract_lane import apply_overrides, evidence_and_rejects, run_lane, verdicts

API = "openapi: 3.0.0\npaths:\n  /b:\n    get: {}\n"


def tree(spark, files):
    rows = [(repo, path, bytearray(text.encode()), len(text), False) for (repo, path), text in files.items()]
    return spark.createDataFrame(rows, "repo string, rel_path string, content binary, size long, is_symlink boolean")


def found(spark, files):
    got, unread = evidence_and_rejects(tree(spark, files))
    return {(r.repo, r.rel_path, r.generator, r.kind, r.api_package, r.build_file, tuple(r.proof)) for r in got.where("tool = 'bazel'").collect()}, {(r.repo, r.rel_path) for r in unread.collect()}


def test_two_calls_deep(spark):
    files = {
        ("r", "svc/BUILD"): 'load("//tools:api.bzl", server = "api_server")\nSPEC = ":api.yaml"\nserver(name = "a", contract = SPEC)\n',
        ("r", "tools/api.bzl"): 'load(":gen.bzl", "generate")\nKIND = {"jvm": "spring", "go": "go"}\ndef api_server(name, contract, lang = "jvm"):\n    generate(name + "_gen", KIND[lang], contract, package = "acme." + name)\n',
        ("r", "tools/gen.bzl"): 'def generate(name, generator, input, package):\n    cmd = "run generate -g %s --api-package %s" % (generator, package)\n    native.genrule(name = name, srcs = [input], cmd = cmd)\n    if name:\n        _inner(spec_file = input)\n\ndef _inner(spec_file):\n    generate(spec_file, "go", spec_file, "x")\n',
        ("r", "svc/api.yaml"): API,
        ("r", "api.yaml"): API,
        ("other", "BUILD"): 'server(contract = ":api.yaml")\n',
        ("other", "api.yaml"): API,
    }
    got, unread = found(spark, files)
    # The specification reaches the generator through no attribute of the first call, but through a parameter of the second.
    assert got == set() and unread == set()
    files[("r", "tools/api.bzl")] = files[("r", "tools/api.bzl")].replace("KIND[lang], contract,", "KIND[lang], spec = contract,")
    files[("r", "tools/gen.bzl")] = files[("r", "tools/gen.bzl")].replace("generator, input, package", "generator, spec, package").replace("[input]", "[spec]").replace("= input)", "= spec)")
    got, _ = found(spark, files)
    assert got == {("r", "svc/api.yaml", "spring", "server", "acme.a", "svc/BUILD", ("svc/BUILD", "tools/api.bzl", "tools/gen.bzl"))}


def test_labels_groups_and_unreadable(spark):
    files = {
        ("r", "defs.bzl"): 'def api(**kwargs):\n    run(["-g", "java"])\ndef apis(name, specs):\n    native.genrule(cmd = "generate -g {} -x".format("spring"))\n',
        ("r", "a/BUILD.bazel"): 'api(inputSpec = "//b:x.yaml")\napi(src = "plain.yaml", openapi_spec = "no.yaml")\napi(spec = "@dep//b:x.yaml")\napi(spec = ":gone.yaml")\napi(name = "nothing")\nGROUP = [{"spec_file": "g.yaml", "api_package": "p.g"}, {"spec": "//b:x.yaml"}]\napis(name = "g", specs = GROUP)\n',
        ("r", "a/src/main/resources/plain.yaml"): API,
        ("r", "plain.yaml"): API,
        ("r", "b/x.yaml"): API,
        ("r", "g.yaml"): API,
        ("r", "c/BUILD"): 'genrule(\n  cmd = "java -jar x generate -g spring -i $(location //b:x.yaml) --api-package \\"c.d\\"", # -g go\n)\ngenrule(cmd = "generate -g go")\n',
        ("r", "bad/BUILD"): "def (",
    }
    got, unread = found(spark, files)
    assert {x[1:6] for x in got} == {
        ("b/x.yaml", "java", "client", None, "a/BUILD.bazel"),
        ("a/src/main/resources/plain.yaml", "java", "client", None, "a/BUILD.bazel"),
        ("g.yaml", "spring", "server", "p.g", "a/BUILD.bazel"),
        ("b/x.yaml", "spring", "server", None, "a/BUILD.bazel"),
        ("b/x.yaml", "spring", "server", "c.d", "c/BUILD"),
    }
    assert unread == {("r", "bad/BUILD")}


def test_recursion_ends(spark):
    files = {("r", "BUILD"): 'def a(spec):\n    b(spec)\ndef b(spec):\n    a(spec)\n    x("generate -g spring")\na(spec = "s.yaml")\n', ("r", "s.yaml"): API}
    got, _ = found(spark, files)
    assert {x[1:4] for x in got} == {("s.yaml", "spring", "server")}
    assert bazel_macros.runs(spark.createDataFrame([], "repo string, rel_path string, text string"))[0].count() == 0


def test_gradle_strings(spark):
    (got,) = cf.gradle('x {\n generatorName = "spring" // "go"\n description = "see /* here"\n inputSpec = "a//b.yaml" /* inputSpec = "c.yaml" */\n}', "")
    assert (got["generator"], got["spec"]) == ("spring", "a/b.yaml")


GRADLE = 'openApiGenerate {\n generatorName = "spring"\n inputSpec = "$rootDir/api.json"\n}\n'
SPEC = json.dumps({"openapi": "3.0.1", "paths": {"/x": {"get": {"operationId": "get", "responses": {}}}}})


def test_overrides_and_tracked_files_of_one_repository(spark):
    both = tree(spark, {(r, p): t for r in ("one", "two") for p, t in (("build.gradle", GRADLE), ("api.json", SPEC))})
    o = spark.createDataFrame([("one", "api.json", "exclude", None, None), ("two", "none.json", "exclude", None, None)], "repo string, rel_path string, action string, eligibility_hash string, prefix string")
    got = run_lane(both, overrides=o)
    assert {(r.repo, r.status) for r in got["verdicts"].collect()} == {("one", "excluded"), ("two", "served")}
    assert {(r.repo, r.rel_path, r.state) for r in got["overrides"].collect()} == {("one", "api.json", "applied"), ("two", "none.json", "unmatched")}
    go = "package x\n//go:generate oapi-codegen -generate chi-server -o out.go api.yaml\n"
    both = tree(spark, {(r, p): t for r in ("one", "two") for p, t in (("gen.go", go), ("out.go", "package x\n"), ("api.yaml", API))})
    tracked = spark.createDataFrame([("one", "out.go")], "repo string, rel_path string")
    assert {(r.repo, r.provisional) for r in evidence_and_rejects(both, tracked)[0].collect()} == {("one", False), ("two", True)}


def test_method_names_meet_inside_a_repository(spark):
    docs = spark.createDataFrame([(r, "a.json", 0, "contracts", 1) for r in ("one", "two")], "repo string, rel_path string, doc_index int, bucket string, contracts_in_file long")
    ops = spark.createDataFrame([(r, "a.json", 0, 0, None, ["get"]) for r in ("one", "two")], "repo string, rel_path string, doc_index int, position int, error string, names array<string>")
    evidence = spark.createDataFrame([], "repo string, rel_path string, kind string, provisional boolean, base_path string, api_package string")
    classes = spark.createDataFrame([("one", "one\0C", "C.java", 0, [""], [])], "repo string, class_id string, rel_path string, pos int, prefixes array<string>, api_packages array<string>")
    methods = spark.createDataFrame([("one\0C", "get", True)], "class_id string, method string, routed boolean")
    v, _ = verdicts(docs, ops, evidence, classes, methods)
    assert {(r.repo, r.matched, r.reason) for r in v.collect()} == {("one", 1, "covers_routed_handlers"), ("two", 0, "no_server_evidence")}
    assert apply_overrides(v.withColumn("eligibility", F.lit("h")), spark.createDataFrame([], "repo string, rel_path string, action string, eligibility_hash string, prefix string"))[0].count() == 2


def test_specifications_behind_links(spark, tmp_path):
    """A specification named through a link is the file that it really is; links out of the tree and in circles prove nothing."""
    import os

    from routeloom.sources.repo_tree import read_tree

    root = tmp_path / "r"
    for name, spec in (("ok", "$rootDir/linked/api.json"), ("out", "$rootDir/away/api.json"), ("circle", "$rootDir/ring/api.json")):
        (root / name).mkdir(parents=True)
        (root / name / "build.gradle").write_text(GRADLE.replace("$rootDir/api.json", spec))
    (root / "specs/v1").mkdir(parents=True)
    (root / "specs/v1/api.json").write_text(SPEC)
    (root / "BUILD").write_text('genrule(cmd = "generate -g spring -i $(location linked/api.json)")\n')
    (tmp_path / "away").mkdir()
    (tmp_path / "away/api.json").write_text(SPEC)
    for link, target in (("linked", "current"), ("current", "specs/v1"), ("away", "../away"), ("ring", "gnir"), ("gnir", "ring")):
        os.symlink(target, root / link)
    got = evidence_and_rejects(read_tree(spark, str(root)))[0]
    assert {(r.build_file, r.tool, r.rel_path) for r in got.collect()} == {("ok/build.gradle", "gradle", "specs/v1/api.json"), ("BUILD", "bazel", "specs/v1/api.json")}
