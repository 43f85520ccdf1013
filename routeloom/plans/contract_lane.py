"""The contract lane: which OpenAPI documents are served, under which prefixes, and how they merge with routes found in code.

Documents, operations, references, build evidence and class facts are tables;
verdicts are ordered conditions over their aggregates. Unknown excludes, and
every exclusion has a reason.
"""

from __future__ import annotations

import json

import pandas as pd
from yaml import YAMLError
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contract_facts as cf
from ..functions import scalars as s
from ..functions import spring_facts
from ..functions.rows import extracted, streamed
from ..operators import budget
from ..operators.closure import settled, transitive
from ..sources.repo_tree import BUILD_IGNORED, CONTRACT_IGNORED, sniffed
from . import bazel_macros, maven_parents
from .real_paths import real_paths


def outside(tree: DataFrame, ignored) -> DataFrame:
    folders = F.slice(F.split("rel_path", "/"), 1, F.size(F.split("rel_path", "/")) - 1)
    return tree.where(~F.arrays_overlap(folders, F.array(*map(F.lit, ignored))) & ~F.col("is_symlink"))


def discover(tree: DataFrame, own_outputs=(), max_files: int = cf.MAX_FILES, max_bytes: int = cf.MAX_BYTES, max_document: int = cf.MAX_DOCUMENT) -> DataFrame:
    """repo, rel_path, doc_index, bucket, version, operations, doc, error, contracts_in_file; a ``truncated`` row where a repo's budget ends."""
    rows = outside(tree, CONTRACT_IGNORED).where(F.col("rel_path").rlike(r"(?i)\.(ya?ml|json)$") & ~F.col("rel_path").isin(list(own_outputs)))
    rows = sniffed(rows, cf.SNIFF)
    # Paths and sizes alone are ordered; contents are joined to what is left.
    known = rows.select("repo", "rel_path", "size")
    kept = settled(budget.within(known, ["repo"], "rel_path", "size", max_files, max_bytes).select("repo", "rel_path"))

    def parse(repo, path, content, size):
        found = [(0, "parse_errors", None, 0, None, "document too large")] if size > max_document or content is None else cf.documents(content, path)
        return ((repo, path, *d) for d in found)

    kind = "repo string, rel_path string, doc_index int, bucket string, version string, operations int, doc string, error string"
    docs = streamed(rows.join(kept, ["repo", "rel_path"], "left_semi").select("repo", "rel_path", "content", "size"), parse, kind)
    cut = known.join(kept, ["repo", "rel_path"], "left_anti").groupBy("repo").agg(F.min("rel_path").alias("rel_path")).select("repo", "rel_path", F.lit(0).alias("doc_index"), F.lit("truncated").alias("bucket"), F.lit(None).cast("string").alias("version"), F.lit(0).alias("operations"), F.lit(None).cast("string").alias("doc"), F.lit(None).cast("string").alias("error"))
    per_file = Window.partitionBy("repo", "rel_path")
    return docs.unionByName(cut).withColumn("contracts_in_file", F.sum((F.col("bucket") == "contracts").cast("int")).over(per_file))


def with_fragments(tree: DataFrame, docs: DataFrame, most: int = cf.MAX_DEPTH, max_document: int = cf.MAX_DOCUMENT) -> DataFrame:
    """docs and, as fragments, the files of the repository that they refer to, directly or through one another; raises beyond ``most`` steps."""

    def goals(repo, path, doc):
        return sorted({(repo, t.partition("#")[0]) for r in cf.every_reference(doc) if (t := cf.target(path, r))})

    def parse(repo, path, content):
        return ((repo, path, k, "fragments", None, 0, doc, error) for k, _, _, _, doc, error in cf.documents(content, path) if k == 0)

    kind = "repo string, rel_path string, doc_index int, bucket string, version string, operations int, doc string, error string"

    new, files = docs, outside(tree, CONTRACT_IGNORED).where(F.col("content").isNotNull() & (F.col("size") <= max_document))
    for _ in range(most):
        wanted = streamed(new.where("doc is not null").select("repo", "rel_path", "doc"), goals, "repo string, rel_path string").distinct()
        wanted = wanted.join(docs.select("repo", "rel_path").distinct(), ["repo", "rel_path"], "left_anti")
        new = streamed(files.join(wanted, ["repo", "rel_path"], "left_semi").select("repo", "rel_path", "content"), parse, kind)
        new = settled(new.withColumn("contracts_in_file", F.lit(0).cast(docs.schema["contracts_in_file"].dataType)))
        if new.isEmpty():
            return docs
        docs = docs.unionByName(new)
    raise RecursionError(f"references lead through more than {most} files")


def loaded_operations(docs: DataFrame) -> DataFrame:
    """repo, rel_path, doc_index, position, method, spec_path, operation_id, operation, names, closure, error: operations with all their reference targets, or why not."""

    def parse(repo, path, k, doc):
        for n, (method, spec, oid, tags, op, goals, _, error) in enumerate(cf.operations_of(doc, path)):
            yield repo, path, k, n, method, spec, oid, op, cf.method_names(oid, method or "", spec), goals, error

    def links(repo, path, doc):
        return ((repo, *e) for e in cf.edges(cf.outline(doc), path))

    ops = settled(streamed(docs.where("bucket = 'contracts'").select("repo", "rel_path", "doc_index", "doc"), parse, "repo string, rel_path string, doc_index int, position int, method string, spec_path string, operation_id string, operation string, names array<string>, goals array<string>, error string"))
    key = lambda c: F.concat_ws("\x00", "repo", c)
    edge = settled(streamed(docs.where("doc is not null").select("repo", "rel_path", "doc"), links, "repo string, src string, dst string, error string").select(key("src").alias("src"), F.when(F.col("dst").isNotNull(), key("dst")).alias("dst"), "error"))
    goals = ops.where("error is null").select("repo", F.explode("goals").alias("g")).select(key("g").alias("root")).distinct()
    reach = transitive(goals.select("root", F.col("root").alias("node")), edge.where("dst is not null").select("src", "dst"), cf.MAX_DEPTH)
    known, bad = edge.select(F.col("src").alias("node")).distinct(), edge.where("error is not null").select(F.col("src").alias("node"), F.lit(True).alias("bad")).distinct()
    broken = reach.join(known, "node", "left_anti").select("root", F.lit("missing reference").alias("why")).unionByName(reach.join(bad, "node").select("root", F.lit("reference refused").alias("why")))
    broken = broken.groupBy("root").agg(F.min("why").alias("why"))
    every = reach.groupBy("root").agg(F.collect_set(F.substring_index("node", "\x00", -1)).alias("nodes"))
    per = ops.select("repo", "rel_path", "doc_index", "position", F.explode_outer("goals").alias("g")).withColumn("root", F.when(F.col("g").isNotNull(), key("g")))
    per = per.join(broken, "root", "left").join(every, "root", "left").groupBy("repo", "rel_path", "doc_index", "position").agg(F.min("why").alias("why"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("nodes", F.array().cast("array<string>")))))).alias("closure"))
    return ops.join(per, ["repo", "rel_path", "doc_index", "position"]).withColumn("error", F.coalesce("error", "why")).drop("goals", "why")


def build_files(tree: DataFrame) -> DataFrame:
    """repo, rel_path, text of files that may say how code is generated."""
    name = F.regexp_extract("rel_path", r"([^/]*)$", 1)
    rows = outside(tree, BUILD_IGNORED).where(F.col("content").isNotNull())
    builds = name.endswith("pom.xml") | name.isin("build.gradle", "build.gradle.kts", "BUILD", "BUILD.bazel") | name.endswith(".bzl") | name.rlike(r"\.ya?ml$")
    rows = rows.where((builds & (F.col("size") <= cf.MAX_BUILD)) | (name.rlike(r"\.(go|py)$") & (F.col("size") <= cf.MAX_SOURCE) & ~F.col("rel_path").rlike(r"(^|/)tests?/|_test\.(go|py)$|(^|/)test_[^/]*\.py$")))
    return rows.select("repo", "rel_path", F.decode("content", "UTF-8").alias("text"))


def evidence_and_rejects(tree: DataFrame, tracked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Generator runs by the spec they read: repo, rel_path, build_file, tool, generator, kind, api_package, provisional, base_path, proof (the files that say so); and build files that could not be read (repo, rel_path, error)."""
    files = build_files(tree)
    starlark = F.col("rel_path").rlike(r"(^|/)(BUILD|BUILD\.bazel|[^/]*\.bzl)$")
    pom = F.col("rel_path").endswith("pom.xml")
    rows = files.where(~starlark & ~pom & F.col("text").rlike("openapi-generator|swagger-codegen|generatorName|oapi-codegen|add_api|generate|spec"))
    columns = ["tool", "generator", "kind", "spec", "api_package", "provisional", "base_path", "output", "config"]

    def parse(parts):
        for p in parts:
            out = []
            for repo, path, text in zip(p["repo"], p["rel_path"], p["text"]):
                try:
                    out += [(repo, path, *(e[c] for c in columns), None) for e in cf.evidence(text, path)]
                except (SyntaxError, ValueError, YAMLError) as e:  # malformed YAML or text: an unreadable file proves nothing, and is named
                    out.append((repo, path, "unread", *[None] * 8, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["repo", "build_file", *columns, "error"])

    found = settled(rows.mapInPandas(parse, "repo string, build_file string, tool string, generator string, kind string, spec string, api_package string, provisional boolean, base_path string, output string, config string, error string"))
    plain = found.where("tool in ('gradle', 'connexion')")
    conf = found.where("tool = 'oapi-config'").groupBy("repo", "config").agg(F.max(F.struct(F.when(F.col("kind") == "server", 2).when(F.col("kind") == "client", 1).otherwise(0).alias("r"), F.col("kind").alias("k"))).alias("c")).select("repo", "config", F.col("c.k").alias("_kind"))
    go = found.where("tool = 'go-generate'").join(conf, ["repo", "config"], "left").withColumn("kind", F.when((F.col("kind") == "server") | (F.col("_kind") == "server"), "server").otherwise(F.when(F.col("kind") == "unknown", F.coalesce("_kind", "kind")).otherwise(F.col("kind")))).drop("_kind")
    there = tree.select("repo", F.col("rel_path").alias("output")).distinct()
    if tracked is not None:
        key = ["repo", "output"] if "repo" in tracked.columns else ["output"]
        there = there.join(tracked.withColumnRenamed("rel_path", "output").select(*key), key, "left_semi")
    live = go.join(there.withColumn("_there", F.lit(True)), ["repo", "output"], "left").withColumn("provisional", F.col("_there").isNull()).select(*found.columns)
    kept = ["repo", "rel_path", "build_file", "tool", "generator", "kind", "api_package", "provisional", "base_path", "proof"]
    proofs = F.array_compact(F.array("build_file", "config"))
    out = plain.unionByName(live).where("spec is not null").withColumn("proof", proofs).withColumnRenamed("spec", "rel_path").select(kept)
    macros, unread = bazel_macros.evidence(files.where(starlark), tree)
    bazel = macros.withColumn("tool", F.lit("bazel")).withColumn("provisional", F.lit(False)).withColumn("base_path", F.lit(None).cast("string")).select(kept)
    poms, open_ = maven_parents.evidence(files.where(pom), tree)
    maven = poms.withColumn("tool", F.lit("maven")).withColumn("base_path", F.lit(None).cast("string")).select(kept)
    rejects = found.where("tool = 'unread'").select("repo", F.col("build_file").alias("rel_path"), "error").unionByName(unread).unionByName(open_)
    return by_real_path(out.unionByName(bazel).unionByName(maven), tree, kept), rejects


def by_real_path(evidence: DataFrame, tree: DataFrame, columns: list[str]) -> DataFrame:
    """evidence with specifications named through links under the path they really have; what leaves the repository or runs in circles is no evidence."""
    links = settled(tree.where("is_symlink and content is not null").select("repo", "rel_path", F.decode("content", "UTF-8").alias("target")))
    if links.isEmpty():
        return evidence
    evidence = settled(evidence)
    real = real_paths(evidence.select("repo", F.col("rel_path").alias("path")), links).where("real is not null")
    led = evidence.join(real.withColumnRenamed("path", "rel_path"), ["repo", "rel_path"]).withColumn("through", F.col("real") != F.col("rel_path")).drop("rel_path", "error").withColumnRenamed("real", "rel_path")
    there = led.where("through").join(tree.select("repo", "rel_path").distinct(), ["repo", "rel_path"], "left_semi")
    return led.where("not through").select(columns).unionByName(there.select(columns)).distinct()


def build_evidence(tree: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    return evidence_and_rejects(tree, tracked)[0]


def class_facts(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (repo, class_id, file, package, api_packages, prefixes: null if unreadable) and their methods (class_id, method, routed)."""
    java = outside(tree, CONTRACT_IGNORED).where(F.col("rel_path").endswith(".java") & F.col("content").isNotNull()).select("repo", "rel_path", F.decode("content", "UTF-8").alias("text"))
    facts = settled(extracted(java, spring_facts.extract))
    cid = F.concat_ws("\x00", "repo", "rel_path", "name")
    types = facts.where("what = 'type' and kind = 'class' and method is not null").withColumn("class_id", cid)
    imports = facts.where("what = 'import'").select("repo", "rel_path", F.col("name").alias("_s"), F.regexp_replace("target", r"\.[^.]*$", "").alias("_pkg"))
    parents = types.select("class_id", "repo", "rel_path", F.col("owner").alias("package"), F.explode(F.from_json("target", "array<string>")).alias("_full")).withColumn("_s", F.regexp_extract("_full", r"(\w+)$", 1)).join(imports, ["repo", "rel_path", "_s"], "left")
    package = F.coalesce("_pkg", F.when(F.instr("_full", ".") > 0, F.regexp_replace("_full", r"\.[^.]*$", "")).otherwise(F.col("package")))
    implemented = parents.select("class_id", package.alias("api_package")).distinct()
    prefixes = F.when(F.col("route").isNull(), None).otherwise(F.array_sort(F.from_json("route", "array<string>")))
    classes = types.select("repo", "class_id", "rel_path", F.col("pos"), prefixes.alias("prefixes")).join(implemented.groupBy("class_id").agg(F.collect_set("api_package").alias("api_packages")), "class_id", "left")
    methods = facts.where("what = 'java_method'").select(F.concat_ws("\x00", "repo", "rel_path", "owner").alias("class_id"), F.col("name").alias("method"), (F.col("kind") == "mapped").alias("routed")).groupBy("class_id", "method").agg(F.max("routed").alias("routed"))
    return classes, methods


def votes(df: DataFrame, key: list[str]) -> DataFrame:
    """key, chosen: what all prefix sets share; else the set of a strict majority; null if unreadable, or tied. df: key, prefixes (null: unreadable)."""
    n = df.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.col("prefixes").isNull()).alias("bad"))
    each = df.where("prefixes is not null").select(*key, F.explode("prefixes").alias("p")).groupBy(*key, "p").agg(F.count("*").alias("m")).join(n, key).where("m = n").groupBy(*key).agg(F.array_sort(F.collect_list("p")).alias("common"))
    sets = df.where("prefixes is not null").groupBy(*key, "prefixes").agg(F.count("*").alias("m")).groupBy(*key).agg(F.max_by("prefixes", "m").alias("top"), F.max("m").alias("m"))  # a tie has no strict majority below, so any of them will do
    out = n.join(each, key, "left").join(sets, key, "left")
    chosen = F.when(F.col("bad"), None).when(F.col("common").isNotNull(), F.col("common")).when(2 * F.col("m") > F.col("n"), F.col("top"))
    return out.select(*key, chosen.alias("chosen"), (F.col("common").isNull() & chosen.isNotNull()).alias("by_majority"))


def verdicts(docs: DataFrame, ops: DataFrame, evidence: DataFrame, classes: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdict of each contract; chosen prefixes of each operation of served ones)."""
    spec = ["repo", "rel_path"]
    contracts = docs.where("bucket = 'contracts'").select(*spec, "doc_index", "contracts_in_file")
    live = (F.col("kind") == "server") & ~F.col("provisional")
    flags = evidence.groupBy(*spec).agg(F.bool_or(F.col("kind") == "server").alias("server"), F.bool_or(live).alias("live"), F.bool_or(F.col("kind") == "client").alias("client"), F.min("base_path").alias("base_path"), F.collect_set(F.when(live, F.col("api_package"))).alias("packages"))
    ops = ops.where("error is null")
    tried = ops.select(*spec, "doc_index", "position", F.posexplode("names").alias("_k", "method_name"))
    # Names like get and list are many: they meet inside a repository only.
    owned = methods.withColumnRenamed("method", "method_name").join(classes.select("class_id", "repo"), "class_id")
    matched = tried.join(owned, ["repo", "method_name"])
    first = matched.groupBy(*spec, "doc_index", "position").agg(F.min_by("routed", F.struct("_k", "class_id")).alias("routed"))
    hits = first.groupBy(*spec, "doc_index").agg(F.count("*").alias("matched"), F.count_if(~F.col("routed")).alias("unannotated"), F.count_if("routed").alias("routed"))
    sizes = ops.groupBy(*spec, "doc_index").agg(F.count("*").alias("n_operations"))
    # Who votes on prefixes: classes that implement a live run's package and one of the contract's operations.
    implementers = flags.where("live").select(*spec, F.explode("packages").alias("api_package")).join(classes.select("repo", "class_id", F.when(F.col("prefixes").isNotNull(), F.when(F.size("prefixes") > 0, F.col("prefixes")).otherwise(F.array(F.lit("")))).alias("prefixes"), F.explode("api_packages").alias("api_package")), ["repo", "api_package"]).dropDuplicates([*spec, "class_id"]).drop("api_package")
    voting = matched.select(*spec, "doc_index", "position", "class_id").distinct().join(implementers, [*spec, "class_id"])
    own = votes(voting, [*spec, "doc_index", "position"])
    voters = voting.select(*spec, "class_id").distinct()
    pool = implementers.join(voters, [*spec, "class_id"], "left_semi").unionByName(implementers.join(voters.select(*spec).distinct(), spec, "left_anti"))
    default = votes(pool, spec).select(*spec, F.col("chosen").alias("default"), F.lit(True).alias("_pool"))
    served = contracts.join(flags, spec).where("live and contracts_in_file = 1")
    per = ops.join(served.select(*spec, "doc_index", "base_path"), [*spec, "doc_index"]).join(own.withColumn("_own", F.lit(True)), [*spec, "doc_index", "position"], "left").join(default, spec, "left")
    plain = F.array(F.coalesce("base_path", F.lit("")))
    per = per.withColumn("prefixes", F.when(F.col("_own"), F.col("chosen")).when(F.col("_pool"), F.col("default")).otherwise(plain))
    known = per.groupBy(*spec, "doc_index").agg(F.count_if(F.col("prefixes").isNotNull()).alias("with_prefix"), F.count_if(F.col("prefixes").isNull()).alias("without_prefix"))
    v = contracts.join(flags, spec, "left").join(hits, [*spec, "doc_index"], "left").join(sizes, [*spec, "doc_index"], "left").join(known, [*spec, "doc_index"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    no = lambda c: F.coalesce(F.col(c), F.lit(0))
    cases = [
        ((yes("server") | yes("client")) & (F.col("contracts_in_file") > 1), "excluded", "multi_document_ambiguity"),
        (yes("server") & ~yes("live") & ~yes("client"), "candidate", "provisional_evidence"),
        (yes("live") & (no("n_operations") > 0) & (no("with_prefix") == 0), "excluded", "unresolved_prefix"),
        (yes("live"), "served", "live_server"),
        (yes("client"), "excluded", "client_generator"),
        ((no("routed") > 0) & (no("unannotated") == 0), "excluded", "covers_routed_handlers"),
        (no("unannotated") > 0, "candidate", "no_server_evidence"),
    ]
    status, reason = F, F
    for when, a, b in cases:
        status, reason = status.when(when, a), reason.when(when, b)
    v = v.withColumn("status", status.otherwise("excluded")).withColumn("reason", reason.otherwise("no_server_evidence"))
    return v.select(*spec, "doc_index", "status", "reason", no("n_operations").alias("operations"), no("matched").alias("matched"), no("without_prefix").alias("without_prefix")), per.where("prefixes is not null").select(*spec, "doc_index", "position", "prefixes")


def hashes(tree: DataFrame, ops: DataFrame, evidence: DataFrame) -> DataFrame:
    """repo, rel_path, eligibility (spec, proof and closure files with their contents), payload (operations)."""
    spec = ["repo", "rel_path"]
    closure = ops.select(*spec, F.explode("closure").alias("k")).select(*spec, F.substring_index("k", "#", 1).alias("file"))
    proof = evidence.select(*spec, F.explode("proof").alias("file"))
    files = ops.select(*spec, F.col("rel_path").alias("file")).unionByName(closure).unionByName(proof).distinct()
    held = files.join(tree.where("content is not null and not is_symlink").select("repo", F.col("rel_path").alias("file"), F.sha2("content", 256).alias("h")), ["repo", "file"])
    eligibility = held.groupBy(*spec).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "file", "h"))), "\n"), 256).alias("eligibility"))
    payload = ops.where("error is null").groupBy(*spec).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\x00", "method", "spec_path", "operation"))), "\n"), 256).alias("payload"))
    return eligibility.join(payload, spec, "left")


def apply_overrides(v: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """overrides (repo, rel_path, action, eligibility_hash, prefix): an exclude always holds; an include lifts a candidate whose hash is unchanged. The report names every override's state.

    An entry speaks of its own repository; a table without the column repo, of every one.
    """
    key = ["repo", "rel_path"] if "repo" in overrides.columns else ["rel_path"]
    # The last entry of a path counts, in the order of the file.
    o = overrides.withColumn("_pos", F.monotonically_increasing_id()).groupBy(*key).agg(F.max(F.col("action") == "exclude").alias("_ex"), F.max_by("eligibility_hash", "_pos").alias("_h"), F.max_by("prefix", "_pos").alias("_p")).withColumn("_has", F.lit(True))
    j = v.join(o, key, "left")
    has = F.coalesce("_has", F.lit(False))
    include = has & ~F.col("_ex") & (F.col("status") == "candidate")
    state = F.when(has & F.col("_ex"), "applied").when(include & (F.col("_h") == F.col("eligibility")), "applied").when(include, "dormant").when(has & (F.col("status") == "excluded"), "inapplicable").when(has, "redundant")
    j = j.withColumn("_state", state)
    status = F.when(has & F.col("_ex"), "excluded").when(include & (F.col("_state") == "applied"), "served").otherwise(F.col("status"))
    reason = F.when(has & F.col("_ex"), "override_exclude").when(include & (F.col("_state") == "applied"), "override_include").otherwise(F.col("reason"))
    out = j.withColumn("reason", reason).withColumn("override_prefix", F.when(F.col("reason") == "override_include", F.coalesce("_p", F.lit("")))).withColumn("status", status)
    report = out.where(has).select(*key, F.when(F.col("_ex"), "exclude").otherwise("include").alias("action"), F.col("_state").alias("state"))
    lost = overrides.join(v.select(*key), key, "left_anti").groupBy(*key).agg(F.max("action").alias("action")).withColumn("state", F.lit("unmatched"))
    return out.drop("_ex", "_h", "_p", "_has", "_state"), report.unionByName(lost)


def reconcile(contract: DataFrame, code: DataFrame) -> dict[str, DataFrame]:
    """contract (repo, rel_path, method, route, operation), code (repo, method, route, conditions, ...): per route shape one winner.

    operations: winners with the losers of other specs as conflict and the
    conditions of the first handler they replace; superseded and to_generate:
    code rows with and without a contract.
    """
    shape = lambda df: df.withColumn("method", F.upper("method")).withColumn("shape", s.shape(F.col("route")))
    c, k = shape(contract), shape(code)
    c = c.withColumn("source_id", F.concat(F.lit("spec:"), "rel_path", F.lit("#"), F.lower("method"), F.lit(" "), "route"))
    key = ["repo", "method", "shape"]
    won = c.groupBy(*key).agg(F.min(F.struct("source_id", "rel_path", "route", "operation")).alias("w"), F.collect_set(F.struct("source_id", "rel_path")).alias("all"))
    lost = F.array_sort(F.transform(F.filter("all", lambda x: x["rel_path"] != F.col("w.rel_path")), lambda x: x["source_id"]))
    conditions = k.where("conditions is not null").groupBy(*key).agg(F.min_by("conditions", F.struct("rel_path", "start_line")).alias("conditions"))
    ops = won.select(*key, F.col("w.route").alias("route"), F.col("w.source_id").alias("source_id"), F.col("w.operation").alias("operation"), lost.alias("conflict")).join(conditions, key, "left")
    keys = c.select(*key).distinct()
    return {"operations": ops, "superseded": k.join(keys, key, "left_semi"), "to_generate": k.join(keys, key, "left_anti")}


def run_lane(tree: DataFrame, overrides: DataFrame | None = None, tracked: DataFrame | None = None, max_bytes: int = cf.MAX_BYTES, max_document: int = cf.MAX_DOCUMENT) -> dict[str, DataFrame]:
    """docs, operations, evidence, verdicts, rows (one a served operation and prefix), overrides, components, unread build files."""
    docs = settled(with_fragments(tree, settled(discover(tree, max_bytes=max_bytes, max_document=max_document)), max_document=max_document))
    ops = settled(loaded_operations(docs))
    evidence, unread = evidence_and_rejects(tree, tracked)
    evidence = settled(evidence)
    classes, methods = class_facts(tree)
    v, prefixes = verdicts(docs, ops, evidence, settled(classes), settled(methods))
    v = v.join(hashes(tree, ops, evidence), ["repo", "rel_path"], "left")
    empty = tree.sparkSession.createDataFrame([], "rel_path string, action string, eligibility_hash string, prefix string")
    v, report = apply_overrides(settled(v), empty if overrides is None else overrides)
    v, prefixes = settled(v), settled(prefixes)
    key = ["repo", "rel_path", "doc_index"]
    good = ops.where("error is null").join(v.where("status = 'served'").select(*key, "override_prefix"), key).join(prefixes, [*key, "position"], "left")
    good = good.withColumn("prefixes", F.when(F.col("override_prefix").isNotNull(), F.array("override_prefix")).otherwise(F.col("prefixes"))).where("prefixes is not null")
    rows = good.select("repo", "rel_path", "position", "method", F.explode("prefixes").alias("prefix"), "spec_path", "operation", "closure")
    rows = rows.withColumn("route", s.join_route(F.col("prefix"), F.col("spec_path"))).dropDuplicates(["repo", "rel_path", "method", "route"])
    parts = components(docs, rows)
    return {"docs": docs, "operations": ops, "evidence": evidence, "verdicts": v, "rows": rebased(rows), "overrides": report, "components": parts, "unread": unread}


def components(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """repo, category, name, body: what the published rows refer to, directly or through one another, under names that carry their file's."""
    wanted = rows.select("repo", F.explode("closure").alias("k")).distinct().select("repo", F.substring_index("k", "#", 1).alias("rel_path"), F.substring_index("k", "#", -1).alias("pointer"))
    asked = wanted.groupBy("repo", "rel_path").agg(F.array_sort(F.collect_set("pointer")).alias("pointers"))

    def cut(parts):
        for p in parts:
            out = []
            for repo, path, doc, pointers in zip(p["repo"], p["rel_path"], p["doc"], p["pointers"]):
                for where in pointers:
                    category, name = cf.component(f"{path}#{where}")
                    out.append((repo, category, name, json.dumps(cf.rebased(cf.pointer(json.loads(doc), where), path))))
            yield pd.DataFrame(out, columns=["repo", "category", "name", "body"])

    return docs.where("doc is not null and doc_index = 0").join(asked, ["repo", "rel_path"]).select("repo", "rel_path", "doc", "pointers").mapInPandas(cut, "repo string, category string, name string, body string")


def rebased(rows: DataFrame) -> DataFrame:
    """rows with the references of their operations led to the published components."""

    def run(parts):
        for p in parts:
            yield p.assign(operation=[json.dumps(cf.rebased(json.loads(o), path)) for o, path in zip(p["operation"], p["rel_path"])])

    return rows.mapInPandas(run, rows.schema)
