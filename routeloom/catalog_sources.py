"""Registered queries of the extraction lanes: source trees written out of the driver tables, a route for each customer, and SQL that names every route.

A tree has one repository; each nation is a file (or a folder) of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query, table
from .operators.closure import settled
from .plans import code_lane, contract_lane, inlining, maven_parents, syntax
from .plans.incremental import keyed
from .plans.origins import origins

_VERBS = ("get", "post", "put", "delete")
_SQL_VERB = "CASE c_custkey % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END"


def _customers(spark, sf_dir) -> DataFrame:
    """k: the nation; key, verb: of each customer, as text."""
    verb = F.get(F.array(*map(F.lit, _VERBS)), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("k"), F.col("c_custkey").alias("pos"), F.col("c_custkey").cast("string").alias("key"), verb.alias("verb"))


def _said(pattern: str):
    """A text with <k>, <key>, <verb>, <VERB> and <Verb> filled in."""
    out = F.lit(pattern)
    for mark, value in (("<k>", F.col("k")), ("<key>", F.col("key")), ("<verb>", F.col("verb")), ("<VERB>", F.upper("verb")), ("<Verb>", F.initcap("verb"))):
        if mark in pattern:
            out = F.replace(out, F.lit(mark), value)
    return out


def _body(rows: DataFrame, line: str, mark: str = "") -> DataFrame:
    """k, body: a line for each customer of k, in order; a block of lines first, so no group of customers is sorted whole."""
    blocks = rows.groupBy("k", F.floor(F.col("pos") / 4096).alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", _said(line).alias("line")))), lambda x: x["line"]), mark).alias("t"))
    return blocks.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "t"))), lambda x: x["t"]), mark).alias("body"))


def _written(rows: DataFrame, language: str, path: str, head: str, line: str, foot: str = "", mark: str = "") -> DataFrame:
    """A file for each nation: head, a line for each customer in order, foot."""
    body = _body(rows, line, mark)
    text = F.concat(_said(head), F.col("body"), _said(foot))
    return body.select(F.lit("repo").alias("repo"), _said(path).alias("rel_path"), F.lit(language).alias("language"), text.alias("text"))


def _all(rows: DataFrame, language: str, path: str, head: str, line: str, foot: str) -> DataFrame:
    """One file with a line for each nation."""
    body = rows.select("k").distinct().agg(F.array_join(F.array_sort(F.collect_list(_said(line))), "").alias("body"))
    return body.select(F.lit("repo").alias("repo"), F.lit(path).alias("rel_path"), F.lit(language).alias("language"), F.concat(F.lit(head), "body", F.lit(foot)).alias("text"))


def _routes(files: DataFrame) -> DataFrame:
    # Written first: a lane reads its files several times; few large files are dealt to all cores.
    return keyed(code_lane.code_endpoints(settled(files.repartition(files.sparkSession.sparkContext.defaultParallelism)))[0]).select("key", "rel_path")


@query(f"SELECT {_SQL_VERB} || ' /n' || c_nationkey || '/c/{{id}}/' || c_custkey AS key, 'n' || c_nationkey || '.py' AS rel_path FROM customer")
def flask_routes(spark, sf_dir):
    return _routes(_written(_customers(spark, sf_dir), "python", "n<k>.py", "from flask import Blueprint\nbp = Blueprint('b', __name__, url_prefix='/n<k>')\n", "\n@bp.route('/c/<int:id>/<key>', methods=['<VERB>'])\ndef f<key>(id):\n    return 'é'\n"))


@query(f"SELECT {_SQL_VERB} || ' /v' || c_nationkey || '/c/{{id}}/' || c_custkey AS key, 'api/v' || c_nationkey || '.py' AS rel_path FROM customer")
def fastapi_routes(spark, sf_dir):
    return _routes(_written(_customers(spark, sf_dir), "python", "api/v<k>.py", "from fastapi import APIRouter\nrouter = APIRouter(prefix='/v<k>')\n", "\n@router.<verb>('/c/{id}/<key>')\nasync def f<key>(id: int):\n    pass\n"))


@query("SELECT 'GET /n' || c_nationkey || '/c/{pk}/' || c_custkey || '/' AS key, 'n' || c_nationkey || '/views.py' AS rel_path FROM customer")
def django_routes(spark, sf_dir):
    c = _customers(spark, sf_dir)
    root = _all(c, "python", "site/urls.py", "from django.urls import include, path\nurlpatterns = [\n", "    path('n<k>/', include('n<k>.urls')),\n", "]\n")
    urls = _written(c, "python", "n<k>/urls.py", "from django.urls import path\nfrom n<k> import views\nurlpatterns = [\n", "    path('c/<int:pk>/<key>/', views.show<key>),\n", "]\n")
    views = _written(c, "python", "n<k>/views.py", "", "def show<key>(request, pk):\n    return None\n\n")
    return _routes(root.unionByName(urls).unionByName(views))


@query(f"SELECT {_SQL_VERB} || ' /n' || c_nationkey || '/c/{{id}}/' || c_custkey AS key, 'routes/n' || c_nationkey || '.js' AS rel_path FROM customer UNION ALL SELECT {_SQL_VERB} || ' /again/' || c_nationkey || '/c/{{id}}/' || c_custkey, 'routes/n' || c_nationkey || '.js' FROM customer")
def express_routes(spark, sf_dir):
    """Each router is mounted twice."""
    c = _customers(spark, sf_dir)
    app = _all(c, "nodejs", "app.js", "const express = require('express');\nconst app = express();\n", "app.use('/n<k>', require('./routes/n<k>'));\napp.use('/again/<k>', require('./routes/n<k>'));\n", "")
    routes = _written(c, "nodejs", "routes/n<k>.js", "const router = require('express').Router();\n// router.get('/not/this', x);\n", "router.<verb>('/c/:id(\\\\d+(-\\\\d+)?)/<key>', show);\n", "module.exports = router;\n")
    return _routes(app.unionByName(routes))


@query(f"SELECT {_SQL_VERB} || ' /n' || c_nationkey || '/c/{{id}}/' || c_custkey AS key, 'src/n' || c_nationkey || '.controller.ts' AS rel_path FROM customer")
def nest_routes(spark, sf_dir):
    return _routes(_written(_customers(spark, sf_dir), "nodejs", "src/n<k>.controller.ts", "import { Controller } from '@nestjs/common';\n@Controller('n<k>')\nexport class N<k>Controller {\n", "  @<Verb>('c/:id/<key>')\n  f<key>() { return 1; }\n", "}\n"))


@query(f"SELECT {_SQL_VERB} || ' /n' || c_nationkey || '/c/{{id}}/' || c_custkey AS key, 'h' || c_nationkey || '.go' AS rel_path FROM customer")
def go_routes(spark, sf_dir):
    """Groups and calls in one file, handlers in another of the folder."""
    c = _customers(spark, sf_dir)
    calls = _written(c, "golang", "r<k>.go", "package main\n\nfunc routes<k>(r *gin.Engine) {\n\tv := r.Group(\"/n<k>\")\n", "\tv.<VERB>(\"/c/:id/<key>\", h<key>)\n", "}\n")
    return _routes(calls.unionByName(_written(c, "golang", "h<k>.go", "package main\n\n", "func h<key>(c *gin.Context) {\n\tc.JSON(200, nil)\n}\n\n")))


@query(f"""WITH p(a, b) AS (VALUES ('/v', '/in'), ('/again/', '/in/deep')) SELECT {_SQL_VERB} || ' ' || a || c_custkey // 200 || b || '/c/{{id}}/' || c_custkey AS key, 'routes/h' || c_custkey // 200 || '.go' AS rel_path FROM customer, p""")
def go_routes_across_files(spark, sf_dir):
    """A file for each 200 customers; its router comes from two callers of other folders, once through a function between them that also calls itself."""
    c = _customers(spark, sf_dir).withColumn("k", F.floor(F.col("pos") / 200).cast("string"))
    files = c.select("k").distinct()
    file = lambda path, text: files.select(F.lit("repo").alias("repo"), _said(path).alias("rel_path"), F.lit("golang").alias("language"), _said(text).alias("text"))
    main = file("cmd/m<k>.go", 'package main\n\nfunc main<k>() {\n\tr := gin.Default()\n\tv := r.Group("/v<k>")\n\tmiddle.Pass<k>(1, v)\n\tg := r.Group("/again/<k>")\n\troutes.Routes<k>(g.Group("/in/deep"), nil)\n}\n')
    between = file("middle/p<k>.go", 'package middle\n\nfunc Pass<k>(n int, router *gin.RouterGroup) {\n\tinner := router.Group("/in")\n\troutes.Routes<k>(inner, nil)\n\tPass<k>(n, inner)\n}\n')
    calls = _written(c, "golang", "routes/r<k>.go", "package routes\n\nfunc Routes<k>(g *gin.RouterGroup, db *sql.DB) {\n\tc := g.Group(\"/c\")\n", "\tc.<VERB>(\"/:id/<key>\", h<key>)\n", "}\n")
    return _routes(main.unionByName(between).unionByName(calls).unionByName(_written(c, "golang", "routes/h<k>.go", "package routes\n\n", "func h<key>(c *gin.Context) {\n\tc.JSON(200, nil)\n}\n\n")))


@query(f"SELECT {_SQL_VERB} || ' /n' || c_nationkey || '/c/{{id}}/' || c_custkey AS key, 'j/N' || c_nationkey || 'Controller.java' AS rel_path FROM customer")
def spring_routes(spark, sf_dir):
    """Mappings stand on an interface; the controller that implements it adds its own prefix by none."""
    c = _customers(spark, sf_dir)
    api = _written(c, "java", "j/N<k>Api.java", "package j;\npublic interface N<k>Api {\n", "  @<Verb>Mapping(\"/n<k>/c/{id}/<key>\")\n  String f<key>(String id);\n", "}\n")
    own = _written(c, "java", "j/N<k>Controller.java", "package j;\n@RestController\npublic class N<k>Controller implements N<k>Api {\n", "  public String f<key>(String id) { return null; }\n", "}\n")
    return _routes(api.unionByName(own))


@query(f"SELECT {_SQL_VERB} || ' /n/' || c_nationkey || '/{{id}}/' || c_custkey AS key, 'app/controllers/' || CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey || '_controller.rb' ELSE 'base_controller.rb' END AS rel_path FROM customer")
def rails_routes(spark, sf_dir):
    """Half of the actions are inherited; a route file for each nation."""
    c = _customers(spark, sf_dir)
    routes = _written(c, "ruby_on_rails", "config/routes/n<k>.rb", "Rails.application.routes.draw do\n", "  <verb> '/n/<k>/:id/<key>', to: 'n<k>#a<key>'\n", "end\n")
    own = _written(c.where("pos % 2 = 0"), "ruby_on_rails", "app/controllers/n<k>_controller.rb", "class N<k>Controller < BaseController\n", "  def a<key>\n    1\n  end\n\n", "end\n")
    bare = c.select("k").distinct().join(c.where("pos % 2 = 0").select("k").distinct(), "k", "left_anti").select(F.lit("repo").alias("repo"), _said("app/controllers/n<k>_controller.rb").alias("rel_path"), F.lit("ruby_on_rails").alias("language"), _said("class N<k>Controller < BaseController\nend\n").alias("text"))
    odd = c.where("pos % 2 = 1").withColumn("k", F.lit("base"))
    base = _written(odd, "ruby_on_rails", "app/controllers/base_controller.rb", "class BaseController\n", "  def a<key>\n    2\n  end\n\n", "end\n")
    return _routes(routes.unionByName(own).unionByName(bare).unionByName(base))


# --- contracts -----------------------------------------------------------------------------------

#: A build file for each way to prove a server, and one that proves a client only.
_PROOFS = {
    "0": ("pom.xml", "<project><build><plugins><plugin><artifactId>openapi-generator-maven-plugin</artifactId><configuration><generatorName>spring</generatorName><inputSpec>${project.basedir}/src/api.json</inputSpec></configuration></plugin></plugins></build></project>"),
    "1": ("build.gradle", "openApiGenerate {\n  // generatorName = \"go\"\n  generatorName = \"spring\"\n  inputSpec = \"$rootDir/src/api.json\"\n}\n"),
    "2": ("BUILD", "genrule(\n  cmd = \"generate -g spring -i $(location src/api.json)\", # -g go\n)\n"),
    "3": ("app.py", "app = connexion.App(__name__, specification_dir='src/')\napp.add_api('api.json', base_path='/base')\n"),
    "4": ("pom.xml", "<project><build><plugins><plugin><artifactId>openapi-generator-maven-plugin</artifactId><configuration><generatorName>java</generatorName><inputSpec>src/api.json</inputSpec></configuration></plugin></plugins></build></project>"),
}


def _contracts(spark, sf_dir) -> DataFrame:
    """A repository for each nation: a specification with an operation for each customer, and what proves who serves it."""
    c = _customers(spark, sf_dir)
    body = _body(c, '"/c/{id}/<key>": {"<verb>": {"operationId": "op<key>", "responses": {"200": {"$ref": "#/components/responses/R"}}}}', ", ")
    text = F.concat(F.lit('{"openapi": "3.0.1", "paths": {'), F.col("body"), F.lit('}, "components": {"responses": {"R": {"content": {"$ref": "#/components/schemas/S"}}}, "schemas": {"S": {"$ref": "#/components/schemas/S"}}}}'))
    files = body.select("k", F.lit("src/api.json").alias("rel_path"), text.alias("text"))
    which = F.create_map(*(F.lit(x) for k, (path, _) in _PROOFS.items() for x in (k, path))), F.create_map(*(F.lit(x) for k, (_, t) in _PROOFS.items() for x in (k, t)))
    fifth = (F.col("k").cast("int") % 5).cast("string")
    proofs = body.select("k", which[0][fifth].alias("rel_path"), which[1][fifth].alias("text"))
    content = F.encode("text", "UTF-8")
    return settled(files.unionByName(proofs).select(F.concat(F.lit("n"), "k").alias("repo"), "rel_path", content.alias("content"), F.octet_length("text").cast("long").alias("size"), F.lit(False).alias("is_symlink")))


def _lane(spark, sf_dir) -> dict[str, DataFrame]:
    # From some 180,000 customers a nation on, a specification is larger than the lane takes by itself.
    return contract_lane.run_lane(_contracts(spark, sf_dir), max_bytes=1 << 31, max_document=1 << 31)


@query(f"""SELECT 'n' || c_nationkey AS repo, {_SQL_VERB} AS method, CASE WHEN c_nationkey % 5 = 3 THEN '/base' ELSE '' END || '/c/{{id}}/' || c_custkey AS route, '#/components/responses/src_api_R' AS ref FROM customer WHERE c_nationkey % 5 <> 4""")
def contract_routes(spark, sf_dir):
    """Operations of every specification that some build file proves to be served, their references led to published components."""
    rows = _lane(spark, sf_dir)["rows"]
    return rows.select("repo", "method", "route", F.regexp_extract("operation", r'"\$ref": "([^"]*)"', 1).alias("ref"))


@query("""SELECT 'n' || c_nationkey AS repo, CASE WHEN c_nationkey % 5 = 4 THEN 'excluded' ELSE 'served' END AS status, CASE WHEN c_nationkey % 5 = 4 THEN 'client_generator' ELSE 'live_server' END AS reason, count(*) AS operations FROM customer GROUP BY c_nationkey""")
def contract_verdicts(spark, sf_dir):
    v = _lane(spark, sf_dir)["verdicts"]
    return v.select("repo", "status", "reason", F.col("operations").cast("long").alias("operations"))


@query("""WITH n AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey % 5 <> 4) SELECT 'n' || k AS repo, 'responses' AS category, 'src_api_R' AS name, '{"content": {"$ref": "#/components/schemas/src_api_S"}}' AS body FROM n UNION ALL SELECT 'n' || k, 'schemas', 'src_api_S', '{"$ref": "#/components/schemas/src_api_S"}' FROM n""")
def contract_components(spark, sf_dir):
    """What published operations refer to, directly or through one another, under the names they are published by."""
    return _lane(spark, sf_dir)["components"]


@query("""SELECT 'n' || c_nationkey AS repo, CASE c_nationkey % 5 WHEN 0 THEN 'maven' WHEN 1 THEN 'gradle' WHEN 2 THEN 'bazel' WHEN 3 THEN 'connexion' ELSE 'maven' END AS tool, CASE c_nationkey % 5 WHEN 3 THEN 'connexion' WHEN 4 THEN 'java' ELSE 'spring' END AS generator, CASE WHEN c_nationkey % 5 = 4 THEN 'client' ELSE 'server' END AS kind, 'src/api.json' AS rel_path FROM (SELECT DISTINCT c_nationkey FROM customer)""")
def build_evidence(spark, sf_dir):
    return contract_lane.build_evidence(_contracts(spark, sf_dir)).select("repo", "tool", "generator", "kind", "rel_path")


@query("""SELECT 'n' || c_nationkey AS repo, 'm/c' || c_custkey || '/pom.xml' AS build_file, CASE WHEN c_custkey % 3 = 0 THEN 'm/own' ELSE 'm/shared' END || '/v' || c_nationkey || '.yaml' AS rel_path, 'g.p' || c_nationkey || '.c' || c_custkey AS api_package, 'm/c' || c_custkey || '/pom.xml,m/pom.xml,pom.xml' AS proof FROM customer""")
def maven_parents_chain(spark, sf_dir):
    """A module for each customer of a nation's repository; its parent and that one's parent complete the input, every third module sets one property itself."""
    c = _customers(spark, sf_dir)
    project = lambda body: F.concat(F.lit("<project xmlns='http://maven.apache.org/POM/4.0.0'>"), body, F.lit("</project>"))
    top = _said("<groupId>g</groupId><artifactId>top</artifactId><version>1</version><properties><dir>shared</dir><pkg>g.p<k></pkg></properties>")
    middle = _said("<parent><groupId>g</groupId><artifactId>top</artifactId><version>1</version></parent><artifactId>middle</artifactId><properties><spec>${dir}/v<k>.yaml</spec></properties>")
    leaf = _said("<parent><groupId>g</groupId><artifactId>middle</artifactId><version>1</version></parent><artifactId>c<key></artifactId><OWN><build><plugins><plugin><artifactId>openapi-generator-maven-plugin</artifactId><configuration><generatorName>spring</generatorName><inputSpec>${project.parent.basedir}/${spec}</inputSpec><apiPackage>${pkg}.${project.artifactId}</apiPackage></configuration></plugin></plugins></build>")
    leaf = F.replace(leaf, F.lit("<OWN>"), F.when(F.col("pos") % 3 == 0, F.lit("<properties><dir>own</dir></properties>")).otherwise(F.lit("")))
    nations = c.select("k").distinct()
    file = lambda df, path, text: df.select(F.concat(F.lit("n"), "k").alias("repo"), path.alias("rel_path"), text.alias("text"))
    files = file(c, _said("m/c<key>/pom.xml"), project(leaf)).unionByName(file(nations, F.lit("m/pom.xml"), project(middle))).unionByName(file(nations, F.lit("pom.xml"), project(top)))
    specs = nations.select("k", F.explode(F.array(F.lit("own"), F.lit("shared"))).alias("d")).select(F.concat(F.lit("n"), "k").alias("repo"), F.concat(F.lit("m/"), "d", F.lit("/v"), "k", F.lit(".yaml")).alias("rel_path"))
    found, _ = maven_parents.evidence(settled(files), specs)
    return found.select("repo", "build_file", "rel_path", "api_package", F.array_join("proof", ",").alias("proof"))


# --- syntax nodes and what joins make of them -----------------------------------------------------


def _sources(spark, sf_dir) -> DataFrame:
    """A file of each language for each 200 customers: a function for each of them that calls another."""
    c = _customers(spark, sf_dir).withColumn("k", F.floor(F.col("pos") / 200).cast("string"))
    parts = [
        _written(c, "nodejs", "n<k>.js", "const a<k> = require('./m<k>');\n", "function f<key>(x) {\n  return g<key>(x, 'it(');\n}\n"),
        _written(c, "java", "C<k>.java", "package p;\nimport q.R<k>;\nclass C<k> {\n", "  String f<key>(String x) {\n    return g<key>(x); // h(x)\n  }\n", "}\n"),
        _written(c, "golang", "m<k>.go", "package p\nimport \"m<k>\"\n", "func f<key>(x string) {\n\tg<key>(x)\n}\n"),
        _written(c, "ruby_on_rails", "c<k>.rb", "require 'm<k>'\nclass C<k>\n", "  def f<key>(x)\n    g<key>(x)\n  end\n", "end\n"),
        _written(c, "python", "p<k>.py", "import m<k>\n", "def f<key>(x):\n    return (\n        g<key>(x))\n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return settled(out)


#: Each customer's place in its file; languages with their file, the lines before the first function, and its kind.
_PLACES = """c AS (SELECT c_custkey AS key, c_custkey // 200 AS k, row_number() OVER (PARTITION BY c_custkey // 200 ORDER BY c_custkey) AS i FROM customer),
l(language, before, after, lead, kind, inner_line) AS (VALUES ('nodejs', 'n', '.js', 1, 'function', 1), ('java', 'C', '.java', 3, 'method', 1), ('golang', 'm', '.go', 2, 'function', 1), ('ruby_on_rails', 'c', '.rb', 2, 'function', 1), ('python', 'p', '.py', 1, 'function', 2)),
f AS (SELECT k, count(*) AS n FROM c GROUP BY k)"""


@query(f"""WITH {_PLACES} SELECT language, before || k || after AS rel_path, kind, 'f' || key AS name, CAST(lead + 3 * i - 2 AS INTEGER) AS start_line, CAST(lead + 3 * i AS INTEGER) AS end_line FROM c, l
UNION ALL SELECT language, before || k || after, 'class', 'C' || k, lead::INTEGER, CAST(lead + 3 * n + 1 AS INTEGER) FROM f, l WHERE language IN ('java', 'ruby_on_rails')
UNION ALL SELECT language, before || k || after, CASE language WHEN 'nodejs' THEN 'variable' ELSE 'module' END, CASE language WHEN 'nodejs' THEN 'a' || k ELSE 'p' END, 1, 1 FROM f, l WHERE language IN ('nodejs', 'golang')""")
def source_symbols(spark, sf_dir):
    """Classes, functions, methods and variables of five languages with their lines."""
    return syntax.metadata(_sources(spark, sf_dir))["symbols"].select("language", "rel_path", "kind", "name", "start_line", "end_line")


@query(f"""WITH {_PLACES} SELECT language, before || k || after AS rel_path, 'g' || key AS target, CAST(lead + 3 * i - 2 + inner_line AS INTEGER) AS start_line, CASE WHEN language <> 'python' THEN 'f' || key END AS caller FROM c, l
UNION ALL SELECT 'nodejs', 'n' || k || '.js', 'require', 1, NULL FROM f""")
def source_calls(spark, sf_dir):
    """Calls and the innermost symbol around each."""
    return syntax.metadata(_sources(spark, sf_dir))["calls"].select("language", "rel_path", "target", "start_line", "caller")


@query(f"""WITH {_PLACES} SELECT language, before || k || after AS rel_path, CASE language WHEN 'nodejs' THEN './m' WHEN 'java' THEN 'q.R' ELSE 'm' END || k AS module FROM f, l""")
def source_imports(spark, sf_dir):
    return syntax.metadata(_sources(spark, sf_dir))["imports"].select("language", "rel_path", "module")


@query("""WITH f AS (SELECT count(DISTINCT c_custkey // 200) AS files, count(*) AS lines FROM customer),
n(language, kind, per_line, per_file) AS (VALUES ('nodejs', 'file', 0, 1), ('nodejs', 'word', 6, 3), ('nodejs', 'mark', 2, 2), ('nodejs', 'paren', 2, 1), ('nodejs', 'string', 1, 1), ('nodejs', 'brace', 1, 0), ('ruby_on_rails', 'file', 0, 1), ('ruby_on_rails', 'word', 4, 2), ('ruby_on_rails', 'paren', 2, 0), ('ruby_on_rails', 'string', 0, 1), ('ruby_on_rails', 'block', 1, 1))
SELECT language, kind, per_line * lines + per_file * files AS n FROM f, n""")
def syntax_nodes(spark, sf_dir):
    return syntax.nodes(_sources(spark, sf_dir).where("language in ('nodejs', 'ruby_on_rails')")).groupBy("language", "kind").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT DISTINCT c_custkey // 200 AS k FROM customer) SELECT 'java' AS language, 'src/main/java/p/Use' || k || '.java' AS rel_path, 'q.R' || k || '.Inner' AS module, 'mod' || k || '/src/main/java/q/R' || k || '.java' AS origin FROM f
UNION ALL SELECT 'golang', 'cmd/m' || k || '.go', 'example.com/x/internal/db' || k, 'internal/db' || k || '/a.go' FROM f UNION ALL SELECT 'ruby_on_rails', 'app/u' || k || '.rb', 'shop/cart' || k, 'lib/shop/cart' || k || '.rb' FROM f
UNION ALL SELECT 'ruby_on_rails', 'app/u' || k || '.rb', 'lib/shop/cart' || k, 'lib/shop/cart' || k || '.rb' FROM f UNION ALL SELECT 'python', 'app/u' || k || '.py', 'core.m' || k, 'app/core/m' || k || '/__init__.py' FROM f""")
def import_origins_of_languages(spark, sf_dir):
    """Dotted names under source roots that nobody declares, Go packages behind a module's name, Ruby's load path and relative names."""
    k = _customers(spark, sf_dir).select(F.floor(F.col("pos") / 200).cast("string").alias("k")).distinct()
    file = lambda language, path, text: k.select(F.lit("repo").alias("repo"), _said(path).alias("rel_path"), F.lit(language).alias("language"), _said(text).alias("text"))
    files = [
        file("java", "src/main/java/p/Use<k>.java", "package p;\nimport q.R<k>.Inner;\nimport java.util.List;\nclass Use<k> { }\n"),
        file("java", "mod<k>/src/main/java/q/R<k>.java", "package q;\nclass R<k> { }\n"),
        file("golang", "cmd/m<k>.go", "package main\nimport (\n\t\"fmt\"\n\t\"example.com/x/internal/db<k>\"\n)\n"),
        file("golang", "internal/db<k>/b.go", "package db\n"),
        file("golang", "internal/db<k>/a.go", "package db\n"),
        file("ruby_on_rails", "app/u<k>.rb", "require 'shop/cart<k>'\nrequire_relative '../lib/shop/cart<k>'\nrequire 'json'\n"),
        file("ruby_on_rails", "lib/shop/cart<k>.rb", "class Cart\nend\n"),
        file("python", "app/u<k>.py", "import os\nfrom core.m<k> import a\n"),
        file("python", "app/core/m<k>/__init__.py", "a = 1\n"),
        file("python", "deep/er/app/core/m<k>.py", "a = 2\n"),
    ]
    every = files[0]
    for f in files[1:]:
        every = every.unionByName(f)
    every = settled(every)
    return origins(syntax.metadata(every)["imports"], every).select("language", "rel_path", "module", "origin")


@query("""WITH r AS (SELECT r_regionkey AS k, '{"name": "' || r_name || '"}' AS body FROM region), n AS (SELECT n_nationkey AS k, '{"name": "' || n_name || '", "in": [' || body || ']}' AS body FROM nation JOIN r ON n_regionkey = r.k),
c AS (SELECT c_custkey AS k, '{"nation": ' || body || ', "of": "' || c_custkey || '"}' AS body FROM customer JOIN n ON c_nationkey = n.k), o AS (SELECT o_orderkey AS k, '{"customer": ' || body || '}' AS body FROM orders JOIN c ON o_custkey = c.k)
SELECT '#/r/' || k AS key, 0 AS level, md5(body) AS digest, NULL AS error FROM r UNION ALL SELECT '#/n/' || k, 1, md5(body), NULL FROM n UNION ALL SELECT '#/c/' || k, 2, md5(body), NULL FROM c UNION ALL SELECT '#/o/' || k, 3, md5(body), NULL FROM o
UNION ALL SELECT '#/s/' || s_suppkey, NULL, NULL, 'cycle' FROM supplier UNION ALL SELECT '#/p/' || p_partkey, NULL, NULL, 'unresolved' FROM part""")
def inlined_components(spark, sf_dir):
    """Orders hold their customer, customers their nation, nations their region; suppliers refer to themselves and parts to nothing."""
    t = lambda name, key, body: table(spark, sf_dir, name).select(F.lit("repo").alias("repo"), key.alias("key"), body.alias("body"))
    key = lambda kind, column: F.concat(F.lit(f"#/{kind}/"), F.col(column).cast("string"))
    ref = lambda kind, column: F.concat(F.lit('{"$ref": "'), key(kind, column), F.lit('"}'))
    parts = [
        t("region", key("r", "r_regionkey"), F.concat(F.lit('{"name": "'), "r_name", F.lit('"}'))),
        t("nation", key("n", "n_nationkey"), F.concat(F.lit('{"name": "'), "n_name", F.lit('", "in": ['), ref("r", "n_regionkey"), F.lit("]}"))),
        t("customer", key("c", "c_custkey"), F.concat(F.lit('{"nation": '), ref("n", "c_nationkey"), F.lit(', "of": "'), F.col("c_custkey").cast("string"), F.lit('"}'))),
        t("orders", key("o", "o_orderkey"), F.concat(F.lit('{"customer": '), ref("c", "o_custkey"), F.lit("}"))),
        t("supplier", key("s", "s_suppkey"), F.concat(F.lit('{"me": '), ref("s", "s_suppkey"), F.lit(', "n": '), ref("n", "s_nationkey"), F.lit("}"))),
        t("part", key("p", "p_partkey"), F.concat(F.lit('{"x": '), ref("none", "p_partkey"), F.lit("}"))),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return inlining.inline(every).select("key", "level", F.md5("body").alias("digest"), "error")
