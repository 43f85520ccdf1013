"""Files with very many declarations: read in proportion to their length, in bounded memory, and with the same facts."""

import json
import time
import tracemalloc

import pytest

from routeloom.functions import code_text, contract_facts, go_facts, js_facts, python_facts, rails_facts, spring_facts
from routeloom.plans import syntax


def _took(f):
    begin = time.process_time()
    out = f()
    return out, time.process_time() - begin


def test_nest_controller_of_many_methods():
    methods = "".join(f"  @Get('c/:id/{k}')\n  @Use(Guard) f{k}() {{ return 1; }}\n" for k in range(1500))
    rows, seconds = _took(lambda: [r for r in js_facts.extract("@Controller('n')\nexport class N {\n" + methods + "}\n", "n.ts") if r["what"] == "endpoint"])
    assert [(r["name"], r["route"], r["start_line"]) for r in rows] == [(f"N.f{k}", f"/n/c/:id/{k}", 3 + 2 * k) for k in range(1500)]
    assert seconds < 5


def test_go_file_of_many_calls():
    body = "".join(f"func h{k}(c *gin.Context) {{\n\tok(c)\n}}\n" for k in range(12000)) + 'func routes(r *gin.Engine) {\n\tv := r.Group("/n")\n' + "".join(f'\tv.GET("/{k}", h{k})\n' for k in range(12000)) + "}\n"
    rows, seconds = _took(lambda: [r for r in go_facts.extract("package main\n\n" + body, "a.go") if r["what"] == "endpoint"])
    assert [(r["route"], r["start_line"], r["detail"]) for r in rows] == [(f"/n/{k}", 36005 + k, '{"func": 36003, "param": 0}') for k in range(12000)]
    assert seconds < 10


def test_java_file_of_many_methods():
    body = "".join(f'  @GetMapping("/{k}")\n  String f{k}(String id) {{ return g(id); }}\n' for k in range(20000))
    rows, seconds = _took(lambda: [r for r in spring_facts.extract("@RestController\nclass A {\n" + body + "}\n", "A.java") if r["what"] == "endpoint"])
    assert [(r["route"], r["start_line"]) for r in rows] == [(f"/{k}", 3 + 2 * k) for k in range(20000)]
    assert seconds < 12


def test_nodes_leave_a_task_in_blocks(spark):
    files = spark.createDataFrame([("r", f"f{k}.js", "nodejs", "a(b);\n" * 3000) for k in range(3)], "repo string, rel_path string, language string, text string").coalesce(1)
    n = syntax.nodes(files)
    sizes = n.mapInArrow(lambda parts: parts, n.schema).mapInPandas(lambda parts: (p[["rel_path"]].groupby("rel_path").size().rename("n").reset_index() for p in parts), "rel_path string, n long").groupBy("rel_path").agg({"n": "sum"}).collect()
    assert sorted((r[0], r[1]) for r in sizes) == [(f"f{k}.js", 12001) for k in range(3)]
    assert "MapInPandas" not in n._jdf.queryExecution().executedPlan().toString()


def _peak(text, extract=python_facts.extract, path="a.py"):
    """MB that reading a file takes at most, its facts not kept; and how many facts there are."""
    tracemalloc.start()
    n = sum(1 for _ in extract(text, path))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak, n


def test_python_file_of_many_functions_is_parsed_in_pieces():
    text = "from flask import Blueprint\nbp = Blueprint('b', __name__)\n" + "".join(f"\n@bp.route('/{k}', methods=['GET'])\ndef f{k}(id):\n    return 1\n" for k in range(8000))
    peak, n = _peak(text)
    assert n == 5 + 4 * 8000 and peak < 15


def test_python_list_of_many_patterns_is_parsed_in_runs():
    text = "from django.urls import path\nfrom n import views\nurlpatterns = [\n" + "".join(f"    path('c/{k}/', views.show{k}),\n" for k in range(8000)) + "] + [path('z', views.z)]\n"
    peak, n = _peak(text)
    assert n == 3 + 4 * 8001 and peak < 15


def test_python_pieces_have_the_facts_of_the_whole(monkeypatch):
    text = "import a\nif a:\n  pass\nelse:\n  import b as c\ns = '''\ndef f(): pass\n'''\n@a.get('/x',\n)\ndef f(): return c\nurlpatterns = [\n  path('1', a.v), # ,\n  include_router(c.r,\n prefix='/p'),\n  path('2', a.w),\n] + [path('3', a.u)]\nx = [\n c.d(1),\n c.e(2),\n][0]\n"
    whole = [r | {"pos": None} for r in python_facts.extract(text, "a.py")]
    monkeypatch.setattr(python_facts, "PIECE", 1)
    pieces = [r | {"pos": None} for r in python_facts.extract(text, "a.py")]
    assert sorted(map(repr, pieces)) == sorted(map(repr, whole)) and len([r for r in whole if r["what"] == "pattern"]) == 3
    with pytest.raises(SyntaxError, match="line 23"):
        list(python_facts.extract(text + "ok = 1\ndef (:\n", "a.py"))


def test_ruby_files_of_many_lines_are_read_a_line_at_a_time():
    routes = "Rails.application.routes.draw do\n" + "".join(f"  get '/n/:id/{k}', to: 'n#a{k}'\n" for k in range(5000)) + "end\n"
    base = "class Base\n" + "".join(f"  def a{k}\n    2\n  end\n\n" for k in range(5000)) + "end\n"
    for text, path, facts in ((routes, "config/routes.rb", 5000), (base, "app/controllers/base.rb", 5001)):
        peak, n = _peak(text, rails_facts.extract, path)
        assert n == facts and peak < 1


def test_masked_lines_are_the_lines_of_the_mask():
    for text in ("", "\n", "a 'b\nc' # d\n\n'e", "''\n# f", "x = \"g\n", "'h\n\n  i'\n"):
        for language in ("ruby", "js", "go", "python"):
            assert [*code_text.masked_lines(text, language)] == [*zip(text.split("\n"), code_text.mask(text, language).split("\n"))]


def test_specification_of_many_paths_is_read_a_path_at_a_time():
    doc = {"openapi": "3.0.1", "paths": {f"/c/{{id}}/{k}": {"get": {"operationId": f"op{k}", "responses": {"200": {"$ref": "#/components/responses/R"}}}} for k in range(10000)}, "components": {"responses": {"R": {}}}}
    text = json.dumps(doc)
    assert contract_facts._in_pieces(text) == (0, "contracts", "3.0.1", 10000, text, None) == [*contract_facts.documents(text.encode(), "a.json")][0]
    assert contract_facts.outline(text) == doc | {"paths": {}}
    assert _peak(text, contract_facts.operations_of)[1] == 10000 and _peak(text, contract_facts.operations_of)[0] < 4
    assert _peak(text, lambda t, _: contract_facts.every_reference(t))[0] < 4


def test_specifications_that_pieces_do_not_tell_are_read_whole():
    for text in ('{"paths": {"/a": 1}, "paths": {"/b": {"get": {}}}, "openapi": "3.1"}', '{"openapi": "3", "paths": {"/a": {"get": {}}, "/a": {"put": {}}}}', '[{"openapi": "3"}]', '{"paths": {"$ref": "b.json"}}', '{"a": 1} x', '{"a": 1,}', "{1: 2}"):
        assert not contract_facts.regular(text)
    alias = '{"openapi": "3", "paths": {"/a": {"$ref": "#/paths/~1b"}, "/b": {"get": {}}}}'
    assert [x[:2] for x in contract_facts.operations_of(alias, "a.json")] == [("GET", "/a"), ("GET", "/b")]
    assert [*contract_facts.documents(b'{"openapi": "3", "paths": {"/a": {"get": {}}, "/a": {"put": {}}}}', "a.json")] == [(0, "contracts", "3", 1, '{"openapi": "3", "paths": {"/a": {"put": {}}}}', None)]
