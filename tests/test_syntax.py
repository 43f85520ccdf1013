"""Syntax nodes, what joins make of them in five languages, and the second tier of routes."""


from routeloom.functions import code_nodes
from routeloom.plans import syntax
from routeloom.plans.code_lane import code_endpoints

JS = """import express, { Router } from 'express';
const users = require("./users");
class Store extends Base {
  // hidden() { }
  load(id) { return this.db.find(id, '(not [ a bracket'); }
  async save(x) {
    if (x) { validate(x); }
  }
}
function start(port) {
  listen(port);
}
const app = express();
"""
JAVA = """package a.b;
import java.util.List;
import static a.c.Util.help;
/* class Not { } */
public class Shop implements Api {
  private String name = "}";
  public List<String> items(String q) throws IOException {
    return find(q);
  }
  interface Inner { void only(int x); }
  void empty() { }
}
"""
GO = """package main
import (
	"fmt"
	web "net/http"
)
type Server struct { name string }
func (s *Server) Run(addr string) error {
	fmt.Println("func not(")
	return listen(addr)
}
func main() {
	s := Server{}
	s.Run(`:80
`)
}
"""
RUBY = """require 'json'
require_relative "lib/a"
module Shop
  class Cart < Base
    attr_reader :class
    def self.build(x) # def no
      if x
        parse(x)
      end
      y = 1 if x
    end
    def total
      items.each do |i|
        add(i)
      end
      while more(1) do
        step(2)
      end
    end
  end
end
"""
PY = "import os\nfrom a.b import c\nclass K:\n    def f(self):\n        return c(1)\n"


def tree(spark, files):
    return spark.createDataFrame([("r", p, lang, t) for p, lang, t in files], "repo string, rel_path string, language string, text string")


def found(spark, *files):
    got = syntax.metadata(tree(spark, files))
    symbols = {(r.kind, r.name, r.start_line, r.end_line) for r in got["symbols"].collect()}
    calls = {(r.target, r.start_line, r.caller) for r in got["calls"].collect()}
    return symbols, calls, {r.module for r in got["imports"].collect()}, {r.rel_path for r in got["errors"].collect()}


def test_javascript(spark):
    symbols, calls, imports, errors = found(spark, ("a.js", "nodejs", JS))
    assert symbols == {("variable", "users", 2, 2), ("class", "Store", 3, 9), ("method", "load", 5, 5), ("method", "save", 6, 8), ("function", "start", 10, 12), ("variable", "app", 13, 13)}
    assert calls == {("require", 2, None), ("this.db.find", 5, "Store"), ("validate", 7, "save"), ("listen", 11, "start"), ("express", 13, None)}
    assert imports == {"express", "./users"} and not errors


def test_java(spark):
    symbols, calls, imports, errors = found(spark, ("Shop.java", "java", JAVA))
    assert symbols == {("class", "Shop", 5, 12), ("method", "items", 7, 9), ("interface", "Inner", 10, 10), ("method", "empty", 11, 11)}
    assert ("find", 8, "items") in calls and not {c for c in calls if c[0] in ("items", "empty", "Not")}
    assert imports == {"java.util.List", "a.c.Util.help"} and not errors


def test_go(spark):
    symbols, calls, imports, errors = found(spark, ("m.go", "golang", GO))
    assert symbols == {("module", "main", 1, 1), ("class", "Server", 6, 6), ("method", "Run", 7, 10), ("function", "main", 11, 15)}
    assert calls == {("fmt.Println", 8, "Run"), ("listen", 9, "Run"), ("s.Run", 13, "main")}
    assert imports == {"fmt", "net/http"} and not errors


def test_ruby_and_python(spark):
    symbols, calls, imports, errors = found(spark, ("c.rb", "ruby_on_rails", RUBY), ("k.py", "python", PY), ("bad.py", "python", "def ("))
    assert symbols == {("module", "Shop", 3, 21), ("class", "Cart", 4, 20), ("function", "build", 6, 11), ("function", "total", 12, 19), ("class", "K", 3, 5), ("function", "f", 4, 5)}
    assert calls >= {("parse", 8, "build"), ("add", 14, "total"), ("more", 16, "total"), ("step", 17, "total"), ("c", 5, None)}
    assert imports >= {"json", "lib/a"} and errors == {"bad.py"}


def test_errors_are_nodes():
    kinds = lambda text, lang: [n[3] for n in code_nodes.nodes(text, lang)]
    assert kinds("f(a]", "nodejs") == ["file", "word", "error", "word", "error"]
    assert kinds("x = 'open\ny()", "java") == ["file", "word", "mark", "error", "word", "paren"]
    assert kinds("def a\n  (b\nend\nend", "ruby_on_rails").count("error") == 2
    assert kinds("", "golang") == ["file"] and kinds("{[(", "golang") == ["file", "error", "error", "error"]
    for text, lang in ((JS, "nodejs"), (JAVA, "java"), (GO, "golang"), (RUBY, "ruby_on_rails")):
        rows = code_nodes.nodes(text, lang)
        assert [r[0] for r in rows] == list(range(len(rows)))
        for node, parent, _, _, _, begin, end, _, _ in rows[1:]:
            assert rows[parent][5] <= begin <= end <= rows[parent][6] and parent < node


def test_second_tier(spark):
    broken = "const re = `open\nrouter.get('/lost/:id', show);\nclient.get('/no', x);\napp.post(`/t/${x}`, y); app.put('/p', z);\nconst { a: [ \n"
    fine = "const router = require('express').Router();\nrouter.get('/kept', show);\n"
    nest = "@Controller('cats')\nexport class Cats extends mixin(`\n  @Get(':id')\n  one() {}\n  @Post()\n  make() {}\n"
    app = "const app = express();\napp.use('/api', require('../../lib/broken'));\napp.get('/own', x);\n"
    files = tree(spark, [("lib/broken.js", "nodejs", broken + "module.exports = router;\n"), ("fine.js", "nodejs", fine), ("cats.ts", "nodejs", nest), ("src/deep/app.js", "nodejs", app)])
    got = {(r.rel_path, r.method, r.route) for r in code_endpoints(files)[0].collect()}
    assert got >= {("fine.js", "GET", "/kept"), ("src/deep/app.js", "GET", "/own"), ("cats.ts", "GET", "/cats/{id}"), ("cats.ts", "POST", "/cats")}
    assert {x[1:] for x in got if x[0] == "lib/broken.js"} in ({("GET", "/lost/{id}"), ("PUT", "/p")}, {("GET", "/api/lost/{id}"), ("PUT", "/api/p")})
    assert len(got) == 6


def test_mount_two_folders_up(spark):
    app = "const app = express();\napp.use('/p', require('../../lib/x'));\n"
    lib = "const router = require('express').Router();\nrouter.get('/a', f);\nmodule.exports = router;\n"
    files = tree(spark, [("src/routes/app.js", "nodejs", app), ("lib/x.js", "nodejs", lib)])
    assert {(r.method, r.route) for r in code_endpoints(files)[0].collect()} == {("GET", "/p/a")}


def test_no_files(spark):
    got = syntax.metadata(tree(spark, []))
    assert all(df.count() == 0 for df in got.values())
