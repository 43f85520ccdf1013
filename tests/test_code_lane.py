from routeloom.plans.code_lane import code_endpoints, framework
from routeloom.sources.repo_tree import CODE_IGNORED, code_files, read_tree

FILES = {
    "web/app.js": "const express = require('express');\nconst app = express();\nconst users = require('./routes/users');\napp.use('/api', users);\napp.use('/v2', users);\napp.get('/ping', h);\n",
    "web/routes/users.js": "const router = require('express').Router();\nrouter.get('/users/:id(\\\\d+)', show);\nmodule.exports = router;\n",
    "j/PetApi.java": "package a;\npublic interface PetApi {\n  @GetMapping(\"/pets/{id}\")\n  String get(String id);\n}\n",
    "j/PetController.java": "package a;\n@RestController\npublic class PetController implements PetApi {\n  public String get(String id) { return null; }\n  @PostMapping(\"/pets\")\n  public void add() {}\n}\n",
    "g/main.go": "package main\nfunc main() {\n  v := r.Group(\"/v\")\n  v.GET(\"/a/:b\", handler)\n  v.GET(\"/lost\", nowhere)\n}\n",
    "g/h.go": "package main\nfunc handler(c *gin.Context) {\n}\n",
    "g/h_test.go": "package main\nfunc x() { r.GET(\"/test\", handler) }\n",
    "config/routes.rb": "Rails.application.routes.draw do\n  resources :posts, only: [:index, :destroy]\nend\n",
    "app/controllers/posts_controller.rb": "class PostsController < BaseController\n  def index\n  end\nend\n",
    "app/controllers/base_controller.rb": "class BaseController\n  def destroy\n  end\nend\n",
    "p/__init__.py": "",
    "p/.hidden.py": "@app.get('/hidden')\ndef f(): pass\n",
    "node_modules/x.js": "app.get('/no', h)",
}


def tree(spark, tmp_path, files):
    for p, t in files.items():
        (tmp_path / "repo" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / p).write_text(t)
    return read_tree(spark, str(tmp_path / "repo"), CODE_IGNORED)


def test_all_languages(spark, tmp_path):
    df = tree(spark, tmp_path, FILES)
    assert {r.rel_path for r in df.select("rel_path").collect()} == {p for p in FILES if not p.startswith("node_modules")}
    rows, rejects = code_endpoints(code_files(df))
    got = {(r.method, r.route) for r in rows.collect()}
    assert got == {("GET", "/api/users/{id}"), ("GET", "/v2/users/{id}"), ("GET", "/ping"), ("GET", "/pets/{id}"), ("POST", "/pets"), ("GET", "/v/a/{b}"), ("GET", "/posts"), ("DELETE", "/posts/{id}"), ("GET", "/hidden")}
    assert {(r.language, r.reason): r.n for r in rejects.collect()} == {("golang", "handler not found"): 1}


def test_rails_ancestors_and_concerns(spark, tmp_path):
    """A concern of another route file; of two modules the one of the later include statement serves, before the superclass."""
    files = {
        "config/routes.rb": "Rails.application.routes.draw do\n  resources :posts, only: [:show], concerns: :likeable\nend\n",
        "config/routes/shared.rb": "Rails.application.routes.draw do\n  concern :likeable do\n    member do\n      get :likes\n    end\n  end\nend\n",
        "app/controllers/posts_controller.rb": "class PostsController < BaseController\n  include Early\n  include Late, Last\nend\n",
        "app/controllers/base_controller.rb": "class BaseController\n  def show\n  end\n  def likes\n  end\nend\n",
        "app/controllers/early.rb": "module Early\n  def show\n  end\nend\n",
        "app/controllers/late.rb": "module Late\n  include Deep\nend\n",
        "app/controllers/deep.rb": "module Deep\n  def show\n  end\nend\n",
        "app/controllers/last.rb": "module Last\n  def show\n  end\nend\n",
    }
    rows, _ = code_endpoints(code_files(tree(spark, tmp_path, files)))
    got = {(r.method, r.route): r.rel_path for r in rows.collect()}
    assert got == {("GET", "/posts/{id}"): "app/controllers/deep.rb", ("GET", "/posts/{id}/likes"): "app/controllers/base_controller.rb"}


def test_framework(spark, tmp_path):
    df = code_files(tree(spark, tmp_path, FILES))
    assert framework(df, [("express", "express"), ("spring", "@RestController")]).first().framework == "express"
