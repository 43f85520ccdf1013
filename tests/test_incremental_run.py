"""The command line from end to end on a small tree under git: what changed is asked for, the rest is kept."""

import json
import os
import re
import subprocess

from routeloom.plans import incremental_run, report
from routeloom.plans.code_lane import code_endpoints
from routeloom.sources.repo_tree import CODE_IGNORED, code_files, read_tree

APP = "from flask import Flask\nfrom lib.store import load\napp = Flask(__name__)\n\ndef shape(x):\n    return {'x': x}\n\n@app.route('/items/<int:id>')\ndef item(id):\n    return shape(load(id))\n\n@app.route('/other', methods=['POST'])\ndef other():\n    return 'other'\n"
MORE = "from flask import Flask\napp = Flask(__name__)\n" + "".join(f"\n@app.route('/m{k}')\ndef m{k}():\n    return {k}\n" for k in range(6))


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def prompts(log):
    return [re.findall(r"^### (\S+ \S+)$", x, re.M) for x in open(log).read().split("\0")[:-1]] if os.path.exists(log) else []


def test_run_twice(spark, tmp_path):
    root, state, log = tmp_path / "shop", str(tmp_path / "state"), str(tmp_path / "log")
    (root / "lib").mkdir(parents=True)
    (root / "app.py").write_text(APP)
    (root / "more.py").write_text(MORE)
    (root / "lib" / "store.py").write_text("def load(id):\n    return id\n\ndef unused():\n    return 1\n")
    git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "x")

    def call(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\0")
        return incremental_run.outline(prompt)

    def go():
        if os.path.exists(log):
            os.remove(log)
        files = code_files(read_tree(spark, str(root)), CODE_IGNORED)
        return incremental_run.run(spark, str(root), state, {"to_generate": code_endpoints(files)[0]}, files, call)

    first = go()
    assert first["mode"] == "full" and first["operations"].count() == 8 and sum(map(len, prompts(log))) == 8
    assert "def load(id):\n    return id" in open(log).read() and "def shape(x):" in open(log).read() and "unused" not in open(log).read()
    # What a handler calls in an imported file changes: that endpoint is asked for, and no other.
    (root / "lib" / "store.py").write_text("def load(id):\n    return id + 1\n\ndef unused():\n    return 1\n")
    again = go()
    assert again["mode"] == "partial" and prompts(log) == [["GET /items/{id}"]] and again["operations"].count() == 8
    # A change outside of every context costs nothing; a new and a removed route do what they should.
    (root / "lib" / "store.py").write_text("def load(id):\n    return id + 1\n\ndef unused():\n    return 2\n")
    (root / "app.py").write_text(APP.replace("/other", "/newer"))
    last = go()
    assert last["mode"] == "partial" and prompts(log) == [["POST /newer"]]
    assert {r.key for r in last["operations"].collect()} >= {"POST /newer", "GET /items/{id}"} and last["operations"].count() == 8


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "shop"
    root.mkdir()
    (root / "app.py").write_text(APP)
    out = str(tmp_path / "o.json")
    assert report.main([str(root), "--output", out, "--incremental", str(tmp_path / "state")]) == report.EXIT_OK
    doc = json.load(open(out))
    assert doc["paths"]["/items/{id}"]["get"]["responses"] == {} and set(doc["paths"]) == {"/items/{id}", "/other"}
    assert "full run, 2 generated, 0 failed" in capsys.readouterr().out
    assert report.main([str(tmp_path / "absent")]) == report.EXIT_ERROR
