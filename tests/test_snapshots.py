"""Digests of folders against a plain comparison, and links followed as the file system follows them."""

import os
import random

from routeloom.plans import snapshots
from routeloom.plans.real_paths import real_paths


def tree(spark, files):
    return spark.createDataFrame([(r, p, bytearray(t.encode()), len(t), False) for (r, p), t in files.items()], "repo string, rel_path string, content binary, size long, is_symlink boolean")


def test_changed(spark):
    r = random.Random(2)
    old = {(repo, "/".join(r.choice("abcd") + str(r.randrange(3)) for _ in range(r.randint(0, 4))).strip("/") + f"/f{k}".lstrip("/" if k % 5 else "")): str(r.random()) for repo in ("x", "y") for k in range(120)}
    old = {(repo, p.strip("/")): t for (repo, p), t in old.items()}
    new = dict(old)
    keys = sorted(old)
    for k in r.sample(keys, 12):
        new[k] += "!"
    for k in r.sample(keys, 5):
        del new[k]
    new |= {("x", "new/deep/er/file"): "1", ("z", "only"): "2"}
    gone = next(k for k in sorted(new) if "/" not in k[1])
    del new[gone]
    new[(gone[0], gone[1] + "/now/a/folder")] = "3"
    want = {(*k, "added") for k in new.keys() - old.keys()} | {(*k, "removed") for k in old.keys() - new.keys()} | {(*k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    a, b = snapshots.stored(tree(spark, old)), snapshots.stored(tree(spark, new))
    assert {tuple(x) for x in snapshots.changed(a, b).collect()} == want
    assert snapshots.changed(a, a).count() == 0
    # A file that moves inside a folder changes the folder's digest, and that of every folder above.
    one, two = ({("x", f"a/{n}/f"): "1", ("x", "b/g"): "2"} for n in ("p", "q"))
    d = [{x.path: x.digest for x in snapshots.nodes(tree(spark, t)).collect()} for t in (one, two)]
    assert d[0]["a"] != d[1]["a"] and d[0][""] != d[1][""] and d[0]["b"] == d[1]["b"] and d[0]["a/p/f"] == d[1]["a/q/f"]


def test_real_paths(spark, tmp_path):
    """Chained, cyclic and escaping links; what a file system says of the same tree."""
    root = tmp_path / "r"
    (root / "real/deep").mkdir(parents=True)
    (root / "real/deep/f").write_text("x")
    (tmp_path / "outside").write_text("y")
    links = {"one": "two", "two": "real", "real/up": "../other", "other": "real/deep/", "loop": "pool", "pool": "loop", "out": "../outside", "abs": "/etc/passwd", "real/self": ".", "in/out": "../../r/real"}
    (root / "in").mkdir()
    for name, target in links.items():
        os.symlink(target, root / name)
    asked = ["real/deep/f", "one/deep/f", "two/up/f", "one/self/self/deep/f", "loop/x", "pool", "out", "abs/x", "nothing/here", "one"]
    df = spark.createDataFrame([("r", p) for p in [*asked, "in/out/deep/f"]], "repo string, path string")
    got = {x.path: (x.real, x.error) for x in real_paths(df, spark.createDataFrame([("r", k, v) for k, v in links.items()], "repo string, rel_path string, target string")).collect()}
    assert len(got) == len(asked) + 1
    for p in asked:
        if p in ("loop/x", "pool"):
            assert got[p] == (None, "cycle")
            continue
        real = os.path.relpath(os.path.realpath(root / p), os.path.realpath(root))
        assert got[p] == ((None, "escaped") if real.startswith("..") else (real, None)), p
    assert got["in/out/deep/f"] == (None, "escaped")  # it comes back by the root's name, but it has been outside
