import json

from pyspark.sql import functions as F

from routeloom.plans import incremental as inc
from routeloom.streaming.maintain import current, maintain, windowed_counts


def rows(spark, data):
    return spark.createDataFrame(data, "key string, rel_path string, context_hash string")


def files(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "rel_path string")


def test_plan(spark):
    stored = rows(spark, [(f"GET /{k}", f"{k}.py", f"h{k}") for k in range(6)])
    now = rows(spark, [(f"GET /{k}", f"{k}.py", "new" if k == 1 else f"h{k}") for k in range(5)] + [("GET /n", "n.py", "x")])
    deps = spark.createDataFrame([("GET /1", "lib.py"), ("GET /2", "lib.py"), ("GET /lib", "deep.py")], "key string, rel_path string")
    got = inc.plan(now, stored, deps, files(spark, "lib.py", "deep.py"))
    names = {k: {r.key for r in v.collect()} for k, v in got.items() if k != "mode"}
    assert got["mode"] == "partial" and names == {"removed": {"GET /5"}, "dirty": {"GET /1", "GET /n"}, "skipped": {"GET /2"}}
    assert inc.plan(stored, stored, deps, files(spark, "other.py"))["mode"] == "fast"
    assert inc.plan(stored, stored, deps, files(spark, *[f"{k}.py" for k in range(4)]))["mode"] == "full"
    assert inc.plan(stored, stored, deps, None)["mode"] == "full"


def test_mirrors(spark):
    jobs = spark.createDataFrame([("PATCH /a", "PATCH", "/a", "x.rb"), ("PUT /a", "PUT", "/a", "x.rb"), ("PUT /b", "PUT", "/b", "x.rb"), ("PUT /c", "PUT", "/c", "y.rb"), ("PATCH /c", "PATCH", "/c", "x.rb")], "key string, method string, route string, rel_path string")
    asked, twins = inc.mirrors(jobs)
    assert {r.key for r in asked.collect()} == {"PATCH /a", "PUT /b", "PUT /c", "PATCH /c"} and [r.key for r in twins.collect()] == ["PUT /a"]
    done = spark.createDataFrame([("PATCH /a", "/a", "PATCH", "A"), ("PUT /b", "/b", "PUT", "B")], "key string, route string, method string, operation string")
    assert {(r.key, r.operation) for r in inc.with_mirrors(done, twins).collect()} == {("PATCH /a", "A"), ("PUT /b", "B"), ("PUT /a", "A")}


def test_generation(spark):
    jobs = spark.createDataFrame([(f"GET /r{k}", "GET", f"/r{k}", "a.py", k, "x" * 400) for k in range(25)], "key string, method string, route string, rel_path string, pos long, section string")
    packed = inc.batches(jobs, inc.approximate_tokens)
    assert sorted(r["count"] for r in packed.groupBy("batch").count().collect()) == [5, 10, 10]
    blocks = spark.createDataFrame([("a.py", 1, "shared"), ("a.py", 2, "shared"), ("a.py", 3, " "), ("a.py", 4, "y" * 30_000), ("a.py", 5, "late")], "rel_path string, pos int, block string")
    asked = inc.prompts(packed, blocks, inc.approximate_tokens)
    assert {r.dropped for r in asked.collect()} == {2} and all("shared" in r.prompt and "late" not in r.prompt for r in asked.collect())

    def call(prompt):
        return "Sure: " + json.dumps({"paths": {"/r1": {"get": {"summary": "one"}}, "/extra": {"get": {}}}}) + " done"

    done, failed = inc.replies(inc.generate(asked, call, lambda s: None), packed)
    assert [r.key for r in done.collect()] == ["GET /r1"] and failed.count() == 24
    bad = inc.generate(asked, lambda p: "junk", lambda s: None)
    assert bad.where("reply is not null").count() == 0
    old = spark.createDataFrame([("GET /r1", "/r1", "GET", "{}"), ("GET /r2", "/r2", "GET", "{}"), ("GET /gone", "/gone", "GET", "{}")], done.schema)
    after = inc.merge_run(old, done, spark.createDataFrame([("GET /gone",)], "key string"), failed)
    assert [r.key for r in after.collect()] == ["GET /r1"]
    assert inc.coverage(packed, done, done.limit(0), failed).first().asDict() == {"extracted": 25, "generated": 1, "unchanged": 0, "failed": 24}


def test_stream(spark, tmp_path, sf):
    source = tmp_path / "in"
    kind = "key string, seq long, operation string"
    for k, batch in enumerate([[("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z"), ("b", 4, None), ("c", 5, "w")]]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(source))
        q = maintain(spark.readStream.schema(kind).parquet(str(source)), str(tmp_path / "state"), str(tmp_path / "check"))
        assert q.awaitTermination(60)
    assert {(r.key, r.operation) for r in current(spark, str(tmp_path / "state")).collect()} == {("a", "z"), ("c", "w")}
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()


def test_stream_out_of_order_and_crash(spark, tmp_path):
    """A late row with a lower seq loses, also against a removal; a folder that is being written is not read, and a replay mends it."""
    from routeloom.streaming.maintain import merge_batch

    kind, where = "key string, seq long, operation string", str(tmp_path / "state")
    put = merge_batch(where)
    batch = lambda *rows: spark.createDataFrame(list(rows), kind)
    now = lambda: {r.key: r.operation for r in current(spark, where).collect()}
    assert now() == {}
    put(batch(("a", 5, "five"), ("b", 1, "one"), ("b", 2, None), ("c", 1, "c")), 0)
    put(batch(("a", 3, "three"), ("b", 1, "again"), ("c", 1, "same")), 1)
    assert now() == {"a": "five", "c": "same"}
    # A crash between the files and the mark: the batch before is read, and the replay starts from it.
    put(batch(("a", 9, "nine")), 2)
    (tmp_path / "state/v=2/_SUCCESS").unlink()
    assert now() == {"a": "five", "c": "same"}
    put(batch(("a", 9, "nine")), 2)
    put(batch(("b", 3, "back")), 3)
    assert now() == {"a": "nine", "b": "back", "c": "same"}
