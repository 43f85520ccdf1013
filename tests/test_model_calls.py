"""Model calls are made once: under failing tasks, later actions and later runs; unusable batches are asked for one by one."""

import json
import os

import pytest
from pyspark.sql import functions as F

from routeloom.plans import incremental as inc
from routeloom.plans import model_calls, state_tables

BLOCKS = "rel_path string, pos int, block string"


def jobs(spark, n, per_file=25):
    return spark.createDataFrame([(f"GET /r{k}", "GET", f"/r{k}", f"{k // per_file}.py", k % per_file, f"section /r{k} " + "x" * 40) for k in range(n)], "key string, method string, route string, rel_path string, pos long, section string")


def counting(folder, break_after=None, junk=()):
    """A model that leaves a file for each call; it fails its process's task once after some calls; some routes make a reply junk."""
    os.makedirs(folder, exist_ok=True)

    def call(prompt):
        import hashlib
        import re
        import uuid

        routes = re.findall(r"section (/r\d+) ", prompt)
        with open(f"{folder}/{hashlib.sha1(prompt.encode()).hexdigest()}-{uuid.uuid4().hex}", "w") as f:
            f.write(" ".join(routes))
        if len(routes) > 1 and set(routes) & set(junk):
            return "sorry"
        return json.dumps({"paths": {r: {"get": {"summary": uuid.uuid4().hex}} for r in routes if r != "/r7"}})

    return call


def calls(folder):
    return [open(f"{folder}/{x}").read().split() for x in os.listdir(folder)]


def test_one_call_a_prompt(spark, tmp_path):
    made = model_calls.generated(jobs(spark, 60), spark.createDataFrame([], BLOCKS), inc.approximate_tokens, counting(str(tmp_path / "calls")), str(tmp_path / "kept"), "one", lambda s: None)
    first = {r.key: r.operation for r in made["made"].collect()}
    assert {r.key: r.operation for r in made["made"].collect()} == first and len(first) == 59  # read twice, asked once
    assert [tuple(r) for r in made["failed"].collect()] == [("GET /r7", "left out of the reply")]
    assert made["report"].first().asDict() == {"generated": 59, "failed": 1, "asked_alone": 0}
    assert sorted(map(len, calls(tmp_path / "calls"))) == [5, 5, 10, 10, 10, 10, 10]
    # Another run with the same prompts asks for nothing.
    again = model_calls.generated(jobs(spark, 60), spark.createDataFrame([], BLOCKS), inc.approximate_tokens, counting(str(tmp_path / "calls")), str(tmp_path / "kept"), "two", lambda s: None)
    assert {r.key: r.operation for r in again["made"].collect()} == first and len(calls(tmp_path / "calls")) == 7


def test_unusable_batch_is_asked_one_by_one(spark, tmp_path):
    made = model_calls.generated(jobs(spark, 20), spark.createDataFrame([], BLOCKS), inc.approximate_tokens, counting(str(tmp_path / "calls"), junk=["/r12"]), str(tmp_path / "kept"), "one", lambda s: None)
    asked = sorted(map(tuple, calls(tmp_path / "calls")))
    batch = tuple(f"/r{k}" for k in range(10, 20))
    assert asked.count(batch) == inc.RETRIES and sorted(x for x in asked if len(x) == 1) == sorted((r,) for r in batch)
    assert made["made"].count() == 19 and made["report"].first().asked_alone == 10


def test_a_task_that_fails_does_not_pay_twice(spark, tmp_path):
    """The journal is what a second attempt of the same task finds."""
    folder, kept = str(tmp_path / "calls"), str(tmp_path / "kept")
    call = counting(folder)

    def breaks(prompt):
        if len(os.listdir(folder)) == 3:
            os._exit(1)  # the worker dies in the midst of its prompts
        return call(prompt)

    requests = spark.createDataFrame([(f"f{k}", 0, [f"k{k}"], f"section /r{k} ") for k in range(8)], "rel_path string, batch long, keys array<string>, prompt string")
    with pytest.raises(Exception):
        model_calls.answered(requests, breaks, kept, "run", lambda s: None, parallel=1).count()
    assert len(calls(folder)) == 3
    got = model_calls.answered(requests, call, kept, "run", lambda s: None, parallel=1)
    assert got.where("reply is not null").count() == 8 - 0 and sorted(calls(folder)) == sorted([f"/r{k}"] for k in range(8))


def test_run_generates_once(spark, tmp_path):
    folder = str(tmp_path / "calls")
    os.makedirs(folder)
    endpoints = spark.createDataFrame([(f"GET /{k}", k, f"{k}.py", f"h{k}") for k in range(10)], "key string, pos int, rel_path string, context_hash string")
    imports = spark.createDataFrame([], "key string, rel_path string, import_path string, name string, start_line int, end_line int")

    def generate(keys):
        def each(parts):
            import uuid

            for p in parts:
                for k in p["key"]:
                    open(f"{folder}/{uuid.uuid4().hex}", "w").close()
                yield p.assign(route=p["key"].str[4:], method="GET", operation=[uuid.uuid4().hex for _ in p["key"]])

        return keys.where("key <> 'GET /3'").mapInPandas(each, "key string, route string, method string, operation string")

    for _ in range(4):  # old versions of the tables go
        got = state_tables.run(spark, str(tmp_path / "state"), endpoints, imports, None, generate)
    assert len(os.listdir(folder)) == 4 * 9
    assert [r.key for r in got["failed"].collect()] == ["GET /3"] and len(os.listdir(folder)) == 4 * 9
    assert sorted(map(tuple, got["made"].collect())) == sorted(map(tuple, got["operations"].collect()))
    assert len([x for x in os.listdir(tmp_path / "state") if x.startswith("operations-")]) == 2


def test_batch_numbers(spark):
    packed = inc.batches(jobs(spark, 45, 23), inc.approximate_tokens)
    assert sorted(r["count"] for r in packed.groupBy("rel_path", "batch").count().collect()) == [2, 3, 10, 10, 10, 10]
    assert packed.groupBy("rel_path", "batch").agg((F.max("pos") - F.min("pos") + 1 - F.count("*")).alias("d")).where("d <> 0").count() == 0
