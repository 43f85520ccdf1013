"""Replies of a model met with what was asked: own route, same shape, only request; fields cleaned."""

import json

from pyspark.sql import functions as F

from routeloom.plans import incremental as inc

JOBS = "key string, rel_path string, batch long, route string, method string"


def met(spark, jobs, replies):
    rows = [(f"{m} {r}", p, b, r, m) for p, b, m, r in jobs]
    said = spark.createDataFrame([(p, b, json.dumps(v) if not isinstance(v, str | None) else v) for (p, b), v in replies.items()], "rel_path string, batch long, reply string")
    done, failed = inc.replies(said, spark.createDataFrame(rows, JOBS))
    return {r.key: json.loads(r.operation) for r in done.collect()}, {r.key for r in failed.collect()}


def test_own_route_before_same_shape(spark):
    jobs = [("a", 0, "GET", "/u/{id}"), ("a", 0, "GET", "/u/{name}"), ("a", 0, "GET", "/w/{x}"), ("a", 0, "POST", "/w/{x}"), ("b", 0, "GET", "/w/{x}")]
    reply = {"paths": {"/w/{wId}": {"get": {"n": 1}}, "/u/{name}": {"get": {"n": 2}}, "/u/{id}": {"get": {"n": 3}}, "/w/{late}": {"get": {"n": 4}}, "/none": {"post": {"n": 5}}}}
    done, failed = met(spark, jobs, {("a", 0): reply, ("b", 0): None})
    assert done == {"GET /u/{id}": {"n": 3}, "GET /u/{name}": {"n": 2}, "GET /w/{x}": {"n": 1}}
    assert failed == {"POST /w/{x}"}


def test_what_is_somebodys_own_is_not_shared(spark):
    jobs = [("a", 0, "GET", "/u/{id}"), ("a", 0, "GET", "/u/{name}")]
    done, failed = met(spark, jobs, {("a", 0): {"paths": {"/u/{name}": {"get": {"n": 2}}}}})
    assert done == {"GET /u/{name}": {"n": 2}} and failed == {"GET /u/{id}"}


def test_only_request_takes_the_first_operation(spark):
    """Whatever the path and verb; keys that are no verbs, and bodies that are no objects, are no operations."""
    reply = {"paths": {"/x": {"parameters": [], "x-note": {"n": 0}}, "/y": None, "/z": {"get": "text", "put": {"n": 1}, "get ": {"n": 9}}, "/last": {"get": {"n": 2}}}}
    done, failed = met(spark, [("a", -1, "GET", "/asked")], {("a", -1): reply})
    assert done == {"GET /asked": {"n": 1}} and failed == set()
    done, failed = met(spark, [("a", -1, "GET", "/last")], {("a", -1): reply})
    assert done == {"GET /last": {"n": 2}}
    done, failed = met(spark, [("a", -1, "GET", "/asked"), ("a", -2, "GET", "/b")], {("a", -1): {"paths": {}}, ("a", -2): {"paths": {"/b": {"parameters": []}}}})
    assert done == {} and failed == {"GET /asked", "GET /b"}


def test_fields(spark):
    cases = {
        '{"summary": "s",  "n": [1, {"b": 1, "a": 2}]}': '{"summary": "s",  "n": [1, {"b": 1, "a": 2}]}',
        '{"api_description": "old", "x": null}': '{"x":null,"description":"old"}',
        '{"api_description": "old", "description": "new"}': '{"description":"new"}',
        '{"auth_tag": " ", "x-auth-tag": "t"}': '{"x-auth-tag":"t"}',
        '{"auth_tag": "t", "x-auth-tag": ""}': '{"x-auth-tag":"t"}',
        '{"x-auth-tag": null, "a": 1}': '{"a":1}',
        "[]": None,
        "text": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "o string")
    got = {r.o: r.c for r in df.select("o", inc.cleaned(F.col("o")).alias("c")).collect()}
    assert {k: v and json.loads(v) for k, v in got.items()} == {k: v and json.loads(v) for k, v in cases.items()}
    same = '{"summary": "s",  "n": [1, {"b": 1, "a": 2}]}'
    assert got[same] == same
