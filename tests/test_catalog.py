"""Every query with SQL against DuckDB on the smallest tables, as the driver compares them."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from routeloom import catalog


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in con.sql(f"select {','.join(columns)} from ({catalog.ORACLE_SQL[name]}) q").fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_packing_across_blocks(spark):
    """Small blocks: batches that cross block borders are the same as in one block."""
    import random

    from routeloom.operators.budget import pack_batches

    r = random.Random(1)
    rows = [("g" if k % 3 else "h", k, r.choice([1, 50, 400, 6500])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, o long, c long")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        small = {tuple(x) for x in pack_batches(df, "g", "o", "c", rows_per_block=20).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = set()
    for g in ("g", "h"):
        number, now = 0, []
        for _, o, c in [x for x in rows if x[0] == g] + [(g, None, 10**9)]:
            if now and (len(now) >= 10 or sum(y for _, y in now) + c > 5936):
                want.add((g, number, len(now), sum(y for _, y in now), now[0][0]))
                number, now = number + 1, []
            now.append((o, c))
    assert small == want


def test_packing_shuffled_blocks(spark):
    """More rows than range partitioning samples, dealt at random, in many blocks: three groups, one of them a third and one null."""
    import random

    from routeloom.operators.budget import pack_batches

    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]) if k % 3 else "a", k, r.choice([1, 50, 400, 6500])) for k in range(60_000)]
    want = {}
    for g, o, c in rows:
        b = want.setdefault(g, [])
        if not b or b[-1][0] >= 10 or b[-1][1] + c > 5936:
            b.append([0, 0, o])
        b[-1][0] += 1
        b[-1][1] += c
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o long, c long").repartition(7)
    got = pack_batches(df, "g", "o", "c", rows_per_block=2000).collect()
    assert len(got) == sum(map(len, want.values()))
    assert {tuple(x) for x in got} == {(g, k, *x) for g, b in want.items() for k, x in enumerate(b)}


def test_reference_closure_whole(spark, sf):
    """Every root over all edges, against a plain search."""
    edges = {}
    for r in catalog.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").collect():
        edges.setdefault(r[0], set()).add(r[1])
    want = set()
    for root in edges:
        seen, todo = {root}, [root]
        while todo:
            for n in edges.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        want |= {(root, n) for n in seen}
    got = [tuple(r) for r in catalog.QUERIES["reference_closure_whole"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want
