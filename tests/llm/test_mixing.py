"""Mixing against plain Python: targets by dealing out the excess again and again, every document's copies."""

import hashlib
import re

import duckdb
import pytest

from routeloom.llm import mixing
from routeloom.llm.shared import table

from .data import awkward, empty


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def dealt(rows, weights=(5, 2, 1), share=1.5):
    """source -> (words, target): what is over a limit is dealt to the others by weight."""
    words = {}
    for _, text, source in rows:
        words[source] = words.get(source, 0) + size(text)
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, rest, free = dict.fromkeys(order, 0.0), share * sum(words.values()), set(order)
    while rest > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / total
        rest = sum(max(0.0, target[s] - 2 * words[s]) for s in free)
        for s in list(free):
            if target[s] >= 2 * words[s]:
                target[s] = 2.0 * words[s]
                free.discard(s)
    return {s: (words[s], target[s]) for s in order}


def copies(doc_id, text, rate, seed=0):
    digest = hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
    return int(rate) + (int(digest[:13], 16) / 2**52 < rate - int(rate))



def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, sf, "documents").collect()]
    got = {r.doc_id: r for r in mixing.op12(spark, sf).collect()}
    by = dealt(rows)
    for doc_id, text, source in rows:
        assert (got[doc_id].size, got[doc_id].source_size) == (size(text), by[source][0]) and got[doc_id].target == pytest.approx(by[source][1], rel=1e-9)
        assert got[doc_id].taken == size(text) * copies(doc_id, text, got[doc_id].target / got[doc_id].source_size)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = mixing.op12(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({mixing.ORACLE})").fetchall())


@pytest.mark.parametrize("few", [1000, 0])
def test_awkward(spark, monkeypatch, few):
    """Few and many sources (the salted join), nulls, no words, repeated rows, a source with most rows."""
    monkeypatch.setattr(mixing, "FEW", few)
    rows = [(k, "a b c " * (k % 7), "big" if k % 3 else f"s{k % 11}") for k in range(200)] + [(5, None, None), (None, "x y", None), (7, "", "nothing"), (9, "q", "é"), (9, "q", "é"), (3, "\U0001f600 z", "￿"), (4, "w", "\U0001f600")]
    df = spark.createDataFrame([(*r, "1", "2") for r in rows], "doc_id long, text string, source string, size string, rank string").repartition(5)
    out = mixing.copies(df)
    assert out.columns == ["doc_id", "text", "source", "rank", *mixing.RESULT]
    by = dealt(rows)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        words, target = by[r.source]
        assert r.source_size == words and r.target == pytest.approx(target, rel=1e-9) and r["size"] == size(r.text)
        assert r.copies == copies(r.doc_id, r.text, r.target / words if words else 0.0) and r.taken <= 2 * r["size"]
    taken = sum(r.copies for r in got)
    assert mixing.mix(df).count() == taken
    assert sum(t for _, t in by.values()) == pytest.approx(1.5 * sum(w for w, _ in by.values()))


def test_given_weights_and_empty(spark):
    df = spark.createDataFrame([(k, "a b", "xy"[k % 2]) for k in range(10)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("x", 1), ("x", 3), ("z", 9)], "source string, weight int")
    got = {r.source: r.target for r in mixing.copies(df, weights, share=0.5).collect()}
    assert got == {"x": 10.0, "y": 0.0}
    assert mixing.copies(empty(spark)).count() == 0 and mixing.mix(awkward(spark)).count() >= 0
