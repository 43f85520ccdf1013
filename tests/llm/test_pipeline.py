"""The pipeline on the smallest tables against its operators' brute force."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from routeloom.llm import secrets, sentencepiece_fst
from routeloom.llm.shared import table

from .data import awkward
from .test_against_brute_force import links


def test_run(spark, sf):
    import sentencepiece as sp

    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    kept = {k for k, t in docs.items() if any(c.isalpha() for c in t or "")}
    near = links({k: docs[k] for k in kept})
    label = {k: k for k in kept}
    for _ in range(20):
        for a, bs in near.items():
            for b in bs:
                label[a] = label[b] = min(label[a], label[b])
    kept = {k for k in kept if label[k] == k}
    fold = lambda t: re.sub(r"\s+", " ", t.strip().lower())
    bench = [fold(r.text) for r in table(spark, sf, "benchmark").collect()]
    plain = {k: fold(docs[k]) for k in kept}
    kept = {k for k in kept if not any(b[s : s + 60] in plain[k] for b in bench for s in range(max(1, len(b) - 59)))}
    m = sp.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == kept
    for k in kept:
        text = secrets.masked(docs[k], secrets.linked(docs[k])[1])
        assert got[k].text == text and got[k].n_chars == len(text) and list(got[k].ids) == m.encode(text)


def test_stages_keep_columns(spark, sf):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_no_language_known(spark, sf):
    """Where no row has a language, only texts without a letter go."""
    docs = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.identify_language(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 2, 2, 3, 7, 8, 9, 10, 11, 13, 14]
