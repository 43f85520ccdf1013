"""Every operator on the awkward table and on empty tables: defined results, no crash."""

from routeloom.llm import anisotropic, decontaminate, jaccard_join, kneser_ney, language_id, licenses, line_dedup, quality, secrets, sentencepiece_fst

from .data import awkward, empty, items, labels


def test_jaccard_join(spark):
    got = sorted((r.doc_id, r.class_id, r.n_links, r.n_class_links) for r in jaccard_join.jaccard_join(awkward(spark)).collect())
    by = {g[0]: g for g in got}
    assert len(got) == 15  # the null id is left out
    assert all(by[k][1:] == (1, 4, 2) for k in (1, 2, 3, 13))  # three rows of one class, a near copy, a text that repeats it
    assert all(by[k][1:] == (k, 0, 0) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert jaccard_join.jaccard_join(empty(spark)).count() == 0


def test_decontamination(spark):
    docs = awkward(spark)
    base = docs.where("doc_id = 1").first().text
    bench = items(spark, [(1, base[100:220], 7), (2, None, 7), (3, "", 7), (4, "short", 7), (5, base[100:220], 8), (None, base, 1)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {(d, i) for d in (1, 2, 3, 13) for i in (1, 5)}
    assert decontaminate.contamination(docs, items(spark)).count() == 0
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 16 - 6  # the row without an id holds the passage too
    rows = [(1, base), (1, "something else that is clean"), (None, None), (2, "")]
    kept = decontaminate.decontaminate(spark.createDataFrame([(*x, 0, 1) for x in rows], "doc_id long, text string, version long, item_id int"), bench)
    assert [(r.doc_id, r.text) for r in kept.collect()] == rows[1:]
    assert decontaminate.decontaminate(docs, items(spark)).count() == 16


def test_kneser_ney(spark):
    got = kneser_ney.score_documents(awkward(spark)).collect()
    assert len(got) == 16 and all(r.score < 0 and r.n_tokens >= 1 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (4, 5, 6)} == {1}
    assert kneser_ney.score_documents(empty(spark)).count() == 0
    nothing = awkward(spark).where("doc_id is null").limit(0).unionByName(awkward(spark).where("doc_id = 4"))
    assert kneser_ney.score_documents(nothing).first().n_tokens == 1


def test_secrets(spark):
    got = secrets.secret_spans(awkward(spark)).collect()
    assert len(got) == 16 and all(r.spans == "" for r in got if r.doc_id != 11)
    assert secrets.secret_spans(empty(spark)).count() == 0
    masked = secrets.mask_secrets(awkward(spark))
    assert masked.schema == awkward(spark).schema and masked.count() == 16


def test_quality(spark):
    docs = awkward(spark)
    some = labels(spark, [(1, 1, 0, "x"), (2, 0, 0, "x"), (2, 1, 0, "x"), (3, 1, 1, "x"), (7, 0, 0, "x"), (8, 0, None, "x"), (None, 1, 1, "x"), (9, None, 1, "x"), (99, 1, 1, "x")])
    for lab in (some, labels(spark), labels(spark, [(1, 1, 0, "x")])):
        got = quality.score(docs, lab).collect()
        assert len(got) == 16 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert quality.score(empty(spark), some).count() == 0


def test_sentencepiece(spark):
    got = sentencepiece_fst.encode(awkward(spark)).collect()
    assert len(got) == 16
    assert all(r.round_trip == ("▁" not in (r.text or "")) for r in got)
    assert all(len(r.ids) == r.n_pieces for r in got) and {r.n_pieces for r in got if not r.text} == {0}
    back = sentencepiece_fst.decode(sentencepiece_fst.encode(awkward(spark))).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back)
    assert sentencepiece_fst.encode(empty(spark)).count() == 0


def test_licenses(spark):
    assert licenses.scan(awkward(spark)).count() == 0
    assert licenses.scan(empty(spark)).count() == 0


def test_language(spark):
    got = {r.doc_id: r for r in language_id.identify(awkward(spark)).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (4, 5, 6, 12))
    assert all(got[k].lang_pred in ("en", "de", "fr") for k in (1, 7, 9, 10, 11))
    assert language_id.identify(empty(spark)).count() == 0
    unknown = awkward(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language_id.identify(unknown).collect()} == {"und"}


def test_line_dedup(spark):
    got = {}
    for r in line_dedup.line_dedup(awkward(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == 16
    assert got[1][0].n_removed == 0 and got[2][0].n_removed == 1 and got[2][0].text == ""
    assert got[13][0].n_removed == 2 and got[13][0].text == "a\n\n\nb\n"
    assert got[4][0].text is None and got[None][0].n_removed == 0
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_nearest(spark):
    v = [(0, [1.0, 0.0, 0.0]), (1, [0.9, 0.1, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, [1.0, None, 1.0]), (7, [1.0]), (100, [1.0, 0.0, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (200, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, e, "x", "y") for i, e in v], "vec_id long, embedding array<float>, score string, v string")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 4)) for r in anisotropic.nearest(df).collect())
    assert got == [(0, 1, 8, 0.0), (0, 2, 100, 0.0), (0, 3, 1, 0.1414), (100, 1, 0, 0.0), (100, 2, 8, 0.0), (100, 3, 1, 0.1414)]
    assert anisotropic.nearest(df.limit(0)).count() == 0
