"""Operator 10: duplicate lines or paragraphs, found by a global grouping of digests.

A unit is a line (or a paragraph: lines between blank ones). It is normalised to
its lower-cased words joined by single spaces; units of fewer than
``min_words`` words are left alone. Of equal units the occurrence with the
lowest (doc_id, offset) stays; the others are repeats. Repeats are removed where
they stand together: in a run of consecutive repeats (units under ``min_words``
neither count nor interrupt) of at least ``run_words`` words. So a repeated
passage goes and a customary line that many documents share by itself stays;
``run_words`` 0 removes every repeat. Offsets are code points of the original
text, ends exclusive; a removed unit takes its line break along.

Passages that repeat across documents but not as units (in the middle of longer
lines, or broken otherwise) are found by runs of ``passage`` words, line breaks
aside: every word of such a run goes if a document of lower id has the run too.
Not all runs are grouped. Words are first sampled by the least hash of half-runs
in every run (winnowing), so equal runs share a sample; only runs around samples
that two documents share, and that lines did not remove already, are digested
and grouped like units. This loses no run.

Registered are the line method by itself (op10_repeated_lines: every repeat goes)
and lines in runs with passages (op10_line_dedup).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import forget, table, written

MIN_WORDS, RUN_WORDS, PASSAGE = 5, 50, 50
_LINES = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("place", pa.int32()), ("words", pa.int32()), ("h0", pa.int64()), ("h1", pa.int64())])
_UNITS = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("h0", pa.int64()), ("h1", pa.int64())])


def _cuts(c: tk.Chunk, paragraphs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of units, none across documents; a span ends after its line break."""
    breaks = np.flatnonzero(c.buf == 10) + 1
    if paragraphs and len(breaks):
        # A break counts if only blanks lie between it and the one before.
        ink = np.concatenate([[0], np.cumsum(~tk._SPACE[c.buf])])
        empty = np.zeros(len(breaks), bool)
        empty[1:] = ink[breaks[1:]] == ink[breaks[:-1]]
        breaks = breaks[empty]
    edge = np.unique(np.concatenate([c.off, breaks]))
    return edge[:-1], edge[1:]


def _own_words(plain: tk.Chunk, folded: tk.Words) -> tk.Words:
    """The words of the original text: lower-casing may change the bytes of a letter, but neither words nor their order.

    Their places in the two texts are the same only where all is ASCII: letters
    that grow and letters that shrink may make up for one another.
    """
    own = tk.Words(plain) if (plain.buf & 0x80).any() else folded
    if own.n != folded.n:
        raise AssertionError("lower-casing changed words")
    return own


def _units(min_words: int, paragraphs: bool):
    def run(batches):
        for b in batches:
            ids, versions = b.column("doc_id"), b.column("version").to_numpy(zero_copy_only=False)
            ids = ids.to_numpy(zero_copy_only=False)
            for c in tk.chunks(b.column("text"), "unicode"):
                plain = next(tk.chunks(b.column("text").slice(c.row, c.n), "", 1 << 62, 1 << 30))
                w = tk.Words(c)
                own = _own_words(plain, w)
                start, end = _cuts(plain, paragraphs)
                first, last = np.searchsorted(own.start, start), np.searchsorted(own.start, end)
                full = np.flatnonzero(last - first >= min_words)
                if not len(full):
                    continue
                up, down = tk.powers(w.n + 1)
                h = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    s = np.zeros(w.n + 1, tk.U64)
                    np.cumsum(tk.mix(w.hash + tk.U64(salt)) * up[: w.n], out=s[1:])
                    h.append(tk.mix((s[last[full]] - s[first[full]]) * down[first[full]] + (last - first)[full].astype(tk.U64)).view(np.int64))
                points = np.concatenate([[0], np.cumsum((plain.buf & 0xC0) != 0x80)])
                doc = np.searchsorted(plain.off, start[full], "right") - 1
                base = points[plain.off[doc]]
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                yield tk.rows_to_batch({"doc_id": ids[c.row + doc].astype(np.int64), "version": versions[c.row + doc], "start": (points[start[full]] - base).astype(np.int32), "end": (points[end[full]] - base).astype(np.int32), "place": place.astype(np.int32), "words": (last - first)[full].astype(np.int32), "h0": h[0], "h1": h[1]}, _LINES)

    return run


_SALTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
_SAMPLES = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("at", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("h", pa.int64())])


def _words(batch):
    """Chunks of a batch with what runs need: folded words, documents of words, and code-point spans in the original."""
    for c in tk.chunks(batch.column("text"), "unicode"):
        w = tk.Words(c)
        plain = next(tk.chunks(batch.column("text").slice(c.row, c.n), "", 1 << 62, 1 << 30))
        own = _own_words(plain, w)
        doc = w.doc()
        points = np.concatenate([[0], np.cumsum((plain.buf & 0xC0) != 0x80)])
        base = points[plain.off[doc]]
        yield c, w, doc, points[own.start] - base, points[own.end] - base


def _runs(w: tk.Words, n: int, salt: int) -> np.ndarray:
    """Hashes of n words from each word on (wherever they end)."""
    up, down = tk.powers(w.n + 1)
    s = np.zeros(w.n + 1, tk.U64)
    np.cumsum(tk.mix(w.hash + tk.U64(salt)) * up[: w.n], out=s[1:])
    return tk.mix((s[n:] - s[:-n]) * down[: w.n + 1 - n])


def _slide(x: np.ndarray, n: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of n values from each place on."""
    size, out = 1, x
    while size * 2 <= n:
        out, size = least(out[:-size], out[size:]), size * 2
    return least(out[: len(x) - n + 1], out[n - size : len(x) - size + 1]) if size < n else out


def _samples(passage: int):
    half = (passage + 1) // 2
    span = passage - half + 1

    def run(batches):
        for b in batches:
            ids, versions = (b.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "version"))
            for c, w, doc, start, end in _words(b):
                if w.n < passage:
                    continue
                g = _runs(w, half, _SALTS[0])
                inside = doc[: w.n - passage + 1] == doc[passage - 1 :]
                low = np.where(inside, _slide(g, span, np.minimum), tk.U64(0))
                none = np.zeros(span - 1, tk.U64)
                at = np.flatnonzero((_slide(np.concatenate([none, low, none]), span, np.maximum) == g) & (doc[: len(g)] == doc[half - 1 :]))
                if not len(at):
                    continue
                d = doc[at]
                first, last = np.maximum(at - span + 1, w.off[d]), np.minimum(at + passage, w.off[d + 1]) - 1
                yield tk.rows_to_batch({"doc_id": ids[c.row + d].astype(np.int64), "version": versions[c.row + d], "at": (at - w.off[d]).astype(np.int32), "start": start[first].astype(np.int32), "end": end[last].astype(np.int32), "h": g[at].view(np.int64)}, _SAMPLES)

    return run


def _around(passage: int):
    """Runs that hold one of the samples ``places`` of their document."""
    span = passage - (passage + 1) // 2 + 1

    def run(batches):
        for b in batches:
            ids, versions = (b.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "version"))
            places = b.column("places").to_pylist()
            for c, w, doc, start, end in _words(b):
                if w.n < passage:
                    continue
                edge = np.zeros(w.n + 1, np.int64)
                for k in range(c.n):
                    at = np.array(places[c.row + k], np.int64)
                    np.add.at(edge, np.maximum(at - span + 1, 0) + w.off[k], 1)
                    np.add.at(edge, at + 1 + w.off[k], -1)
                inside = doc[: w.n - passage + 1] == doc[passage - 1 :]
                i = np.flatnonzero(inside & (np.cumsum(edge)[: len(inside)] > 0))
                h = [_runs(w, passage, salt)[i].view(np.int64) for salt in _SALTS]
                yield tk.rows_to_batch({"doc_id": ids[c.row + doc[i]].astype(np.int64), "version": versions[c.row + doc[i]], "start": start[i].astype(np.int32), "end": end[i + passage - 1].astype(np.int32), "h0": h[0], "h1": h[1]}, _UNITS)

    return run


def _merged(batches):
    """Overlapping spans of a document as one."""
    for b in batches:
        lists = b.column("removed")
        spans, size = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        start, end = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        doc = np.repeat(np.arange(b.num_rows), size)
        key = doc << 32
        reach = np.maximum.accumulate(key + end) if len(end) else end
        new = np.ones(len(start), bool)
        new[1:] = (key + start)[1:] >= reach[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start))[: len(first)] - 1
        off = np.searchsorted(doc[first], np.arange(b.num_rows + 1))
        pairs = pa.StructArray.from_arrays([pa.array(start[first].astype(np.int32)), pa.array((reach - key)[last].astype(np.int32))], ["start", "end"])
        yield pa.record_batch([b.column("doc_id"), b.column("version"), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pairs)], ["doc_id", "version", "removed"])


def _together(run_words: int):
    """Repeats of a document (start, end, place, words), in order: those in runs of consecutive places of ``run_words`` words."""

    def run(batches):
        for b in batches:
            lists = b.column("removed")
            spans, size = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            start, end, place, words = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            doc = np.repeat(np.arange(b.num_rows), size)
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
            group = np.cumsum(new) - 1
            keep = np.bincount(group, words)[group] >= run_words if len(group) else new
            off = np.searchsorted(doc[keep], np.arange(b.num_rows + 1))
            pairs = pa.StructArray.from_arrays([pa.array(start[keep].astype(np.int32)), pa.array(end[keep].astype(np.int32))], ["start", "end"])
            out = pa.record_batch([b.column("doc_id"), b.column("version"), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pairs)], ["doc_id", "version", "removed"])
            yield out.filter(pa.array(np.diff(off) > 0))

    return run


def _passages(rows: DataFrame, lines: DataFrame, passage: int) -> DataFrame:
    """rows (doc_id, text, version), lines (doc_id, version, removed) -> doc_id, version, removed with repeated passages too.

    Tables on the way are deleted as soon as what they led to is written.
    """
    doc = F.struct("doc_id", "version")
    samples = written(rows.mapInArrow(_samples(passage), "doc_id long, version long, at int, start int, end int, h long"), "samples")
    # As tables, so that adaptive execution may split the joins where a sample or a run is frequent.
    twice = written(samples.groupBy("h").agg(F.min(doc).alias("first"), F.max(doc).alias("last")).where("first < last").select("h", "first"), "twice")
    hits = written(samples.join(twice, "h"), "hits")
    forget(samples)
    forget(twice)
    # Samples whose later surroundings went with their lines need no digests.
    gone = F.aggregate("removed", F.lit(0), lambda n, x: n + F.greatest(F.least(x["end"], F.col("end")) - F.greatest(x["start"], F.col("start")), F.lit(0)))
    live = written(hits.where(doc > F.col("first")).join(lines, ["doc_id", "version"], "left").where(F.coalesce(gone, F.lit(0)) < F.col("end") - F.col("start")).select("h").distinct(), "live")
    places = hits.join(live, "h", "left_semi").groupBy("doc_id", "version").agg(F.collect_set("at").alias("places"))
    runs = written(rows.join(places, ["doc_id", "version"]).select("doc_id", "version", "text", "places").mapInArrow(_around(passage), "doc_id long, version long, start int, end int, h0 long, h1 long"), "runs")
    forget(hits)
    forget(live)
    first = written(runs.groupBy("h0", "h1").agg(F.min(doc).alias("first"), F.max(doc).alias("last")).where("first < last").select("h0", "h1", "first"), "first")
    late = runs.join(first, ["h0", "h1"]).where(doc > F.col("first")).select("doc_id", "version", F.struct("start", "end").alias("x"))
    both = late.unionByName(lines.select("doc_id", "version", F.explode("removed").alias("x")))
    spans = both.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("x")).alias("removed"))
    out = written(spans.mapInArrow(_merged, "doc_id long, version long, removed array<struct<start:int,end:int>>"), "passages")
    for x in (runs, first, lines):
        forget(x)
    return out


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, paragraphs: bool = False, passage: int = PASSAGE, run_words: int = RUN_WORDS) -> DataFrame:
    """documents (doc_id, text) -> doc_id, text (what stays), removed: array of (start, end), n_removed.

    One row per input row. Null ids, null and empty texts pass unchanged (null
    text stays null). Rows that repeat both id and text are one occurrence: they
    keep or lose the same units. Other columns are ignored. ``passage`` 0 leaves
    passages alone.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("version", F.xxhash64("text"))
    units = written(docs.where("doc_id is not null and text is not null").mapInArrow(_units(min_words, paragraphs), "doc_id long, version long, start int, end int, place int, words int, h0 long, h1 long"), "units")
    at = F.struct("doc_id", "version", "start")
    first = written(units.groupBy("h0", "h1").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last").select("h0", "h1", "first"), "firsts")
    gone = units.join(first, ["h0", "h1"]).where(at > F.col("first"))
    spans = gone.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("start", "end", "place", "words"))).alias("removed"))
    spans = written(spans.mapInArrow(_together(run_words), "doc_id long, version long, removed array<struct<start:int,end:int>>"), "spans")
    forget(units)
    forget(first)
    if passage:
        spans = _passages(docs.where("doc_id is not null and text is not null"), spans, passage)
    out = docs.join(spans, ["doc_id", "version"], "left")
    before = F.transform("removed", lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.get("removed", i - 1)["end"]))
    kept = F.zip_with("removed", before, lambda x, s: F.col("text").substr(s + 1, x["start"] - s))
    tail = F.expr("substring(text, element_at(removed, -1).end + 1)")
    nothing = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return out.select("doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail)).alias("text"), F.coalesce("removed", nothing).alias("removed"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"))


def _query(spark: SparkSession, sf_dir: str, passage: int, run_words: int) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), passage=passage, run_words=run_words)
    return out.select("doc_id", "n_removed", F.length("text").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"), "removed", F.col("text").alias("kept_text"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated line of five words or more: the earliest stays, wherever the others stand."""
    return _query(spark, sf_dir, 0, 0).select("doc_id", "n_removed", "kept_chars", "kept_sha256")


def op10_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated lines of fifty words or more, and passages within lines."""
    return _query(spark, sf_dir, PASSAGE, RUN_WORDS)


#: The line method: digests are of no concern here, lines are grouped as they are.
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+$') AS lines FROM documents)),
w AS (SELECT *, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS words FROM l),
r AS (SELECT *, len(words) >= 5 AND row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1 AS gone FROM w),
k AS (SELECT doc_id, count_if(gone)::INTEGER AS n_removed, coalesce(string_agg(line, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_removed, 0) AS n_removed, length(coalesce(k.kept, d.text))::INTEGER AS kept_chars, sha256(coalesce(k.kept, d.text)) AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)
"""
