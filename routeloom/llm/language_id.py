"""Operator 9: language of whole texts by words first, character n-grams for words never seen.

A word is a run of letters, lower-cased. A word that the model knows costs
-log10 of its relative frequency in each language (a fixed penalty where a
language lacks it). A word that no language has costs the mean of its known
longest n-grams instead: 5 letters, then 4, and so on to 1, blanks at both ends
counted. The language of the least mean cost over all words wins.

The classifier is fitted on a sample of the labelled rows, at most about
``fit_chars`` characters in all, shared evenly by the languages (each
language's rows are taken at an even rate by a hash of doc_id and text). That
bound is also the bound of what is broadcast. Prediction covers every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .shared import remainder, table, without

FIT_CHARS, MAX_LANGUAGES, LONGEST, PENALTY, UNDETERMINED = 16_000_000, 500, 5, 7.0, "und"
_letters: list[np.ndarray] = []


def letters() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 65536: whether it is a letter; its lower case, where that is one code point."""
    if not _letters:
        chars = [chr(i) for i in range(0x10000)]
        _letters.append(np.array([c.isalpha() for c in chars]))
        _letters.append(np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], np.uint32))
    return _letters[0], _letters[1]


class LetterRuns:
    """Words of a chunk of texts: spans in ``points`` (lower-cased, every word with blanks around), hashes and documents."""

    def __init__(self, c: tk.Chunk):
        alpha, low = letters()
        p = np.frombuffer(bytes(c.buf).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        place = np.concatenate([[0], np.cumsum((c.buf & 0xC0) != 0x80)])
        off = place[c.off]
        small = p < 0x10000
        if small.all():
            ink, p = alpha[p], low[p]
        else:
            q = np.where(small, p, 0)
            ink, p = alpha[q], np.where(small, low[q], p)
            for x in np.unique(p[~small]):
                if chr(x).isalpha():
                    ink = ink | (p == x)
        before = np.zeros(len(ink), bool)
        before[1:] = ink[:-1]
        before[off[:-1][off[:-1] < len(ink)]] = False
        after = np.zeros(len(ink), bool)
        after[:-1] = ink[1:]
        last = off[1:] - 1
        after[last[last >= 0]] = False
        self.points, self.start, self.end = p, np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
        self.h = tk.prefix(p)
        self.hash = tk.span_hash(p, self.start, self.end, self.h)
        self.off = np.searchsorted(self.start, off)

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n-gram hashes of the given words, blanks at both ends counted, and the place in ``words`` of each."""
        start, end = self.start[words], self.end[words]
        if n == 1:
            size = end - start
            which = np.repeat(np.arange(len(words)), size)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + start[which]
            return tk.mix(self.points[at].astype(tk.U64) + tk.U64(0xABCDEF)), which
        up, down = tk.powers(len(self.points) + 2)
        size = np.maximum(end - start + 3 - n, 0)  # windows of the word with a blank on either side
        which = np.repeat(np.arange(len(words)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + start[which] - 1
        a, b = np.maximum(at, start[which]), np.minimum(at + n, end[which])
        h = (self.h[b] - self.h[a]) * down[a]
        edge = (at < start[which]).astype(tk.U64) + tk.U64(2) * (at + n > end[which]).astype(tk.U64)
        return tk.mix(h ^ (edge + tk.U64(4 * n)) * tk.U64(0x9E3779B97F4A7C15)), which


def _count(batches):
    """(lang, kind, hash, count): kind 0 for words, n for n-grams."""
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        found: dict = {}
        for c in tk.chunks(b.column("text")):
            r = LetterRuns(c)
            doc = np.repeat(np.arange(c.n), np.diff(r.off))
            for lang in set(langs[c.row : c.row + c.n]):
                own = np.flatnonzero((langs[c.row : c.row + c.n] == lang)[doc])
                found.setdefault((lang, 0), []).append(r.hash[own])
                for n in range(1, LONGEST + 1):
                    found.setdefault((lang, n), []).append(r.grams(own, n)[0])
        for (lang, kind), hashes in found.items():
            x, k = np.unique(np.concatenate(hashes), return_counts=True)
            yield pa.record_batch({"lang": pa.array([lang] * len(x), pa.string()), "kind": pa.array(np.full(len(x), kind, np.int32)), "hash": pa.array(x.view(np.int64)), "n": pa.array(k.astype(np.int64))})


class Model:
    """Per kind: sorted hashes and a (hash, language) matrix of costs."""

    def __init__(self, langs: list[str], prior: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.prior, self.tables, self.seen = langs, prior, tables, []
        for keys, _ in tables:
            bits = max(12, min(24, int(len(keys) * 8).bit_length()))
            seen = np.zeros(1 << bits, bool)
            seen[keys >> tk.U64(64 - bits)] = True
            self.seen.append((bits, seen))

    def find(self, kind: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` of those known, and their rows in the table."""
        keys = self.tables[kind][0]
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits, seen = self.seen[kind]
        at = np.flatnonzero(seen[hashes >> tk.U64(64 - bits)])
        slot = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
        ok = keys[slot] == hashes[at]
        return at[ok], slot[ok]

    def predict(self, c: tk.Chunk) -> tuple[list[str], np.ndarray]:
        r, n = LetterRuns(c), len(self.langs)
        words = len(r.start)
        doc = np.repeat(np.arange(c.n), np.diff(r.off))
        total, known = np.zeros((c.n, n)), np.zeros(c.n)
        at, slot = self.find(0, r.hash)
        for k in range(n):
            total[:, k] += np.bincount(doc[at], self.tables[0][1][slot, k], c.n)
        known += np.bincount(doc[at], minlength=c.n)
        left = np.ones(words, bool)
        left[at] = False
        left = np.flatnonzero(left)
        for size in range(LONGEST, 0, -1):
            if not len(left):
                break
            h, which = r.grams(left, size)
            at, slot = self.find(size, h)
            hits = np.bincount(which[at], minlength=len(left))
            share = 1.0 / np.maximum(hits, 1)[which[at]]
            for k in range(n):
                total[:, k] += np.bincount(doc[left[which[at]]], self.tables[size][1][slot, k] * share, c.n)
            known += np.bincount(doc[left], hits > 0, c.n)
            left = left[hits == 0]
        mean = total / np.maximum(known, 1)[:, None]
        # The prior only decides where the text says nothing.
        cost = mean * np.minimum(known, 20)[:, None] * np.log(10) - np.where(known == 0, 1.0, 1e-6)[:, None] * np.log(self.prior)
        like = np.exp(cost.min(1, keepdims=True) - cost)
        like /= like.sum(1, keepdims=True)
        best = like.argmax(1)
        some = np.diff(r.off) > 0
        return [self.langs[k] if ok else UNDETERMINED for k, ok in zip(best, some)], np.where(some, like[np.arange(c.n), best], 0.0)


def fit(labelled: DataFrame, fit_chars: int = FIT_CHARS) -> Model | None:
    """labelled: text, lang (neither null) and an integer ``pick`` that is even over 0..999999."""
    known = labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    known = [r for r in known if r.chars]
    if not known:
        return None
    rate = F.lit(0)
    for r in known:
        rate = F.when(F.col("lang") == r.lang, int(1_000_000 * min(1.0, fit_chars / len(known) / r.chars)) + 1).otherwise(rate)
    counts = labelled.where(F.col("pick") < rate).select("text", "lang").mapInArrow(_count, "lang string, kind int, hash long, n long").groupBy("lang", "kind", "hash").agg(F.sum("n").alias("n")).toArrow()
    langs = [r.lang for r in known]
    place = {x: k for k, x in enumerate(langs)}
    codes = counts.column("lang").combine_chunks().dictionary_encode()
    lang = np.array([place[x] for x in codes.dictionary.to_pylist()], np.int64)[codes.indices.to_numpy()]
    kind, h, n = (counts.column(x).to_numpy() for x in ("kind", "hash", "n"))
    tables = []
    for k in range(LONGEST + 1):
        own = kind == k
        keys, inv = np.unique(h[own].view(tk.U64), return_inverse=True)
        cost = np.full((len(keys), len(langs)), PENALTY, np.float32)
        total = np.maximum(np.bincount(lang[own], n[own], len(langs)), 1)
        cost[inv, lang[own]] = np.minimum(PENALTY, -np.log10(n[own] / total[lang[own]]))
        tables.append((keys, cost))
    rows = np.array([r.rows for r in known], float)
    return Model(langs, rows / rows.sum(), tables)


def predict(docs: DataFrame, model: Model | None, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs, all columns, with ``label`` string and ``score`` double; ``und`` and 0 for texts that are null or without a letter.

    Columns of docs that already have one of these names, in any case, are replaced.
    """
    docs = without(docs, label, score)
    if model is None:
        return docs.withColumn(label, F.lit(UNDETERMINED)).withColumn(score, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            langs, scores = [], []
            for c in tk.chunks(b.column(place)):
                x, y = shared.value.predict(c)
                langs += x
                scores.append(y)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*b.schema.names, label, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows the model may learn from: crc32(doc_id as text) mod 3 is not 1, text and lang not null."""
    part = docs.select(F.col("doc_id").cast("long"), "text", "lang").where("text is not null and lang is not null").where(F.coalesce(remainder("doc_id", 3) != 1, F.lit(True)))
    return part.withColumn("pick", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)))


def identify(docs: DataFrame, fit_chars: int = FIT_CHARS) -> DataFrame:
    """documents (doc_id, text, lang) -> doc_id, held_out, lang_pred, score; a row per row.

    Null ids are never held out. A text with letters but without any known
    n-gram, and an empty model, follow the prior. Other columns are ignored.
    """
    model = fit(learnable(docs), fit_chars)
    rows = predict(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return rows.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
