"""Operator 5: quality by naive Bayes support vectors.

Features are indicators of word unigrams and bigrams (lower-cased), hashed to
2**bits places. Each is scaled by the log ratio of its smoothed frequencies in
the two classes; every document's vector has unit length. A linear hinge-loss
model is fitted to them by dual coordinate descent and mixed with its mean
weight, and a logistic curve fitted on rows held back from that turns margins
into probabilities.

The fit uses a sample of the labelled rows: of each class at most about
``fit_rows`` rows and ``fit_chars`` characters in all, taken by a hash of the
id, whole texts each. That bounds what the driver holds; only the 2**bits
weights are broadcast. Scoring reads every whole text, with the features that
the fit uses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import remainder, table

BITS, FIT_ROWS, FIT_CHARS, EPOCHS, COST, MIXTURE, THRESHOLD = 20, 6000, 40_000_000, 15, 1.0, 0.25, 0.7


def features(c: tk.Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct places of each document's indicators, and the offsets of documents in them."""
    w = tk.Words(c)
    two, doc = tk.ngrams(w.hash, w.off, 2)
    x, off, _ = tk.by_doc(np.concatenate([w.doc(), doc]), np.concatenate([w.hash, two]), c.n)
    x = x >> tk.U64(54 - bits)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[off[:-1][off[:-1] < len(x)]] = True  # the first of a document, whatever the one before ended with
    return x[new], np.concatenate([[0], np.cumsum(new)])[off]


def _collect(bits: int):
    def run(batches):
        for b in batches:
            for c in tk.chunks(b.column("text"), "unicode"):
                x, off = features(c, bits)
                blobs = [x[off[i] : off[i + 1]].astype(np.int32).tobytes() for i in range(c.n)]
                yield pa.record_batch({"quality": b.column("quality").slice(c.row, c.n), "pick": b.column("pick").slice(c.row, c.n), "f": pa.array(blobs, pa.binary())})

    return run


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + sum cost_i max(0, 1 - y_i (w x_i + b)), the bias as one more feature of value 1."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i], values[i]
            g = y[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    # Summed anew: steps that were taken back leave roundings, which must not count as weights.
    w[:] = 0.0
    for i in np.flatnonzero(alpha):
        w[rows[i]] += alpha[i] * y[i] * values[i]
    return w, float(alpha @ y)


def _sigmoid(m: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))


def _curve(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on margins by Newton's method, with the usual soft targets."""
    p, n = max(weight[y > 0].sum(), 1e-9), max(weight[y < 0].sum(), 1e-9)
    t = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    z = np.zeros(2)
    x = np.stack([m, np.ones_like(m)], 1)
    for _ in range(50):
        q = _sigmoid(m, *z)
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (q - t)) + 1e-3 * z)
        z = z - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(z[0]), float(z[1])


class Model:
    def __init__(self, weights: np.ndarray, bias: float, curve: tuple[float, float]):
        self.weights, self.bias, self.curve = weights, bias, curve

    def score(self, c: tk.Chunk, bits: int) -> np.ndarray:
        x, off = features(c, bits)
        n = np.diff(off)
        total = np.concatenate([[0.0], np.cumsum(self.weights[x].astype(np.float64))])
        return _sigmoid((total[off[1:]] - total[off[:-1]]) / np.sqrt(np.maximum(n, 1)) + self.bias, *self.curve)


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS, epochs: int = EPOCHS, cost: float = COST, mixture: float = MIXTURE) -> Model | float:
    """docs: doc_id, text; labels: doc_id (distinct), quality (0 or 1). With one class only: its probability."""
    # Ids and lengths alone meet the labels; texts meet the sample, which the rates bound, and which is broadcast.
    known = docs.where("text is not null").select("doc_id", F.length("text").alias("chars")).join(labels, "doc_id")
    counts = {r.quality: r for r in known.groupBy("quality").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()}
    if len(counts) < 2:
        return 0.5 if not counts else float(next(iter(counts)))
    rate = {k: min(1.0, fit_rows / r.n, fit_chars / max(r.chars, 1)) for k, r in counts.items()}
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    some = known.select("doc_id", "quality", pick.alias("pick")).distinct().where(F.col("pick") < F.when(F.col("quality") == 1, int(1e6 * rate[1]) + 1).otherwise(int(1e6 * rate[0]) + 1))
    got = docs.where("text is not null").join(F.broadcast(some), "doc_id").select("quality", F.col("pick").cast("long").alias("pick"), "text").mapInArrow(_collect(bits), "quality int, pick long, f binary").toArrow().sort_by([("pick", "ascending"), ("f", "ascending")])
    if got.num_rows == 0:
        return 0.5
    y = np.where(got.column("quality").to_numpy() == 1, 1.0, -1.0)
    rows = [np.frombuffer(x, np.int32) for x in got.column("f").to_pylist()]
    size = 1 << bits
    back = np.arange(len(y)) % 5 == 0  # held back for the curve
    count = {k: np.ones(size) for k in (1.0, -1.0)}
    for f, k, b in zip(rows, y, back):
        if not b:
            count[k][f] += 1
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    values = [(ratio[f] / np.sqrt(max(len(f), 1))).astype(np.float32) for f in rows]
    fore = np.flatnonzero(~back)
    share = {k: max(1, (y[fore] == k).sum()) for k in (1.0, -1.0)}
    costs = np.array([cost * len(fore) / 2 / share[k] for k in y[fore]])
    w, bias = dual_coordinate_descent([rows[i] for i in fore], [values[i] for i in fore], y[fore], size, costs, epochs)
    used = np.flatnonzero(w)
    w = mixture * w + (1 - mixture) * (np.abs(w[used]).mean() if len(used) else 0.0) * (w != 0)
    at = np.flatnonzero(back) if back.any() and len(set(y[back])) == 2 else fore
    margin = np.array([w[rows[i]] @ values[i] + bias for i in at])
    weight = np.where(y[at] > 0, 1 / rate[1], 1 / rate[0])
    return Model((w * ratio).astype(np.float32), bias, _curve(margin, y[at], weight))


def score(docs: DataFrame, labels: DataFrame, bits: int = BITS, threshold: float = THRESHOLD, **how) -> DataFrame:
    """documents (doc_id, text), labels (doc_id, quality) -> doc_id, held_out, score, predicted; a row per row.

    Learns from labels of 0 or 1 whose document has a text and
    crc32(doc_id as text) mod 4 other than 2; an id labelled twice counts by
    its lower label. Null and empty texts get the score of no features; null
    ids are never held out. Other columns are ignored.
    """
    labels = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(remainder("doc_id", 4) != 2)
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    model = fit(rows, labels, bits, **how)
    if isinstance(model, float):
        out = rows.select("doc_id", F.lit(model).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            for b in batches:
                for c in tk.chunks(b.column("text"), "unicode"):
                    yield pa.record_batch({"doc_id": b.column("doc_id").slice(c.row, c.n), "score": pa.array(shared.value.score(c, bits))})

        out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
