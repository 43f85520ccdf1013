"""Operator 3: interpolated modified Kneser-Ney bigram model.

Counted in Spark, stored as sorted arrays of hashes in the folder all executors
share, and memory-mapped there by the workers that score.

* Words are runs without ASCII white space, A-Z lower-cased; every text closes
  with one end token, and starts from a begin context.
* Vocabulary: word hashes in ``shards`` sorted arrays by their leading bits. A
  word's id is its rank over all shards.
* Bigrams: (context id, word id) packed in 64 bits. Map tasks sort and count a
  run of tokens and send one sorted block to each partition; a partition merges
  its blocks into one sorted array. Bigrams are dealt by context, so that a
  context's totals are complete in one place; those of frequent contexts (above
  one token in ``HOT``, thus fewer than ``HOT`` words) are dealt by both words.
* Per word: count, context total, continuation count and the numbers of
  successors seen once, twice and more often, as dense arrays by id.

P(w|v) = max(c - D(c), 0) / c(v.) + g(v) P(w), P(w) = max(k - D(k), 0) / k(.)
+ g / (V + 1), with k the continuation count and D the three modified discounts
of each order from its counts of counts.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import remainder, scratch, table, written

END = tk.mix(np.array([0xE0D], tk.U64))[0]
HOT, RUN_TOKENS, SHARD_WORDS, PART_BIGRAMS = 2000, 1 << 21, 1 << 21, 1 << 21
_FIELDS = ("count", "total", "cont", "n1", "n2", "n3")


# --- files in the shared folder --------------------------------------------------------------


def _local(uri: str) -> str | None:
    return uri.removeprefix("file://") if uri.startswith("file:") else uri if "://" not in uri else None


def save(uri: str, array: np.ndarray) -> None:
    """Write-then-rename, so a repeated task leaves the same file."""
    path = _local(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        array.tofile(tmp := f"{path}.{uuid.uuid4().hex}")
        os.replace(tmp, path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(tmp := f"{path}.{uuid.uuid4().hex}") as out:
            out.write(memoryview(np.ascontiguousarray(array)).cast("B"))
        store.move(tmp, path)


def mapped(uri: str, dtype) -> np.ndarray:
    """A file as a memory map; of a store that is no file system, a worker maps its own copy."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, far = fs.FileSystem.from_uri(uri)
        path = os.path.join(tempfile.gettempdir(), "routeloom-" + uri.rsplit("/", 2)[-2] + "-" + uri.rsplit("/", 1)[-1])
        if not os.path.exists(path):
            with store.open_input_stream(far) as data, open(tmp := f"{path}.{uuid.uuid4().hex}", "wb") as out:
                shutil.copyfileobj(data, out)
            os.replace(tmp, path)
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


class Mapped:
    """Arrays of a model's folder, each mapped when it is first asked for; the least recently used go beyond ``most``."""

    def __init__(self, folder: str, most: int = 8192):
        self.get = lru_cache(most)(lambda name, dtype: mapped(f"{folder}/{name}", dtype))

    def counts(self, name: str, size: int) -> np.ndarray:
        """Counts of ``size`` entries, as wide as ``save_counts`` wrote them."""
        x = self.get(name, np.uint8)
        return x.view(np.int64 if len(x) == 8 * size else np.uint32)


def save_counts(uri: str, array: np.ndarray) -> None:
    """Counts in four bytes each, in eight where one of them needs it."""
    save(uri, array.astype(np.uint32 if array.max(initial=0) < 2**32 else np.int64))


# --- tokens ----------------------------------------------------------------------------------


def tokens(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each document with its end token, and offsets."""
    w = tk.Words(c)
    off = w.off + np.arange(len(w.off))
    out = np.empty(w.n + c.n, tk.U64)
    out[off[1:] - 1] = END
    own = np.ones(len(out), bool)
    own[off[1:] - 1] = False
    out[own] = w.hash
    return out, off


class Vocabulary:
    def __init__(self, folder: str, sizes: list[int]):
        self.bits = (len(sizes) - 1).bit_length()
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.size = int(self.base[-1])
        self.keys = [mapped(f"{folder}/words-{k}", tk.U64) for k in range(len(sizes))]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for unknown words."""
        out = np.full(len(hashes), -1, np.int64)
        x, inv = np.unique(hashes, return_inverse=True)
        got = np.full(len(x), -1, np.int64)
        cut = np.searchsorted(x, np.arange(1, len(self.keys), dtype=tk.U64) << tk.U64(64 - self.bits)) if self.bits else []
        for k, (a, b) in enumerate(zip([0, *cut], [*cut, len(x)])):
            keys = self.keys[k]
            if a < b and len(keys):
                at = np.minimum(np.searchsorted(keys, x[a:b]), len(keys) - 1)
                got[a:b] = np.where(keys[at] == x[a:b], at + self.base[k], -1)
        out[:] = got[inv]
        return out


class Dealer:
    """The partition of each bigram: by context, by both words for hot contexts."""

    def __init__(self, parts: int, hot: np.ndarray):
        self.parts, self.hot = parts, hot

    def of(self, pairs: np.ndarray) -> np.ndarray:
        v = pairs >> tk.U64(32)
        at = np.minimum(np.searchsorted(self.hot, v), max(len(self.hot) - 1, 0))
        hot = self.hot[at] == v if len(self.hot) else np.zeros(len(v), bool)
        return (tk.mix(np.where(hot, pairs, v) + tk.U64(12345)) % tk.U64(self.parts)).astype(np.int64)


def _per_word(batches):
    """(h, n): token counts, combined over runs of tokens."""
    held, n = [], 0

    def flush():
        x, k = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch({"h": pa.array(x.view(np.int64)), "n": pa.array(k.astype(np.int64))})

    for b in batches:
        for c in tk.chunks(b.column("text"), "ascii"):
            t, _ = tokens(c)
            held.append(t)
            n += len(t)
            if n >= RUN_TOKENS:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def _shards(folder: str):
    """Rows (shard, h, n), sorted, into a file of hashes and one of counts for each shard."""

    def run(batches):
        now, keys, counts = None, [], []

        def close():
            save(f"{folder}/words-{now}", np.concatenate(keys).view(tk.U64))
            save_counts(f"{folder}/counts-{now}", np.concatenate(counts))
            return pa.record_batch({"shard": pa.array([now], pa.int32()), "size": pa.array([sum(map(len, keys))], pa.int64())})

        for b in batches:
            shard, h, n = (b.column(k).to_numpy() for k in ("shard", "h", "n"))
            for a, z in zip(*(lambda cut: (cut[:-1], cut[1:]))(np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]))):
                if a == z:
                    continue
                if now is not None and shard[a] != now:
                    yield close()
                    keys, counts = [], []
                now = int(shard[a])
                keys.append(h[a:z].copy())
                counts.append(n[a:z].copy())
        if now is not None:
            yield close()

    return run


def _blocks(folder: str, sizes: list[int], dealer: Dealer):
    """(part, keys, counts): sorted distinct bigrams of runs of tokens, one block for each partition."""

    def run(batches):
        words = Vocabulary(folder, sizes)
        held, n = [], 0

        def flush():
            x, k = np.unique(np.concatenate(held), return_counts=True)
            p = dealer.of(x)
            order = np.argsort(p, kind="stable")
            x, k = x[order], k[order].astype(np.uint32)  # a run is far below 2**32 tokens
            cut = np.searchsorted(p[order], np.arange(dealer.parts + 1))
            some = np.flatnonzero(np.diff(cut))
            # Most counts are 1: a byte each, with the rest (255 or more) apart.
            small = np.minimum(k, 255).astype(np.uint8)
            rest = [k[a:b][small[a:b] == 255].tobytes() for a, b in zip(cut[some], cut[some + 1])]
            return pa.record_batch({"part": pa.array(some, pa.int32()), "keys": pa.array([x[a:b].tobytes() for a, b in zip(cut[some], cut[some + 1])], pa.binary()), "small": pa.array([small[a:b].tobytes() for a, b in zip(cut[some], cut[some + 1])], pa.binary()), "rest": pa.array(rest, pa.binary())})

        for b in batches:
            for c in tk.chunks(b.column("text"), "ascii"):
                t, off = tokens(c)
                held.append(pairs(words.ids(t), off, words.size)[0])
                n += len(t)
                if n >= RUN_TOKENS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


def pairs(ids: np.ndarray, off: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, word) of each token, and the context ids; the first context of a document is ``begin``."""
    v = np.empty(len(ids), np.int64)
    v[1:] = ids[:-1]
    v[off[:-1]] = begin
    return (v.astype(tk.U64) << tk.U64(32)) | (ids.astype(tk.U64) & tk.U64(0xFFFFFFFF)), v


def _merge(folder: str, span: int):
    """Blocks of a partition into its sorted array; sends on sums by range of ids: (range, kind, ids, values)."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for part, keys, small, rest in zip(*(b.column(k).to_pylist() for k in ("part", "keys", "small", "rest"))):
                k = np.frombuffer(small, np.uint8).astype(np.uint32)
                k[k == 255] = np.frombuffer(rest, np.uint32)
                held.setdefault(part, []).append((np.frombuffer(keys, tk.U64), k))
        for part in list(held):
            got = held.pop(part)
            x, k = np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])
            del got
            order = np.argsort(x, kind="stable")
            x, k = x[order], k[order]
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            x, k = x[at], np.add.reduceat(k.astype(np.int64), at)
            save(f"{folder}/pairs-{part}", x)
            save_counts(f"{folder}/times-{part}", k)
            v, w = (x >> tk.U64(32)).astype(np.int64), (x & tk.U64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            sums = np.stack([np.add.reduceat(a, first) for a in (k, (k == 1).astype(np.int64), (k == 2).astype(np.int64), (k > 2).astype(np.int64))], 1)
            words, cont = np.unique(w, return_counts=True)
            rows = {"range": [], "kind": [], "ids": [], "values": []}
            for kind, ids, values in ((0, v[first], sums), (1, words, cont.astype(np.int64)[:, None])):
                cut = np.flatnonzero(np.concatenate([[True], ids[1:] // span != ids[:-1] // span, [True]]))
                for a, b in zip(cut[:-1], cut[1:]):
                    rows["range"].append(int(ids[a] // span))
                    rows["kind"].append(kind)
                    rows["ids"].append((ids[a:b] % span).astype(np.uint32).tobytes())
                    rows["values"].append(values[a:b].astype(np.uint32 if values.max() < 2**32 else np.int64).tobytes())
            of = np.bincount(np.minimum(k, 5), minlength=6)
            yield pa.record_batch({"range": pa.array([*rows["range"], -1], pa.int32()), "kind": pa.array([*rows["kind"], part], pa.int32()), "ids": pa.array([*rows["ids"], b""], pa.binary()), "values": pa.array([*rows["values"], of.astype(np.int64).tobytes()], pa.binary())})

    return run


def _dense(folder: str, span: int):
    """Sums of a range of ids into dense arrays; counts of continuation counts."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for r, kind, ids, values in zip(*(b.column(k).to_pylist() for k in ("range", "kind", "ids", "values"))):
                a = held.setdefault(r, np.zeros((span, 5), np.int64))
                i = np.frombuffer(ids, np.uint32)
                width = 4 if kind == 0 else 1
                x = np.frombuffer(values, np.uint32 if len(values) == 4 * width * len(i) else np.int64).reshape(-1, width)
                if kind == 0:
                    a[i, :4] += x
                else:
                    a[i, 4] += x[:, 0]
        for r, a in held.items():
            for k, name in enumerate(("total", "n1", "n2", "n3", "cont")):
                save_counts(f"{folder}/{name}-{r}", a[:, k])
            of = np.bincount(np.minimum(a[:, 4], 5), minlength=6)
            yield pa.record_batch({"range": pa.array([r], pa.int32()), "of": pa.array([of.astype(np.int64).tobytes()], pa.binary()), "sum": pa.array([int(a[:, 4].sum())], pa.int64())})

    return run


def discounts(of: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times; half of one where those say nothing."""
    n = of.astype(float)
    if not all(n[1:5] > 0):
        return 0.5, 0.5, 0.5
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.0), float(k)) for k in (1, 2, 3))


class Model:
    """Where the arrays lie, and the few numbers beside them."""

    def __init__(self, folder: str, sizes: list[int], dealer: Dealer, span: int, d1, d2, cont: int, tokens: int):
        self.folder, self.sizes, self.dealer, self.span, self.d1, self.d2, self.cont, self.tokens = folder, sizes, dealer, span, np.array([0.0, *d1]), np.array([0.0, *d2]), cont, tokens

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def open(self) -> Model:
        self._words = Vocabulary(self.folder, self.sizes)
        self._files = Mapped(self.folder)
        return self

    def _word(self, ids: np.ndarray) -> np.ndarray:
        """(n, 5) sums of each id; zeros for -1."""
        out = np.zeros((len(ids), 5))
        r = ids // self.span
        for k in np.unique(r[ids >= 0]):
            at = np.flatnonzero(r == k)
            for j, name in enumerate(("total", "n1", "n2", "n3", "cont")):
                out[at, j] = self._files.counts(f"{name}-{k}", self.span)[ids[at] % self.span]
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct bigrams."""
        out = np.zeros(len(x))
        p = self.dealer.of(x)
        order = np.argsort(p, kind="stable")
        cut = np.searchsorted(p[order], np.arange(self.dealer.parts + 1))
        for k in np.flatnonzero(np.diff(cut)):
            keys = self._files.get(f"pairs-{k}", tk.U64)
            n = self._files.counts(f"times-{k}", len(keys))
            at = order[cut[k] : cut[k + 1]]
            if len(keys):
                slot = np.minimum(np.searchsorted(keys, x[at]), len(keys) - 1)
                out[at] = np.where(keys[slot] == x[at], n[slot], 0)
        return out

    def score(self, c: tk.Chunk):
        """Per document: tokens, known tokens, base score, log10 probability."""
        t, off = tokens(c)
        ids = self._words.ids(t)
        known = ids >= 0
        begin = self._words.size
        x, v = pairs(ids, off, begin)
        one, inv = np.unique(np.concatenate([ids, v]), return_inverse=True)
        sums = self._word(one)
        w_of, v_of = inv[: len(ids)], inv[len(ids) :]
        k = sums[:, 4]
        low = np.maximum(k - self.d1[np.minimum(k, 3).astype(int)], 0) / max(self.cont, 1)
        low += self._gamma1 / (begin + 1)
        p = low[w_of]
        total = sums[:, 0]
        gamma = (self.d2[1] * sums[:, 1] + self.d2[2] * sums[:, 2] + self.d2[3] * sums[:, 3]) / np.maximum(total, 1)
        both = np.flatnonzero(known & (v >= 0))
        y, yi = np.unique(x[both], return_inverse=True)
        n = np.zeros(len(ids))
        n[both] = self.times(y)[yi]
        seen = total[v_of] > 0
        high = np.maximum(n - self.d2[np.minimum(n, 3).astype(int)], 0) / np.maximum(total[v_of], 1)
        p = np.where(seen, high + gamma[v_of] * p, p)
        count = np.zeros(len(ids))
        r = np.searchsorted(self._words.base, ids[known], "right") - 1
        got = np.zeros(len(r))
        for j in np.unique(r):
            at = r == j
            got[at] = self._files.counts(f"counts-{j}", self.sizes[j])[ids[known][at] - self._words.base[j]]
        count[known] = got
        base = np.log10((count + 1) / (self.tokens + (begin + 1)))  # add-one, one more type for the unknown
        add = lambda a: np.add.reduceat(a, off[:-1]) if len(a) else np.zeros(0)  # noqa: E731  every document has its end token
        return np.diff(off), add(known.astype(np.int64)), add(base), add(np.log10(p))

    @property
    def _gamma1(self) -> float:
        n = self.of1
        return float(self.d1[1] * n[1] + self.d1[2] * n[2] + self.d1[3] * (n[3:].sum())) / max(self.cont, 1) if self.cont else 1.0


def train(texts: DataFrame) -> Model:
    """texts (text) -> the model; nulls count as empty."""
    spark = texts.sparkSession
    folder = scratch(spark, "kneser-ney")
    texts = texts.select("text")
    words = written(texts.mapInArrow(_per_word, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    size, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, (-(-size // SHARD_WORDS) - 1).bit_length())
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    # Signed order within a shard is the unsigned order: leading bits are shared (one shard: flip the sign).
    order = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    parts = words.select(shard.alias("shard"), "h", "n").repartition(max(1, 1 << bits), "shard").sortWithinPartitions("shard", order)
    made = {r.shard: r.size for r in parts.mapInArrow(_shards(folder), "shard int, size long").collect()}
    sizes = [made.get(k, 0) for k in range(1 << bits)]
    for k, n in enumerate(sizes):
        if not n:
            save(f"{folder}/words-{k}", np.zeros(0, tk.U64))
            save(f"{folder}/counts-{k}", np.zeros(0, np.uint32))
    if size >= 2**32 - 1:
        raise ValueError("word ids have 32 bits")
    vocabulary = Vocabulary(folder, sizes)
    frequent = np.array([r.h for r in words.where(F.col("n") > total / HOT).select("h").collect()], np.int64).view(tk.U64)
    begin = size
    rows = int(texts.count())
    hot = vocabulary.ids(np.sort(frequent))
    hot = np.sort(np.append(hot, begin) if rows * HOT > total else hot).astype(tk.U64)
    dealer = Dealer(max(1, -(-int(total) // PART_BIGRAMS)) * 2, hot)
    span = max(1 << 16, -(-(begin + 1) // 256))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = texts.mapInArrow(_blocks(folder, sizes, dealer), "part int, keys binary, small binary, rest binary")
    sums = written(blocks.repartition(min(dealer.parts, max(tasks, dealer.parts // 4)), "part").mapInArrow(_merge(folder, span), "range int, kind int, ids binary, values binary"), "sums")
    of2, got = np.zeros(6, np.int64), set()
    for r in sums.where("range = -1").select("kind", "values").toLocalIterator():
        of2 += np.frombuffer(r["values"], np.int64)
        got.add(r["kind"])
    for p in set(range(dealer.parts)) - got:
        save(f"{folder}/pairs-{p}", np.zeros(0, tk.U64))
        save(f"{folder}/times-{p}", np.zeros(0, np.uint32))
    ranges = -(-(begin + 1) // span)
    dense = sums.where("range >= 0").repartition(min(ranges, tasks), "range").mapInArrow(_dense(folder, span), "range int, of binary, sum long").collect()
    for r in set(range(ranges)) - {x["range"] for x in dense}:
        for name in ("total", "n1", "n2", "n3", "cont"):
            save(f"{folder}/{name}-{r}", np.zeros(span, np.uint32))
    of1 = sum((np.frombuffer(r["of"], np.int64) for r in dense), np.zeros(6, np.int64))
    model = Model(folder, sizes, dealer, span, discounts(of1), discounts(of2), sum(r["sum"] for r in dense), int(total))
    model.of1 = of1
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value.open()
        for b in batches:
            for c in tk.chunks(b.column("text"), "ascii"):
                n, known, base, log = m.score(c)
                yield pa.record_batch({"doc_id": b.column("doc_id").slice(c.row, c.n), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array(np.full(c.n, m.tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(log)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Learns from rows whose crc32(doc_id as text) mod 7 is not 2 (null ids too), scores every row, with perplexity."""
    held = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = score(docs, train(docs.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
