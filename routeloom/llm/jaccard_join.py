"""Operator 1: n-gram Jaccard self-join by chosen paths.

Documents are sets of word five-grams (a text of one to four words is one
shingle of all its words; a null or blank text has none and links to nothing).
Words are lower-cased runs between ASCII white space.

1. Equal sets form a class, which the row of lowest (doc_id, hash of the text)
   represents. Classes get numbers of their own, so ids may repeat.
2. Each run samples about 1/``spread`` shingles of every representative by hash
   threshold; representatives that sampled the same shingle meet in a bucket. A
   bucket above ``small`` is split again on the next level's sampled shingles
   (its members' paths grow by one), up to ``levels``. There are as many runs as
   the target ``recall`` takes.
3. Buckets are brute-forced on 128-bit one-bit minwise sketches, large ones in
   tiles of bounded size. What may be similar is joined to components. Members
   of components of more than ``LOOSE`` tiles' rows are compared again in their
   buckets on 1024-bit sketches, so that chains of loosely similar sets fall apart.
4. Inside a component every pair is compared by exact Jaccard, in tiles; a pair
   that no run had brought together is found here too. Tiles give each member
   its number of links and the lowest member it reaches, never a row per pair.

A pair at similarity 0.8 is missed by one run with probability of at most 0.14
(two shared samples expected), by the eight runs of the default recall with
1e-7; in split buckets with 1e-4.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .shared import forget, unused, written

WORDS, SIMILARITY, RECALL, LEVELS, SPREAD, SMALL = 5, 0.8, 1 - 2e-7, 3, 0.4, 4096
MISS, MOST_RUNS = 0.14, 16  # of one run, at the similarity; the run is four bits of a key
SKETCH_BITS, WIDE_BITS, TILE, TILE_TOKENS, LOOSE = 128, 1024, 512, 400_000, 16
_RNG = np.random.default_rng(20240117)
_A = _RNG.integers(1 << 31, 1 << 32, WIDE_BITS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, WIDE_BITS, dtype=np.uint32)
_S = _RNG.integers(0, 1 << 63, (MOST_RUNS, 8), dtype=np.uint64)
_FEATURES = "doc_id long, version long, d0 long, d1 long, n int, s0 long, s1 long, l1 array<long>, l2 array<long>, l3 array<long>"
_MASK = tk.U64((1 << 60) - 1)


def shingle_sets(c: tk.Chunk, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document and their offsets."""
    w = tk.Words(c)
    h, doc = tk.ngrams(w.hash, w.off, words)
    size = np.diff(w.off)
    short = np.flatnonzero((size > 0) & (size < words))
    if len(short):
        whole = np.array([int(np.bitwise_xor.reduce(tk.mix(w.hash[w.off[d] : w.off[d + 1]] + np.arange(size[d], dtype=tk.U64)))) for d in short], tk.U64)
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    x, off, _ = tk.by_doc(doc, h, c.n)
    return x, off


def _sample(x: np.ndarray, off: np.ndarray, runs: int, level: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that each run samples: run in the top four bits, then the shingle's hash."""
    size = np.diff(off)
    limit = np.repeat(np.minimum(2.0**32 - 1, 2.0**32 / (spread * np.maximum(size, 1))).astype(np.uint32), size)
    doc = np.repeat(np.arange(len(size)), size)
    low = (x ^ (x >> tk.U64(27))).astype(np.uint32)
    keys, docs = [], []
    for r in range(runs):
        seed = _S[r, level]
        t = (low ^ np.uint32(seed & tk.U64(0xFFFFFFFF))) * np.uint32((seed >> tk.U64(32)) | tk.U64(1))
        t ^= t >> np.uint32(15)
        t *= np.uint32(0x2C1B3C6D)
        t ^= t >> np.uint32(13)
        at = np.flatnonzero(t <= limit)
        keys.append((tk.mix(x[at] + seed) & _MASK) | tk.U64(r << 60))
        docs.append(doc[at])
    keys, docs = np.concatenate(keys), np.concatenate(docs)
    order = np.argsort(docs, kind="stable")
    return keys[order].view(np.int64), np.searchsorted(docs[order], np.arange(len(size) + 1))


def _sketch(x: np.ndarray, off: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """(n, bits / 64) words of one-bit minwise sketches; zeros for empty sets."""
    size = np.diff(off)
    full = np.flatnonzero(size)
    out = np.zeros((len(size), bits), bool)
    if len(full):
        low = (x ^ (x >> tk.U64(23))).astype(np.uint32)
        for k in range(bits):
            t = low * _A[k]
            t += _B[k]
            t ^= t >> np.uint32(16)
            out[full, k] = (np.minimum.reduceat(t, off[:-1][full]) * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(out, axis=1).view(np.int64).reshape(-1, bits // 64)


def _features(runs: int, spread: float, words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), ("n", pa.int32()), ("s0", pa.int64()), ("s1", pa.int64()), *((f"l{k}", pa.list_(pa.int64())) for k in (1, 2, 3))])

    def run(batches):
        for b in batches:
            for c in tk.chunks(b.column("text"), "unicode"):
                x, off = shingle_sets(c, words)
                size = np.diff(off)
                h = np.zeros((2, len(x) + 1), tk.U64)
                for k in range(2):
                    np.cumsum(tk.mix(x + tk.U64(k * 0x51ED27 + 77)), out=h[k, 1:])
                d = tk.mix(h[:, off[1:]] - h[:, off[:-1]] + size.astype(tk.U64)).view(np.int64)
                s = _sketch(x, off)
                yield tk.rows_to_batch({"doc_id": b.column("doc_id").slice(c.row, c.n), "version": b.column("version").slice(c.row, c.n), "d0": d[0], "d1": d[1], "n": size.astype(np.int32), "s0": np.ascontiguousarray(s[:, 0]), "s1": np.ascontiguousarray(s[:, 1]), **{f"l{k}": tk.lists(*_sample(x, off, runs, k, spread)) for k in (1, 2, 3)}}, schema)

    return run


def _groups(batch: pa.RecordBatch, column: str):
    """Offsets and the flattened fields of a column of lists of structs."""
    a = batch.column(column)
    off = a.offsets.to_numpy().astype(np.int64)
    s = a.flatten()
    return off - off[0], {f.name: s.field(k) for k, f in enumerate(s.type)}


def _labels(near: np.ndarray) -> np.ndarray:
    """Component of each node of symmetric adjacency matrices (the last two axes), as its lowest index."""
    n = near.shape[-1]
    lab = np.broadcast_to(np.arange(n, dtype=np.int32), near.shape[:-1])
    while True:
        # In strips of rows, so that a large matrix needs no second one of integers.
        new = np.concatenate([np.where(near[..., r : r + 256, :], lab[..., None, :], n).min(-1) for r in range(0, n, 256)], -1)
        new = np.minimum(new, lab)
        new = np.take_along_axis(new, new.astype(np.int64), -1)
        if (new == lab).all():
            return lab
        lab = new


def _near(similarity: float, bits: int = SKETCH_BITS):
    """Brute force on sketches over bucket tiles: edges (u, v) that join what may be similar."""
    # Agreement of one-bit sketches has mean (1 + J) / 2; six deviations are left below it.
    p = (1 + similarity) / 2
    least = int(bits * p - 6 * (bits * p * (1 - p)) ** 0.5)

    def similar(n, s, i, j):
        differ = sum(np.bitwise_count(s[..., k][i] ^ s[..., k][j]).astype(np.int32) for k in range(bits // 64))
        return (differ <= bits - least) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)

    def run(batches):
        for b in batches:
            off, f = _groups(b, "members")
            size = np.diff(off)
            # In order of ids, so that components of all buckets take the same lowest member as their hub.
            order = np.lexsort((f["rep"].to_numpy(), np.repeat(np.arange(len(size)), size)))
            ids, n = f["rep"].to_numpy()[order], f["n"].to_numpy()[order]
            if bits == SKETCH_BITS:
                s = np.stack([f["s0"].to_numpy()[order], f["s1"].to_numpy()[order]], 1).view(np.uint64)
            else:
                wide = f["s"]
                s = np.frombuffer(b"".join(wide.to_pylist()), np.uint64).reshape(len(wide), -1)[order]
            u, v = [], []
            for m in np.unique(size[(size > 1) & (size <= 24)]):
                first = off[:-1][size == m]
                a, c = np.triu_indices(m, 1)
                for k in range(0, len(first), max(1, 200_000 // len(a))):
                    at = first[k : k + max(1, 200_000 // len(a)), None]
                    ok = similar(n, s, at + a, at + c)
                    near = np.zeros((len(at), m, m), bool)
                    near[:, a, c] = near[:, c, a] = ok
                    lab = _labels(near)
                    g, own = np.nonzero(lab != np.arange(m))
                    u.append(ids[at[g, 0] + own])
                    v.append(ids[at[g, 0] + lab[g, own]])
            for k in np.flatnonzero(size > 24):
                at = np.arange(off[k], off[k + 1])
                near = np.zeros((len(at), len(at)), bool)
                for r in range(0, len(at), 128):
                    near[r : r + 128] = similar(n, s, at[r : r + 128, None], at[None, :])
                lab = _labels(near)
                own = np.flatnonzero(lab != np.arange(len(at)))
                u.append(ids[at[own]])
                v.append(ids[at[lab[own]]])
            if u:
                pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], 1), axis=0)
                yield pa.record_batch({"u": pa.array(pairs[:, 0], pa.int64()), "v": pa.array(pairs[:, 1], pa.int64())})

    return run


def _tiled(df: DataFrame, blocks, by: list[str]) -> DataFrame:
    """Deal the rows of a group to tiles (x, y) of its blocks, x <= y: each pair of rows meets in one tile at least."""
    block = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks"))
    return df.withColumn("blocks", blocks).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))


def _exact(similarity: float):
    """Exact Jaccard over tiles: for each member with links their number, weighted by copies, and the lowest reached."""
    schema = pa.schema([("rep", pa.int64()), ("label", pa.int64()), ("links", pa.int64()), ("class_links", pa.int64())])

    def run(batches):
        for b in batches:
            off, f = _groups(b, "members")
            ids, copies, block = (f[k].to_numpy(zero_copy_only=False) for k in ("rep", "copies", "block"))
            blobs, xs, ys = f["shingles"], b.column("x").to_numpy(), b.column("y").to_numpy()
            at = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
            tokens = np.frombuffer(blobs.buffers()[2], np.uint8)
            out = []
            for k in range(len(off) - 1):
                lo, hi = off[k], off[k + 1]
                if hi - lo < 2:
                    continue
                sets = [tokens[at[i] : at[i + 1]].view(tk.U64) for i in range(lo, hi)]
                n = np.array([len(s) for s in sets], np.int64)
                m = hi - lo
                if m <= 6:
                    common = np.zeros((m, m))
                    for i in range(m):
                        for j in range(i + 1, m):
                            common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                else:
                    x, inv, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                    doc = np.repeat(np.arange(m), n)
                    shared = df > 1
                    place = np.cumsum(shared) - 1
                    keep = shared[inv]
                    doc, col = doc[keep], place[inv[keep]]
                    order = np.argsort(col, kind="stable")
                    doc, col = doc[order], col[order]
                    common = np.zeros((m, m), np.float32)
                    step = max(64, 4_000_000 // m)
                    for c0 in range(0, int(shared.sum()), step):
                        s, e = np.searchsorted(col, [c0, c0 + step])
                        part = np.zeros((m, step), np.float32)
                        part[doc[s:e], col[s:e] - c0] = 1
                        common += part @ part.T
                near = common >= similarity * (n[:, None] + n[None, :] - common) - 1e-6
                np.fill_diagonal(near, False)
                if xs[k] != ys[k]:  # pairs inside a block are counted by its own tile
                    near &= block[lo:hi, None] != block[None, lo:hi]
                own = np.flatnonzero(near.any(1))
                if len(own):
                    lab, low = _labels(near), {}
                    for i in own:
                        low[lab[i]] = min(low.get(lab[i], ids[lo + i]), ids[lo + i])
                    out.append((ids[lo + own], np.array([low[lab[i]] for i in own], np.int64), (near[own] @ copies[lo:hi]).astype(np.int64), near[own].sum(1)))
            if out:
                yield tk.rows_to_batch(dict(zip(schema.names, (np.concatenate(x) for x in zip(*out)))), schema)

    return run


def _meetings(reps: DataFrame, levels: int, small: int, made: list) -> DataFrame:
    """reps (rep, l1, l2, l3) -> (rep, key, size): the buckets they meet in; tables on the way are added to ``made``."""
    buckets = []
    paths = reps.select("rep", F.explode("l1").alias("key"))
    for level in range(1, levels + 1):
        paths = written(paths, "paths")
        made.append(paths)
        # As a table, so that adaptive execution may split the join where a key is frequent.
        many = written(paths.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        made.append(many)
        full = paths.join(many, "key")
        if level == levels:
            buckets.append(full)
            break
        buckets.append(full.where(F.col("size") <= small))
        split = full.where(F.col("size") > small).join(reps.select("rep", F.col(f"l{level + 1}").alias("more")), "rep")
        run = F.shiftrightunsigned("key", 60)
        step = F.explode(F.filter("more", lambda x: F.shiftrightunsigned(x, 60) == run)).alias("step")
        paths = split.select("rep", "key", run.alias("run"), step).select("rep", F.shiftleft("run", 60).bitwiseOR(F.xxhash64("key", "step").bitwiseAND((1 << 60) - 1)).alias("key"))
    met = buckets[0]
    for x in buckets[1:]:
        met = met.unionByName(x)
    return met


def _candidates(reps: DataFrame, sketches: DataFrame, columns: tuple, near, levels: int, small: int) -> DataFrame:
    """(node, label): components of what may be similar, by ``near`` over the buckets that reps meet in."""
    made: list = []
    met = _meetings(reps, levels, small, made).join(sketches, "rep")
    tiles = _tiled(met, F.ceil(F.col("size") / small).cast("long"), ["key"]).groupBy("key", "x", "y").agg(F.collect_list(F.struct(*columns)).alias("members"))
    edges = written(tiles.select("members").mapInArrow(near, "u long, v long").distinct(), "near")
    for x in made:
        forget(x)
    return written(components(edges), "components")


def _joined(docs: DataFrame, words: int, similarity: float, recall: float, levels: int, spread: float, small: int) -> DataFrame:
    """docs (doc_id, version, text) -> doc_id, version, head (doc_id and version of the class's first row), n_links, n_class_links."""
    runs = max(1, math.ceil(round(math.log(max(1 - recall, 1e-300)) / math.log(MISS), 6)))
    if runs > MOST_RUNS or levels > 3:
        raise ValueError(f"at most {MOST_RUNS} runs (here {runs}) and three levels")
    feats = written(docs.mapInArrow(_features(runs, spread, words), _FEATURES), "features")
    of_set = ("n", "s0", "s1", "l1", "l2", "l3")  # equal for equal sets
    reps = feats.where("n > 0").groupBy("d0", "d1").agg(F.min(F.struct("doc_id", "version")).alias("head"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in of_set))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    comp = _candidates(reps, reps.select("rep", "n", "s0", "s1"), ("rep", "n", "s0", "s1"), _near(similarity), levels, small)

    def sized(comp):
        """rep, comp, copies, n, head, and the number of blocks that its component takes."""
        active = comp.select(F.col("node").alias("rep"), F.col("label").alias("comp")).join(reps.select("rep", "copies", "n", "head"), "rep")
        whole = active.groupBy("comp").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
        blocks = F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("tokens") / TILE_TOKENS)).cast("long")
        return written(active.join(whole.select("comp", blocks.alias("blocks")), "comp"), "active")

    active = sized(comp)
    heads = active.select(F.col("head.doc_id").alias("doc_id"), F.col("head.version").alias("version"), "rep", "comp", "copies", "blocks")
    # Both sides grow with the table, so the join is by sorting at every size.
    texts = docs.hint("merge").join(heads, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])
    sets = texts.mapInArrow(_sets(words), "rep long, comp long, copies long, blocks long, shingles binary")
    large = active.where(F.col("blocks") > LOOSE).select("rep", "n")
    if not large.isEmpty():
        sets = written(sets, "sets")
        wide = written(sets.join(large, "rep").select("rep", "n", "shingles").mapInArrow(_wide, "rep long, n int, s binary"), "wide")
        again = _candidates(reps.join(wide.select("rep"), "rep", "left_semi"), wide, ("rep", "n", "s"), _near(similarity, WIDE_BITS), levels, small)
        active = sized(active.where(F.col("blocks") <= LOOSE).select(F.col("rep").alias("node"), F.col("comp").alias("label")).unionByName(again))
        sets = sets.select("rep", "shingles").join(active.select("rep", "comp", "copies", "blocks"), "rep")
    tiles = _tiled(sets, F.col("blocks"), ["comp"]).groupBy("comp", "blocks", "x", "y").agg(F.collect_list(F.struct("rep", "copies", "block", "shingles")).alias("members"))
    found = written(tiles.select("blocks", "x", "y", "members").mapInArrow(_exact_keep(similarity), "rep long, label long, links long, class_links long, one boolean"), "links")
    wide = found.where("not one")
    label = found.where("one").select("rep", "label").unionByName(components(wide.select(F.col("rep").alias("u"), F.col("label").alias("v"))).select(F.col("node").alias("rep"), "label"))
    label = written(label, "labels")
    first = written(label.join(reps.select("rep", "head"), "rep").groupBy("label").agg(F.min("head").alias("first")), "first")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))
    linked = links.join(label.join(first, "label").select("rep", "first"), "rep")
    of_class = reps.select("rep", "d0", "d1", "head", "copies").join(linked, "rep", "left")
    of_class = written(of_class.select("d0", "d1", F.coalesce("first", "head").alias("head"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("class_links", F.lit(0)).cast("long").alias("n_class_links")), "classes")
    out = feats.where("n > 0").select("doc_id", "version", "d0", "d1").join(of_class, ["d0", "d1"]).drop("d0", "d1")
    alone = feats.where("n = 0").select("doc_id", "version", F.struct("doc_id", "version").alias("head"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_class_links"))
    return out.unionByName(alone)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text").where("doc_id is not null")


def jaccard_join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, levels: int = LEVELS, spread: float = SPREAD, small: int = SMALL) -> DataFrame:
    """documents (doc_id, text) -> doc_id, class_id, n_links, n_class_links; a row per row with a doc_id.

    class_id: the lowest doc_id of its connected group of links (its own, if it
    has none); n_links: other rows at or above ``similarity``, copies counted
    each; n_class_links: other distinct sets. Null ids are left out. Rows that
    repeat an id count as documents of their own, whatever their texts. Other
    columns are ignored.
    """
    out = _joined(_rows(docs), words, similarity, recall, levels, spread, small)
    return out.select("doc_id", F.col("head.doc_id").alias("class_id"), "n_links", "n_class_links")


def keep_first(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, levels: int = LEVELS, spread: float = SPREAD, small: int = SMALL) -> DataFrame:
    """docs, all columns: of each connected group of links the rows of one text, that of lowest (doc_id, hash of the text).

    Rows are told apart by id and text: another text under a removed row's id
    stays. Rows without an id stay. Of rows that repeat both id and text one
    stays, with the columns of any of them.
    """
    out = _joined(_rows(docs), words, similarity, recall, levels, spread, small)
    i, v, own = (unused(docs, name) for name in ("_row_id", "_row_version", "_own"))
    gone = out.where((F.col("head.doc_id") != F.col("doc_id")) | (F.col("head.version") != F.col("version"))).select(F.col("doc_id").alias(i), F.col("version").alias(v)).distinct()
    rows = docs.withColumns({i: F.col("doc_id").cast("long"), v: F.xxhash64("text"), own: F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())})
    # Repeated rows fall together on the partitioning of the join: texts are shuffled once.
    return rows.join(gone, [i, v], "left_anti").dropDuplicates([i, v, "doc_id", "text", own]).drop(i, v, own).select(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))


def _wide(batches):
    """Wide sketches of sets of shingles."""
    for b in batches:
        sets = [np.frombuffer(x, tk.U64) for x in b.column("shingles").to_pylist()]
        for k in range(0, len(sets), 256):
            part = sets[k : k + 256]
            s = _sketch(np.concatenate(part), np.concatenate([[0], np.cumsum([len(x) for x in part])]), WIDE_BITS)
            yield pa.record_batch([b.column("rep").slice(k, len(part)), b.column("n").slice(k, len(part)), pa.array([x.tobytes() for x in s], pa.binary())], ["rep", "n", "s"])


def _sets(words: int):
    schema = pa.schema([("rep", pa.int64()), ("comp", pa.int64()), ("copies", pa.int64()), ("blocks", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for b in batches:
            for c in tk.chunks(b.column("text"), "unicode"):
                x, off = shingle_sets(c, words)
                blob = pa.Array.from_buffers(pa.binary(), c.n, [None, pa.py_buffer((off * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
                keep = {k: b.column(k).slice(c.row, c.n) for k in ("comp", "copies", "blocks")}
                yield tk.rows_to_batch({"rep": b.column("rep").slice(c.row, c.n), **keep, "shingles": blob}, schema)

    return run


def _exact_keep(similarity: float):
    """As ``_exact``, row by row of tiles, with whether the tile holds its whole component."""
    exact = _exact(similarity)

    def run(batches):
        for b in batches:
            for one in (True, False):
                part = b.filter(pa.compute.equal(b.column("blocks"), 1) if one else pa.compute.greater(b.column("blocks"), 1))
                for k in range(part.num_rows):
                    for x in exact([part.slice(k, 1)]) if not one else ():
                        yield x.append_column("one", pa.array([False] * x.num_rows))
                if one and part.num_rows:
                    for x in exact([part]):
                        yield x.append_column("one", pa.array([True] * x.num_rows))

    return run


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return jaccard_join(table(spark, sf_dir, "documents"))
