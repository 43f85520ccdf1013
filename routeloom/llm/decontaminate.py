"""Operator 2: benchmark passages in documents, by the q-gram lemma and banded alignment.

Text is compared as code points, each lower-cased on its own, runs of ASCII
white space as one space. A document is contaminated by an item if some window
of ``length`` characters of the item (the whole item, if shorter) aligns with a
part of the document at no more than ``rate * length`` edits.

The lemma: such a part shares at least ``length + 1 - q * (edits + 1)`` q-grams
with the window, all within ``edits + 1`` neighbouring diagonals. So hits are
counted in diagonal bands that overlap by the edit budget; a stretch of a band
that reaches the bound is verified by banded alignment of every item window that
falls into it. Nothing that meets the definition is filtered out.

Where the bound would fall below one (windows too short for their budget at
this q), the items are indexed with the largest q at which it does not, so the
definition holds at every length. Contamination is not defined by items of fewer
than ``shortest`` characters, which ordinary prose holds by chance.

The items are broadcast in blocks of at most ``block_chars`` characters, one
scan of the documents for each block, and a block's broadcast is released before
the next is sent; so any number of items can be given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import table, written

Q, LENGTH, RATE, BAND, SHORTEST, BLOCK_CHARS = 12, 60, 0.05, 16, 12, 2_000_000
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])
_TYPE = "doc_id long, version long, item_id long, start int, end int, edits int"
_lower: list[np.ndarray] = []


def fold(points: np.ndarray) -> np.ndarray:
    """Each code point lower-cased where that gives one code point; ASCII white space as a space."""
    if not _lower:
        t = np.arange(0x10000, dtype=np.uint32)
        for i in range(0x10000):
            low = chr(i).lower()
            if len(low) == 1:
                t[i] = ord(low)
        t[[9, 10, 11, 12, 13]] = 32
        _lower.append(t)
    small = points < 0x10000
    if small.all():
        return _lower[0][points]
    return np.where(small, _lower[0][np.where(small, points, 0)], points)


def squeeze(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points without repeated blanks, and the place of each in the text."""
    p = fold(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    keep = np.ones(len(p), bool)
    keep[1:] = (p[1:] != 32) | (p[:-1] != 32)
    at = np.flatnonzero(keep)
    return p[at], at


class Index:
    """q-grams of items of one q: sorted distinct hashes, and item and offset of each occurrence."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int, length: int, rate: float):
        self.q = q
        self.ids, self.texts, hashes, item, pos = [], [], [], [], []
        for item_id, p in items:
            h, _ = qgrams(p, np.array([0, len(p)]), q)
            hashes.append(h)
            item.append(np.full(len(h), len(self.ids), np.int32))
            pos.append(np.arange(len(h), dtype=np.int32))
            self.ids.append(item_id)
            self.texts.append(p)
        h = np.concatenate(hashes) if hashes else np.zeros(0, tk.U64)
        order = np.argsort(h, kind="stable")
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.pos = np.concatenate(pos)[order] if pos else np.zeros(0, np.int64)
        self.hash, self.first = np.unique(h[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(h)))
        self.bits = max(16, min(27, int(len(self.hash) * 16).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.hash >> tk.U64(64 - self.bits)] = True
        self.size = np.minimum(length, [len(t) for t in self.texts]).astype(np.int64) if self.texts else np.zeros(0, np.int64)
        self.edits = budget(self.size, rate)
        self.bound = self.size + 1 - q * (self.edits + 1)


def budget(size, rate: float):
    """Edits that a window of ``size`` characters may take."""
    return np.floor(np.asarray(size) * rate + 1e-9).astype(np.int64)


def indexes(items: list[tuple[int, str]], q: int, length: int, rate: float, shortest: int) -> list[Index]:
    """An index for each q that the items need, so that the lemma's bound is at least one for all of them."""
    by_q: dict[int, list] = {}
    for item_id, text in items:
        p, _ = squeeze(text.strip())
        size = min(length, len(p))
        if len(p) >= max(1, shortest):
            by_q.setdefault(max(1, min(q, size // (int(budget(size, rate)) + 1))), []).append((item_id, p))
    return [Index(part, k, length, rate) for k, part in sorted(by_q.items())]


def qgrams(points: np.ndarray, off: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the q-gram at each position that has one inside its document, and the positions."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, tk.U64), np.zeros(0, np.int64)
    up, down = tk.powers(len(points) + 1)
    h = np.zeros(len(points) + 1, tk.U64)
    np.cumsum((points.astype(tk.U64) + tk.U64(1)) * up[: len(points)], out=h[1:])
    x = (h[q:] - h[:n]) * down[:n]
    x ^= x >> tk.U64(29)
    x *= tk.U64(0xBF58476D1CE4E5B9)
    ok = np.ones(n, bool)
    for cut in off[1:-1]:
        ok[max(0, cut - q + 1) : cut] = False
    at = np.flatnonzero(ok)
    return (x, at) if len(at) == n else (x[at], at)


def align(item: np.ndarray, doc: np.ndarray, low: int, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``size`` of item: the fewest edits against any part of doc whose diagonals (doc minus item offset) lie in low..low+width-1, and where that part ends."""
    n = len(item) - size + 1
    inf = np.int32(1 << 20)
    k = np.arange(width)
    base = np.arange(n)[:, None] + low + k[None, :]
    cost = np.where((base >= 0) & (base <= len(doc)), np.int32(0), inf)
    for r in range(size):
        at = base + r
        inside = (at >= 0) & (at < len(doc))
        differ = np.where(inside, doc[np.clip(at, 0, len(doc) - 1)] != item[r : r + n, None], True)
        new = np.where(inside, cost + differ, inf)
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        # Inserted characters of the document: along the row.
        new = np.minimum(np.minimum.accumulate(new - k, axis=1) + k, inf)
        cost = new
    best = cost.argmin(1)
    return cost[np.arange(n), best], np.arange(n) + size + low + best


def regions(index: Index, points: np.ndarray, off: np.ndarray, band: int):
    """(document, item, start, end, edits) of each verified region; places in points."""
    q = index.q
    x, at = qgrams(points, off, q)
    some = np.flatnonzero(index.seen[x >> tk.U64(64 - index.bits)])
    if not len(some):
        return
    x, at = x[some], at[some]
    slot = np.minimum(np.searchsorted(index.hash, x), len(index.hash) - 1)
    ok = index.hash[slot] == x
    slot, at = slot[ok], at[ok]
    count = index.count[slot]
    total = int(count.sum())
    if not total:
        return
    # Every occurrence of a shared q-gram: its document offset, item and diagonal.
    pos = np.repeat(at, count)
    entry = np.repeat(index.first[slot] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
    item = index.item[entry]
    doc = np.searchsorted(off, pos, "right") - 1
    shift = 1 << 30
    diagonal = pos - off[doc] - index.pos[entry] + shift
    most = int(index.edits.max(initial=0))
    step = max(band, most + 1)
    low = diagonal // step
    again = np.flatnonzero(diagonal - low * step < index.edits[item])  # also in the band before, which reaches that far
    item, doc, pos, low = (np.concatenate([a, a[again]]) for a in (item, doc, pos, low))
    low[total:] -= 1
    order = np.lexsort((pos, low, item, doc))
    item, doc, pos, low = item[order], doc[order], pos[order], low[order]
    same = np.zeros(len(pos), bool)
    same[1:] = (item[1:] == item[:-1]) & (doc[1:] == doc[:-1]) & (low[1:] == low[:-1])
    once = ~same
    once[1:] |= pos[1:] != pos[:-1]
    item, doc, pos, low = item[once], doc[once], pos[once], low[once]
    group = np.cumsum(np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (low[1:] != low[:-1])])) - 1
    last = np.arange(len(pos)) + index.bound[item] - 1
    far = np.minimum(last, len(pos) - 1)
    ok = (last < len(pos)) & (group[far] == group) & (pos[far] - pos <= index.size[item] - q + index.edits[item])
    hits = np.flatnonzero(ok)
    if not len(hits):
        return
    # Stretches that follow one another in a band are one region.
    new = np.concatenate([[True], (group[hits[1:]] != group[hits[:-1]]) | (pos[hits[1:]] > pos[far[hits[:-1]]] + index.size[item[hits[1:]]])])
    for i, j in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(hits))):
        h, g = hits[i], hits[j - 1]
        it, d, size, e = item[h], doc[h], int(index.size[item[h]]), int(index.edits[item[h]])
        text, lo = index.texts[it], int(low[h]) * step - shift
        begin, end = int(pos[h] - off[d]), int(pos[far[g]] - off[d]) + q
        # Item offsets that can lie under the stretch, with a window's length around it.
        a = max(0, min(begin - (lo + step + e) - size, len(text) - size))
        b = min(len(text), max(end - lo + size, a + size))
        left = max(0, a + lo - e)
        part = points[off[d] + left : min(off[d + 1], off[d] + b + lo + step + 2 * e + 1)]
        cost, ends = align(text[a:b], part, a + lo - e - left, step + 3 * e, size)
        good = np.flatnonzero(cost <= e)
        if len(good):
            f, t = good[0], good[-1]
            back, starts = align(text[a + f : a + f + size][::-1], part[: ends[f]][::-1], 0, e + 1, size)
            start = int(ends[f] - starts[0]) if back[0] <= e else int(max(0, ends[f] - size))
            yield int(d), int(it), left + start, left + int(ends[t]), int(cost[good].min())


def _found(every: list[Index], band: int, texts: pa.Array):
    """(row, item_id, start, end, edits) of each verified region; places in code points of the row's text."""
    for c in tk.chunks(texts):
        points = fold(np.frombuffer(bytes(c.buf).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32))
        off = np.concatenate([[0], np.cumsum((c.buf & 0xC0) != 0x80)])[c.off]
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
        keep[off[:-1][off[:-1] < len(points)]] = True
        at = np.flatnonzero(keep)
        short = np.searchsorted(at, off)
        for index in every:
            for d, i, s, t, e in regions(index, points[at], short, band):
                yield c.row + d, index.ids[i], int(at[short[d] + s] - off[d]), int(at[short[d] + t - 1] - off[d] + 1), e


def _scan(every: list[Index], band: int):
    def run(batches):
        for b in batches:
            ids, versions = (b.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "version"))
            rows = [(ids[d], versions[d], *x) for d, *x in _found(every, band, b.column("text"))]
            if rows:
                yield tk.rows_to_batch({f.name: np.array(x) for f, x in zip(_SCHEMA, zip(*rows))}, _SCHEMA)

    return run


def _blocks(items: DataFrame, q: int, length: int, rate: float, shortest: int, block_chars: int):
    """The items (item_id, text) as broadcast indexes, block after block; each is released when the next is asked for."""
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    blocks = max(1, -(-int(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // block_chars))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(indexes([(r.item_id, r.text) for r in block.toLocalIterator()], q, length, rate, shortest))
        yield shared, blocks
        if blocks > 1:
            shared.unpersist()


def contamination(docs: DataFrame, items: DataFrame, q: int = Q, length: int = LENGTH, rate: float = RATE, band: int = BAND, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """documents (doc_id, text), items (item_id, text) -> doc_id, item_id, start, end, edits: a row per document text and item.

    start and end: the first and last place found, in code points of the
    document's text, end exclusive; edits: of the best window. Null ids and
    texts, and empty texts, take no part; repeated rows give one row, different
    texts under one id a row each. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text").where("doc_id is not null and text is not null")
    found = None
    for shared, blocks in _blocks(items, q, length, rate, shortest, block_chars):
        part = docs.mapInArrow(lambda batches, shared=shared: _scan(shared.value, band)(batches), _TYPE)
        part = written(part, "regions") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("doc_id", "version", "item_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits"))
    return best.drop("version")


def decontaminate(docs: DataFrame, items: DataFrame, q: int = Q, length: int = LENGTH, rate: float = RATE, band: int = BAND, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns, whose own text holds no passage of the items; rows without an id too, in one pass without a shuffle."""
    place, kind = docs.columns.index("text"), docs.schema
    for shared, blocks in _blocks(items, q, length, rate, shortest, block_chars):

        def run(batches, shared=shared):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for d, *_ in _found(shared.value, band, b.column(place)):
                    keep[d] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, kind)
        docs = written(docs, "clean") if blocks > 1 else docs
    return docs


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
