"""Operator 6: SentencePiece encoding and decoding as weighted finite-state transduction.

Compiled once from a model file:

* the normaliser: the model's character map, if it has one (an arc for each of
  its keys, longest first), then repeated blanks removed if the model says so, a
  dummy blank in front, blanks as U+2581;
* user-defined symbols of BPE models: arcs that nothing may cross (unigram models
  with such symbols are refused: the weight depends on the library's version);
* the piece transducer: an arc for each piece from its code points to its id;
* byte fallback: an arc for a code point that no piece holds, to its UTF-8 bytes.

Composing a text with them gives a lattice of piece arcs, and its shortest path
in the tropical semiring is the encoding. The weights make it the model's own:
of a unigram model, minus the scores; of a BPE model, zero or infinity: a path
is a merge result exactly if every two neighbouring pieces are stable, that is,
no merge of lower rank would have joined parts of them across their border. So
the state of the transducer is its last piece, an unstable pair has no arc, and
one path of finite weight is left.

Lattices are cut where no piece has the two code points side by side, which
changes nothing and bounds their length; equal segments are solved once in a
worker while a bounded cache holds them. All lattices of a chunk advance
together as arrays. Runs of blanks, whose pieces tie in rank in BPE models, are
merged directly, leftmost first.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .shared import table, without

MODEL, BLANK, CACHE = "/opt/tokenizers/piece_bpe_32k.model", 0x2581, 200_000
NORMAL, UNKNOWN, BYTE, USER, UNUSED = 1, 2, 6, 4, 5
INF = 1 << 40


class Lookup:
    """A map from 64-bit keys to integers on sorted arrays, with a bit table that turns most misses away."""

    def __init__(self, keys, values, bits: int = 22):
        keys, values = np.asarray(keys, tk.U64), np.asarray(values, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.values, self.bits = keys[order], values[order], bits
        self.seen = np.zeros(1 << bits, bool)
        self.seen[tk.mix(self.keys) >> tk.U64(64 - bits)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known keys and their values."""
        at = np.flatnonzero(self.seen[tk.mix(x) >> tk.U64(64 - self.bits)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
        ok = self.keys[slot] == x[at]
        return at[ok], self.values[slot[ok]]

    def get(self, x: np.ndarray, default: int) -> np.ndarray:
        out = np.full(len(x), default, np.int64)
        at, v = self.find(x)
        out[at] = v
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def character_map(blob: bytes) -> dict[str, str]:
    """The keys of a compiled character map and what they become.

    The blob is a length, a double-array trie of that many bytes over the keys'
    UTF-8, and the replacements, each closed by a zero byte; a key's value is its
    replacement's place. A trie unit holds a label in its low byte (the top bit
    marks values), whether a value follows (bit 8) and the offset to its children.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, words = np.frombuffer(blob[4 : 4 + size], np.uint32).astype(np.int64), blob[4 + size :]
    base = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
    labels, out, todo = np.arange(1, 256), {}, [(int(base(units[0])), b"")]
    while todo:
        place, key = todo.pop()
        at = place ^ labels
        at, found = at[at < len(units)], labels[at < len(units)]
        for child, label in zip(*(x[(units[at] & 0x800000FF) == found].tolist() for x in (at, found))):
            unit, name = int(units[child]), key + bytes([label])
            below = child ^ base(unit)
            if unit >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                out[name.decode("utf-8", "replace")] = words[start : words.index(0, start)].decode("utf-8", "replace")
            todo.append((below, name))
    return out


class Transducer:
    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if kind not in (1, 2) or proto.trainer_spec.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("only unigram and BPE models with blanks as prefixes")
        self.bpe = kind == 2
        self.dummy, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        pieces = list(proto.pieces)
        users = {p.piece: i for i, p in enumerate(pieces) if p.type == USER}
        if users and not self.bpe:
            raise ValueError("unigram models with user-defined symbols are not supported")
        longest_first = lambda some: re.compile("|".join(map(re.escape, sorted(some, key=len, reverse=True))))
        self.users = longest_first(users) if users else None
        self.user_keys, self.user_ids = [self._key(_points(u)) for u in users], list(users.values())
        self.chars = character_map(norm.precompiled_charsmap)
        self.starts = re.compile("[" + "".join(map(re.escape, sorted({k[0] for k in self.chars}))) + "]") if self.chars else None
        self.reach = max(map(len, self.chars), default=0)
        self.raw_users = longest_first({u.replace(chr(BLANK), " ") for u in users} | set(users)) if users else None
        self.unk = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
        self.byte_ids = np.full(256, self.unk, np.int64)
        for i, p in enumerate(pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        self.fallback = proto.trainer_spec.byte_fallback
        self.size = len(pieces)
        normal = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        self.score = np.array([p.score for p in pieces])
        # What an id writes: blanks for U+2581, its byte for byte pieces, nothing for control symbols.
        out = [p.piece.replace("▁", " ").encode() if p.type in (NORMAL, USER) else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else " ⁇ ".encode() if p.type == UNKNOWN else b"" for p in pieces]
        self.out_off = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        self.out = np.frombuffer(b"".join(out), np.uint8)

        self.rank = np.full(self.size, INF, np.int64)
        order = sorted(normal.values(), key=lambda i: (len(pieces[i].piece) > 1, -pieces[i].score, i))
        self.rank[order] = np.arange(len(order))
        self.ids, self.ranked = normal, np.array(order)
        if self.bpe:
            left, right = np.arange(len(order)), np.arange(len(order))
            for piece, i in list(normal.items()):
                if len(piece) > 1:
                    got = self.merge(piece, last=True)
                    if got is None:
                        del normal[piece]  # no sequence of merges makes it
                    else:
                        r = self.rank[i]
                        left[r], right[r] = (self.rank[j] for j in got)
            self.left, self.right = left, right
            joint = [(int(self.rank[normal[p[:k]]]) * self.size + int(self.rank[normal[p[k:]]]), int(self.rank[i])) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
            self.joint = Lookup([a for a, _ in joint], [b for _, b in joint])
            self.pair_key, self.pair_ok = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.longest = max(map(len, normal), default=1)
        self.arcs = Lookup([self._key(_points(p)) for p in normal], [self.rank[i] for i in normal.values()])
        self.inside = Lookup(sorted({(ord(a) << 32) | ord(b) for p in normal for a, b in zip(p, p[1:])}), np.zeros(len({(a, b) for p in normal for a, b in zip(p, p[1:])})))
        self.cost = -self.score[self.ranked]
        self.unknown_cost = -(min((self.score[i] for i in normal.values()), default=0.0) - 10.0)
        self.clear()

    @staticmethod
    def _key(p: np.ndarray) -> int:
        return int(tk.span_hash(p, np.array([0]), np.array([len(p)]))[0])

    def clear(self) -> None:
        """Only user-defined symbols are known from the start."""
        order = np.argsort(np.array(self.user_keys, tk.U64))
        self.cached, self.cached_ids = np.array(self.user_keys, tk.U64)[order], np.array(self.user_ids, np.int64)[order]
        self.cached_off = np.arange(len(order) + 1)

    def normalise(self, text: str) -> str:
        """Each place's longest key of the character map replaced, user-defined symbols left alone; then blanks, as the model says."""
        if self.starts is not None and self.starts.search(text):
            out, at = [], 0
            kept = [m.span() for m in self.raw_users.finditer(text)] if self.raw_users else []
            for m in self.starts.finditer(text):
                i = m.start()
                while kept and kept[0][1] <= i:
                    kept.pop(0)
                if i < at or (kept and kept[0][0] <= i):
                    continue
                for n in range(min(self.reach, len(text) - i), 0, -1):
                    if (new := self.chars.get(text[i : i + n])) is not None:
                        out += [text[at:i], new]
                        at = i + n
                        break
            text = "".join([*out, text[at:]])
        return " ".join(filter(None, text.split(" "))) if self.squeeze else text

    # --- merges of one string, as the model defines them: for compiling, and for runs of blanks ---

    def merge(self, text: str, last: bool = False):
        """Ids after all merges; with ``last``, the two ids of the final merge if they make the whole text."""
        parts: list = list(text)
        n = len(parts)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(a, b):
            if a >= 0 and b >= 0 and (i := self.ids.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, b, parts[a], parts[b]))

        for k in range(n - 1):
            offer(k, k + 1)
        final = None
        while heap:
            _, a, b, x, y = heapq.heappop(heap)
            if parts[a] != x or parts[b] != y or nxt[a] != b:
                continue
            final = (self.ids.get(x), self.ids.get(y))
            parts[a], parts[b] = x + y, None
            nxt[a] = nxt[b]
            if nxt[b] >= 0:
                prev[nxt[b]] = a
            offer(prev[a], a)
            offer(a, nxt[a])
        if last:
            return final if parts[0] == text and final and None not in final else None
        return [i for p in parts if p is not None for i in ([self.ids[p]] if p in self.ids else self.spell(p))]

    def spell(self, char: str) -> list[int]:
        return [int(self.byte_ids[x]) for x in char.encode("utf-8", "surrogatepass")] if self.fallback else [self.unk]

    # --- stable pairs -----------------------------------------------------------------------

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces of ranks a, b stay apart: their border is walked from the last merges down to single code points."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), INF, np.int64)
        ok = np.ones(len(a), bool)
        on = np.arange(len(a))
        while len(on):
            x, y = a[on], b[on]
            joined = self.joint.get((x * self.size + y).astype(tk.U64), INF)
            bad = joined < limit[on]
            ok[on[bad]] = False
            on, x, y = on[~bad], x[~bad], y[~bad]
            # Undo the later of the two last merges; the other one where that is a single code point.
            x_whole, y_whole = self.right[x] == x, self.left[y] == y
            undo_x = ((x > y) & ~x_whole) | ((x <= y) & y_whole & ~x_whole)
            undo_y = ~undo_x & ~y_whole
            i, j = on[undo_x], on[undo_y]
            limit[i] = x[undo_x]
            a[i] = self.right[x[undo_x]]
            limit[j] = y[undo_y] + 1
            b[j] = self.left[y[undo_y]]
            on = on[undo_x | undo_y]
        return ok

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = (tk.mix(key.astype(tk.U64)) >> tk.U64(44)).astype(np.int64)
        out = self.pair_ok[at]
        miss = np.flatnonzero(self.pair_key[at] != key)
        if len(miss):
            x, first, inv = np.unique(key[miss], return_index=True, return_inverse=True)
            got = self._stable(a[miss[first]], b[miss[first]])
            self.pair_key[at[miss[first]]], self.pair_ok[at[miss[first]]] = x, got
            out[miss] = got[inv]
        return out

    # --- shortest paths ---------------------------------------------------------------------

    def solve(self, p: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments p[start:end] one after the other, and their offsets."""
        h = tk.prefix(p)
        seg_of = np.repeat(np.arange(len(start)), end - start)
        pos = np.concatenate([np.arange(a, b) for a, b in zip(start, end)]) if len(start) < 64 else np.arange(int((end - start).sum())) - np.repeat(np.cumsum(end - start) - (end - start), end - start) + start[seg_of]
        s_all, e_all, r_all = [], [], []
        for size in range(1, self.longest + 1):
            ok = pos + size <= end[seg_of]
            s = pos[ok]
            if not len(s):
                break
            at, rank = self.arcs.find(tk.span_hash(p, s, s + size, h))
            s_all.append(s[at])
            e_all.append(s[at] + size)
            r_all.append(rank)
        s, e, r = np.concatenate(s_all), np.concatenate(e_all), np.concatenate(r_all)
        # An arc for each code point without a piece of its own; its place is taken by bytes below.
        lone = np.setdiff1d(pos, s[e == s + 1], assume_unique=False)
        s, e, r = np.concatenate([s, lone]), np.concatenate([e, lone + 1]), np.concatenate([r, np.full(len(lone), -1)])
        first = np.zeros(len(p) + 1, np.int64)
        first[pos] = start[seg_of]
        level = e - first[s]
        order = np.lexsort((s, level))
        s, e, r, level = s[order], e[order], r[order], level[order]
        begins = first[s] == s
        cut = np.concatenate([[0], np.flatnonzero(level[1:] != level[:-1]) + 1, [len(level)]])
        # Nodes are borders; a segment's first border has no last piece (-2).
        node = np.full(len(p) + 1, -3, np.int64)
        back = np.zeros(len(p) + 1, np.int64)
        best = np.full(len(p) + 1, np.inf)
        for a, z in zip(cut[:-1], cut[1:]):
            if a == z:
                continue
            i, j, k = s[a:z], e[a:z], r[a:z]
            before = np.where(begins[a:z], -2, node[i])
            if self.bpe:
                ok = (before < 0) | (k < 0)
                ok &= before != -3
                both = np.flatnonzero((before >= 0) & (k >= 0))
                ok[both] = self.stable(before[both], k[both])
                node[j[ok]], back[j[ok]] = k[ok], i[ok]
            else:
                c = np.where(begins[a:z], 0.0, best[i]) + np.where(k < 0, self.unknown_cost, self.cost[k])
                o = np.lexsort((-i, c))[::-1]  # the least cost is written last; of equal ones, the longer arc loses
                best[j[o]], node[j[o]], back[j[o]] = c[o], k[o], i[o]
        # Paths from the ends, all segments together.
        at, live = end.copy(), np.arange(len(start))
        got_seg, got_pos = [], []
        while len(live):
            got_seg.append(live)
            got_pos.append(at[live])
            at[live] = back[at[live]]
            live = live[at[live] > start[live]]
        seg, to = np.concatenate(got_seg), np.concatenate(got_pos)
        order = np.lexsort((to, seg))
        seg, to = seg[order], to[order]
        rank = node[to]
        ids = np.where(rank >= 0, self.ranked[np.maximum(rank, 0)], -1)
        size = np.ones(len(ids), np.int64)
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            spelt = [self.spell(chr(c)) for c in p[to[odd] - 1]]
            size[odd] = [len(x) for x in spelt]
            ids = np.repeat(ids, size)
            ids[np.repeat(rank < 0, size)] = np.concatenate(spelt)
        per = np.bincount(seg, size, len(start)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per)])

    def encode(self, texts: pa.Array):
        """Per chunk of texts: the chunk, ids, and offsets of rows in them."""
        for whole in tk.chunks(texts):
            c = whole
            if self.squeeze or self.chars:
                plain = [self.normalise(bytes(c.buf[a:b]).decode("utf-8", "replace")) for a, b in zip(c.off[:-1], c.off[1:])]
                c = next(tk.chunks(pa.array(plain, pa.large_string()), "", 1 << 62, 1 << 30), c)
            q = np.frombuffer(bytes(c.buf).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            points = np.concatenate([[0], np.cumsum((c.buf & 0xC0) != 0x80)])[c.off]
            full = np.flatnonzero(np.diff(points))
            front = len(full) if self.dummy else 0
            p = np.full(len(q) + front, BLANK, np.uint32)
            own = np.ones(len(p), bool)
            shift = np.zeros(c.n + 1, np.int64)
            if self.dummy:
                shift[full + 1] = 1
                shift = np.cumsum(shift)
                own[points[full] + np.arange(len(full))] = False
            off = points + shift
            p[own] = np.where(q == 32, BLANK, q)
            if not len(p):
                yield whole, np.zeros(0, np.int64), np.zeros(c.n + 1, np.int64)
                continue
            cut = np.ones(len(p) + 1, bool)
            known, _ = self.inside.find((p[:-1].astype(tk.U64) << tk.U64(32)) | p[1:].astype(tk.U64))
            cut[known + 1] = False
            cut[off] = True
            if self.users is not None:
                for a, b in zip(off[:-1], off[1:]):
                    for m in self.users.finditer(p[a:b].tobytes().decode("utf-32-le", "surrogatepass")):
                        cut[a + m.start() + 1 : a + m.end()] = False
                        cut[[a + m.start(), a + m.end()]] = True
            edge = np.flatnonzero(cut)
            ids, at = self.segments(p, edge[:-1], edge[1:])
            yield whole, ids, at[np.searchsorted(edge, off)]

    def segments(self, p: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = tk.span_hash(p, start, end)
        x, first, inv = np.unique(h, return_index=True, return_inverse=True)
        slot = np.minimum(np.searchsorted(self.cached, x), max(len(self.cached) - 1, 0))
        hit = self.cached[slot] == x if len(self.cached) else np.zeros(len(x), bool)
        miss = np.flatnonzero(~hit)
        a, b = start[first[miss]], end[first[miss]]
        blanks = np.zeros(len(p) + 1, np.int64)
        np.cumsum((p[1:] == BLANK) & (p[:-1] == BLANK), out=blanks[1 : len(p)])
        blanks[len(p)] = blanks[len(p) - 1]
        runs = self.bpe & (blanks[b - 1] > blanks[a])
        new: list = [np.zeros(0, np.int64)] * len(miss)
        plain = np.flatnonzero(~runs) if self.bpe else np.arange(len(miss))
        if len(plain):
            ids, off = self.solve(p, a[plain], b[plain])
        else:
            ids, off = np.zeros(0, np.int64), np.zeros(1, np.int64)
        if len(plain) < len(miss):
            for k, i in enumerate(plain):
                new[i] = ids[off[k] : off[k + 1]]
            for i in np.flatnonzero(runs):
                new[i] = np.array(self.merge(p[a[i] : b[i]].tobytes().decode("utf-32-le", "surrogatepass")), np.int64)
            size = np.array([len(y) for y in new], np.int64)
            ids, off = np.concatenate(new), np.concatenate([[0], np.cumsum(size)])
        # Segments of the chunk and of the cache side by side, in the order of x.
        size = np.zeros(len(x), np.int64)
        src = np.zeros(len(x), np.int64)
        size[miss], src[miss] = np.diff(off), off[:-1] + len(self.cached_ids)
        if hit.any():
            size[hit] = (self.cached_off[1:] - self.cached_off[:-1])[slot[hit]]
            src[hit] = self.cached_off[:-1][slot[hit]]
        pool = np.concatenate([self.cached_ids, ids])
        total = size[inv]
        at = np.concatenate([[0], np.cumsum(total)])
        out = pool[np.arange(at[-1]) - np.repeat(at[:-1], total) + np.repeat(src[inv], total)]
        if len(self.cached) + len(miss) <= CACHE:
            keys = np.concatenate([self.cached, x[miss]])
            sizes = np.concatenate([np.diff(self.cached_off), np.diff(off)])
            srcs = np.concatenate([self.cached_off[:-1], off[:-1] + len(self.cached_ids)])
            order = np.argsort(keys, kind="stable")
            s = sizes[order]
            o = np.concatenate([[0], np.cumsum(s)])
            self.cached_ids = pool[np.arange(o[-1]) - np.repeat(o[:-1], s) + np.repeat(srcs[order], s)]
            self.cached, self.cached_off = keys[order], o
        return out, at

    # --- decoding ---------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts and their offsets, the dummy blank taken off."""
        size = np.diff(self.out_off)[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        data = self.out[np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(self.out_off[:-1][ids], size)]
        bytes_off = at[off]
        if self.dummy and len(data):
            first = bytes_off[:-1][np.diff(bytes_off) > 0]
            first = first[data[first] == 32]
            keep = np.ones(len(data), bool)
            keep[first] = False
            gone = np.concatenate([[0], np.cumsum(~keep)])
            return data[keep], bytes_off - gone[bytes_off]
        return data, bytes_off


@lru_cache(2)
def _compiled(data: bytes) -> Transducer:
    return Transducer(data)


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs, all columns, with ids array<int>, n_pieces and round_trip: whether decoding the ids gives the text back.

    Null and empty texts have no ids and round_trip true. ``model`` is read once
    on the driver; a vocabulary file's size bounds what is broadcast. Texts that
    hold U+2581, or what the model's normaliser changes, do not come back unchanged.
    Columns of docs that already have one of the three names are replaced.
    """
    docs = without(docs, "ids", "n_pieces", "round_trip")
    place = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(_model_bytes(model))

    def run(batches):
        fst = _compiled(shared.value)
        for b in batches:
            for c, ids, o in fst.encode(b.column(place)):
                data, at = fst.decode(ids, o)
                size = np.diff(c.off)
                same = np.diff(at) == size
                if same.all():
                    wrong = np.concatenate([[0], np.cumsum(data != c.buf)])
                    same = wrong[c.off[1:]] == wrong[c.off[:-1]]
                else:
                    same = np.array([np.array_equal(data[at[k] : at[k + 1]], c.buf[c.off[k] : c.off[k + 1]]) for k in range(c.n)], bool)
                yield pa.RecordBatch.from_arrays([*b.slice(c.row, c.n).columns, tk.lists(ids.astype(np.int32), o, pa.int32()), pa.array(np.diff(o).astype(np.int32)), pa.array(same)], names=[*b.schema.names, "ids", "n_pieces", "round_trip"])

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_pieces", T.IntegerType()), T.StructField("round_trip", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows, all columns but ids, with decoded (which replaces a column of that name): the text of ``ids`` (empty for null)."""
    rows = without(rows, "decoded")
    place = rows.columns.index("ids")
    shared = rows.sparkSession.sparkContext.broadcast(_model_bytes(model))

    def run(batches):
        fst = _compiled(shared.value)
        for b in batches:
            lists = b.column(place).to_pylist()
            off = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            data, at = fst.decode(np.array([i for x in lists for i in x or ()], np.int64), off)
            texts = [bytes(data[a:z]).decode("utf-8", "replace") for a, z in zip(at[:-1], at[1:])]
            keep = [k for k in range(b.num_columns) if k != place]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string())], names=[*(b.schema.names[k] for k in keep), "decoded"])

    return rows.mapInArrow(run, T.StructType([*(f for k, f in enumerate(rows.schema.fields) if k != place), T.StructField("decoded", T.StringType())]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")).drop("text")
