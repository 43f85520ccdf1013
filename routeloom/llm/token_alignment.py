"""Operator 11: alignment of two tokenizers with a dictionary of token groups.

A blank and the text are encoded by a byte-level BPE (A) and the text by a
SentencePiece model (B), which puts the blank in front itself. Where tokens of
both end at the same byte, a group ends: runs of A ids and B ids of the same
bytes. Every A and B token of a group are linked.

Groups are interned. Whole documents of up to ``BLOCK`` bytes make a block, which
is encoded once and written as small rows: its distinct groups and how many of
its documents hold each, and which groups each document has how often, ``PIECE``
of them a row, since readers hold thousands of rows at once. Then

* equal groups of all blocks are one row of the group dictionary, with the number
  of documents that hold it;
* links are expanded once for each distinct group: a pair's documents are the
  sum over the groups that have it, less what documents that have it in several
  groups would count more than once, which blocks add up beforehand;
* each group gets the sum of its links' counts and the number of those that are
  the highest of their A id, and these two numbers go back to the blocks by the
  group's key, where documents sum them by their frequencies.

So what is shuffled are distinct groups of blocks and pairs of distinct groups,
never tokens. The best count of each A id is broadcast: at most one row an id of
the vocabulary. Rows that meet by group or pair are summed before the shuffle.

A text is cut before a blank that follows a character other than white space:
the pre-tokenizer of A always splits there, and no piece of B has a blank after
another character (both are verified of the files; otherwise texts are encoded
whole). No group crosses a cut, so equal segments are encoded once in a block,
and once in a worker while a cache, bounded in entries and bytes, holds those that
a block repeats. Tokenizers are handed ``PART`` segments at a time and their ids
kept packed. A worker's memory follows its block (``BLOCK`` bytes, or one longer
document) and the longest run without such a cut.

Special tokens' strings are plain text. Texts that are null or empty, and those
whose tokens do not spell blank and text (a text with U+2581), have no tokens:
zeros and an empty digest. Each row is a document, also where ids repeat or are
null. Only doc_id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .sentencepiece_fst import _model_bytes
from .shared import forget, table, written

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of a block's texts; segments that a worker remembers, and bytes of them and their ids.
BLOCK, CACHE, CACHE_BYTES = 6 << 20, 150_000, 32 << 20
#: Segments, and bytes of them, that tokenizers get at once; groups of a document in a row.
PART, PART_BYTES, PIECE = 4096, 256 << 10, 1024


def _csr(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _gather(off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of ``rows`` in a list of lists, one row after the other, and how many each has."""
    size = (off[1:] - off[:-1])[rows]
    return _runs(off[:-1][rows], size), size


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others follow from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers: ids of segments, and the bytes of each id."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        spec, proto = json.loads(a_file), pb.ModelProto()
        proto.ParseFromString(b_file)
        alphabet = _byte_alphabet()
        spelt = {i: bytes(alphabet[c] for c in entry) for entry, i in spec["model"]["vocab"].items()}
        self.a_bytes = self._table([spelt.get(i, b"") for i in range(max(spelt) + 1)])
        self.b_bytes = self._table([bytes([int(p.piece[3:-1], 16)]) if p.type == 6 else p.piece.replace("▁", " ").encode() for p in proto.pieces])
        split = spec.get("pre_tokenizer") or {}
        crossing = any("▁" in p.piece.lstrip("▁") for p in proto.pieces)
        plain = not proto.normalizer_spec.precompiled_charsmap and not proto.normalizer_spec.remove_extra_whitespaces and proto.normalizer_spec.add_dummy_prefix
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", False) and not spec.get("normalizer") and not crossing and plain
        self.blank = self.b.piece_to_id("▁")
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0

    @staticmethod
    def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return _csr(np.array([len(x) for x in entries])), np.frombuffer(b"".join(entries), np.uint8)

    def encode(self, segments: list[str], keep: list[bool] | None = None) -> list[tuple[bytes, bytes]]:
        """A ids and B ids of segments, each beginning with a blank, as packed int32; those of ``keep`` (None: all) are remembered."""
        new = [s for s in segments if s not in self.known]
        if len(self.known) + len(new) > CACHE or self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
            new = segments
        ids = lambda x: array("i", x).tobytes()
        found = {s: (ids(e.ids), ids(x)) for s, e, x in zip(new, self.a.encode_batch_fast(new, add_special_tokens=False), self.b.encode([s[1:] for s in new], num_threads=1))} if new else {}
        for s in (" ", ""):
            if s in found:
                found[s] = (found[s][0], ids([self.blank] if s else []))
        out = [found.get(s) or self.known[s] for s in segments]
        if len(self.known) + len(new) <= CACHE:
            held = {s: found[s] for s, k in zip(segments, keep) if k and s in found} if keep else found
            self.held += sum(len(s) + len(x) + len(y) for s, (x, y) in held.items())
            self.known |= held
        return out

    def encoded(self, segments: pa.Array, keep: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """A ids and B ids of all segments, one segment after the other, and where each one's begin."""
        ends, i = np.cumsum(pc.binary_length(segments).to_numpy(zero_copy_only=False)), 0
        ids, sizes = ([], []), ([], [])
        while i < len(segments):
            j = min(i + PART, max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PART_BYTES, "right"))))
            part = self.encode(segments.slice(i, j - i).to_pylist(), keep[i:j].tolist())
            for k in (0, 1):
                ids[k].append(b"".join([x[k] for x in part]))
                sizes[k].extend([len(x[k]) // 4 for x in part])
            i = j
        return [(np.frombuffer(b"".join(ids[k]), np.int32), _csr(np.array(sizes[k], np.int64))) for k in (0, 1)]


@lru_cache(1)
def _pair(a_file: bytes, b_file: bytes) -> Pair:
    return Pair(a_file, b_file)


def _cut_places(buf: np.ndarray, off: np.ndarray, cuts: bool) -> np.ndarray:
    """Borders of segments in the bytes of texts that begin with a blank each."""
    if not cuts or len(buf) < 4:
        return np.unique(off)
    wide = np.concatenate([np.zeros(3, np.uint8), buf])
    b1, b2, b3 = wide[2:-1], wide[1:-2], wide[:-3]  # the bytes before each place
    space = ((b1 >= 9) & (b1 <= 13)) | ((b1 >= 0x1C) & (b1 <= 0x20))
    if (b1 >= 0x80).any():
        space |= (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        space |= (b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)
        space |= (b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF)) & (b1 >= 0x80)
        space |= (b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)
        space |= (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80)
    cut = (buf == 0x20) & ~space
    mark = np.zeros(len(buf) + 1, bool)
    mark[:-1] = cut
    mark[off] = True
    return np.flatnonzero(mark)


def _expand(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct links of groups: the group's place in keys, a << 32 | b, and how many links of the group are of that pair."""
    keys = keys.cast(pa.large_binary())
    off = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1] // 4
    flat = np.frombuffer(keys.buffers()[2], np.uint32).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
    n_a = flat[off[:-1]]
    n_b = np.diff(off) - 1 - n_a

    def distinct(start, size):
        group = np.repeat(np.arange(len(start)), size)
        code, times = np.unique((group << 32) | flat[_runs(start, size)], return_counts=True)
        return code >> 32, code & 0xFFFFFFFF, times

    ga, a, ta = distinct(off[:-1] + 1, n_a)
    gb, b, tb = distinct(off[:-1] + 1 + n_a, n_b)
    b_off = _csr(np.bincount(gb, minlength=len(keys)))
    at, size = _gather(b_off, ga)
    return np.repeat(ga, size), (np.repeat(a, size) << 32) | b[at], np.repeat(ta, size) * tb[at]


class Block:
    """Documents of one block, encoded: totals of each, and their groups in the block's dictionary."""

    def __init__(self, pair: Pair, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        self.n = len(texts)
        full = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.take(pa.array(full)), pa.scalar(" ", pa.large_string()))
        off = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1] if len(spaced) else np.zeros(1, np.int64)
        data = spaced.buffers()[2] if len(spaced) else None
        buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
        off = off - off[0]
        edge = _cut_places(buf, off, pair.cuts)
        segments = pa.Array.from_buffers(pa.large_string(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(buf)]) if len(edge) > 1 else pa.array([], pa.large_string())
        coded = segments.dictionary_encode()
        self.seg = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seg_off = np.searchsorted(edge, off)
        distinct = coded.dictionary
        n = len(distinct)
        (a, a_off), (b, b_off) = pair.encoded(distinct, np.bincount(self.seg, minlength=n) > 1)
        size = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        good = self._spells(pair.a_bytes, a, a_off, distinct, size) & self._spells(pair.b_bytes, b, b_off, distinct, size)
        keep = np.flatnonzero(good)
        at, na = _gather(a_off, keep)
        a = a[at]
        at, nb = _gather(b_off, keep)
        b = b[at]
        ends_a, ends_b = np.cumsum(np.diff(pair.a_bytes[0])[a]), np.cumsum(np.diff(pair.b_bytes[0])[b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a, in_b = np.bincount(np.searchsorted(shared, ends_a), minlength=len(shared)), np.bincount(np.searchsorted(shared, ends_b), minlength=len(shared))
        # Keys of groups: the number of A ids, A ids, B ids.
        width = 1 + in_a + in_b
        key_off = _csr(width)
        flat = np.zeros(key_off[-1], np.uint32)
        flat[key_off[:-1]] = in_a
        flat[_runs(key_off[:-1] + 1, in_a)] = a
        flat[_runs(key_off[:-1] + 1 + in_a, in_b)] = b
        keys = pa.Array.from_buffers(pa.large_binary(), len(shared), [None, pa.py_buffer(key_off * 4), pa.py_buffer(flat)]).dictionary_encode() if len(shared) else pa.array([], pa.large_binary()).dictionary_encode()
        self.keys, group = keys.dictionary, keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        per_seg = np.zeros(n, np.int64)
        per_seg[keep] = np.bincount(np.searchsorted(np.cumsum(size[keep]), shared), minlength=len(keep))
        self.group_off, self.group = _csr(per_seg), group
        seg_links = np.concatenate([[0], np.cumsum(in_a * in_b)])
        totals = np.zeros((4, n), np.int64)
        totals[0, keep], totals[1, keep], totals[2] = na, nb, per_seg
        totals[3] = seg_links[self.group_off[1:]] - seg_links[self.group_off[:-1]]
        # Documents: rows of the block with a text; of those that a segment spoils nothing counts.
        spoilt = np.concatenate([[0], np.cumsum(~good[self.seg])])
        fine = spoilt[seg_off[1:]] == spoilt[seg_off[:-1]]
        self.rows = full[fine]
        self.begin, self.end = seg_off[:-1][fine], seg_off[1:][fine]
        self.totals = np.zeros((4, self.n), np.int64)
        for own, of in zip(self.totals, totals):
            sums = _csr(of[self.seg])
            own[self.rows] = sums[self.end] - sums[self.begin]
        self.byte_ends = shared
        self.seg_bytes = size
        self.kept_before = np.concatenate([[0], np.cumsum(np.where(good, size, 0))])

    @staticmethod
    def _spells(entries, ids, off, distinct, size) -> np.ndarray:
        """Whether the ids of each segment spell it."""
        width = np.concatenate([[0], np.cumsum(np.diff(entries[0])[ids])])
        same = width[off[1:]] - width[off[:-1]] == size
        keep = np.flatnonzero(same)
        at, _ = _gather(off, keep)
        spelt, _ = _gather(entries[0], ids[at])
        starts = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64)
        own, _ = _gather(starts, keep)
        if len(own):
            wrong = np.concatenate([[0], np.cumsum(entries[1][spelt] != np.frombuffer(distinct.buffers()[2], np.uint8)[own])])
            ends = np.cumsum(size[keep])
            same[keep] = wrong[ends] == wrong[ends - size[keep]]
        return same

    def digests(self) -> list[str]:
        off = np.frombuffer(self.keys.buffers()[1], np.int64)[: len(self.keys) + 1] // 4 if len(self.keys) else np.zeros(1, np.int64)
        flat = np.frombuffer(self.keys.buffers()[2], np.uint32).tolist() if len(self.keys) else []
        names = []
        for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
            m = s + 1 + flat[s]
            names.append(f"{','.join(map(str, flat[s + 1 : m]))}|{','.join(map(str, flat[m:e]))}")
        group = self.group.tolist()
        spelt = [";".join([names[g] for g in group[s:e]]) for s, e in zip(self.group_off[:-1].tolist(), self.group_off[1:].tolist())]
        out = [""] * self.n
        for row, s, e in zip(self.rows.tolist(), self.begin.tolist(), self.end.tolist()):
            out[row] = hashlib.sha256(";".join([spelt[k] for k in self.seg[s:e].tolist()]).encode()).hexdigest()
        return out

    def seen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, group, times) of the documents, distinct, in order."""
        size = self.end - self.begin
        row, seg = np.repeat(self.rows, size), self.seg[_runs(self.begin, size)]
        code, times = np.unique(row * max(len(self.group_off), 1) + seg, return_counts=True)
        row, seg = code // max(len(self.group_off), 1), code % max(len(self.group_off), 1)
        at, size = _gather(self.group_off, seg)
        code = np.repeat(row, size) * max(len(self.keys), 1) + self.group[at]
        order = np.argsort(code, kind="stable")
        code, times = code[order], np.repeat(times, size)[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        return code[first] // max(len(self.keys), 1), code[first] % max(len(self.keys), 1), np.add.reduceat(times, first) if len(first) else times

    def excess(self, row: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that documents have in several of their groups, and how often beyond the first one."""
        of, pair, _ = _expand(self.keys)
        code, inverse, holders = np.unique(pair, return_inverse=True, return_counts=True)
        keep = holders[inverse] > 1
        of, pair = of[keep], inverse[keep]
        at, size = _gather(_csr(np.bincount(of, minlength=len(self.keys))), group)
        held, times = np.unique(np.repeat(row, size) * max(len(code), 1) + pair[at], return_counts=True)
        more = np.bincount(held[times > 1] % max(len(code), 1), times[times > 1] - 1, len(code)).astype(np.int64)
        return code[more > 0], more[more > 0]


def _blocks(batches, files, make):
    pair = _pair(files.value[0], files.value[1])
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column("text").cast(pa.large_string())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, i = np.cumsum(size), 0
        while i < len(b):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, "right")))
            part = b.slice(i, j - i)
            yield from make(part, Block(pair, part.column("text")))
            i = j
        tk.release()


#: Rows of three kinds; what a row is not has nulls. A document's groups may take several, of which the first has its totals.
ENCODED = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, digest string, seen array<int>, times array<int>, local int, key binary, docs long, pair long, more long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
_FIELDS = {name: _KINDS[kind] for name, kind in (x.split(" ") for x in ENCODED.split(", "))}


def _files(spark: SparkSession, a_file: str, b_file: str):
    return spark.sparkContext.broadcast((_model_bytes(a_file), _model_bytes(b_file)))


def encoded(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Small rows of blocks: documents, their totals and groups (place is not null); groups (key is not null); pairs counted too often (pair is not null)."""
    files = _files(docs.sparkSession, a_file, b_file)

    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        for kinds in _blocks(batches, files, rows):
            for columns in kinds:
                n = len(next(iter(columns.values())))
                columns["block"] = np.full(n, part << 32 | nth, np.int64)
                yield pa.RecordBatch.from_pydict({name: (x if isinstance(x := columns[name], pa.Array) else pa.array(x)).cast(kind) if name in columns else pa.nulls(n, kind) for name, kind in _FIELDS.items()})
            nth += 1

    def rows(part, block):
        row, group, times = block.seen()
        pair, more = block.excess(row, group)
        off = np.searchsorted(row, np.arange(block.n + 1))
        pieces = np.maximum(1, -(-np.diff(off) // PIECE))
        place, nth = np.repeat(np.arange(block.n), pieces), _runs(np.zeros(block.n, np.int64), pieces)
        starts = pa.array(np.append(off[:-1][place] + nth * PIECE, len(row)), pa.int32())
        own = pa.array(place, mask=nth > 0)
        lists = {name: pa.ListArray.from_arrays(starts, pa.array(x, pa.int32())) for name, x in (("seen", group), ("times", times))}
        yield (
            {"place": place, "doc_id": part.column("doc_id").take(own), **{name: pa.array(block.totals[k]).take(own) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "digest": pa.array(block.digests(), pa.string()).take(own), **lists},
            {"local": np.arange(len(block.keys)), "key": block.keys, "docs": np.bincount(group, minlength=len(block.keys))},
            {"pair": pair, "more": more},
        )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def _dictionary(blocks: DataFrame) -> DataFrame:
    """Distinct groups with the number of documents that hold each, numbered."""
    entries = blocks.where("key is not null").select("key", "docs")
    return written(entries.groupBy("key").agg(F.sum("docs").alias("docs")).withColumn("id", F.monotonically_increasing_id()), "groups")


def _links(dictionary: DataFrame) -> DataFrame:
    """(id, pair, n, docs): the distinct links of each distinct group."""

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.slice(i, 2000)
                group, pair, n = _expand(part.column("key"))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(group)), pa.array(pair), pa.array(n), part.column("docs").take(pa.array(group))], names=["id", "pair", "n", "docs"])

    return written(dictionary.mapInArrow(run, "id long, pair long, n long, docs long"), "links")


def _counts(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """(pair, docs): how many documents hold each linked pair."""
    more = blocks.where("pair is not null").select("pair", (-F.col("more")).alias("docs"))
    return links.select("pair", "docs").unionByName(more).groupBy("pair").agg(F.sum("docs").alias("docs"))


def pair_counts(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """a, b, docs: every pair of an A id and a B id that some document links, and how many do."""
    blocks = written(encoded(docs, a_file, b_file), "blocks")
    out = _counts(_links(_dictionary(blocks)), blocks)
    return out.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "docs")


def groups(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """The groups themselves, in order: doc_id, place, start and end (bytes of blank and text), a_ids, b_ids."""
    files = _files(docs.sparkSession, a_file, b_file)

    def rows(part, block):
        keys = [np.frombuffer(k, np.uint32) for k in block.keys.to_pylist()]
        for row, s, e in zip(block.rows.tolist(), block.begin.tolist(), block.end.tolist()):
            seg = block.seg[s:e]
            at, size = _gather(block.group_off, seg)
            base = np.repeat(np.cumsum(block.seg_bytes[seg]) - block.seg_bytes[seg] - block.kept_before[:-1][seg], size)
            end = block.byte_ends[at] + base
            mine = [keys[g] for g in block.group[at].tolist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").take(pa.array([row] * len(end), pa.int64())), "place": pa.array(np.arange(len(end)), pa.int32()),
                "start": pa.array(np.concatenate([[0], end[:-1]]), pa.int64()), "end": pa.array(end, pa.int64()),
                "a_ids": pa.array([k[1 : 1 + k[0]].tolist() for k in mine], pa.list_(pa.int32())), "b_ids": pa.array([k[1 + k[0] :].tolist() for k in mine], pa.list_(pa.int32())),
            })

    def run(batches):
        yield from _blocks(batches, files, rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, place int, start long, end long, a_ids array<int>, b_ids array<int>")


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(key, docs: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of a block, with the sums over their groups."""
    get = lambda table, name: table.column(name).to_numpy().astype(np.int64)
    local, place = get(found, "local"), get(docs, "place")
    seen, times = (docs.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("seen", "times"))
    off = _csr(pc.list_value_length(docs.column("seen")).to_numpy().astype(np.int64))
    first = docs.filter(pc.is_valid(docs.column("n_a")))
    out = {c: first.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    for name, of in (("n_best", "best"), ("count_sum", "total")):
        value, sums = np.zeros(max(local.max(initial=-1), seen.max(initial=-1)) + 1, np.int64), np.zeros(place.max(initial=-1) + 1, np.int64)
        value[local] = get(found, of)
        before = _csr(value[seen] * times)
        np.add.at(sums, place, before[off[1:]] - before[off[:-1]])
        out[name] = sums[get(first, "place")]
    return pa.table(out | {"groups_sha256": first.column("digest")})


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """A row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = written(encoded(docs, a_file, b_file), "blocks")
    dictionary = _dictionary(blocks)
    links = _links(dictionary)
    counts = written(_counts(links, blocks).withColumn("a", F.shiftright("pair", 32)), "pairs")
    highest = counts.groupBy("a").agg(F.max("docs").alias("highest"))  # at most one row an id of A
    rated = counts.join(F.broadcast(highest), "a").select("pair", F.col("docs").alias("count"), (F.col("docs") == F.col("highest")).alias("is_best"))
    by_group = links.join(rated, "pair").groupBy("id").agg(F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("count")).alias("total"))
    results = written(dictionary.join(by_group, "id").select("key", "best", "total"), "results")
    forget(links)
    forget(counts)
    forget(dictionary)
    found = blocks.where("key is not null").select("block", "local", "key").join(results, "key").select(F.col("block").alias("of_block"), "local", "best", "total")
    kept = blocks.where("place is not null").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "digest", "seen", "times")
    return kept.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(_summed, ALIGNED)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
