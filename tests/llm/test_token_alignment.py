"""Token alignment against whole encodings of every text by the libraries themselves."""

import hashlib
import json
from collections import Counter, defaultdict

import pytest

from routeloom.llm import token_alignment as ta
from routeloom.llm.shared import table

from .data import awkward, empty, prose


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a = Tokenizer.from_file(ta.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=ta.B_FILE)
    stand_ins = dict(zip([*map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)])], [*range(33, 127), *range(161, 173), *range(174, 256)]))
    stand_ins |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in stand_ins.values())}
    entry = {i: bytes(stand_ins[c] for c in t) for t, i in json.load(open(ta.A_FILE))["model"]["vocab"].items()}
    assert ByteLevel

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if b"".join(entry[i] for i in x) != (" " + text).encode() or b"".join(map(piece, y)) != (" " + text).encode():
            return []
        out, i, j, at, bt = [], 0, 0, 0, 0
        while i < len(x):
            p, q = [x[i]], [y[j]]
            at, bt, i, j = at + len(entry[x[i]]), bt + len(piece(y[j])), i + 1, j + 1
            while at != bt:
                if at < bt:
                    p.append(x[i])
                    at, i = at + len(entry[x[i]]), i + 1
                else:
                    q.append(y[j])
                    bt, j = bt + len(piece(y[j])), j + 1
            out.append((p, q))
        assert j == len(y)
        return out

    return groups


def expected(rows, groups):
    found = [(i, groups(t)) for i, t in rows]
    held = Counter()
    for _, g in found:
        held.update({(a, b) for p, q in g for a in p for b in q})
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = Counter()
    for i, g in found:
        links = [(a, b) for p, q in g for a in p for b in q]
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g)
        out[(i, sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if g else "")] += 1
    return out, held


def test_whole_table(spark, sf, plain):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert Counter(map(tuple, ta.op11(spark, sf).collect())) == expected(rows, plain)[0]


SPACES = ["a  b   c ", " lead", "   ", " ", "x\n\n y\t z \n", "it's they'll ' s", "nb  sp  em　 id  ls  x  y  z\x85 q", "日本 語 の  テキスト", "<|endoftext|> <s> </s> <0x41> <unk>", "😀 😀😀 é ñ", "don▁t", "▁", "a▁ b", "1234 12 3,4 ... !!! a_b", "é ‍ ﻿ x\x00 y", "\x1c \x1f a \x1d", "ab" * 3000, "﷽ 𒐫 ꧅"]


def test_awkward_texts(spark, plain, monkeypatch):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    assert Counter(map(tuple, ta.align(awkward(spark)).collect())) == expected(rows, plain)[0]
    rows = [(k, t) for k, t in enumerate(SPACES * 2)] + [(1, None), (None, ""), (7, prose(5, 3000))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, block string, key string").repartition(3)
    want, held = expected(rows, plain)
    assert Counter(map(tuple, ta.align(df).collect())) == want
    assert {(r.a, r.b): r.docs for r in ta.pair_counts(df).collect()} == held
    assert ta.align(empty(spark)).count() == 0


def test_small_blocks_and_cache(spark, plain):
    """Documents in many blocks, a cache that overflows: a worker's functions called directly."""
    pair = ta.Pair(open(ta.A_FILE, "rb").read(), open(ta.B_FILE, "rb").read())
    assert pair.cuts
    first = [x for x, _ in pair.encode([" a", " b c", " "])]
    ta.CACHE, before = 2, ta.CACHE
    try:
        assert [x for x, _ in pair.encode([" a", " b c", " "])] == first and not pair.known
    finally:
        ta.CACHE = before


def test_groups(spark, plain):
    rows = [(k, t) for k, t in enumerate(SPACES)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in ta.groups(df).orderBy("doc_id", "place").collect():
        assert r.start == (got[r.doc_id][-1][3] if got[r.doc_id] else 0)
        got[r.doc_id].append((r.a_ids, r.b_ids, r.start, r.end))
    for k, t in rows:
        assert [x[:2] for x in got[k]] == plain(t)
        if got[k]:
            assert got[k][-1][3] == len((" " + t).encode())


def test_rows_of_blocks_are_small_and_tokenizers_get_a_part_at_a_time(spark, plain, monkeypatch):
    """A block of 300 texts, one of them with more groups than a row takes, and 20,000 words that occur once: no row holds a block, no call and no cache all words."""
    many = " ".join(f"w{k:05d}x" for k in range(20_000))
    rows = [(k, prose(k, 40)) for k in range(298)] + [(298, many), (299, many[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert max(len(r.seen or ()) + len(r.times or ()) for r in ta.encoded(df).collect()) <= 2 * ta.PIECE
    monkeypatch.setattr(ta, "PIECE", 50)
    longest = [len(r.seen or ()) for r in ta.encoded(df).collect()]
    assert max(longest) <= 50 < sum(longest)
    assert Counter(map(tuple, ta.align(df).collect())) == expected(rows, plain)[0]
    pair, sizes = ta.Pair(open(ta.A_FILE, "rb").read(), open(ta.B_FILE, "rb").read()), []

    class Counted:
        def encode_batch_fast(self, segments, tokenizer=pair.a, **how):
            sizes.append((len(segments), sum(map(len, segments))))
            return tokenizer.encode_batch_fast(segments, **how)

        encode_batch = encode_batch_fast

    pair.a = Counted()
    monkeypatch.setattr(ta, "CACHE_BYTES", 10_000)
    import pyarrow as pa

    ta.Block(pair, pa.array([many, "so so so"]))
    assert len(sizes) > 1 and all(n <= 4096 and size <= 256 << 10 for n, size in sizes)
    assert {" so"} == set(pair.known)
