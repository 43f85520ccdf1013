"""Operator 4: secrets, and credentials whose parts lie apart, linked by interval joins within scopes.

Strong parts are reported wherever they stand (fixed patterns below). Weak
parts, each too common to report alone, are reported only beside complementary
ones: an identifier, a secret and an endpoint are complementary roles. A scope
is a block of lines between blank lines; two disjoint parts of it belong
together, if ``reach`` is given, when at most that many code points lie between
them. The join is by sorted ends: the partners of a part are the intervals that
begin early enough less those that end too early, so it counts every pair in
n log n steps and makes none. Spans are code points, ends exclusive.

Weak candidates are: values of names such as client_id, login or account
(identifier); runs of 24 characters or more of the base64 alphabets with both
cases and digits, and hexadecimal runs of 24 to 31 digits with letters and
figures (weak_secret); URLs with a scheme and values of names such as host or
server (endpoint). Of overlapping candidates the strong one stays, then the
identifier, then the endpoint.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

# The strong patterns and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "identifier", "endpoint", "weak_secret")

_ASSIGN = re.compile(ASSIGN, re.ASCII)
_ACCESS = re.compile(ACCESS)
# A greedy run of the class that is long enough is a run that no class member precedes.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_IDENTIFIER = re.compile(r"""(?i:client_?id|access_?key_?id|account_?(?:id|name)|user_?(?:id|name)|login|tenant_?id|app(?:lication)?_?id|project_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII)
_WEAK = re.compile(r"(?<![A-Za-z0-9/+=_-])[A-Za-z0-9/+_-]{24,}={0,2}(?![A-Za-z0-9/+=_-])")
_WEAK_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_ENDPOINT = re.compile(r"""(?i:[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{4,}|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::\d+)?)""", re.ASCII)
#: Holds of every text that has a strong part, a weak secret or a weak identifier; endpoints alone are never reported.
_ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|[A-Za-z0-9/+_-]{24}|(?i:client_?id|access_?key_?id|account_?(?:id|name)|user_?(?:id|name)|login|tenant_?id|app(?:lication)?_?id|project_?id)["']?\x20*[:=]"""
_ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
_ROLES = ("identifier", "secret", "endpoint")


def strong(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strong parts, sorted by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _varied(value: str) -> bool:
    """Letters of both cases and digits, or hexadecimal letters and digits: what keys have and prose has not."""
    digits, letters = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
    return digits and letters and (any(c.isupper() for c in value) and any(c.islower() for c in value) or _WEAK_HEX.match(value) is not None)


def weak(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak candidates that overlap neither ``taken`` nor a candidate of an earlier kind."""
    out: list[tuple[int, int, str]] = []
    found = [(m.start(), m.end(), kind) for kind, pattern in (("identifier", _IDENTIFIER), ("endpoint", _ENDPOINT), ("weak_secret", _WEAK)) for m in pattern.finditer(text) if kind != "weak_secret" or _varied(m[0])]
    if not found:
        return out
    for kind in KINDS[3:]:
        busy = sorted(taken + out)
        starts, ends = np.array([s for s, _, _ in busy], np.int64), np.maximum.accumulate([e for _, e, _ in busy] or [0])
        for s, e, k in found:
            if k == kind and ((at := int(np.searchsorted(starts, e))) == 0 or ends[at - 1] <= s):
                out.append((s, e, k))
    return out


def scopes(text: str) -> list[int]:
    """Where the scopes after the first begin."""
    return [m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)]


def partners(start: np.ndarray, end: np.ndarray, role: np.ndarray, scope: np.ndarray, reach: int | None = None) -> np.ndarray:
    """The number of disjoint intervals of other roles in each one's scope, within ``reach`` of it if given."""
    far = int(end.max(initial=0)) + 1
    near = far if reach is None else min(reach, far)
    base = scope * (2 * far + near + 2)  # scopes side by side, out of each other's reach
    s, e = base + start, base + end
    found = np.zeros(len(start), np.int64)
    for r in np.unique(role):
        mine, other = role == r, role != r
        a, b = np.sort(s[mine]), np.sort(e[mine])
        x, y = s[other], e[other]
        within = np.searchsorted(a, np.minimum(y + near, base[other] + far), "right") - np.searchsorted(b, np.maximum(x - near, base[other]), "left")
        over = np.searchsorted(a, y, "left") - np.searchsorted(b, x, "right")
        found[other] += within - over
    return found


def linked(text: str, reach: int | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], int]:
    """Strong spans; all spans; linked pairs of complementary parts."""
    base = strong(text)
    parts = sorted(base + weak(text, base))
    count = np.zeros(len(parts), np.int64)
    if len(parts) > 1:
        start, end = (np.array(x, np.int64) for x in zip(*((s, e) for s, e, _ in parts)))
        role = np.array([_ROLES.index(_ROLE[k]) for _, _, k in parts])
        count = partners(start, end, role, np.searchsorted(scopes(text), start, "right"), reach)
    spans = base + [x for x, n in zip(parts, count) if n and x[2] not in KINDS[:3]]
    return base, sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))), int(count.sum()) // 2


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span (overlapping ones as one) replaced by its kind in angle brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        s, e, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e = max(e, spans[i][1])
            i += 1
        out += [text[at:s], f"<{kind}>"]
        at = e
    return "".join(out) + text[at:]


def _suspects(texts: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_numpy(zero_copy_only=False))


def _scan(reach: int | None):
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_links", pa.int64())])
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for b in batches:
            texts, n = b.column("text"), b.num_rows
            counts, digest, spans = np.zeros((4, n), np.int64), [none] * n, [""] * n
            for i in _suspects(texts):
                base, every, links = linked(texts[i].as_py(), reach)
                for k in range(3):
                    counts[k, i] = sum(x[2] == KINDS[k] for x in base)
                counts[3, i] = links
                digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(every)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(counts[k]) for k in range(3)), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3])], schema=schema)

    return run


def secret_spans(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_links; a row per row.

    Null and empty texts have no spans. Null ids stay null. Other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(reach), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_links long")


def mask_secrets(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """docs, all columns, with every span of ``text`` masked."""
    place = docs.columns.index("text")

    def run(batches):
        for b in (whole.slice(k, 500) for whole in batches for k in range(0, max(whole.num_rows, 1), 500)):
            texts = b.column(place)
            hits = _suspects(texts)
            if len(hits):
                new = texts.to_pylist()
                for i in hits:
                    spans = linked(new[i], reach)[1]
                    if spans:
                        new[i] = masked(new[i], spans)
                b = b.set_column(place, b.schema.field(place), pa.array(new, texts.type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
