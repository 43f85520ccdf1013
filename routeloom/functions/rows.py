"""The row types that extractors emit, and a helper that runs a text extractor over files without letting one file fail a task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

#: what: endpoint, definition, registration, import, include, view, router, mount, reject ...; the other columns by kind.
FACT = "repo string, rel_path string, pos int, what string, name string, method string, route string, owner string, target string, kind string, start_line int, end_line int, detail string"
COLUMNS = [c.split()[0] for c in FACT.split(", ")]
NUMBERS = ("pos", "start_line", "end_line")
ENDPOINT = ["repo", "rel_path", "pos", "kind", "name", "method", "route", "start_line", "end_line"]
#: Rows that go back to Spark at once.
BLOCK = 4096


def fact(what: str, **more) -> dict:
    return dict.fromkeys(COLUMNS) | {"what": what} | more


def packed(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int32() if c in NUMBERS else pa.string()) for c in COLUMNS], COLUMNS)


_TYPES = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
#: Characters and list entries that go back to Spark at once.
HEAVY = 1 << 20


def streamed(df: DataFrame, make, kind: str) -> DataFrame:
    """The rows, of type ``kind``, that ``make`` yields for the values of each row of df; a task holds one row of df, and a block of what is made."""
    schema = pa.schema([(name, _TYPES[t]) for name, t in (c.split() for c in kind.split(", "))])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(parts):
        rows, weight = [], 0
        for p in parts:
            for n in range(p.num_rows):
                for r in make(*(c[n].as_py() for c in p.columns)):
                    rows.append(r)
                    weight += sum(len(x) for x in r if isinstance(x, (str, list)))
                    if len(rows) >= BLOCK or weight >= HEAVY:
                        yield batch(rows)
                        rows, weight = [], 0
        if rows:
            yield batch(rows)

    return df.mapInArrow(run, kind)


def extracted(files: DataFrame, extract, also: str | None = None) -> DataFrame:
    """facts of each file: ``extract(text, rel_path)`` yields ``fact`` rows, given column ``also`` too if named; an error becomes a reject row.

    A task holds the packed facts of one file, and those of small files up to a block.
    """

    def run(parts):
        for p in parts:
            rows = []
            for n in range(p.num_rows):
                repo, path, text, *more = (c[n].as_py() for c in p.columns)
                full, own = [], []
                try:
                    for k, r in enumerate(extract(text or "", path, *more)):
                        own.append(r | {"repo": repo, "rel_path": path, "pos": k})
                        if len(own) == BLOCK:
                            full.append(packed(own))
                            own = []
                except Exception as e:  # one broken file is a row, not a failed task
                    full, own = [], [fact("reject", detail=f"{type(e).__name__}: {e}"[:200]) | {"repo": repo, "rel_path": path, "pos": 0}]
                yield from full
                rows += own
                if len(rows) >= BLOCK:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    return files.select("repo", "rel_path", "text", *([also] if also else [])).mapInArrow(run, FACT)
