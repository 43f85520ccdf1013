"""Conversation repair against plain Python: every way of editing small ones, a table of states for longer ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from routeloom.llm import conversation_repair as cr
from routeloom.llm.shared import table

SPACE = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, cost string, present boolean, part int"


def damaged(rows):
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        yield from [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)


def flagged(rows):
    seen, out = set(), []
    for r, x in rows:
        body = x.strip(SPACE)
        fault = "b" if not body else "d" if (r, x) in seen else "t" if body[-1] not in ".!?" else ""
        seen.add((r, x))
        out.append((r, x, fault))
    return out


def cheapest(rows):
    """The least (cost, audit, messages) by a table over what has been said; inserted pairs never pay."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def put(at, state, way):
        if state not in at or way[:2] < at[state][:2]:
            at[state] = way

    def inserted(at):
        for _ in range(3):
            for s, (c, a, m) in list(at.items()):
                for i in after[s].replace("s", ""):
                    put(at, i, (c + 2, a + "I", (*m, (name[i], ""))))
        return at

    for r, x, fault in rows:
        new = {}
        for s, (c, a, m) in inserted(best).items():
            put(new, s, (c + 3, a + "D", m))
            if fault not in ("b", "d"):
                more = fault == "t"
                if r[:1] and r[0] in after[s]:
                    put(new, r[0], (c + more, a + "K", (*m, (r, x))))
                for i in after[s].replace("s", ""):
                    put(new, i, (c + 2 + more, a + "R", (*m, (name[i], x))))
        best = new
    return min(v for s, v in inserted(best).items() if s in ("", "a"))


def every_way(rows):
    """(cost, audit) of the best of all edits with up to two insertions in each place."""
    puts = ["", "u", "a", "ua", "au"]
    found = []
    for gaps in itertools.product(puts, repeat=len(rows) + 1):
        for edits in itertools.product(["K", "Ru", "Ra", "D"], repeat=len(rows)):
            if any(f in ("b", "d") and e != "D" for (_, _, f), e in zip(rows, edits)):
                continue
            said, audit, cost = gaps[0], "I" * len(gaps[0]), 2 * sum(map(len, gaps))
            for (r, _, f), e, g in zip(rows, edits, gaps[1:]):
                said += "" if e == "D" else (r[:1] or "?") if e == "K" else e[1]
                audit += e[0] + "I" * len(g)
                said += g
                cost += {"K": 0, "R": 2, "D": 3}[e[0]] + (f == "t" and e != "D")
            if re.fullmatch("(s?(ua)+)?", said):
                found.append((cost, audit))
    return min(found)


def expected(rows, ids):
    out = {}
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        turns = {r[1] for r in mine if r[1] is not None}
        marks = flagged([(r[2], r[3]) for r in mine])
        cost, audit, said = cheapest(marks)
        initials = [r[:1] for r, _, _ in marks]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f == x for _, _, f in marks) for x in "bdt"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest())
    return out


def as_dict(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(cr.op13(spark, sf)) == expected(list(damaged(rows)), {r[0] for r in rows})


def test_table_of_states_is_every_way():
    r = random.Random(3)
    for _ in range(60):
        rows = [(r.choice(["user", "assistant", "system", "tool", ""]), "x", r.choice(["", "", "b", "t"])) for _ in range(r.randint(0, 3))]
        assert cheapest(rows)[:2] == every_way(rows)


def awkward():
    r = random.Random(5)
    rows = [(1, None, "user", "null turn."), (1, None, None, None), (1, 4, "", "no role."), (2, 7, "user", ""), (2, 7, "user", ""), (3, 0, "user", "same."), (3, 0, "user", "same."), (3, 1, "assistant", "A."), (3, 2, "user", "same."), (None, 1, "user", "no conversation."), (None, 2, "assistant", "x"), (4, 0, "system", "only."), (6, 5, "user", "long " * 50_000 + ".")]
    for conv, n in ((10, 40), (11, 90), (12, 7)):
        rows += [(conv, r.randrange(n) if r.random() < 0.9 else None, r.choice(["user", "assistant", "assistant", "user", "system", "t"]), r.choice(["Yes.", "No", " ", f"text {r.random()}.", f"open {k}"])) for k in range(n)]
    rows += [(13, None, "user", "all the same.")] * 50  # nothing but repeated rows
    return rows


@pytest.mark.parametrize("piece, fan", [(64, 16), (2, 4)])
def test_pieces(spark, piece, fan):
    rows = awkward()
    df = spark.createDataFrame([(*x, "c", True, 1) for x in rows] + [(99, 1, "user", "gone.", "c", False, 1)], SCHEMA).repartition(7)
    whole, pieces = cr.repair(df, piece, fan, batch=3000)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = expected(plain, {r[0] for r in rows} | {99})
    assert as_dict(cr.reports(whole, pieces)) == want
    assert want[99] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_messages_and_empty(spark):
    df = spark.createDataFrame([(1, k, "user", f"m{k}.") for k in range(5)], "conv_id long, turn long, role string, text string")
    got = [(r.role, r.text) for r in cr.messages(df, piece=2).orderBy("conv_id", "part", "seg", "place").collect()]
    assert got == list(cheapest(flagged([("user", f"m{k}.") for k in range(5)]))[2])
    none = cr.reports(*cr.repair(df.limit(0)))
    assert none.count() == 0


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got = cr.op13(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({cr.ORACLE})").fetchall())
