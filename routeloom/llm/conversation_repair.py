"""Operator 13: repair of conversation structure.

A conversation is well formed if the initials of its roles spell ``(s?(ua)+)?``.
Its rows are kept (0), given the role user or assistant (2), or deleted (3, and
nothing else for blank rows and repeated messages); empty messages may be put in
anywhere (2), and a truncated row that stays costs 1 more. The repair is the
cheapest such path through the states of the grammar (nothing yet, after the
system's message, after a user's, after an assistant's), of equal ones that with
the least audit, the edits' initials K, R, D, I in order.

Conversations are dealt by hash into batches, and each batch is one recursive
DuckDB query: every recursion takes one more turn of all its conversations and
keeps for each state the minimum of (cost, plan), where the plan is the audit
with the role behind each edit. Two equal costs never have plans of which one
begins the other (it would lack a paid insertion), so what follows does not
change the order and the minimum may be kept at every turn.

A conversation of more than ``piece`` rows is cut. Its rows are sorted by range,
so that any number of tasks share them, and pieces of up to ``piece`` rows are
solved from each of the four states to each: the same query with four starts.
Such tables compose like the rows do, so the same query joins ``FAN`` neighbours
at a time until one is left; the states that its path has between the pieces are
then handed down, and each piece is spelt by itself. No task holds more than a
batch of pieces, but for the audit of a whole conversation, which is one letter
a row by definition.

Order: by turn, nulls first; of equal turns by role and then by the MD5 digest of
the text, whatever order the rows had. Nulls: a null role or text is one space,
a null conversation is one, null turns are no gaps. An empty role has no initial
and cannot be kept. Repeated rows are repeated messages. A row whose ``present``
is false only says that its conversation exists. Other columns are left out. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import forget, table, written

#: Rows of a piece; neighbours joined at a time; bytes of a batch (a row counts ROW more than its text); conversations broadcast as long ones at most.
PIECE, FAN, BATCH, ROW, FEW = 64, 16, 8 << 20, 200, 1_000_000
SPACE = r"\x20\x09-\x0D"
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
INSERTS = {0: [(0, ""), (2, "Iu"), (3, "IuIa")], 1: [(1, ""), (2, "Iu"), (3, "IuIa")], 2: [(2, ""), (3, "Ia")], 3: [(3, ""), (2, "Iu")]}
CLOSING = [(0, 0, ""), (1, 4, "IuIa"), (2, 2, "Ia"), (3, 0, "")]


def _steps() -> list[tuple]:
    """(from, to, edit, initial, cost, plan) of one row, insertions before it included; before a deletion they can wait, and waiting has the lesser audit."""
    out = [(f, f, "D", "", 3, "D.") for f in INSERTS]
    for f, ways in INSERTS.items():
        for mid, put in ways:
            for (state, initial), to in NEXT.items():
                if state == mid:
                    out.append((f, to, "K", initial, len(put), put + "K."))
                    if initial in "ua":
                        out.append((f, to, "R", "", len(put) + 2, f"{put}R{initial}"))
    return out


def _values(rows) -> str:
    return ",".join("(" + ",".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: Edges of each row: e(p, k, f, t, cost, plan) from y(p, k, initial, must, short).
EDGES = f"""CREATE OR REPLACE TEMP TABLE e AS
SELECT y.p, y.k, s.f, s.t, s.cost + CASE WHEN s.op <> 'D' AND y.short THEN 1 ELSE 0 END AS cost, s.plan
FROM y JOIN (VALUES {_values(_steps())}) s(f, t, op, initial, cost, plan)
  ON s.op = 'D' OR (NOT y.must AND (s.op = 'R' OR s.initial = y.initial))"""
#: One more turn of all conversations at each recursion. The path has the state after each turn.
WALK = """CREATE OR REPLACE TEMP TABLE w AS
WITH RECURSIVE d AS (
  SELECT DISTINCT p, 0::BIGINT AS k, f, f AS s, 0::BIGINT AS cost, '' AS plan, '' AS path FROM e WHERE k = 1 AND f IN ({starts})
  UNION ALL
  SELECT p, k, f, s, best.cost, best.plan, best.path FROM (
    SELECT d.p, d.k + 1 AS k, d.f, e.t AS s, min(struct_pack(cost := d.cost + e.cost, plan := d.plan || e.plan, path := d.path || e.t)) AS best
    FROM d JOIN e ON e.p = d.p AND e.k = d.k + 1 AND e.f = d.s GROUP BY d.p, d.k, d.f, e.t))
SELECT d.p, d.f, d.s AS t, d.cost, d.plan, d.path FROM d JOIN (SELECT p, max(k) AS k FROM e GROUP BY p) n ON n.p = d.p AND n.k = d.k"""
#: What plans g(p, plan) make of y(p, k, role, text): messages m(p, messages).
SPELL = """CREATE OR REPLACE TEMP TABLE m AS
WITH a AS (SELECT p, unnest(regexp_extract_all(plan, '..')) AS event, generate_subscripts(regexp_extract_all(plan, '..'), 1) AS i FROM g),
b AS (SELECT *, sum(CASE WHEN event[1] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY p ORDER BY i) AS k FROM a)
SELECT b.p, list(struct_pack(role := CASE event[2] WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' ELSE y.role END, text := CASE event[1] WHEN 'I' THEN '' ELSE y.text END) ORDER BY i) AS messages
FROM b LEFT JOIN y ON y.p = b.p AND y.k = b.k WHERE event[1] <> 'D' GROUP BY b.p"""
AUDIT = "regexp_replace(g.plan, '(.).', '\\1', 'g')"
COUNTS = "count_if(blank)::BIGINT AS blank, count_if(again AND NOT blank)::BIGINT AS duplicate, count_if(short)::BIGINT AS truncated, count_if(coalesce(before || initial NOT IN ('su', 'ua', 'au'), FALSE))::BIGINT AS illegal"

MESSAGES = "array<struct<role string, text string>>"
SHORT = f"conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, messages {MESSAGES}"
SPELT = f"conv_id long, part long, seg long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, messages {MESSAGES}"
TRANSFER = "conv_id long, part long, seg long, f int, t int, cost long, plan string, path string"


@lru_cache(1)
def _duck():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})


def _query(tables: dict[str, pa.Table], *statements: str) -> pa.Table:
    con = _duck()
    for name, rows in tables.items():
        con.register(name, rows)
    for statement in statements[:-1]:
        con.execute(statement)
    out = con.sql(statements[-1]).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return out


def _whole(rows: pa.Table) -> pa.Table:
    """Conversations that lie in the batch as a whole."""
    return _query(
        {"r": rows},
        "CREATE OR REPLACE TEMP TABLE x AS SELECT *, dense_rank() OVER (ORDER BY conv_id) AS p FROM r",
        "CREATE OR REPLACE TEMP TABLE z AS SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY p ORDER BY turn NULLS FIRST, role, digest) AS k FROM x WHERE present",
        """CREATE OR REPLACE TEMP TABLE y AS SELECT *, blank OR again AS must, cut AND NOT blank AND NOT again AS short FROM (
             SELECT *, k > min(k) OVER (PARTITION BY p, role, text) AS again, lag(initial) OVER (PARTITION BY p ORDER BY k) AS before FROM z)""",
        EDGES,
        WALK.format(starts="0"),
        f"""CREATE OR REPLACE TEMP TABLE g AS SELECT p, best.cost, best.plan FROM (
             SELECT w.p, min(struct_pack(cost := w.cost + c.cost, plan := w.plan || c.plan)) AS best FROM w JOIN (VALUES {_values(CLOSING)}) c(t, cost, plan) ON c.t = w.t GROUP BY w.p)""",
        SPELL,
        f"""SELECT c.conv_id, coalesce(v.gaps, 0)::BIGINT AS gaps, coalesce(v.blank, 0)::BIGINT AS blank, coalesce(v.duplicate, 0)::BIGINT AS duplicate, coalesce(v.truncated, 0)::BIGINT AS truncated,
             coalesce(v.illegal, 0)::BIGINT AS illegal, coalesce(g.cost, 0)::BIGINT AS cost, coalesce({AUDIT}, '') AS audit, coalesce(m.messages, []) AS messages
           FROM (SELECT DISTINCT p, conv_id FROM x) c LEFT JOIN (SELECT p, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, {COUNTS} FROM y GROUP BY p) v USING (p) LEFT JOIN g USING (p) LEFT JOIN m USING (p)""",
    )


def _first_level(rows: pa.Table) -> pa.Table:
    """Pieces (conv_id, part, seg) of rows k, from every state to every state."""
    return _query(
        {"r": rows},
        "CREATE OR REPLACE TEMP TABLE y AS SELECT *, dense_rank() OVER (ORDER BY conv_id, part, seg) AS p FROM r",
        EDGES,
        WALK.format(starts="0, 1, 2, 3"),
        "SELECT c.conv_id, c.part, c.seg, w.f, w.t, w.cost, w.plan, w.path FROM w JOIN (SELECT DISTINCT p, conv_id, part, seg FROM y) c USING (p)",
    )


def _next_level(rows: pa.Table) -> pa.Table:
    """Neighbours under the same (up_part, up_seg) become one."""
    return _query(
        {"r": rows},
        "CREATE OR REPLACE TEMP TABLE y AS SELECT *, dense_rank() OVER (ORDER BY conv_id, up_part, up_seg) AS p FROM r",
        "CREATE OR REPLACE TEMP TABLE e AS SELECT p, dense_rank() OVER (PARTITION BY p ORDER BY part, seg) AS k, f, t, cost, plan FROM y",
        WALK.format(starts="0, 1, 2, 3"),
        "SELECT c.conv_id, c.part, c.seg, w.f, w.t, w.cost, w.plan, w.path FROM w JOIN (SELECT DISTINCT p, conv_id, up_part AS part, up_seg AS seg FROM y) c USING (p)",
    )


def _spelt(key, rows: pa.Table, chosen: pa.Table) -> pa.Table:
    """The rows of pieces and the plan chosen for each piece."""
    return _query(
        {"r": rows, "q": chosen},
        "CREATE OR REPLACE TEMP TABLE g AS SELECT *, row_number() OVER () AS p FROM q",
        "CREATE OR REPLACE TEMP TABLE y AS SELECT r.*, g.p FROM r JOIN g ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.part = g.part AND r.seg = g.seg",
        SPELL,
        f"""SELECT g.conv_id, g.part, g.seg, g.gaps, v.blank, v.duplicate, v.truncated, v.illegal, g.cost, {AUDIT} AS audit, coalesce(m.messages, []) AS messages
           FROM g JOIN (SELECT p, {COUNTS} FROM y GROUP BY p) v USING (p) LEFT JOIN m USING (p)""",
    )


def _numbered(piece: int):
    def run(batches):
        """Sorted rows with part (the task), seg and k (the place in pieces of the conversation), nth (in the part) and the initial before them."""
        part, conv, seg, k, nth, before = TaskContext.get().partitionId(), object(), 0, 0, 0, None
        for b in batches:
            segs, ks, nths, befores = [], [], [], []
            for c, i in zip(b.column("conv_id").to_pylist(), b.column("initial").to_pylist()):
                if c != conv:
                    conv, seg, k, before = c, 0, 0, None
                elif k == piece:
                    seg, k = seg + 1, 0
                k += 1
                segs.append(seg), ks.append(k), nths.append(nth), befores.append(before)
                nth, before = nth + 1, i
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(b), pa.int64()), pa.array(segs, pa.int64()), pa.array(ks, pa.int64()), pa.array(nths, pa.int64()), pa.array(befores, pa.string())], names=[*b.schema.names, "part", "seg", "k", "nth", "before"])

    return run


def _batch(count: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(max(1, count))).alias("batch")


def _placed(rows: DataFrame, piece: int) -> DataFrame:
    """Rows of long conversations in order, in pieces, with their faults."""
    order = ["conv_id", "turn", "role", "digest"]
    dealt = rows.withColumn("initial", F.substring("role", 1, 1)).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = dealt.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order), "salt").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order)).drop("salt")
    numbered = written(ranged.mapInArrow(_numbered(piece), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in ranged.schema)}, part long, seg long, k long, nth long, before string"), "numbered")
    # The first row of a part follows the last one of the part before: a row for each task.
    ends = numbered.groupBy("part").agg(F.max_by(F.struct("conv_id", "initial"), "nth").alias("end")).collect()
    ends = sorted((r.part, r.end) for r in ends)
    borders = [(after, end.conv_id, end.initial) for (_, end), (after, _) in zip(ends, ends[1:])]
    spark = rows.sparkSession
    borders = spark.createDataFrame(borders, "part long, border long, border_initial string")
    joined = numbered.join(F.broadcast(borders), "part", "left")
    joined = joined.withColumn("before", F.when((F.col("nth") == 0) & F.col("border").eqNullSafe(F.col("conv_id")), F.col("border_initial")).otherwise(F.col("before"))).drop("border", "border_initial", "nth")
    # The earliest of equal messages stays; a message that is repeated is added up before it is dealt.
    place = F.struct("part", "seg", "k")
    firsts = written(numbered.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("o"), F.col("digest").alias("d")).agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"), "firsts")
    out = joined.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("o")) & (F.col("digest") == F.col("d")), "left")
    again = F.coalesce(F.col("first") < place, F.lit(False))
    out = out.withColumn("again", again).withColumn("must", F.col("blank") | F.col("again")).withColumn("short", F.col("cut") & ~F.col("must"))
    placed = written(out.drop("c", "o", "d", "first", "cut", "digest", "present"), "placed")
    forget(numbered)
    forget(firsts)
    return placed


def _long(rows: DataFrame, piece: int, fan: int, batches: int) -> DataFrame:
    placed = _placed(rows, piece)
    key = ["conv_id", "part", "seg"]
    narrow = placed.select(*key, "k", "initial", "must", "short")
    level = written(narrow.groupBy(_batch(batches, *key)).applyInArrow(_first_level, TRANSFER), "level")
    levels, steps = [level], []
    while True:
        parts, segs = level.agg(F.max("part"), F.max("seg")).first()
        if not parts and not segs:
            break
        up = (F.col("part"), F.floor(F.col("seg") / fan)) if segs else (F.floor(F.col("part") / fan), F.lit(0))
        steps.append(bool(segs))
        rows_up = level.drop("path").withColumn("up_part", up[0].cast("long")).withColumn("up_seg", up[1].cast("long"))
        level = written(rows_up.groupBy(_batch(batches, "conv_id", "up_part", "up_seg")).applyInArrow(_next_level, TRANSFER), "level")
        levels.append(level)
    # The cheapest way to an end, then the states between the pieces, level by level downwards.
    spark = rows.sparkSession
    closing = spark.createDataFrame(CLOSING, "end int, more long, tail string")
    gaps = placed.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")).select(F.col("conv_id").alias("c"), F.coalesce("gaps", F.lit(0)).alias("gaps"))
    ends = level.where("f = 0").join(F.broadcast(closing), F.col("t") == F.col("end"))
    best = ends.groupBy("conv_id").agg(F.min_by(F.struct("t", "path", "tail", "more"), F.struct(F.col("cost") + F.col("more"), F.concat("plan", "tail"))).alias("x"))
    chosen = best.join(gaps, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("seg"), F.lit(0).alias("f"), "x.t", "x.path", "x.tail", "x.more", "gaps")
    for below, by_seg in zip(reversed(levels[:-1]), reversed(steps)):
        chosen = written(chosen, "chosen")
        up = (F.col("part"), F.floor(F.col("seg") / fan)) if by_seg else (F.floor(F.col("part") / fan), F.lit(0))
        children = below.select(*key).distinct().withColumn("up_part", up[0].cast("long")).withColumn("up_seg", up[1].cast("long"))
        nth = F.row_number().over(Window.partitionBy("conv_id", "up_part", "up_seg").orderBy("part", "seg"))  # at most ``fan`` under one
        above = chosen.select(F.col("conv_id").alias("c"), F.col("part").alias("up_part"), F.col("seg").alias("up_seg"), F.col("f").alias("from"), "path", "tail", "more", "gaps")
        found = children.withColumn("nth", nth).join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (children.up_part == above.up_part) & (children.up_seg == above.up_seg))
        last = F.col("nth") == F.length("path")
        states = found.select(
            *key,
            F.when(F.col("nth") == 1, F.col("from")).otherwise(F.substring("path", F.col("nth") - 1, F.lit(1)).cast("int")).alias("f"),
            F.substring("path", F.col("nth"), F.lit(1)).cast("int").alias("t"),
            F.when(last, F.col("tail")).otherwise("").alias("tail"),
            F.when(last, F.col("more")).otherwise(0).alias("more"),
            F.when(F.col("nth") == 1, F.col("gaps")).otherwise(0).alias("gaps"),
        )
        paths = below.select(*(F.col(c).alias(f"_{c}") for c in (*key, "f", "t")), "path")
        same = F.col("conv_id").eqNullSafe(F.col("_conv_id"))
        for c in ("part", "seg", "f", "t"):
            same = same & (F.col(c) == F.col(f"_{c}"))
        chosen = states.join(paths, same).select(*key, "f", "t", "path", "tail", "more", "gaps")
    chosen = written(chosen.drop("path"), "chosen")
    plans = levels[0].select(*(F.col(c).alias(f"_{c}") for c in (*key, "f", "t")), "cost", "plan")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id"))
    for c in ("part", "seg", "f", "t"):
        same = same & (F.col(c) == F.col(f"_{c}"))
    spelt = chosen.join(plans, same).select(*key, "gaps", (F.col("cost") + F.col("more")).alias("cost"), F.concat("plan", "tail").alias("plan"))
    wide = placed.select(*key, "k", "role", "text", "initial", "before", "blank", "again", "short")
    return wide.groupBy(_batch(batches, *key)).cogroup(spelt.groupBy(_batch(batches, *key))).applyInArrow(_spelt, SPELT)


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present, with blank, cut (no end mark) and the text's digest."""
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in rows.columns else F.lit(True)
    plain = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present"))
    return plain.withColumn("blank", ~F.col("text").rlike(f"[^{SPACE}]")).withColumn("cut", ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).withColumn("digest", F.md5(F.col("text").cast("binary")))


def repair(rows: DataFrame, piece: int = PIECE, fan: int = FAN, batch: int = BATCH) -> tuple[DataFrame, DataFrame | None]:
    """rows (conv_id, turn, role, text, present if some rows only name their conversation) -> whole conversations, and pieces of the long ones (None without any).

    Both have conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    messages (array of role, text), pieces also part and seg, their order. The
    numbers of a conversation's pieces add up; audits and messages follow one
    another.
    """
    known = faults(rows)
    sizes = written(known.groupBy("conv_id").agg(F.count_if("present").alias("n"), F.sum(F.octet_length("text") + ROW).alias("bytes")), "sizes")
    total, long_ones = sizes.agg(F.sum("bytes"), F.count_if(F.col("n") > piece)).first()
    batches = -(-(total or 0) // batch)
    if not long_ones:
        return known.groupBy(_batch(batches, "conv_id")).applyInArrow(_whole, SHORT), None
    ids = sizes.where(F.col("n") > piece).select(F.col("conv_id").alias("c"))
    ids = F.broadcast(ids) if long_ones <= FEW else ids
    is_long = F.col("conv_id").eqNullSafe(F.col("c"))
    whole = known.join(ids, is_long, "left_anti").groupBy(_batch(batches, "conv_id")).applyInArrow(_whole, SHORT)
    return whole, _long(known.join(ids, is_long, "left_semi").where("present"), piece, fan, batches)


def messages(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The repaired conversations: conv_id, part, seg and place, in whose order they stand, role, text."""
    whole, pieces = repair(rows, piece)
    out = whole.select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("seg"), "messages")
    if pieces is not None:
        out = out.unionByName(pieces.select("conv_id", "part", "seg", "messages"))
    return out.select("conv_id", "part", "seg", F.posexplode("messages").alias("place", "m")).select("conv_id", "part", "seg", "place", "m.role", "m.text")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _chained(batches):
    """Sorted pieces -> a report for each conversation; texts are hashed as they pass."""
    now, seen = None, False

    def report():
        return pa.RecordBatch.from_pylist([{"conv_id": now["conv_id"], **{c: now[c] for c in NUMBERS}, "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in NUMBERS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    for b in batches:
        for k in range(len(b)):
            conv = b.column("conv_id")[k].as_py()
            if not seen or now["conv_id"] != conv:
                if seen:
                    yield report()
                now, seen = {"conv_id": conv, "audit": [], "hash": hashlib.sha256(), "any": False, **dict.fromkeys(NUMBERS, 0)}, True
            for c in NUMBERS:
                now[c] += b.column(c)[k].as_py()
            now["audit"].append(b.column("audit")[k].as_py())
            text = b.column("body")[k].as_py()
            if b.column("n")[k].as_py():
                now["hash"].update((("\n" if now["any"] else "") + text).encode())
                now["any"] = True
    if seen:
        yield report()


def reports(whole: DataFrame, pieces: DataFrame | None) -> DataFrame:
    """One row a conversation, with the digest of its repaired text: lines ``role:text``."""
    body = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.text)), "\n")
    columns = ["conv_id", *NUMBERS, "audit"]
    out = whole.select(*columns, F.sha2(body.cast("binary"), 256).alias("repaired_sha256"))
    if pieces is None:
        return out
    # A digest is sequential: the texts of one conversation pass through one task, a piece at a time.
    order = ["conv_id", "part", "seg"]
    long = pieces.select(*order, *NUMBERS, "audit", body.alias("body"), F.size("messages").alias("n")).repartition("conv_id").sortWithinPartitions(*order)
    return out.unionByName(long.mapInArrow(_chained, REPORT))


def damage(rows: DataFrame) -> DataFrame:
    """rows with the faults that the contract puts in, by CRC-32 of ``conv_id:turn`` modulo 20; dropped rows stay with present false."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = out.withColumn("text", body).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).withColumn("present", F.col("kind") != 0)
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy", "kind")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(*repair(damage(table(spark, sf_dir, "conversations"))))


#: The whole table at once: CRC-32 by its table, a row of the recursion for each conversation, turn and state, messages spelt from the cheapest plan.
ORACLE = rf"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i)),
r AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS p, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
d AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM r, crc),
x AS (SELECT p, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
z AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY p ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k, regexp_extract_all(text, '[^{SPACE}]') AS ink FROM x),
v AS (SELECT *, len(ink) = 0 AS blank, len(ink) > 0 AND k > min(k) OVER (PARTITION BY p, role, text) AS again, lag(initial) OVER (PARTITION BY p ORDER BY k) AS before FROM z),
y AS (SELECT *, blank OR again AS must, NOT blank AND NOT again AND ink[-1] NOT IN ('.', '!', '?') AS short FROM v),
e AS (SELECT y.p, y.k, s.f, s.t, s.cost + CASE WHEN s.op <> 'D' AND y.short THEN 1 ELSE 0 END AS cost, s.plan
      FROM y JOIN (VALUES {_values(_steps())}) s(f, t, op, initial, cost, plan) ON s.op = 'D' OR (NOT y.must AND (s.op = 'R' OR s.initial = y.initial))),
w AS (SELECT DISTINCT p, 0::BIGINT AS k, 0 AS s, 0::BIGINT AS cost, '' AS plan FROM y
      UNION ALL SELECT p, k, s, best.cost, best.plan FROM (SELECT w.p, w.k + 1 AS k, e.t AS s, min(struct_pack(cost := w.cost + e.cost, plan := w.plan || e.plan)) AS best FROM w JOIN e ON e.p = w.p AND e.k = w.k + 1 AND e.f = w.s GROUP BY w.p, w.k, e.t)),
g AS (SELECT p, best.cost AS cost, best.plan AS plan FROM (SELECT w.p, min(struct_pack(cost := w.cost + c.cost, plan := w.plan || c.plan)) AS best FROM w JOIN (SELECT p, max(k) AS k FROM y GROUP BY p) n ON n.p = w.p AND n.k = w.k JOIN (VALUES {_values(CLOSING)}) c(t, cost, plan) ON c.t = w.s GROUP BY w.p)),
a AS (SELECT p, unnest(regexp_extract_all(plan, '..')) AS event, generate_subscripts(regexp_extract_all(plan, '..'), 1) AS i FROM g),
b AS (SELECT *, sum(CASE WHEN event[1] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY p ORDER BY i) AS k FROM a),
m AS (SELECT b.p, string_agg(CASE event[2] WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' ELSE y.role END || ':' || CASE event[1] WHEN 'I' THEN '' ELSE y.text END, chr(10) ORDER BY i) AS body FROM b LEFT JOIN y ON y.p = b.p AND y.k = b.k WHERE event[1] <> 'D' GROUP BY b.p),
n AS (SELECT p, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, {COUNTS} FROM y GROUP BY p)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(g.cost, 0)::BIGINT AS cost, coalesce(regexp_replace(g.plan, '(.).', '\1', 'g'), '') AS audit, sha256(coalesce(m.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT p, conv_id FROM r) c LEFT JOIN n ON n.p = c.p LEFT JOIN g ON g.p = c.p LEFT JOIN m ON m.p = c.p
"""
