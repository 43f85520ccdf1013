"""Token budgets: the longest fitting prefix of a group, and greedy packing into batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .closure import settled

# The prompt budget and what one batch may hold.
BUDGET, RESERVE, MAX_ITEMS, HANDLER_TOKENS, SEPARATOR = 6000, 64, 10, 2000, 2
EFFECTIVE = BUDGET - RESERVE


def fit_context(df: DataFrame, group: str, order: str, cost: str, budget: int = EFFECTIVE) -> DataFrame:
    """Per group: rows kept from the front until the first that does not fit (each costs two more), tokens used, rows dropped.

    A fitting prefix has at most budget / 2 rows, so only that many of a group
    (chosen before the shuffle) are ever ordered; the rest is counted.
    """
    w = Window.partitionBy(group).orderBy(order)
    # A cost is at least 0, so each row takes at least the separator.
    front = df.select(group, order, cost).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= budget // SEPARATOR + 1)
    used = front.withColumn("_used", F.sum(F.col(cost) + SEPARATOR).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = used.where(F.col("_used") <= budget).groupBy(group).agg(F.count("*").alias("kept"), F.max("_used").alias("used_tokens"))
    total = df.groupBy(group).agg(F.count("*").alias("_all"))
    return total.join(kept, group, "left").select(group, F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), (F.col("_all") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def within(df: DataFrame, by: list[str], order: str, size: str, max_rows: int, max_bytes: int) -> DataFrame:
    """Rows of each group until ``max_rows`` rows or ``max_bytes`` are taken; the one that passes the bytes is the last.

    Only key, order and size are sorted, cut to ``max_rows`` before the shuffle; wide columns are joined back to what is left.
    """
    w = Window.partitionBy(*by).orderBy(order)
    front = df.select(*by, order, size).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_rows)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = front.withColumn("_b", before).where(F.col("_b") < max_bytes).select(*by, order)
    return df.join(kept, [*by, order], "left_semi")


def _walk(costs: list[int], count: int, used: int, max_items: int, budget: int) -> tuple[list[int], int, int]:
    """Batch number of each row (0: the batch open before them), then items and tokens of the batch left open."""
    number, out = 0, []
    for c in costs:
        if count and (count >= max_items or used + c > budget):
            number, count, used = number + 1, 0, 0
        count, used = count + 1, used + c
        out.append(number)
    return out, count, used


def _pieces(parts):
    """(block, group, costs, orders) of each group in each block, from sorted rows (b, g, o, c) in batches of any size."""
    held = None
    for p in parts:
        for (b, g), q in p.groupby(["b", "g"], sort=False, dropna=False):
            key = (int(b), None if pd.isna(g) else g)
            if held is not None and held[0] != key:
                yield *held[0], held[1], held[2]
                held = None
            if held is None:
                held = (key, [], [])
            held[1].extend(q["c"].tolist())
            held[2].extend(q["o"].tolist())
    if held is not None:
        yield *held[0], held[1], held[2]


def pack_batches(df: DataFrame, group: str, order: str, cost: str, max_items: int = MAX_ITEMS, budget: int = EFFECTIVE, rows_per_block: int = 200_000) -> DataFrame:
    """Greedy batches in order within each group: group, batch (from 0), n_docs, tokens, first (the batch's first order value).

    A batch closes when it holds ``max_items`` rows or the next would pass the
    budget; a row above the budget is a batch of its own; null costs count as 0.
    Groups may be of any size: rows are range-partitioned into blocks of about
    ``rows_per_block`` rows, whose numbers are written down once. Only the first
    group of a block can have begun in an earlier one. A batch open at the
    block's start then holds one of the few runs of up to ``max_items`` rows
    before it, and that group is walked once from each. The driver links these
    walks (at most ``max_items`` + 3 numbers a block), then all blocks emit
    their batches.
    """
    spark = df.sparkSession
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("c"))
    n = max(1, -(-rows.count() // rows_per_block))
    if n > 1:
        rows = settled(rows.repartitionByRange(n, "g", "o").withColumn("b", F.spark_partition_id()))
    else:
        rows = rows.withColumn("b", F.lit(0))
    blocks = rows.repartition(n, "b").sortWithinPartitions("b", "g", "o", "c")

    def border(parts):
        """Of each block: number, first and last group, whether they are one, and the last ``max_items`` costs."""
        now = None
        for b, g, costs, _ in _pieces(parts):
            if now is not None and now[0] != b:
                yield pd.DataFrame([now], columns=["b", "first", "last", "tail"])
                now = None
            now = [b, g, g, costs[-max_items:]] if now is None else [b, now[1], g, costs[-max_items:]]
        if now is not None:
            yield pd.DataFrame([now], columns=["b", "first", "last", "tail"])

    heads: dict[int, list[int]] = {}  # the costs before a block that belong to its first group
    state: dict[int, tuple[int, int]] = {}  # batches of that group begun before the block, and items of the open one
    if n > 1:
        edge = sorted(blocks.mapInPandas(border, "b int, first string, last string, tail array<long>").collect(), key=lambda r: r.b)
        for k, r in enumerate(edge[1:], 1):
            if edge[k - 1]["last"] == r["first"]:
                whole = edge[k - 1]["first"] == edge[k - 1]["last"]  # the block before may hold the end of a yet earlier one
                heads[r.b] = ((heads.get(edge[k - 1].b, []) if whole else []) + list(edge[k - 1].tail))[-max_items:]

        def exits(parts):
            """Of the first and the last group of each block: batches begun and items left open, from each state of the first."""
            seen, last = None, None
            for b, g, costs, _ in _pieces(parts):
                if seen != b:
                    if last is not None:
                        yield pd.DataFrame([last], columns=["b", "j", "begun", "open"])
                    seen, last, head = b, None, heads.get(b, [])
                    out = []
                    for j in range(len(head) + 1):
                        number, count, _ = _walk(costs, j, sum(head[len(head) - j :]), max_items, budget)
                        out.append((b, j, number[-1] + (j == 0), count))
                    yield pd.DataFrame(out, columns=["b", "j", "begun", "open"])
                else:
                    number, count, _ = _walk(costs, 0, 0, max_items, budget)
                    last = (b, -1, number[-1] + 1, count)
            if last is not None:
                yield pd.DataFrame([last], columns=["b", "j", "begun", "open"])

        step = {(r.b, r.j): (r.begun, r.open) for r in blocks.mapInPandas(exits, "b int, j int, begun long, open int").collect()}
        before, left = 0, 0
        for r in edge:
            before, left = (before, left) if r.b in heads else (0, 0)
            state[r.b] = (before, left)
            begun, open_ = step[(r.b, left)]
            before, left = (before + begun, open_) if r["first"] == r["last"] else step[(r.b, -1)]

    def emit(parts):
        """Rows of batches; a batch that crosses blocks is summed afterwards."""
        seen = None
        for b, g, costs, orders in _pieces(parts):
            begun, j = state.get(b, (0, 0)) if seen != b else (0, 0)
            seen, head = b, heads.get(b, [])
            number, _, _ = _walk(costs, j, sum(head[len(head) - j :]) if j else 0, max_items, budget)
            base = begun - 1 if j else begun
            d = pd.DataFrame({"batch": [base + k for k in number], "n": 1, "c": costs, "first": orders})
            yield d.groupby("batch", as_index=False).agg({"n": "sum", "c": "sum", "first": "first"}).assign(g=g)[["g", "batch", "n", "c", "first"]]

    kind = f"g string, batch long, n long, c long, first {df.schema[order].dataType.simpleString()}"
    parts = blocks.mapInPandas(emit, kind)
    return parts.groupBy("g", "batch").agg(F.sum("n").alias("n_docs"), F.sum("c").alias("tokens"), F.min("first").alias("first")).withColumnRenamed("g", group)
