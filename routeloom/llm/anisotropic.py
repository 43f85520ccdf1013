"""Operator 8: approximate nearest neighbours by score-aware quantisation.

Nearest by Euclidean distance is largest by q.x - |x|^2 / 2. The inner product is
estimated from product codes of four bits for every two dimensions, chosen to
minimise |r|^2 + (eta - 1) (r.x)^2 / |x|^2, r the residual: errors along x, which
move its score, weigh eta times as much. The norms stay exact. Tables of a
query's products with all code words, eight-bit entries for pairs of codes,
are scanned over all codes. The best ``rerank`` rows of every block of rows are
compared exactly, in double precision on the original vectors; so is every other
row that may still belong to the nearest. With x' the decoded vector,
|q - x| >= |q - x'| - |x - x'|, and the tables give |q - x'| up to the rounding of
their entries; a row whose bound exceeds the query's current last distance is
left out, nothing else is. So the result is that of comparing all rows, however
dense they lie; dense groups cost comparisons, not neighbours.

Tables of more than ``cell_rows`` rows are divided into cells of about that many
by coarse centroids (at most 4096). A query visits the cells of its nearest
centroids, as many as it takes for ``recall`` of the neighbours of a part of the
sample, measured when the cells are fitted; inside a cell nothing is lost. So the
work grows with queries times visited rows, not times all rows. Cells are cut to
segments, so a dense group is many tasks. The queries of each cell lie in a file
of the shared folder, which the tasks of that cell map.

Code book and centroids are fitted on at most about ``fit_rows`` vectors (taken
by hash); every vector is encoded, and every cell can be visited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kneser_ney import mapped, save
from .shared import scratch, table, written

FIT_ROWS, NEAREST, RERANK, ROWS, THRESHOLD, ROUNDS = 16_384, 10, 64, 8192, 0.2, 4
CELL_ROWS, MOST_CELLS, SEGMENT, RECALL = 131_072, 4096, 262_144, 0.98


class CodeBook:
    """Code words (subspaces, 16, 2) for vectors of ``size`` dimensions (padded to a multiple of four)."""

    def __init__(self, sample: np.ndarray, threshold: float = THRESHOLD, rounds: int = ROUNDS, seed: int = 5):
        self.size = sample.shape[1]
        self.eta = max(1.0, (self.size - 1) * threshold**2 / (1 - threshold**2))
        x = self._pad(sample.astype(np.float32))
        n, d = x.shape
        m = d // 2
        rng = np.random.default_rng(seed)
        parts = x.reshape(n, m, 2)
        self.words = np.stack([parts[rng.choice(n, 16, replace=n < 16), k] for k in range(m)]).astype(np.float32)
        for _ in range(12):  # plain k-means of each subspace first
            codes = self._nearest(parts)
            for k in range(m):
                count = np.bincount(codes[:, k], minlength=16)
                full = count > 0
                for j in range(2):
                    self.words[k, full, j] = np.bincount(codes[:, k], parts[:, k, j], 16)[full] / count[full]
        weight = (self.eta - 1) / np.maximum((x * x).sum(1), 1e-12)
        for _ in range(rounds):  # codes by coordinate descent, then code words by weighted least squares
            codes = self.encode(sample)
            a, rhs = np.zeros((m * 32, m * 32)), np.zeros(m * 32)
            for s in range(0, n, 4096):
                part, c = x[s : s + 4096], codes[s : s + 4096]
                z = np.zeros((len(part), m, 16, 2), np.float32)
                z[np.arange(len(part))[:, None], np.arange(m)[None, :], c] = part.reshape(-1, m, 2)
                z = z.reshape(len(part), -1)
                a += (z * weight[s : s + 4096, None]).T @ z
                rhs += self.eta * z.sum(0)
            count = np.stack([np.bincount(codes[:, k], minlength=16) for k in range(m)]).ravel()
            a[np.arange(m * 32), np.arange(m * 32)] += np.repeat(count, 2) + 1e-3
            rhs += 1e-3 * self.words.ravel()
            self.words = np.linalg.solve(a, rhs).reshape(m, 16, 2).astype(np.float32)

    def _pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % 4)))

    def _nearest(self, parts: np.ndarray) -> np.ndarray:
        return np.stack([((parts[:, k, None, :] - self.words[k][None]) ** 2).sum(2).argmin(1) for k in range(parts.shape[1])], 1)

    def encode(self, vectors: np.ndarray, passes: int = 2) -> np.ndarray:
        """(n, subspaces) codes: nearest first, then coordinate descent on the anisotropic loss."""
        x = self._pad(vectors.astype(np.float32))
        parts = x.reshape(len(x), -1, 2)
        codes = self._nearest(parts)
        weight = (self.eta - 1) / np.maximum((x * x).sum(1), 1e-12)
        m = parts.shape[1]
        along = np.stack([((parts[:, k] - self.words[k][codes[:, k]]) * parts[:, k]).sum(1) for k in range(m)], 1)
        total = along.sum(1)
        for _ in range(passes):
            for k in range(m):
                r = parts[:, k, None, :] - self.words[k][None]
                mine = (r * parts[:, k, None, :]).sum(2)
                others = (total - along[:, k])[:, None]
                codes[:, k] = ((r * r).sum(2) + weight[:, None] * (others + mine) ** 2).argmin(1)
                new = mine[np.arange(len(x)), codes[:, k]]
                total += new - along[:, k]
                along[:, k] = new
        return codes

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes in a byte."""
        return (codes[:, 0::2] | (codes[:, 1::2] << 4)).astype(np.uint8)

    def decode(self, packed: np.ndarray) -> np.ndarray:
        """The (padded) vectors that packed codes stand for."""
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)
        return self.words[np.arange(codes.shape[1])[None, :], codes].reshape(len(packed), -1)

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eight-bit products of queries with pairs of code words (bytes, queries, 256), and each query's scale and offset."""
        q = self._pad(queries.astype(np.float32)).reshape(len(queries), -1, 2)
        t = np.einsum("nmd,mkd->nmk", q, self.words)
        low = t.min(2, keepdims=True)
        scale = np.maximum((t - low).max((1, 2)) / 127.0, 1e-12)
        t = np.rint((t - low) / scale[:, None, None]).astype(np.uint8)
        pairs = t[:, 1::2, :, None] + t[:, 0::2, None, :]  # high code major
        return np.ascontiguousarray(pairs.reshape(len(queries), -1, 256).transpose(1, 0, 2)), scale, low.sum((1, 2))


class Cells:
    """Coarse centroids, and how many of the nearest ones a query visits."""

    def __init__(self, sample: np.ndarray, count: int, nearest: int, recall: float, seed: int = 7):
        x = sample.astype(np.float32)
        rng = np.random.default_rng(seed)
        self.centroids = x[rng.choice(len(x), min(count, len(x)), replace=False)]
        self.visits = 1
        if len(self.centroids) == 1:
            return
        for _ in range(8):
            cell = self.order(x, 1)[:, 0]
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, cell, x)
            n = np.bincount(cell, minlength=len(sums))
            self.centroids[n > 0] = (sums / np.maximum(n, 1)[:, None])[n > 0]
        cell = self.order(x, 1)[:, 0]
        some = rng.choice(len(x), min(len(x), 512), replace=False)
        found = np.zeros(len(self.centroids) + 1)
        for k in range(0, len(some), 64):
            q = some[k : k + 64]
            d = ((x[q] ** 2).sum(1)[:, None] + (x**2).sum(1)[None, :]) - 2 * x[q] @ x.T
            d[np.arange(len(q)), q] = np.inf
            near = np.argpartition(d, min(nearest, len(x) - 1) - 1, axis=1)[:, : min(nearest, len(x) - 1)]
            rank = np.argsort(self.order(x[q], len(self.centroids)), axis=1)
            found[: len(self.centroids)] += np.bincount(rank[np.arange(len(q))[:, None], cell[near]].ravel(), minlength=len(self.centroids))
        share = np.cumsum(found) / max(found.sum(), 1)
        self.visits = min(len(self.centroids), max(2, int(np.searchsorted(share, recall)) + 1))

    def order(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest centroids of each vector, nearest first."""
        out = np.zeros((len(vectors), count), np.int32)
        half = (self.centroids**2).sum(1) / 2
        for s in range(0, len(vectors), 2048):
            d = half[None, :] - vectors[s : s + 2048].astype(np.float32) @ self.centroids.T
            best = np.argpartition(d, count - 1, axis=1)[:, :count] if count < d.shape[1] else np.broadcast_to(np.arange(count), d.shape)
            out[s : s + 2048] = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), axis=1, kind="stable"), 1)
        return out


class _Search:
    """The nearest rows so far of some queries."""

    def __init__(self, book: CodeBook, ids: np.ndarray, vectors: np.ndarray, nearest: int, rerank: int):
        self.book, self.ids, self.vectors, self.nearest, self.rerank = book, ids, vectors, nearest, rerank
        self.d = np.full((len(ids), nearest), np.inf)
        self.i = np.full((len(ids), nearest), np.iinfo(np.int64).max)

    def merge(self, k: int, d: np.ndarray, i: np.ndarray, own: np.ndarray) -> None:
        """Rows i at distances d join the nearest of the queries from k on."""
        to = slice(k, k + len(own))
        d = np.where(i == own[:, None], np.inf, d)
        d = np.concatenate([self.d[to], d], 1)
        i = np.concatenate([self.i[to], np.where(np.isinf(d[:, self.nearest :]), np.iinfo(np.int64).max, i)], 1)
        o = np.lexsort((i, d))[:, : self.nearest]
        self.d[to], self.i[to] = np.take_along_axis(d, o, 1), np.take_along_axis(i, o, 1)

    def add(self, rows: np.ndarray, x: np.ndarray, codes: np.ndarray) -> None:
        """Compare rows (by ascending id) with every query."""
        half = (x * x).sum(1) / 2
        for s in range(0, len(rows), ROWS):
            r, v, c, h = (a[s : s + ROWS] for a in (rows, x, codes, half))
            keep = min(len(r), self.rerank)
            y = self.book.decode(c).astype(np.float64)
            norm, gap = (y * y).sum(1), np.sqrt(((np.pad(v, ((0, 0), (0, y.shape[1] - v.shape[1]))) - y) ** 2).sum(1))
            for k in range(0, len(self.ids), 256):
                q, own = self.vectors[k : k + 256], self.ids[k : k + 256]
                t, scale, low = self.book.tables(q)
                acc = np.zeros((len(q), len(r)), np.uint16)
                for j in range(c.shape[1]):
                    acc += np.take(t[j], c[:, j], axis=1)
                product = acc * scale[:, None] + low[:, None]
                far = h[None, :] - product
                # Ties go to smaller ids: rows are in their order, and so are equal keys of a stable cut.
                if keep < len(r):
                    edge = np.partition(far, keep - 1, axis=1)[:, keep - 1 : keep]
                    rank = np.where(far < edge, -1, np.where(far == edge, np.arange(len(r))[None, :], len(r)))
                    cand = np.argpartition(rank, keep - 1, axis=1)[:, :keep]
                else:
                    cand = np.broadcast_to(np.arange(len(r)), (len(q), len(r)))
                d = np.sqrt(((v[cand] - q[:, None, :]) ** 2).sum(2))
                self.merge(k, d, r[cand], own)
                if keep == len(r):
                    continue
                # Every other row that the bound does not rule out. Roundings: half a step for each table entry,
                # and what single precision in the tables and the sums below may lose.
                qq = (q * q).sum(1)
                length, longest = np.sqrt(qq), np.sqrt(norm)
                lost = y.shape[1] / 4 * scale[:, None] + 1e-5 * (length[:, None] * longest[None, :] + np.abs(low)[:, None] + 255 * c.shape[1] * scale[:, None])
                least = np.sqrt(np.maximum(qq[:, None] + norm[None, :] - 2 * (product + lost), 0)) - gap[None, :]
                last = self.d[k : k + 256, -1]
                may = least <= last[:, None] + 1e-9 * (length[:, None] + np.sqrt(2 * h)[None, :])
                np.put_along_axis(may, cand, False, axis=1)
                at = np.flatnonzero(may.any(0))
                if not len(at):
                    continue
                # Squared distances by one product, whose rounding is allowed for; then the exact ones of what is left.
                x2, h2 = v[at], 2 * h[at]
                sq = qq[:, None] + h2[None, :] - 2 * (q @ x2.T)
                may = may[:, at] & (sq <= last[:, None] ** 2 + 1e-12 * (qq[:, None] + h2[None, :]))
                for n in np.flatnonzero(may.any(1)):
                    near = at[may[n]]
                    self.merge(k + n, np.sqrt(((v[near] - q[n]) ** 2).sum(1))[None, :], r[near][None, :], own[n : n + 1])

    def result(self) -> pa.RecordBatch:
        some = np.isfinite(self.d)
        return pa.record_batch({"query_id": pa.array(np.repeat(self.ids, some.sum(1))), "vec_id": pa.array(self.i[some]), "score": pa.array(self.d[some])})


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """Equally long binary values as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _scan(book: CodeBook, folder: str, size: int, nearest: int, rerank: int):
    """Rows (cell, vec_id, v, code), a cell's rows together, against the queries of their cell."""

    def run(batches):
        now, search = None, None
        for b in batches:
            cells = b.column("cell").to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]]) if len(cells) else []
            for a, z in zip(edge[:-1], edge[1:]):
                if cells[a] != now:
                    if search is not None:
                        yield search.result()
                    now, search = cells[a], None
                    ids = mapped(f"{folder}/ids-{now}", np.int64)
                    if len(ids):
                        search = _Search(book, np.array(ids), np.array(mapped(f"{folder}/vectors-{now}", np.float64)).reshape(-1, size), nearest, rerank)
                if search is not None:
                    part = b.slice(a, z - a)
                    rows = part.column("vec_id").to_numpy()
                    order = np.argsort(rows, kind="stable")
                    search.add(rows[order], _matrix(part.column("v"), np.float64)[order], _matrix(part.column("code"), np.uint8)[order])
        if search is not None:
            yield search.result()

    return run


def _questions(folder: str):
    """Rows (cell, vec_id, v), a cell's rows together, into a file of ids and one of vectors for each cell."""

    def run(batches):
        now, ids, vectors = None, [], []

        def close():
            save(f"{folder}/ids-{now}", np.concatenate(ids))
            save(f"{folder}/vectors-{now}", np.concatenate(vectors))
            return pa.record_batch({"cell": pa.array([now], pa.int32())})

        for b in batches:
            cells = b.column("cell").to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]]) if len(cells) else []
            for a, z in zip(edge[:-1], edge[1:]):
                if now is not None and cells[a] != now:
                    yield close()
                    ids, vectors = [], []
                now = int(cells[a])
                ids.append(b.column("vec_id").slice(a, z - a).to_numpy().copy())
                vectors.append(_matrix(b.column("v").slice(a, z - a), np.float64).copy())
        if now is not None:
            yield close()

    return run


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<double> of vectors that take part: not null, not zero, all components finite, of the commonest length."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null and v is not null").where(ok)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].n if sizes else 0))


def nearest(vectors: DataFrame, queries=lambda i: i % 100 == 0, k: int = NEAREST, rerank: int = RERANK, fit_rows: int = FIT_ROWS, cell_rows: int = CELL_ROWS, recall: float = RECALL, segment: int = SEGMENT) -> DataFrame:
    """embeddings (vec_id, embedding) -> query_id, rank, vec_id, score for the rows whose id ``queries`` selects.

    Each query's k nearest other ids (all, if fewer), ties to smaller ids. An
    empty table, or one without valid vectors, gives no rows. Rows that repeat
    an id are candidates of their own; of repeated query ids one is searched.
    """
    spark = vectors.sparkSession
    kind = "query_id long, vec_id long, score double"
    rows = valid(vectors)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], kind).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    pick = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / n)) + 1
    sample = np.array([r.v for r in rows.where(pick).select("vec_id", "v").orderBy("vec_id").collect()] or [r.v for r in rows.limit(1).collect()])
    book, cells = CodeBook(sample), Cells(sample, max(1, min(MOST_CELLS, len(sample) // 4, n // cell_rows)), k, recall)
    shared = spark.sparkContext.broadcast((book, cells))
    folder, parts = scratch(spark, "queries"), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches):
        book, cells = shared.value
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            codes = np.concatenate([book.pack(book.encode(x[s : s + 4096])) for s in range(0, len(x), 4096)]) if len(x) else np.zeros((0, 1), np.uint8)
            yield pa.record_batch({"cell": pa.array(cells.order(x, 1)[:, 0]), "vec_id": b.column("vec_id"), "v": pa.array([y.tobytes() for y in x], pa.binary()), "code": pa.array([y.tobytes() for y in codes], pa.binary())})

    def visit(batches):
        cells = shared.value[1]
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            to = cells.order(x, cells.visits)
            of = np.repeat(np.arange(len(x)), cells.visits)
            yield pa.record_batch({"cell": pa.array(to.ravel()), "vec_id": b.column("vec_id").take(pa.array(of)), "v": pa.array([x[i].tobytes() for i in of], pa.binary())})

    codes = written(rows.mapInArrow(encode, "cell int, vec_id long, v binary, code binary"), "codes")
    asked = rows.where(queries(F.col("vec_id"))).dropDuplicates(["vec_id"]).mapInArrow(visit, "cell int, vec_id long, v binary")
    asked = asked.repartition(min(parts, len(cells.centroids)), "cell").sortWithinPartitions("cell", "vec_id")
    visited = {r.cell for r in asked.mapInArrow(_questions(folder), "cell int").collect()}
    for c in set(range(len(cells.centroids))) - visited:
        save(f"{folder}/ids-{c}", np.zeros(0, np.int64))
    if len(cells.centroids) > 1:
        # A cell of many rows is several segments, each a task's worth.
        sizes = {r.cell: r.n for r in codes.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        cuts = spark.createDataFrame([(c, -(-m // segment)) for c, m in sizes.items()], "cell int, cuts int")
        held = codes.join(F.broadcast(cuts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("cuts")))
        codes = held.repartition(max(parts, min(100_000, sum(-(-m // segment) for m in sizes.values()))), "cell", "part").sortWithinPartitions("cell", "part").drop("cuts", "part")
    size = sample.shape[1]

    def scan(batches):
        return _scan(shared.value[0], folder, size, k, rerank)(batches)

    found = codes.mapInArrow(scan, kind)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
