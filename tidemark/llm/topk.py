"""Exact top-k inner products of integer-coded vectors.

All vectors are put in order of descending length, over all partitions, and packed into blocks of `block` rows of one
dimension. They are rotated by the right singular vectors of the whole table, so that the first coordinates carry most
of every inner product. Queries first meet the block of the longest vectors, which gives each a k-th score to begin with.
Then they go, in rounds of at most `round_bytes`, to all tasks; a task goes down its blocks by length and keeps each
query's k-th score from block to block. It passes over a block, or the rest of one, for the queries whose |q||x| can't
reach that score, bounds the rest by the partial inner product over the first coordinates plus the Cauchy-Schwarz bound
|q'||x'| of what is left over, and computes exact integer products for the survivors only. Bounds carry a margin for
rounding, and a vector is passed over only if its bound is below the k-th score, so ties stay.

Vectors are shuffled once, by length; queries are not. A task hands on at most k rows of each query, none below its first
k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.folders import scratch

BLOCK = 8192
ROUND_BYTES = 64 << 20
HEAD_BYTES = 64 << 20
LARGEST = 1 << 62  # codes beyond are held at it
I64 = np.iinfo(np.int64)


def integer_coded(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; null for a vector that is null or holds nulls or non-finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    x = v.cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = lambda c: F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return F.when(fine, F.transform(x, lambda c: F.floor(held(c)).cast("long")))


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """dim, longest, ids and codes as bytes: blocks of at most `size` rows, each partition's rows in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = -1

        def out():
            ids, codes = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for i in range(0, len(ids), size):
                part = codes[i : i + size]
                longest = float(_lengths(part).max(initial=0.0))
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([longest]), pa.array([ids[i : i + size].tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary())], ["dim", "longest", "ids", "codes"])

        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            edges = np.flatnonzero(np.concatenate([[True], sizes[1:] != sizes[:-1], [True]])) if len(sizes) else []
            for a, b in zip(edges, edges[1:]):
                dim = int(sizes[a])
                if dim != now or sum(len(x[0]) for x in held) >= size:
                    if held:
                        yield from out()
                    now = dim
                held.append((ids[a:b], flat[ends[a] - dim : ends[b - 1]].reshape(b - a, dim)))
        if held:
            yield from out()

    return rows.select("id", "codes").mapInArrow(run, "dim long, longest double, ids binary, codes binary")


def _lengths(codes: np.ndarray) -> np.ndarray:
    return np.sqrt((codes.astype(float) ** 2).sum(1))


def _unpacked(dim: int, ids: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(codes, np.int64).reshape(len(ids), dim)


def _rotations(blocks: DataFrame) -> dict[int, np.ndarray]:
    """Right singular vectors of all vectors of each dimension, from dim x dim sums of products of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if dim:
                    x = np.frombuffer(codes, np.int64).reshape(-1, dim).astype(float)
                    sums[dim] = sums.get(dim, 0) + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.ravel() for s in sums.values()], pa.list_(pa.float64()))], ["dim", "sums"])

    parts = blocks.select("dim", "codes").mapInArrow(run, "dim long, sums array<double>")
    cells = parts.select("dim", F.posexplode("sums")).groupBy("dim", "pos").agg(F.sum("col").alias("v"))
    gram: dict[int, np.ndarray] = {}
    for r in cells.collect():  # dim x dim numbers for each dimension
        gram.setdefault(r["dim"], np.zeros(r["dim"] ** 2))[r["pos"]] = r["v"]
    return {d: np.linalg.eigh(g.reshape(d, d))[1][:, ::-1] for d, g in gram.items()}


class Search:
    """The k best so far of each query of one dimension: ties to smaller ids, a query's own id left out. `floor`: a score
    that each query is known to reach k times."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, rotation: np.ndarray | None, k: int, floor: np.ndarray | None = None) -> None:
        self.ids, self.q, self.rotation, self.k = ids, codes, rotation, k
        self.head = max(1, codes.shape[1] // 4)
        self.rotated = self._turn(codes)
        self.length = _lengths(codes)
        self.rest = np.sqrt((self.rotated[:, self.head :] ** 2).sum(1))
        self.best = np.full((len(ids), k), I64.min)
        self.best_id = np.full((len(ids), k), I64.max)
        self.floor = np.full(len(ids), I64.min) if floor is None else floor

    def _turn(self, codes: np.ndarray) -> np.ndarray:
        x = codes.astype(float)
        return x if self.rotation is None else x @ self.rotation

    def _kth(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.best[rows, -1], self.floor[rows])

    def alive(self, longest: float) -> np.ndarray:
        """Queries that a vector of this length may concern."""
        kth = np.maximum(self.best[:, -1], self.floor).astype(float)
        return np.flatnonzero(self.length * longest * (1 + 1e-9) + 1 >= kth)

    def products(self, rows: np.ndarray, x: np.ndarray, cols: np.ndarray, longest: float) -> np.ndarray:
        """Exact inner products, those beyond 64 bits held at the largest or smallest number."""
        if self.length[rows].max(initial=0) * longest < 2.0**62:
            return np.einsum("ij,ij->i", self.q[rows], x[cols])
        exact = [sum(int(a) * int(b) for a, b in zip(self.q[r], x[c])) for r, c in zip(rows, cols)]
        return np.array([min(max(s, I64.min + 1), I64.max) for s in exact], np.int64)

    def take(self, x_ids: np.ndarray, x: np.ndarray, step: int = 512) -> None:
        """A block of vectors."""
        length = _lengths(x)
        order = np.lexsort((x_ids, -length))
        x, x_ids, length = x[order], x_ids[order], length[order]
        if not len(x) or not len(alive := self.alive(length[0])):
            return
        turned = self._turn(x)
        x_rest = np.sqrt((turned[:, self.head :] ** 2).sum(1))
        for i in range(0, len(x), step):
            kth = self._kth(alive).astype(float)
            alive = alive[self.length[alive] * length[i] * (1 + 1e-9) + 1 >= kth]
            if not len(alive):
                break
            part = slice(i, i + step)
            kth = self._kth(alive)
            bound = self.rotated[alive, : self.head] @ turned[part, : self.head].T + np.outer(self.rest[alive], x_rest[part])
            slack = 1 + 1e-9 * np.outer(self.length[alive], length[part])
            rows, cols = np.nonzero(bound + slack >= kth[:, None].astype(float))
            keep = self.ids[alive[rows]] != x_ids[i + cols]
            rows, cols = alive[rows[keep]], i + cols[keep]
            if not len(rows):
                continue
            if len(rows) * 4 > len(alive) * min(step, len(x) - i) and self.length.max(initial=0) * length[0] < 2.0**52:
                scores = np.rint(self.q[alive].astype(float) @ x[part].astype(float).T)
                scores = scores[np.searchsorted(alive, rows), cols - i].astype(np.int64)
            else:
                scores = self.products(rows, x, cols, length[i])
            fine = scores >= self._kth(rows)
            rows, cols, scores = rows[fine], cols[fine], scores[fine]
            touched = np.unique(rows)
            all_rows = np.concatenate([np.repeat(touched, self.k), rows])
            all_scores = np.concatenate([self.best[touched].ravel(), scores])
            all_ids = np.concatenate([self.best_id[touched].ravel(), x_ids[cols]])
            o = np.lexsort((all_ids, ~all_scores, all_rows))
            rank = np.arange(len(o)) - np.searchsorted(all_rows[o], all_rows[o])
            o = o[rank < self.k]
            self.best[touched] = all_scores[o].reshape(-1, self.k)
            self.best_id[touched] = all_ids[o].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query places, ids, scores)."""
        rows, cols = np.nonzero(self.best > I64.min)
        return rows, self.best_id[rows, cols], self.best[rows, cols]


def _first_scores(queries: DataFrame, blocks: DataFrame, rotations, k: int, head_bytes: int) -> DataFrame:
    """Query blocks with the k-th score of each query among the longest vectors of its dimension. Only the longest block of
    each dimension goes to all tasks, of as many dimensions as `head_bytes` hold; queries of others begin without a score."""
    heads, size = {}, 0
    longest = blocks.groupBy("dim").agg(F.max_by(F.struct("ids", "codes"), "longest").alias("x"), F.count("*").alias("n"))
    for r in longest.orderBy(F.desc("n"), "dim").toLocalIterator():
        size += len(r["x"]["codes"]) + len(r["x"]["ids"])
        if size > head_bytes:
            break
        heads[r["dim"]] = bytes(r["x"]["ids"]), bytes(r["x"]["codes"])
    heads = blocks.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, ids, codes in zip(*(c.to_pylist() for c in batch.columns)):
                q_ids, q = _unpacked(dim, ids, codes)
                search = Search(q_ids, q, rotations.value.get(dim), k)
                if dim in heads.value:
                    search.take(*_unpacked(dim, *heads.value[dim]))
                yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([ids], pa.binary()), pa.array([codes], pa.binary()), pa.array([search.best[:, -1].tobytes()], pa.binary())], ["dim", "ids", "codes", "floor"])

    return queries.mapInArrow(run, "dim long, ids binary, codes binary, floor binary")


def top_k(
    vectors: DataFrame, queries: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = BLOCK,
    round_bytes: int = ROUND_BYTES, head_bytes: int = HEAD_BYTES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row that the condition `queries` (on the column of ids) holds for,
    the k largest inner products with rows of another id and the same dimension.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Repeated ids: each
    row is a candidate of its own; of rows of one query id, each vector is answered once, by itself. Ties go to the
    smaller id. Codes beyond 2^62 and scores beyond 64 bits are held at these. An empty table gives no rows; other columns
    are ignored whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integer_coded(vector_col, scale).alias("codes"), queries.alias("_query")).where("id is not null and codes is not null")
    length = F.aggregate("codes", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("dim"), F.desc("length"), F.col("id")]
    placed = rows.withColumns({"dim": F.size("codes"), "length": length}).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    x = _pack(placed, block).checkpoint()
    context = spark.sparkContext
    rotations = context.broadcast(_rotations(x))
    asked = _pack(rows.where("_query").select("id", "codes").distinct(), 1024)
    seeded = _first_scores(asked, x, rotations, k, head_bytes).withColumn("part", F.xxhash64("ids")).checkpoint()
    size = seeded.agg(F.sum(F.length("codes") + 2 * F.length("ids"))).first()[0] or 0
    rounds = max(1, -(-size // round_bytes))
    folder = scratch(spark, "top-k")
    schema = "query_id long, row int, vec_id long, score long"
    for i in range(rounds):
        given: dict[int, list] = {}
        for r in seeded.where(F.pmod("part", F.lit(rounds)) == i).collect():  # round_bytes of queries
            given.setdefault(r["dim"], []).append((*_unpacked(r["dim"], bytes(r["ids"]), bytes(r["codes"])), np.frombuffer(bytes(r["floor"]), np.int64)))
        sent = context.broadcast({d: tuple(map(np.concatenate, zip(*v))) for d, v in given.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searches: dict[int, Search] = {}
            for batch in batches:
                for dim, longest, ids, codes in zip(*(c.to_pylist() for c in batch.columns)):
                    if dim not in searches and dim in sent.value:
                        ids_, q, floor = sent.value[dim]
                        searches[dim] = Search(ids_, q, rotations.value.get(dim), k, floor)
                    if dim in searches and len(searches[dim].alive(longest)):
                        searches[dim].take(*_unpacked(dim, ids, codes))
            for s in searches.values():
                at, best, score = s.found()
                yield pa.RecordBatch.from_arrays([pa.array(s.ids[at]), pa.array(at, pa.int32()), pa.array(best), pa.array(score)], ["query_id", "row", "vec_id", "score"])

        w = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
        found = x.mapInArrow(run, schema).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        found.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(folder)
