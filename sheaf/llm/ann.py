"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue a query, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import batch, written

#: Trees, distinct vectors that they are fitted on at most (expected number), vectors that set the search effort, and the recall aimed at.
TREES, SAMPLE, TRIED, RECALL = 16, 20_000, 64, 0.96
#: Results that a task holds before it gives them out.
HELD = 1_000_000


def packed_vectors(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """(id, vector) -> (vec_id, v): ``width`` components as floats of a kind, zeros after the last; null, empty, zero and non-finite vectors take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or not v or any(x is None for x in v):
                    continue
                a = np.zeros(width, kind)
                a[: len(v)] = v
                a += 0.0  # one zero for both signs
                if np.isfinite(a).all() and a.any():
                    out.append((i, a.tobytes()))
            yield batch(pa.schema([("vec_id", pa.int64()), ("v", pa.binary())]), *(zip(*out, strict=True) if out else [[]] * 2))

    return rows.mapInArrow(run, "vec_id long, v binary")


def vectors(packed: list[bytes], kind: str) -> np.ndarray:
    """Packed vectors of one width as rows of doubles."""
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(float) if packed else np.zeros((0, 0))


class Forest:
    """Complete binary trees: each node halves the sample at the median along the direction of a random pair."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 5):
        rng, self.depth = np.random.default_rng(seed), depth
        self.way = np.zeros((trees, 2**depth - 1, sample.shape[1]))
        self.at = np.zeros((trees, 2**depth - 1))
        for t in range(trees):
            parts = {0: np.arange(len(sample))}
            for k in range(2**depth - 1):
                own = parts.pop(k)
                if len(own) > 1:
                    pairs = sample[rng.choice(own, (8, 2))]
                    ways = pairs[:, 0] - pairs[:, 1]
                    ways /= np.maximum(np.linalg.norm(ways, axis=1, keepdims=True), 1e-12)
                    along = sample[own[:2000]] @ ways.T
                    self.way[t, k] = ways[along.var(axis=0).argmax()]
                    p = sample[own] @ self.way[t, k]
                    self.at[t, k] = np.median(p)
                    right = p >= self.at[t, k]
                else:
                    right = np.zeros(len(own), bool)
                parts[2 * k + 1], parts[2 * k + 2] = own[~right], own[right]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(vectors, trees): the cell of each vector in each tree."""
        out = np.zeros((len(x), len(self.way)), np.int64)
        for t in range(len(self.way)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = (x * self.way[t, node]).sum(axis=1) >= self.at[t, node]
                node = 2 * node + 1 + right
            out[:, t] = t << 32 | node
        return out

    def visits(self, x: np.ndarray, most: int) -> list[int]:
        """The first ``most`` cells over all trees, by the largest distance to a boundary crossed on the way."""
        side = self.way @ x - self.at
        inner = 2**self.depth - 1
        queue, out = [(0.0, t, 0) for t in range(len(self.way))], []
        while queue and len(out) < most:
            far, t, node = heapq.heappop(queue)
            while node < inner:
                s = side[t, node]
                right = s >= 0
                heapq.heappush(queue, (max(far, abs(s)), t, 2 * node + 1 + (not right)))
                node = 2 * node + 1 + bool(right)
            out.append(t << 32 | node)
        return out


def nearest_in(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of x to q: (ids, distances), ties to the smaller id."""
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
    best = some[np.lexsort((ids[some], d[some]))[:k]]
    return ids[best], d[best]


def top_rows(held: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    n = [len(v[0]) for v in held.values()]
    cat = lambda c, t: np.concatenate([v[c] for v in held.values()]) if held else np.zeros(0, t)
    return batch(schema, np.repeat(np.array(list(held), np.int64), n), cat(0, np.int64), cat(1, np.float64))


def merge(held: dict, q: int, ids: np.ndarray, d: np.ndarray, k: int) -> None:
    if q in held:
        ids, d = np.concatenate([held[q][0], ids]), np.concatenate([held[q][1], d])
        near = np.argsort(d, kind="stable")
        ids, one = np.unique(ids[near], return_index=True)  # of an id's vectors the nearest
        d = d[near][one]
        best = np.lexsort((ids, d))[:k]
        ids, d = ids[best], d[best]
    held[q] = (ids, d)


def scan(queries: list[tuple[int, bytes]], k: int, kind: str):
    """Brute force of a bounded list of queries: rows (vec_id, v) -> the k nearest of each in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            ids, x = b.column(0).to_numpy(), vectors(b.column(1).to_pylist(), kind)
            for q, v in queries if len(ids) else ():
                merge(held, q, *nearest_in(x, ids, vectors([v], kind)[0], k), k)
        yield top_rows(held)

    return run


def searched(k: int, kind: str):
    """Rows (cell, qid, vec_id, v) in order of the cell, its queries (without vec_id) first -> nearest vectors of each query.

    A task holds the queries of one cell, one batch of rows, and up to HELD results: each query's k nearest so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, asked = {}, None, []
        for b in batches:
            cells, n = b.column(0).to_numpy(), b.num_rows
            cut = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), n] if n else [0]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if cells[lo] != now:
                    now, asked = cells[lo], []
                own = b.slice(lo, hi - lo)
                new = own.column(1).drop_null().to_pylist()
                x = vectors(own.column(3).to_pylist(), kind)
                asked += zip(new, x[: len(new)], strict=True)
                ids, x = own.column(2).drop_null().to_numpy(), x[len(new) :]
                while len(ids):  # each id once a turn
                    _, once = np.unique(ids, return_index=True)
                    for q, v in asked:
                        merge(held, q, *nearest_in(x[once], ids[once], v, k), k)
                    ids, x = np.delete(ids, once), np.delete(x, once, axis=0)
            if len(held) * k > HELD:
                yield top_rows(held)
                held = {}
        yield top_rows(held)

    return run


def first(rows: DataFrame, by: str, k: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def neighbours(rows: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): the k nearest found of each row with vec_id % every = 0.

    Equal vectors are one vector in the index: of its ids only the k + 1 smallest can be answers, so no
    others are searched; equal queries are searched once. Trees are fitted on about SAMPLE distinct
    vectors and every vector is put into a leaf of every tree. The number of leaves that a query visits
    is the least at which TRIED vectors, compared with all rows, find RECALL of their true neighbours.
    A vector shorter than the longest counts as one with zeros after its last component. A vec_id with one vector
    in several rows counts once; with several vectors it is a candidate, or a query, with each of them: a candidate's
    distance is that of its nearest, and a query's results are those of all its vectors together. Ties go to the
    smaller vec_id. Fewer than k others: all of them. Empty table: no rows.
    """
    spark, none = rows.sparkSession, "query_id long, rank int, vec_id long, score double"
    kind = "<f4" if rows.schema["embedding"].dataType.jsonValue()["elementType"] == "float" else "<f8"
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    if width is None or width < 1:
        return spark.createDataFrame([], none)
    every_row = written(packed_vectors(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), kind, width))
    # smallest ids of each vector, in two steps so that a very common vector is not one task
    some = every_row.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    inner = Window.partitionBy("v", "salt").orderBy("vec_id")
    some = some.withColumn("r", F.row_number().over(inner)).where(F.col("r") <= k + 1).select("vec_id", "v").distinct()
    held = written(first(some, "v", k + 1, "vec_id").select("vec_id", "v", "rank"))
    one = held.where("rank = 1")
    n = one.count()
    if not n:
        return spark.createDataFrame([], none)
    draw = F.pmod(F.xxhash64("v", F.lit("trees")), F.lit(1_000_000)) < int(min(1.0, SAMPLE / n) * 1_000_000)
    sample = vectors([bytes(r.v) for r in one.where(draw).orderBy("v").limit(2 * SAMPLE).collect() or [one.orderBy("v").first()]], kind)
    # about as many leaves as a leaf has vectors, and at least 8 of the sample in each
    depth = max(0, min(round(np.log2(n) / 2), int(np.log2(max(1, len(sample) / 8)))))
    forest = Forest(sample, depth)
    tried = [(r.vec_id, bytes(r.v)) for r in one.orderBy(F.xxhash64("v", F.lit("tried")), "vec_id").limit(TRIED).collect()]
    true = first(one.select("vec_id", "v").mapInArrow(scan(tried, k + 1, kind), "qid long, vec_id long, score double"), "qid", k + 1, "score", "vec_id")
    true = true.where("qid <> vec_id").join(one.select("vec_id", "v"), "vec_id").select("qid", "v").collect()  # TRIED * (k + 1) rows
    place = {q: {c: i for i, c in enumerate(forest.visits(vectors([v], kind)[0], 1 << 30))} for q, v in tried}
    need = sorted(min(place[r.qid][c] for c in forest.leaves(vectors([bytes(r.v)], kind))[0].tolist()) + 1 for r in true)
    most = need[min(len(need) - 1, int(RECALL * len(need)))] if need else 1

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int64()), ("qid", pa.int64()), ("vec_id", pa.int64()), ("v", pa.binary())])
        for b in batches:
            leaf = forest.leaves(vectors(b.column(1).to_pylist(), kind)) if b.num_rows else np.zeros((0, 0), np.int64)
            for t in range(leaf.shape[1]):
                yield batch(schema, leaf[:, t], pa.nulls(b.num_rows, pa.int64()), b.column(0), b.column(1))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int64()), ("qid", pa.int64()), ("vec_id", pa.int64()), ("v", pa.binary())])
        for b in batches:
            for q, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cells = forest.visits(vectors([v], kind)[0], most)
                yield batch(schema, cells, [q] * len(cells), pa.nulls(len(cells), pa.int64()), [v] * len(cells))

    ddl = "cell long, qid long, vec_id long, v binary"
    queries = every_row.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    each = queries.select("v").distinct().withColumn("qid", F.xxhash64("v"))
    rows_of = held.select("vec_id", "v").mapInArrow(indexed, ddl)
    cells = rows_of.unionByName(each.select("qid", "v").mapInArrow(asked, ddl)).repartition("cell").sortWithinPartitions("cell", F.col("vec_id").isNotNull())
    found = cells.mapInArrow(searched(k + 1, kind), "qid long, vec_id long, score double")
    found = found.groupBy("qid", "vec_id").agg(F.min("score").alias("score"))
    found = first(found, "qid", k + 1, "score", "vec_id").drop("rank")
    named = queries.join(each, "v").select(F.col("vec_id").alias("query_id"), "qid")
    out = named.join(found, "qid").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return first(out, "query_id", k, "score", "vec_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
