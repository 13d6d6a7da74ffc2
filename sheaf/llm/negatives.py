"""Hard negatives by exact inner products: an STR-packed R-tree, interval bounds, one best-first queue an anchor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import batch, partitions, written

#: Rows of a leaf page, of a tile that is cut into pages at once, pages under one upper box, and pages that a task searches at once.
PAGE, TILE, FAN, AT_ONCE = 64, 4096, 16, 512
#: Anchors that are searched in step, pages that an anchor takes in its first round (eight times as many in each round after it), and scores that are put in at once.
TOGETHER, HEAD, PENDING = 256, 4, 200_000
#: Bytes of anchors that go out with a pass.
BLOCK = 8 << 20
#: Components are whole numbers of 1 / SCALE.
SCALE = 256


def scaled(rows: DataFrame, width: int) -> DataFrame:
    """(vec_id, label, embedding) -> (vec_id, label, v, c0, c1): floor(256 x) as 32-bit numbers, zeros after the last.

    Rows with a null, vectors that are null, empty or hold a null or non-finite component, and vectors
    whose products might not fit a long, are left out.
    """
    most = min(2.0**31 - 1, np.sqrt(2.0**62 / width))
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("c0", pa.int64()), ("c1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, label, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i is None or label is None or not v or any(x is None for x in v):
                    continue
                a = np.zeros(width)
                a[: len(v)] = np.floor(SCALE * np.array(v, float))
                if np.isfinite(a).all() and (abs(a) < most).all():
                    out.append((i, label, a.astype("<i4").tobytes(), int(a[0]), int(a[1 % width])))
            yield batch(schema, *(zip(*out, strict=True) if out else [[]] * 5))

    return rows.mapInArrow(run, "vec_id long, label long, v binary, c0 long, c1 long")


def matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), -1)


def tiled(x: np.ndarray, first: int = 2) -> Iterator[np.ndarray]:
    """Sort-tile-recursive: slabs along one coordinate, each cut into pages along the next; yields row numbers."""
    one, two = first % x.shape[1], (first + 1) % x.shape[1]
    slabs = int(np.ceil(np.sqrt(np.ceil(len(x) / PAGE))))
    for slab in np.array_split(np.argsort(x[:, one], kind="stable"), slabs):
        slab = slab[np.argsort(x[slab, two], kind="stable")]
        yield from (slab[s : s + PAGE] for s in range(0, len(slab), PAGE))


PAGES = "label long, low binary, high binary, ids binary, rows binary"


def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, v) in order of label and a coordinate -> pages with their minimum bounding boxes. A task holds a tile."""
    schema = pa.schema([("label", pa.int64()), *((n, pa.binary()) for n in ("low", "high", "ids", "rows"))])

    def pages(label: int, ids: list, v: list) -> pa.RecordBatch:
        x, ids, out = matrix(v), np.array(ids, np.int64), []
        for own in tiled(x):
            out.append((label, x[own].min(0).tobytes(), x[own].max(0).tobytes(), ids[own].tobytes(), x[own].tobytes()))
        return batch(schema, *zip(*out, strict=True))

    now, ids, held = None, [], []
    for b in batches:
        for i, label, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and (label != now or len(held) == TILE):
                yield pages(now, ids, held)
                ids, held = [], []
            now = label
            ids.append(i)
            held.append(v)
    if held:
        yield pages(now, ids, held)


def tree(rows: DataFrame) -> DataFrame:
    """scaled() rows -> the leaf pages, as a written table.

    Slabs are ranges of (label, first coordinate), found by Spark's own sampling, so their number follows the
    partitions and a hot label is many slabs; a slab is read in order of the second coordinate and cut into tiles.
    """
    spark = rows.sparkSession
    slabs = rows.repartitionByRange(partitions(spark), "label", "c0", "c1", F.xxhash64("vec_id", "v"))
    return written(slabs.sortWithinPartitions("label", "c1", "vec_id").select("vec_id", "label", "v").mapInArrow(leaves, PAGES))


class Anchors:
    """A block of anchors: vectors, labels, ids, and per anchor the windows of scores that are asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.labels, self.x, self.low, self.high = ids, labels, x, low, high


class Best:
    """The k best (score, id) of each anchor and window so far; higher scores first, ties to the smaller id."""

    def __init__(self, anchors: int, windows: int, k: int):
        self.ids, self.scores, self.n = np.zeros((anchors, windows, k), np.int64), np.zeros((anchors, windows, k), np.int64), np.zeros((anchors, windows), np.int64)
        self.kth = np.full((anchors, windows), -np.inf)

    def held(self, s: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, counted from the first of s, window, id, score) of what some anchors have."""
        a, w, place = np.nonzero(np.arange(self.ids.shape[2]) < self.n[s][..., None])
        return a, w, self.ids[s][a, w, place], self.scores[s][a, w, place]

    def add(self, s: slice, a: np.ndarray, w: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows found for anchors of s (counted from its first) and windows."""
        a, w, ids, scores = (np.concatenate(c) for c in zip(self.held(s), (a, w, ids, scores), strict=True))
        windows, k = self.ids.shape[1:]
        key = a * windows + w
        order = np.lexsort((ids, -scores, key))
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        order, place = order[place < k], place[place < k]
        a, w = a[order], w[order]
        self.ids[s][a, w, place], self.scores[s][a, w, place] = ids[order], scores[order]
        np.maximum.at(self.n[s], (a, w), place + 1)
        full = place == k - 1
        self.kth[s][a[full], w[full]] = scores[order[full]]


def hopes(top: np.ndarray, bottom: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Boxes by their interval of inner products -> the highest score that could still count, -inf where none can.

    A box is out where its interval misses every window, or lies strictly below the kth of every window it meets. Windows are
    the last axis of low, high and kth, which may have those of top and bottom before it.
    """
    out = np.full(top.shape, -np.inf)
    for w in range(low.shape[-1]):
        lo, hi, k = low[..., w], high[..., w], kth[..., w]
        most = np.minimum(top, hi)
        np.maximum(out, np.where((top >= lo) & (bottom <= hi) & (most >= k), most, -np.inf), out=out)
    return out


def search(anchors: Anchors, best: Best, label: np.ndarray, low: np.ndarray, high: np.ndarray, ids: list[np.ndarray], rows: list[np.ndarray], same: bool) -> None:
    """One best-first queue an anchor over the pages under the upper boxes that may count; ``same``: pages of the anchor's label, else of all others.

    TOGETHER anchors go in step: in each round an anchor takes the pages at the head of its queue, more every round, and a
    page is multiplied at once with all the anchors that took it. The queue ends where nothing in it may still count.
    """
    cut = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    start = np.concatenate([np.arange(a, b, FAN) for a, b in zip(cut, [*cut[1:], len(label)], strict=True)])
    under = np.repeat(np.arange(len(start)), np.diff([*start, len(label)]))
    up_low, up_high = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
    # interval ends as doubles: one unit and a share of slack outweigh their rounding
    interval = lambda x, lo, hi: (np.maximum(x, 0) @ hi.T + np.minimum(x, 0) @ lo.T, np.maximum(x, 0) @ lo.T + np.minimum(x, 0) @ hi.T)
    wider = lambda top, bottom: (top + 1 + abs(top) * 1e-12, bottom - 1 - abs(bottom) * 1e-12)
    small = lambda m: float(abs(m).max(initial=1).astype(float)) ** 2 < 2.0**53 / low.shape[1]
    exact = small(low) and small(high)

    def put(s: slice, found: list[tuple[np.ndarray, ...]]) -> int:
        if found:
            a, of, score = (np.concatenate(c) for c in zip(*found, strict=True))
            hit, w = np.nonzero((score[:, None] >= np.maximum(anchors.low[s], best.kth[s])[a]) & (score[:, None] <= anchors.high[s][a]))
            best.add(s, a[hit], w, of[hit], score[hit])
            found.clear()
        return 0

    for a in range(0, len(anchors.ids), TOGETHER):
        s = slice(a, a + TOGETHER)
        x = anchors.x[s].astype(float)
        exact_x = exact and small(x)
        lo, hi, kth = anchors.low[s], anchors.high[s], best.kth[s]
        own = (label[start] == anchors.labels[s, None]) == same
        up = own & (hopes(*wider(*interval(x, up_low, up_high)), lo[:, None], hi[:, None], kth[:, None]) > -np.inf)
        top, bottom = wider(*interval(x, low, high))
        left, take = up[:, under], HEAD
        while True:
            hope = np.where(left, hopes(top, bottom, lo[:, None], hi[:, None], kth[:, None]), -np.inf)
            left = hope > -np.inf
            if not left.any():
                break
            now = left
            if take < left.shape[1]:
                now = np.zeros_like(left)
                np.put_along_axis(now, np.argpartition(-hope, take - 1, axis=1)[:, :take], True, axis=1)
                now &= left
            found, waits = [], 0
            least, most = np.where(hi >= lo, np.maximum(lo, kth), np.inf).min(axis=1), np.where(hi >= lo, hi, -np.inf).max(axis=1)
            for n in np.flatnonzero(now.any(axis=0)).tolist():
                at = np.flatnonzero(now[:, n])
                score = (x[at] @ rows[n].T.astype(float)).astype(np.int64) if exact_x else anchors.x[s][at].astype(np.int64) @ rows[n].T.astype(np.int64)
                i, j = np.nonzero((score >= least[at, None]) & (score <= most[at, None]) & (anchors.ids[s][at, None] != ids[n]))
                found.append((at[i], ids[n][j], score[i, j]))
                waits += len(i)
                if waits > PENDING:
                    waits = put(s, found)
            put(s, found)
            left, take = left & ~now, take * 8


def searching(shared, k: int, same: bool):
    """Pages -> (a, w, vec_id, score): the task's k best of each anchor and window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held = Anchors(*shared.value), []  # plain arrays travel, as executors have no copy of this package
        best = Best(len(anchors.ids), anchors.low.shape[1], k)

        def turn() -> None:
            label, low, high, ids, rows = zip(*held, strict=True)
            rows = [np.frombuffer(r, "<i4").reshape(len(i) // 8, -1) for r, i in zip(rows, ids, strict=True)]
            search(anchors, best, np.array(label, np.int64), matrix(low), matrix(high), [np.frombuffer(i, np.int64) for i in ids], rows, same)
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                if len(held) == AT_ONCE:
                    turn()
        if held:
            turn()
        schema = pa.schema([("a", pa.int64()), ("w", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.held(slice(None))], schema=schema)

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, low: int = 50, high: int = 95, shift: Column | None = None) -> DataFrame:
    """(vec_id, embedding, label) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows with vec_id % every = 0. An anchor's positives are the first other rows of its label; for each,
    the first rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    Higher scores come first, ties go to the smaller vec_id. ``shift`` is the label to use in place of ``label``.

    Repeated rows count once; a vec_id with several vectors or labels takes part with each of them, and no row is its own
    positive or negative. Of rows with one vector and one label only the smallest ids can be among the first, so no others are
    in the tree (found in salted steps): a hot vector is no hot page. Vectors null, empty, or with a null or
    non-finite component take no part, nor do null labels, nor components so large (about 2^20 for 64 of
    them) that a product might not fit a long. Shorter vectors have zeros after their last component. A zero or
    negative positive score has an empty or a one-score window. Empty table: no rows.

    Anchors go through the tree in blocks of BLOCK bytes, so a task holds a block, AT_ONCE pages and the best so far.
    """
    spark = rows.sparkSession
    none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    if width is None or width < 1:
        return spark.createDataFrame([], none)
    label = F.col("label") if shift is None else shift
    own = written(scaled(rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding"), width))
    some = own.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    for by in (["v", "label", "salt"], ["v", "label"]):
        some = some.dropDuplicates(["vec_id", "label", "v"]).withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("r") <= max(positives, negatives) + 1).drop("r")
    pages = tree(some)
    asked = own.where(F.col("vec_id") % every == 0).select("vec_id", "label", "v").distinct()
    n = asked.count()
    blocks = max(1, -(-n * width * 4 // BLOCK))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)))) if blocks > 1 else asked.withColumn("block", F.lit(0))
    out = None
    ddl = "a long, w long, vec_id long, score long"
    for b in range(blocks if n else 0):
        one = asked.where(F.col("block") == b).orderBy("vec_id", "label", "v").collect()  # BLOCK bytes
        if not one:
            continue
        ids, labels, x = np.array([r.vec_id for r in one], np.int64), np.array([r.label for r in one], np.int64), matrix([bytes(r.v) for r in one])
        wide = np.full((len(ids), 1), np.inf)
        first = spark.sparkContext.broadcast((ids, labels, x, -wide, wide))
        near = ranked(pages.mapInArrow(searching(first, positives, True), ddl), positives).collect()
        # windows in whole numbers; an anchor with fewer positives has empty windows
        lo, hi, of = np.full((len(ids), positives), 1.0), np.full((len(ids), positives), 0.0), []
        for r in near:
            least, most = -(-low * r.score // 100), high * r.score // 100
            of.append((r.a, r.rank - 1, int(ids[r.a]), r.vec_id, r.score))
            lo[r.a, r.rank - 1], hi[r.a, r.rank - 1] = least, most
        second = spark.sparkContext.broadcast((ids, labels, x, lo, hi))
        hard = ranked(pages.mapInArrow(searching(second, negatives, False), ddl), negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        named = spark.createDataFrame(of, "a long, w long, anchor_id long, positive_id long, positive_score long")
        part = hard.join(named, ["a", "w"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
        part = written(part) if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], none) if out is None else out

