"""Embedding near-duplicates: spherical-cap filters from structured random product codes, list-decoded, joined and verified."""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.ann import vectors
from sheaf.llm.common import batch, written
from sheaf.llm.components import connected_components

#: Filters that both vectors of a pair at the threshold are expected to exceed, vectors that a filter is meant to hold, independent codes.
SHARED, HELD, CODES = 11.0, 256, 4
#: Filters of a vector at most, on average.
MOST = 100
#: Vectors of a block: a fuller filter is cut into blocks, and each pair of blocks is a task's group of its own.
BLOCK = 4096
#: Filters that may be known to be full (bounds what is sent out), vectors that dense spots are looked for in, the share of them that makes a spot, and spots at most.
FULL, SAMPLE, SHARE, SPOTS = 1_000_000, 8192, 1 / 256, 256
#: Angles are compared with this slack; cosines nearer to the threshold than NEAR are computed again without rounding in the sums.
SLACK, NEAR = 1e-6, 1e-9


# -- filters -------------------------------------------------------------------------------------


def tail(height: np.ndarray, width: int, cells: int = 4000) -> np.ndarray:
    """The share of the unit sphere in ``width`` dimensions at or above each height along an axis."""
    if width < 2:
        return np.where(height <= -1, 1.0, np.where(height <= 1, 0.5, 0.0))
    angle = (np.arange(cells) + 0.5) * np.pi / cells
    mass = np.sin(angle) ** (width - 2)
    below = np.concatenate([[0], np.cumsum(mass)]) / mass.sum()
    return np.interp(np.arccos(np.clip(height, -1, 1)), np.arange(cells + 1) * np.pi / cells, below)


def height_for(share: float, width: int) -> float:
    """The height of the cap that holds ``share`` of the sphere."""
    low, high = -1.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(np.array(mid), width) > share else (low, mid)
    return low


def met(height: float, cosine: float, width: int, cells: int = 2000) -> float:
    """The share of directions that both vectors of a pair at ``cosine`` exceed by ``height``."""
    if width == 1:
        return float(tail(np.array(height), width))
    if width == 2:
        return max(0.0, (2 * np.arccos(height) - np.arccos(cosine)) / (2 * np.pi))
    angle = (np.arange(cells) + 0.5) * np.pi / cells
    mass, u = np.sin(angle) ** (width - 2), np.cos(angle)
    rest = np.maximum(sqrt(1 - cosine**2) * np.sqrt(1 - u**2), 1e-12)
    return float((mass * (u >= height) * tail((height - cosine * u) / rest, width - 1)).sum() / mass.sum())


class Caps:
    """Filter directions: after a random rotation the coordinates fall into blocks, and a direction takes a code word of each block.

    A vector's filters are those whose direction it exceeds ``height`` along. They are found block by block: a partial
    sum goes on only while the best words of the blocks to come can still lift it to the height, so the work
    follows the filters found, not those that there are.
    """

    def __init__(self, n: int, width: int, cosine: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.height = height_for(min(0.5, HELD / max(1, n)), width)
        while SHARED * float(tail(np.array(self.height), width)) > MOST * met(self.height, cosine, width):
            self.height -= 0.01  # in few dimensions small caps hardly meet: larger ones then, which hold more
        wanted = SHARED / met(self.height, cosine, width) / CODES
        self.blocks = max(1, min(width // 8, max(2, int(np.ceil(np.log(wanted) / np.log(1024))))))
        self.words = max(2, int(np.ceil(wanted ** (1 / self.blocks))))
        cut = np.linspace(0, width, self.blocks + 1).astype(int)
        self.cuts = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        self.turns, self.codes = [], []
        for _ in range(CODES):
            self.turns.append(np.linalg.qr(rng.standard_normal((width, width)))[0])
            words = []
            for a, b in self.cuts:
                w = rng.standard_normal((self.words, b - a))
                words.append((w / np.linalg.norm(w, axis=1, keepdims=True) * sqrt((b - a) / width)).T)
            self.codes.append(words)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors -> (row, filter), every filter that each row exceeds, in order of row and filter."""
        rows, filters = [], []
        for c in range(CODES):
            y = x @ self.turns[c]
            scores = [y[:, a:b] @ w for (a, b), w in zip(self.cuts, self.codes[c], strict=True)]
            order = [np.argsort(-s, axis=1) for s in scores]
            falling = [np.take_along_axis(s, o, axis=1) for s, o in zip(scores, order, strict=True)]
            hope = np.array([f[:, 0] for f in falling])
            hope = np.cumsum(hope[::-1], axis=0)[::-1]  # the best that block k and those after it can add
            row, at, total = np.arange(len(x)), np.full(len(x), c, np.int64), np.zeros(len(x))
            for k in range(self.blocks):
                need = self.height - total - (hope[k + 1][row] if k + 1 < self.blocks else 0)
                n = (falling[k][row] >= need[:, None]).sum(axis=1)
                back = np.repeat(np.arange(len(row)), n)
                nth = np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n)
                row, at, total = row[back], at[back] * self.words + order[k][row[back], nth], total[back] + falling[k][row[back], nth]
            rows.append(row)
            filters.append(at)
        row, at = np.concatenate(rows), np.concatenate(filters)
        both = np.lexsort((at, row))
        return row[both], at[both]


def unit(packed: list[bytes], kind: str) -> np.ndarray:
    x = vectors(packed, kind)
    if not len(x):
        return x
    x = x / abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact(x: bytes, y: bytes, kind: str) -> float:
    a, b = np.frombuffer(x, kind).astype(float), np.frombuffer(y, kind).astype(float)
    a, b = (v / 2.0 ** np.floor(np.log2(abs(v).max())) for v in (a, b))
    return fsum(a * b) / (sqrt(fsum(a * a)) * sqrt(fsum(b * b)))


# -- comparison ----------------------------------------------------------------------------------

#: f: a filter, or -1 - s for dense spot s; cell: which blocks meet; side: of two blocks the second; own: the row's spot; lists: its filters below f.
CELL = "f long, cell long, side int, node long, w long, own int, lists binary, v binary"
CELL_SCHEMA = pa.schema([("f", pa.int64()), ("cell", pa.int64()), ("side", pa.int32()), ("node", pa.int64()), ("w", pa.int64()), ("own", pa.int32()), ("lists", pa.binary()), ("v", pa.binary())])
#: A node's links (n vectors), or a link that joins a and b (n = 0).
FOUND = "a long, b long, n long"
FOUND_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def near(x: np.ndarray, y: np.ndarray, vx: list[bytes], vy: list[bytes], cosine: float, kind: str) -> np.ndarray:
    """Which rows of x and y link."""
    s = x @ y.T
    out = s >= cosine
    for i, j in zip(*np.nonzero(abs(s - cosine) < NEAR), strict=True):
        out[i, j] = exact(vx[i], vy[j], kind) >= cosine
    return out


def unowned(lists: list[np.ndarray], i: int, others: np.ndarray, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of the others share a filter below this one with row i: that filter counts the pair."""
    if not len(lists[i]):
        return np.zeros(len(others), bool)
    size = start[others + 1] - start[others]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[others], size)
    hit = np.isin(flat[at], lists[i])
    return np.bincount(np.repeat(np.arange(len(others)), size), hit, len(others)) > 0


def compared(cosine: float, kind: str):
    """Rows of CELL in order of (f, cell, side) -> FOUND: every link of a cell counted for both ends, and a forest that joins what is linked.

    A cell has one block, all of whose pairs are compared, or two. A filter leaves to the smallest filter that both
    rows exceed to count a pair. In a spot's cell the first block holds those that ask; rows of no spot are counted at both ends, rows of
    another spot at their own, as the others ask in turn.
    """

    def cell(group: list[tuple]) -> pa.RecordBatch | None:
        f, side = group[0][0], np.array([r[2] for r in group])
        node, w, own = (np.array([r[c] for r in group], np.int64) for c in (3, 4, 5))
        v = [r[7] for r in group]
        x = unit(v, kind)
        lists = [np.frombuffer(r[6], np.int64) for r in group]
        start = np.concatenate([[0], np.cumsum([len(y) for y in lists])]).astype(np.int64)
        flat = np.concatenate(lists) if start[-1] else np.zeros(0, np.int64)
        two = bool(side.any())
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if two else left
        many, part, joins = np.zeros(len(group), np.int64), np.arange(len(group)), []
        vr = [v[j] for j in right]
        for s in range(0, len(left), 512):
            rows = left[s : s + 512]
            for i, hit in zip(rows.tolist(), near(x[rows], x[right], [v[i] for i in rows], vr, cosine, kind), strict=True):
                js = right[hit]
                js = js[node[js] != node[i]] if two else js[js > i]
                if not len(js):
                    continue
                ours = js[~unowned(lists, i, js, flat, start)]
                many[i] += w[ours].sum()
                if f >= 0 or own[i] < 0:
                    many[ours] += w[i]
                labels, one = np.unique(part[js], return_index=True)
                new = labels != part[i]
                joins += [(node[i], node[j]) for j in js[one[new]].tolist()]
                if new.any():
                    part[np.isin(part, labels)] = part[i]
        some = np.flatnonzero(many)
        if not len(some) and not joins:
            return None
        a, b = zip(*joins, strict=True) if joins else ((), ())
        return batch(FOUND_SCHEMA, [*node[some].tolist(), *a], [*node[some].tolist(), *b], [*many[some].tolist(), *[0] * len(joins)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    out = cell(held) if len(held) > 1 else None
                    if out is not None:
                        yield out
                    held = []
                held.append(row)
        out = cell(held) if len(held) > 1 else None
        if out is not None:
            yield out

    return run


def meet(cells: DataFrame, cosine: float, kind: str) -> DataFrame:
    return cells.repartition("f", "cell").sortWithinPartitions("f", "cell", "side", "node").mapInArrow(compared(cosine, kind), FOUND)


# -- dense spots ---------------------------------------------------------------------------------


def spots(x: np.ndarray, reach: float) -> np.ndarray:
    """Unit vectors of a sample -> directions that have at least SHARE of it within the angle ``reach``, the fullest first."""
    out, least, alive = [], max(16, int(len(x) * SHARE)), np.ones(len(x), bool)
    # a centre has its members' noise averaged out, so members are first looked for around one of them, further out
    wide = np.cos(min(1.5 * reach, np.pi / 2))
    around = np.concatenate([(x[s : s + 512] @ x.T >= wide).sum(axis=1) for s in range(0, len(x), 512)])
    while len(out) < SPOTS and around.max() >= least:
        top = int(around.argmax())
        own = alive & (x @ x[top] >= wide)
        if own.sum() < around[top]:
            around[top] = own.sum()
            continue
        centre = x[own].sum(axis=0)
        centre /= np.linalg.norm(centre)
        held = alive & (x @ centre >= np.cos(reach))
        if held.sum() >= least:
            out.append(centre)
            alive &= ~held
            around[held] = 0
        around[top] = 0
    return np.array(out).reshape(-1, x.shape[1])


def placed(centres: np.ndarray, reach: float, kind: str):
    """(node, w, v) -> (node, w, v, own, far): the nearest dense spot within reach, or -1, and the angle to it."""
    schema = pa.schema([("node", pa.int64()), ("w", pa.int64()), ("v", pa.binary()), ("own", pa.int32()), ("far", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(centres) or not b.num_rows:
                yield batch(schema, b.column(0), b.column(1), b.column(2), np.full(b.num_rows, -1), np.zeros(b.num_rows))
                continue
            far = np.arccos(np.clip(unit(b.column(2).to_pylist(), kind) @ centres.T, -1, 1))
            own = far.argmin(axis=1)
            least = far[np.arange(len(own)), own]
            yield batch(schema, b.column(0), b.column(1), b.column(2), np.where(least <= reach, own, -1), least)

    return run


def judged(centres: np.ndarray, spot: dict[int, tuple], reach: float, kind: str):
    """Rows (node, w, v, own) -> per spot: the rows whose angle settles a link with all of it, and those whose angle leaves it open."""

    def run(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        own = b.column(3).to_numpy()
        far = np.arccos(np.clip(unit(b.column(2).to_pylist(), kind) @ centres.T, -1, 1))
        for s, (_, radius, _, _) in spot.items():
            sure = (far[:, s] + radius <= reach - SLACK) & (own != s)
            yield s, np.flatnonzero(sure), np.flatnonzero(~sure & (far[:, s] - radius <= reach + SLACK) & (own != s))

    return run


def settled(judge, spot: dict[int, tuple]):
    """FOUND rows of what the angles settle. The number for all members of spot s that an outsider adds has a = -1 - s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, w, own = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy()
            for s, sure, _ in judge(b):
                size, _, head, _ = spot[s]
                mine, out = np.flatnonzero(own == s), sure[own[sure] < 0]
                for at, n in ((sure, np.full(len(sure), size)), (mine, size - w[mine])):
                    yield batch(FOUND_SCHEMA, node[at], node[at], n)
                    yield batch(FOUND_SCHEMA, node[at], np.full(len(at), head), np.zeros(len(at), int))
                yield batch(FOUND_SCHEMA, np.full(len(out), -1 - s), np.full(len(out), -1 - s), w[out])

    return run


def asking(judge):
    """How many rows each spot leaves open."""
    schema = pa.schema([("s", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch(schema, *zip(*((s, len(left)) for s, _, left in judge(b)), strict=True))

    return run


def blocked(node: np.ndarray, blocks) -> np.ndarray:
    return (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks


def opened(judge, spot: dict[int, tuple], asks: dict[int, int]):
    """CELL rows of what the angles leave open: blocks of those that ask meet blocks of the spot's members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, w, own = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy()
            for s, _, left in judge(b):
                many = [-(-x // BLOCK) for x in (asks[s], spot[s][3])]
                for side, at in enumerate((left, np.flatnonzero(own == s)) if asks[s] else ()):
                    mine, n = blocked(node[at], many[side]), len(at)
                    for other in range(many[1 - side]):
                        cell = mine * many[1] + other if side == 0 else other * many[1] + mine
                        yield batch(CELL_SCHEMA, np.full(n, -1 - s), cell, np.full(n, side), node[at], w[at], own[at], [b""] * n, b.column(2).take(pa.array(at)))

    return run


def packed_rows(kind: str, width: int):
    """(vec_id, embedding) -> (vec_id, v): the components as bytes, or null where the row takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.zeros(width, kind)
                if i is not None and v and not any(x is None for x in v):
                    a[: len(v)] = v
                    a += 0.0  # one zero for both signs
                out.append(a.tobytes() if np.isfinite(a).all() and a.any() else None)
            yield batch(pa.schema([("vec_id", pa.int64()), ("v", pa.binary())]), b.column(0), out)

    return run


# -- the operator --------------------------------------------------------------------------------


def filtered(caps: Caps, kind: str, full: dict[int, int] | None):
    """placed() rows -> the filters' numbers alone (``full`` None), or CELL rows."""
    alone = pa.schema([("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                row, f = caps.decode(unit(b.column(2).to_pylist(), kind))
                if full is None:
                    yield batch(alone, f)
                    continue
                node, w = b.column(0).to_numpy(), b.column(1).to_numpy()
                start = np.searchsorted(row, np.arange(b.num_rows + 1))
                g = np.array([full.get(x, 1) for x in f.tolist()], np.int64) if full else np.ones(len(f), np.int64)
                mine = blocked(node[row], g)
                back = np.repeat(np.arange(len(f)), g)
                other = np.arange(len(back)) - np.repeat(np.cumsum(g) - g, g)
                low, high = np.minimum(mine[back], other), np.maximum(mine[back], other)
                r = row[back]
                lists = [f[a:z].tobytes() for a, z in zip(start[r].tolist(), back.tolist(), strict=True)]
                side = (mine[back] > other).astype(int)
                yield batch(CELL_SCHEMA, f[back], low * g[back] + high, side, node[r], w[r], np.full(len(r), -1), lists, b.column(2).take(pa.array(r)))

    return run


def near_vectors(rows: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, n_links, component_id, kept), one row a row.

    Equal vectors are one node with a weight. Dense spots, directions with many of a sample of SAMPLE vectors so near that all
    are within the threshold of each other, are linked as wholes; angles to their centres settle most other pairs with them, and
    the rest are compared block by block, so copies and near copies cost no pairs. All others meet by filters:
    ``Caps`` is set so that a filter holds HELD of them and a pair at the threshold shares SHARED filters, which leaves out
    exp(-SHARED) of such pairs, fewer at higher cosines; a pair counts in the first filter that it shares, if its cosine
    in double precision reaches the threshold. A filter over BLOCK rows is cut into blocks and each two of them
    are a group of their own. A group gives counts and a forest of its links, never all pairs.

    n_links counts other rows. Vectors null, empty, zero or with a null or non-finite component link with
    nothing and are kept, as are vectors alone. Shorter vectors have zeros after their last component. Repeated rows
    count as vectors of their own, and all of a component have its smallest vec_id. Rows without vec_id link with nothing and have
    null component_id and kept. Empty table: no rows.
    """
    spark = rows.sparkSession
    schema = "vec_id long, n_links long, component_id long, kept boolean"
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    if width is None:
        return spark.createDataFrame([], schema)
    kind = "<f4" if rows.schema["embedding"].dataType.jsonValue()["elementType"] == "float" else "<f8"
    width = max(1, width)
    packed = written(own.mapInArrow(packed_rows(kind, width), "vec_id long, v binary"))
    valid = packed.where("v is not null")
    # equal vectors: a node, numbered once and for all by being written
    nodes = written(valid.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("w")).withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()
    alone = (F.col("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    if n < 1:
        return packed.select(*alone)
    reach = float(np.arccos(cosine))
    draw = F.pmod(F.xxhash64("v", F.lit("spots")), F.lit(1_000_000)) < int(min(1.0, SAMPLE / n) * 1_000_000)
    sample = unit([bytes(r.v) for r in nodes.where(draw).select("v").limit(2 * SAMPLE).collect()], kind)
    centres = spots(sample, reach / 2 - SLACK) if len(sample) else np.zeros((0, width))
    put = written(nodes.select("node", "w", "v").mapInArrow(placed(centres, reach / 2 - SLACK, kind), "node long, w long, v binary, own int, far double"))
    by = put.where("own >= 0").groupBy("own").agg(F.sum("w").alias("size"), F.max("far").alias("radius"), F.min("node").alias("head"), F.count("*").alias("members"))
    spot = {r.own: (r.size, r.radius, r.head, r.members) for r in by.collect()}  # SPOTS rows
    found = []
    if spot:
        angles, judge = put.select("node", "w", "v", "own"), judged(centres, spot, reach, kind)
        found.append(angles.mapInArrow(settled(judge, spot), FOUND))
        asks = {r.s: r.n for r in angles.mapInArrow(asking(judge), "s int, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()}
        if any(asks.values()):
            found.append(meet(angles.mapInArrow(opened(judge, spot, asks), CELL), cosine, kind))
    rest = put.where("own < 0").select("node", "w", "v")
    others = rest.count()
    if others > 1:
        caps = Caps(others, width, cosine)
        sizes = rest.mapInArrow(filtered(caps, kind, None), "f long").groupBy("f").count()
        total = sizes.agg(F.sum("count"), F.max("count")).first()
        full_from = max(BLOCK, (total[0] or 0) // FULL)
        full = {r.f: -(-r["count"] // BLOCK) for r in sizes.where(F.col("count") > full_from).collect()} if (total[1] or 0) > full_from else {}
        found.append(meet(rest.mapInArrow(filtered(caps, kind, full), CELL), cosine, kind))
    if not found:  # one node alone
        found.append(spark.createDataFrame([], FOUND))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = written(links)
    counts = links.where("n > 0 and a >= 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    whole = links.where("n > 0 and a < 0").groupBy(F.col("a").alias("spot")).agg(F.sum("n").alias("more"))  # a row a spot
    roots = connected_components(links.where("n = 0").select("a", "b"))
    named = put.select("node", (-1 - F.col("own")).alias("spot")).join(F.broadcast(whole), "spot", "left").join(counts, "node", "left").join(roots, "node", "left").join(nodes.select("node", "first", "w", "v"), "node")
    named = named.select("v", "first", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("v", "n_links", "component_id")
    linked = valid.join(named, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(packed.where("v is null").select(*alone))
