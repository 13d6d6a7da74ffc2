"""Packing token sequences by cutting-stock column generation over a length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import batch, partitions, texts, written
from sheaf.llm.sharding import best_fit_decreasing

#: Tokens of a sequence, the id that ends a document, and the tokens by which lengths are classed (rounded up).
ROOM, END, STEP = 2048, 1, 8
#: Simplex steps at most, and the share above the bound at which the linear program may stop.
STEPS, GAP = 4000, 2e-3


def encoder(path: str, tiktoken_path: str | None) -> Callable[[list[str]], list[list[int]]]:
    """Texts -> ids of the vocabulary at ``path``.

    The same vocabulary and merges as ranks (``tiktoken_path``) give the same ids several times faster;
    a text with the special token's string goes to the tokenizer itself.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    plain = lambda x: whole.encode(x, add_special_tokens=False).ids
    if not tiktoken_path:
        return lambda batch_: [plain(x) for x in batch_]
    import base64

    import public_tokenizers
    import tiktoken

    with open(tiktoken_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda batch_: [plain(x) if "<|" in x else fast.encode_ordinary(x) for x in batch_]


def pieces(docs: DataFrame, path: str, tiktoken_path: str | None = None, room: int = ROOM) -> DataFrame:
    """Documents -> (doc_id, start, length, ids_crc32, doc_tokens): full pieces of ``room`` ids, then the rest."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, tiktoken_path)
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*encode([t or ""])[0], END], "<u4")
                out += [(d, s, min(room, len(ids) - s), zlib.crc32(ids[s : s + room].tobytes()), len(ids)) for s in range(0, len(ids), room)]
            yield batch(schema, *(zip(*out, strict=True) if out else [[]] * 5))

    return texts(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def priced(sizes: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern, by dynamic programming: its value and how often each size stands in it."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        k = np.searchsorted(sizes, c, "right")
        best[c] = best[c - 1]
        if k:
            got = best[c - sizes[:k]] + value[:k]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], pick[c] = got[i], i
    count, c = np.zeros(len(sizes)), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            count[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), count


def columns(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how much of each) of the least linear cover of the demand, to within GAP."""
    m = len(sizes)
    cols = np.diag((room // sizes).astype(float))
    inverse, x = np.diag(1 / np.diag(cols)), demand / np.diag(cols)
    bound = (sizes * demand).sum() / room
    for _ in range(STEPS):
        if x.sum() <= bound * (1 + GAP):
            break
        value, new = priced(sizes, np.maximum(inverse.sum(axis=0), 0), room)
        if value <= 1 + 1e-7:
            break
        way = inverse @ new
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / way[up]
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * way, 0)
        x[out] = step
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        cols[:, out] = new
    return cols, x


def patterns(counts: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """{size: how many} -> [(copies, {size: how often in a copy})], every item in exactly one place.

    The linear program's patterns are rounded down; what they leave, a bounded number, goes by best fit decreasing.
    """
    sizes = np.array(sorted(counts), np.int64)
    if not len(sizes):
        return []
    left = np.array([counts[s] for s in sizes.tolist()], np.int64)
    cols, x = columns(sizes, left.astype(float), room)
    out = []
    for p in np.argsort(-x, kind="stable"):
        a = cols[:, p].astype(np.int64)
        k = int(min(np.floor(x[p] + 1e-9), (left[a > 0] // a[a > 0]).min()))
        if k > 0:
            left -= a * k
            out.append((k, {int(s): int(n) for s, n in zip(sizes, a, strict=True) if n}))
    items = np.repeat(sizes, left).tolist()
    bins: dict[int, dict[int, int]] = {}
    for s, b in zip(items, best_fit_decreasing(items, room), strict=True):
        one = bins.setdefault(b, {})
        one[s] = one.get(s, 0) + 1
    alike: dict[tuple, int] = {}
    for one in bins.values():
        k = tuple(sorted(one.items()))
        alike[k] = alike.get(k, 0) + 1
    return out + [(n, dict(k)) for k, n in alike.items()]


def packed(parts: DataFrame, room: int = ROOM, step: int = STEP) -> DataFrame:
    """Pieces (with ``length``) -> their columns, sequence_id, offset: sequences of at most ``room``.

    The histogram has at most room / step classes at any input size; the linear program and the patterns
    are as small. Pieces are ranked within their class in salted cells, so a very common length is
    not one task, and a rank finds its pattern by an equality on the class. Pieces of 0 or over
    ``room`` are not expected. Empty table: no rows.
    """
    spark, top = parts.sparkSession, room // step
    parts = written(parts.withColumn("size", F.ceil(F.col("length") / step).cast("int")))
    counts = {r["size"]: r["count"] for r in parts.groupBy("size").count().collect()}
    found = patterns(counts, top)
    used, base, rows = dict.fromkeys(counts, 0), 0, []
    for k, one in found:
        for s, n in one.items():
            rows.append((s, used[s], used[s] + n * k, n, base))
            used[s] += n * k
        base += k
    places = spark.createDataFrame(rows, "size int, first long, last long, each int, base long")
    cells = max(8, partitions(spark) // 2)
    salted = parts.withColumn("cell", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(cells)).cast("int"))
    totals = salted.groupBy("size", "cell").count()
    before = totals.select("size", "cell", (F.sum("count").over(Window.partitionBy("size").orderBy("cell")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("at", F.row_number().over(Window.partitionBy("size", "cell").orderBy("doc_id", "start", "ids_crc32")) - 1).join(before, ["size", "cell"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at"))
    p = F.broadcast(places.withColumnRenamed("size", "_size"))
    put = ranked.join(p, (F.col("size") == F.col("_size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    put = put.withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("each")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keep = [c for c in parts.columns if c != "size"]
    return put.select(*keep, F.col("sequence_id").cast("long").alias("sequence_id"), (F.sum("length").over(inside) - F.col("length")).cast("long").alias("offset"))


def packed_documents(docs: DataFrame, path: str, tiktoken_path: str | None = None) -> DataFrame:
    """Documents -> one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows with one doc_id are cut one by one. A document of
    any length is cut into full sequences and a rest.
    """
    return packed(pieces(docs, path, tiktoken_path))
