"""Sharding by best-fit-decreasing bin packing over indivisible groups."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import partitions, texts, written

#: A group above total / (shards * FINE) is an item of its own; smaller ones share CHUNKS items.
FINE, CHUNKS = 500, 8192


class FreeSpace:
    """A randomised balanced search tree of (free capacity, bin), smallest first."""

    def __init__(self):
        self.root, self.rng = None, random.Random(7)

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            a, b = self._split(t[3], key)
            return (t[0], t[1], t[2], a), b
        a, b = self._split(t[2], key)
        return a, (t[0], t[1], b, t[3])

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            return (a[0], a[1], a[2], self._merge(a[3], b))
        return (b[0], b[1], self._merge(a, b[2]), b[3])

    def add(self, free: int, n: int) -> None:
        a, b = self._split(self.root, (free, n))
        self.root = self._merge(self._merge(a, ((free, n), self.rng.random(), None, None)), b)

    def take(self, need: int):
        """Remove and return the tightest (free, bin) with free >= need, or None."""
        a, b = self._split(self.root, (need, -1))
        if b is None:
            return None
        t = b
        while t[2] is not None:
            t = t[2]
        _, rest = self._split(b, (t[0][0], t[0][1] + 1))
        self.root = self._merge(a, rest)
        return t[0]


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size. A size above capacity gets a bin of its own. None if over ``most`` bins."""
    tree, bins, out = FreeSpace(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            if most is not None and bins == most:
                return None
            found, bins = (max(capacity, sizes[i]), bins), bins + 1
        tree.add(found[0] - sizes[i], found[1])
        out[i] = found[1]
    return out


def near_equal(sizes: list[int], shards: int) -> list[int]:
    """Best-fit-decreasing at the least capacity (by bisection) that needs no more than ``shards`` bins.

    An item above the fair share of what is left takes a shard alone, and the share is taken anew.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out, alone, left = [0] * len(sizes), 0, sum(sizes)
    while alone < shards - 1 and alone < len(order) and sizes[order[alone]] * (shards - alone) >= left:
        out[order[alone]] = alone
        left -= sizes[order[alone]]
        alone += 1
    rest, n = order[alone:], shards - alone
    if rest:
        part = [sizes[i] for i in rest]
        low, high, best = max(-(-left // n), part[0]), left, None
        span = max(1, low // 1000)
        while best is None and low + span < high:
            best = best_fit_decreasing(part, low + span, n)
            high, span = (low + span, span) if best else (high, span * 2)
        best = best or [0] * len(part)
        while low < high and high - low > max(1, low // 20000):
            mid = (low + high) // 2
            found = best_fit_decreasing(part, mid, n)
            best, low, high = (found, low, mid) if found else (best, mid + 1, high)
        for i, b in zip(rest, best, strict=True):
            out[i] = alone + b
    return out


def shards_by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents -> (doc_id, size, text_crc32, law, shard, slot, grown_shard), sizes near equal.

    Equal texts stay together. A null text counts as an empty one (size 16). Groups above a
    fixed fraction of the total are items of their own (at most shards * FINE can be); all
    smaller groups are hashed into CHUNKS items. So at most shards * FINE + CHUNKS items, at
    any input size, are sorted by size and enter the tightest bin. A group larger than a fair
    share gets a shard alone. Ties in size go by bundle, then by hash. Repeated rows are rows of their own
    in one shard; a text of any length is but its size and hashes. Rows are numbered in salted cells of a shard, so neither a hot
    text nor a shard is one task. Empty table: no rows. Rows without doc_id are kept.
    """
    spark = docs.sparkSession
    body = F.coalesce("text", F.lit(""))
    rows = written(texts(docs).select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("k")))
    groups = rows.groupBy("k").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = total // (shards * FINE)
    chunk = F.pmod(F.xxhash64("k"), F.lit(CHUNKS)).cast("int")
    item = F.when(F.col("bytes") > large, F.lit(None)).otherwise(chunk)
    items = groups.select(item.alias("chunk"), F.when(F.col("bytes") > large, F.col("k")).alias("k"), "bytes").groupBy("chunk", "k").agg(F.sum("bytes").alias("bytes")).collect()
    items.sort(key=lambda r: (-r.bytes, r.chunk if r.chunk is not None else -1, bytes(r.k or b"")))
    placed = near_equal([r.bytes for r in items], shards)
    of = {"k": T.StructType([T.StructField("k", T.BinaryType()), T.StructField("own", T.IntegerType())]), "c": T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("common", T.IntegerType())])}
    own = spark.createDataFrame([(bytes(r.k), s) for r, s in zip(items, placed, strict=True) if r.k is not None], of["k"])
    common = spark.createDataFrame([(r.chunk, s) for r, s in zip(items, placed, strict=True) if r.k is None], of["c"])
    cells = max(8, partitions(spark) // 8)
    put = rows.withColumn("chunk", chunk).join(F.broadcast(own), "k", "left").join(F.broadcast(common), "chunk", "left")
    put = put.select("doc_id", "size", "text_crc32", F.coalesce("own", "common").alias("shard"), F.pmod(F.xxhash64("doc_id", "k"), F.lit(cells)).cast("int").alias("cell"))
    counts = put.groupBy("shard", "cell").count()
    before = counts.select("shard", "cell", (F.sum("count").over(Window.partitionBy("shard").orderBy("cell")) - F.col("count")).alias("before"))
    at = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32")) - 1
    return put.withColumn("at", at).join(before, ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
