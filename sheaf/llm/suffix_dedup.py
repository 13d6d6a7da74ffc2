"""Removal of long strings that repeat: suffix buckets sorted one at a time, long ties settled by a cover sample.

Every window of LENGTH bytes is the start of a suffix. A sample of positions covers all windows:
a window's sample is the leftmost least hash among its GRAM-byte strings, so equal windows have
their samples at one offset - what a difference cover is needed for. Windows with one sample form
a run; a run's rank is the pair (hash of the sampled string, hash of the run's bytes).

1. Runs go to the bucket of their sampled string. A run whose rank stands earlier is a long tie
   that the ranks settle: all its windows repeat. A string with one rank has no other repeats.
2. For strings with several ranks, the first run of each rank is sent with its bytes, and one
   bucket of suffixes at a time is sorted and neighbours compared, to LENGTH bytes.
Strings with very many ranks are split: there each window is its own key (128-bit hash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import batch, partitions, utf8, written

LENGTH, GRAM = 100, 24
#: Runs held by a task before they are sent; ranks of one string in such a load, and in all, from which its windows go by their own hash.
LOAD, HOT, MANY = 600_000, 64, 512
#: Windows sorted at once, bytes of a text sampled at once, and bytes of text for which a bucket is made at least.
SORTED, PIECE, BUCKET = 100_000, 900_000, 16 << 20
REPEAT, RUNS, HOT_RUNS, MARK, BYTES, WINDOWS = range(6)
SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("load", pa.binary())])
SENT_DDL = "bucket int, kind int, load binary"
FOUND = pa.schema([("doc_id", pa.int64()), ("twin", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("string", pa.int64()), ("kind", pa.int32())])
FOUND_DDL = "doc_id long, twin long, lo int, n int, string long, kind int"


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as a compressed block, preceded by their types."""
    head = ",".join(c.dtype.str for c in columns).encode()
    return head + b"\n" + zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(load: bytes) -> list[np.ndarray]:
    head, _, rest = load.partition(b"\n")
    raw = zstandard.ZstdDecompressor().decompress(rest)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in head.decode().split(","):
        t = np.dtype(kind)
        out.append(np.frombuffer(raw, t, n, at))
        at += n * t.itemsize
    return out


def joined(loads: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*(unpack(x) for x in loads), strict=True)]


def hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position."""
    n = len(b)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = b
    eight = np.empty(n + 8 - n % 8, np.uint64)
    for r in range(8):
        eight[r::8] = padded[r : r + len(eight)].view("<u8")[: len(eight) // 8]
    m = n - GRAM + 1
    h = eight[:m] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += eight[8 : 8 + m]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += eight[16 : 16 + m]
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(31)
    return h


def runs(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sampled string's hash, hash of the run's bytes, first window, number of windows) of each run."""
    none = np.zeros(0, np.uint64)
    if len(text) < length:
        return none, none, none.astype(np.int32), none.astype(np.uint8)
    width, out = length - GRAM + 1, []
    for at in range(0, len(text) - length + 1, PIECE):
        b = np.frombuffer(text, np.uint8)[at : at + PIECE + length - 1]
        h = hashes(b)
        v = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            v = np.minimum(v[:-step], v[step:])
            step *= 2
        if step < width:
            v = np.minimum(v[: len(v) - (width - step)], v[width - step :])
        sample = (v & np.uint64(0xFFFFF)).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(sample[1:] != sample[:-1]) + 1])
        n = np.diff(np.concatenate([start, [len(sample)]]))
        part, digest = memoryview(text)[at : at + len(b)], xxhash.xxh3_64_intdigest
        ranks = np.array([digest(part[s:e]) for s, e in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)], np.uint64)
        out.append((h[sample[start]], ranks, (start + at).astype(np.int32), n.astype(np.uint8)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def by_bucket(bucket: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield batch(SENT, [bucket[a]], [kind], [pack(*(c[a:b] for c in columns))])


def firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, most significant first, without repeated rows; and whether a row's keys but the last three (a place) are new."""
    order = np.lexsort(keys[::-1])
    if len(order):
        other = np.ones(len(order), bool)
        other[1:] = False
        for k in keys:
            other[1:] |= k[order[1:]] != k[order[:-1]]
        order = order[other]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys[:-3]:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, new


def sampled(buckets: int, length: int):
    """(doc_id, twin, text) -> runs by the bucket of their string; what repeats within a load is settled here."""

    def send(held) -> Iterator[pa.RecordBatch]:
        h, rank, doc, twin, lo, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order, new = firsts(h, rank, doc, twin, lo)
        rest = order[~new]
        rest = rest[np.argsort(doc[rest], kind="stable")]
        yield from by_bucket((doc[rest] % buckets).astype(np.int32), REPEAT, doc[rest], twin[rest], lo[rest], n[rest])
        keep = order[new]
        string = h[keep]
        start = np.flatnonzero(np.concatenate([[True], string[1:] != string[:-1]]))
        count = np.diff(np.concatenate([start, [len(string)]]))
        hot = np.repeat(count > HOT, count)
        marks = string[start[count > HOT]]
        yield from by_bucket((marks % np.uint64(buckets)).astype(np.int32), MARK, marks)
        for kind, key, some in ((RUNS, h, keep[~hot]), (HOT_RUNS, rank, keep[hot])):
            some = some[np.argsort(doc[some], kind="stable")]
            yield from by_bucket((key[some] % np.uint64(buckets)).astype(np.int32), kind, h[some], rank[some], doc[some], twin[some], lo[some], n[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for d, w, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), strict=True):
                h, rank, lo, n = runs(t, length)
                held.append((h, rank, np.full(len(h), d, np.int64), np.full(len(h), w, np.int64), lo, n))
                size += len(h)
                if size >= LOAD:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    return run


def ranked(rows: pa.Table) -> pa.Table:
    """One bucket of runs -> repeats, and the runs whose windows must be compared."""
    loads: dict[int, list[bytes]] = {}
    for kind, load in zip(rows["kind"].to_pylist(), rows["load"].to_pylist(), strict=True):
        loads.setdefault(kind, []).append(load)
    out = []
    if REPEAT in loads:
        doc, twin, lo, n = joined(loads[REPEAT])
        out.append((doc, twin, lo, n, np.zeros(len(doc), np.uint64), np.full(len(doc), REPEAT)))
    marks = np.unique(joined(loads[MARK])[0]) if MARK in loads else np.zeros(0, np.uint64)
    for kind in (RUNS, HOT_RUNS):
        if kind not in loads:
            continue
        h, rank, doc, twin, lo, n = joined(loads[kind])
        order, new = firsts(h, rank, doc, twin, lo)
        rest, first = order[~new], order[new]
        out.append((doc[rest], twin[rest], lo[rest], n[rest], h[rest], np.full(len(rest), REPEAT)))
        string = h[first]
        start = np.flatnonzero(np.concatenate([[True], string[1:] != string[:-1]]))
        count = np.diff(np.concatenate([start, [len(string)]]))
        alone = (count == 1) & ~np.isin(string[start], marks) & (kind == RUNS)
        split = (count > MANY) | np.isin(string[start], marks) | (kind == HOT_RUNS)
        more = np.repeat(~alone, count)
        out.append((doc[first][more], twin[first][more], lo[first][more], n[first][more], string[more], np.repeat(np.where(split, WINDOWS, BYTES), count)[more]))
    doc, twin, lo, n, h, kind = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 6
    return pa.Table.from_batches([batch(FOUND, doc, twin, lo.astype(np.int32), n.astype(np.int32), h.view(np.int64), kind.astype(np.int32))])


def cut_out(buckets: int, length: int):
    """(doc_id, twin, text, runs) -> the runs' bytes by the bucket of their string, or their windows by their hash."""

    def send_bytes(held) -> Iterator[pa.RecordBatch]:
        h = np.array([x[0] for x in held], np.int64).view(np.uint64)
        bucket = (h % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            some = [held[i] for i in order[a:b]]
            head = pack(*(np.array([x[c] for x in some], np.int64) for c in range(5)))
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(x[5] for x in some))
            yield batch(SENT, [bucket[order[a]]], [BYTES], [len(head).to_bytes(8, "little") + head + body])

    def send_windows(held) -> Iterator[pa.RecordBatch]:
        a, b, doc, twin, lo = (np.array(c, t) for c, t in zip(zip(*held, strict=True), (np.uint64, np.uint64, np.int64, np.int64, np.int32), strict=True))
        order, new = firsts(a, b, doc, twin, lo)
        rest, keep = order[~new], order[new]
        yield from by_bucket((doc[rest] % buckets).astype(np.int32), REPEAT, doc[rest], twin[rest], lo[rest], np.ones(len(rest), np.uint8))
        yield from by_bucket((a[keep] % np.uint64(buckets)).astype(np.int32), WINDOWS, a[keep], b[keep], doc[keep], twin[keep], lo[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, windows, size = [], [], 0
        for b in batches:
            for d, w, t, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(), strict=True):
                for p in parts:
                    lo, n = p["lo"], p["n"]
                    if p["kind"] == BYTES:
                        spans.append((p["string"], d, w, lo, n, t[lo : lo + n + length - 1]))
                        size += n + length
                    else:
                        for s in range(lo, lo + n):
                            x = xxhash.xxh3_128_intdigest(t[s : s + length])
                            windows.append((x >> 64, x & 0xFFFFFFFFFFFFFFFF, d, w, s))
                if size > 16 << 20:
                    yield from send_bytes(spans)
                    spans, size = [], 0
                if len(windows) > 200_000:
                    yield from send_windows(windows)
                    windows = []
        if spans:
            yield from send_bytes(spans)
        if windows:
            yield from send_windows(windows)

    return run


def sorted_bucket(length: int):
    """One bucket of suffixes, sorted: a window whose string stands earlier in (doc_id, start) repeats."""

    def order_bytes(loads: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held, text, size = [], [], 0
        for load in loads:
            cut = 8 + int.from_bytes(load[:8], "little")
            held.append(unpack(load[8:cut]))
            text.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(load[cut:]), np.uint8))
        h, doc, twin, lo, n = (np.concatenate(c) for c in zip(*held, strict=True))
        text = np.concatenate(text)
        at = np.concatenate([[0], np.cumsum(n + length - 1)[:-1]])
        order, _ = firsts(h, doc, twin, lo)  # rows with one doc_id and one text are one document
        h, doc, twin, lo, n, at = (x[order] for x in (h, doc, twin, lo, n, at))
        last = np.flatnonzero(np.concatenate([h[1:] != h[:-1], [True]])) + 1
        view = np.lib.stride_tricks.sliding_window_view(text, length)
        total, a = np.concatenate([[0], np.cumsum(n)]), 0
        while a < len(h):
            b = int(last[min(np.searchsorted(total[last], total[a] + SORTED), len(last) - 1)])
            k = n[a:b]
            step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            d, w, s = np.repeat(doc[a:b], k), np.repeat(twin[a:b], k), np.repeat(lo[a:b], k) + step
            early = np.lexsort((s, w, d))
            suffix = np.ascontiguousarray(view[(np.repeat(at[a:b], k) + step)[early]]).view(f"V{length}").ravel()
            by = np.argsort(suffix, kind="stable")  # equal strings stay in order of (doc_id, start)
            again = by[1:][suffix[by[1:]] == suffix[by[:-1]]]
            yield d[early][again], w[early][again], s[early][again]
            a = b

    def run(rows: pa.Table) -> pa.Table:
        loads: dict[int, list[bytes]] = {}
        for kind, load in zip(rows["kind"].to_pylist(), rows["load"].to_pylist(), strict=True):
            loads.setdefault(kind, []).append(load)
        out = []
        if REPEAT in loads:
            out.append(tuple(joined(loads[REPEAT])[:3]))
        if WINDOWS in loads:
            a, b, doc, twin, lo = joined(loads[WINDOWS])
            order, new = firsts(a, b, doc, twin, lo)
            out.append((doc[order[~new]], twin[order[~new]], lo[order[~new]]))
        if BYTES in loads:
            out.extend(order_bytes(loads[BYTES]))
        doc, twin, lo = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((lo, twin, doc))
        doc, twin, lo = doc[order], twin[order], lo[order]
        start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]) | (lo[1:] != lo[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([start, [len(doc)]]))
        return pa.Table.from_batches([batch(FOUND, doc[start], twin[start], lo[start].astype(np.int32), n.astype(np.int32), np.zeros(len(start), np.int64), np.zeros(len(start), np.int32))])

    return run


def removed(length: int, width: int):
    """(columns of the documents, text, spans) -> (columns, n_bytes, n_removed, n_spans, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, parts in zip(utf8(b.column(width)), b.column(width + 1), strict=True):
                spans = parts.values if parts.is_valid else None
                if spans is None or not len(spans):
                    out.append((len(t), 0, 0, t))
                    continue
                lo = spans.field(0).to_numpy()
                hi = np.minimum(lo + spans.field(1).to_numpy() + length - 1, len(t))
                edge = np.bincount(np.minimum(lo, len(t)), minlength=len(t) + 1) - np.bincount(hi, minlength=len(t) + 1)
                gone = np.cumsum(edge)[: len(t)] > 0
                n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(t), int(gone.sum()), n_spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *columns], [*b.schema.names[:width], "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def twins(known: DataFrame) -> DataFrame:
    """(doc_id, text) -> and twin: 0, or a hash of the text where rows of one doc_id have different texts."""
    marked = known.withColumn("twin", F.xxhash64("text"))
    torn = written(marked.groupBy("doc_id").agg(F.min("twin").alias("a"), F.max("twin").alias("b")).where("a <> b").select("doc_id", F.lit(1).alias("torn")))
    if not torn.limit(1).count():
        return known.withColumn("twin", F.lit(0).cast("long"))
    return marked.join(torn, "doc_id", "left").withColumn("twin", F.when(F.col("torn") == 1, F.col("twin")).otherwise(F.lit(0).cast("long"))).drop("torn")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Documents -> their columns, n_bytes, n_removed, n_spans and kept (binary): what is left of the text.

    A byte goes if a string of ``length`` bytes over it also starts earlier, in (doc_id, start), judged on
    the input. Null texts are empty; texts shorter than ``length`` stay whole. Rows with one doc_id and one
    text are one document and get one result; rows with one doc_id and different texts are documents in the
    order of a hash of their texts. Rows without doc_id stay whole and match nothing. A text of any length is
    sampled a piece at a time. The documents' own columns must not have the names of the four that are added
    (``apart`` renames them). Empty table: no rows.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * partitions(docs.sparkSession), size // BUCKET)
    known = twins(known).select("doc_id", "twin", "text")
    sent = known.mapInArrow(sampled(buckets, length), SENT_DDL)
    found = written(sent.groupBy("bucket").applyInArrow(ranked, FOUND_DDL))
    asked = found.where(F.col("kind") != REPEAT).groupBy("doc_id", "twin").agg(F.collect_list(F.struct("lo", "n", "string", "kind")).alias("runs"))
    cut = known.join(asked, ["doc_id", "twin"]).select("doc_id", "twin", "text", "runs").mapInArrow(cut_out(buckets, length), SENT_DDL)
    more = cut.groupBy("bucket").applyInArrow(sorted_bucket(length), FOUND_DDL)
    spans = found.where(F.col("kind") == REPEAT).unionByName(more).groupBy("doc_id", "twin").agg(F.collect_list(F.struct("lo", "n")).alias("_spans"))
    spans = spans.withColumnsRenamed({"doc_id": "_doc", "twin": "_twin"})
    same = (F.col("doc_id").cast("long") == F.col("_doc")) & ((F.col("_twin") == 0) | (F.col("_twin") == F.xxhash64(F.col("text").cast("string"))))
    rows = docs.join(spans, same, "left")
    keep = docs.columns
    schema = docs.schema
    for c, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")):
        schema = type(schema)(list(schema.fields)).add(c, kind)
    return rows.select(*keep, F.col("text").alias("_text"), "_spans").mapInArrow(removed(length, len(keep)), schema)
