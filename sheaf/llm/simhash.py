"""SimHash near-duplicates: one-wildcard variants of three segments, equality, verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import batch, popcount, texts, utf8, written
from sheaf.llm.components import connected_components

#: Four differing bits over three segments leave one segment with at most one.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
NEAR = 4
#: Up to this many fingerprints under one variant are compared pair by pair in arrays, more by a breadth-first search.
SMALL = 48
#: Rows that a task compares at once.
LOAD = 1_000_000


def fingerprint(text: bytes, width: int = 4) -> int:
    """64-bit SimHash of word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)], np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        votes += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Documents -> (doc_id, fp): the fingerprint as a signed long. Null and blank texts have 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield batch(schema, b.column(0), fps)

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def variants(wild: bool):
    """(node, fp) -> (key, node, fp): each segment as it is, or with each of its bits blanked in turn."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            for start, width in SEGMENTS:
                part = (fp.view(np.uint64) >> np.uint64(start)).astype(np.int64) & ((1 << width) - 1)
                for bit in range(width) if wild else [None]:
                    yield batch(schema, (start + (bit or 0)) << 22 | (part & ~(1 << bit) if wild else part), node, fp)

    return run


def search(node: np.ndarray, fp: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between the nodes of a large group: what is reached is never compared again."""
    left = np.arange(len(fp))
    while len(left):
        own = node[left] == node[left[0]]
        front, left = left[own], left[~own]
        while len(front) and len(left):
            f, front = front[:64], front[64:]
            near = popcount(fp[f][:, None] ^ fp[left][None, :]) <= NEAR
            hit = np.flatnonzero(near.any(axis=0))
            if len(hit):
                reached, one = np.unique(node[left[hit]], return_index=True)
                yield from zip(node[f[near[:, hit[one]].argmax(axis=0)]].tolist(), reached.tolist(), strict=True)
                new = np.isin(node[left], reached)
                front, left = np.concatenate([front, left[new]]), left[~new]


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join what the pairs before have not joined."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def linked(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """Rows in order of the key, groups whole -> a forest of the verified links between nodes under one key."""
    order = np.lexsort((node, key))
    key, node, fp = key[order], node[order], fp[order].view(np.uint64)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([start, [len(key)]]))
    found = [np.array(list(search(node[s : s + n], fp[s : s + n])), np.int64).reshape(-1, 2) for s, n in zip(start[size > SMALL], size[size > SMALL], strict=True)]
    small = np.repeat((size > 1) & (size <= SMALL), size)
    key, node, fp = key[small], node[small], fp[small]
    for d in range(1, min(SMALL, len(key))):
        same = np.flatnonzero((key[:-d] == key[d:]) & (node[:-d] != node[d:]))
        same = same[popcount(fp[same] ^ fp[same + d]) <= NEAR]
        found.append(np.stack([node[same], node[same + d]], axis=1))
    return forest(np.unique(np.concatenate(found), axis=0)) if found else []


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, fp) in order of the key -> verified links (a, b) that connect all nodes within NEAR bits of each other.

    A task holds LOAD rows and the rest of a group, not its whole partition.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held, size = [], 0
    for b in batches:
        held.append(tuple(c.to_numpy() for c in b.columns))
        size += b.num_rows
        if size >= LOAD:
            key, node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if whole:
                pairs = linked(key[:whole], node[:whole], fp[:whole])
                yield batch(schema, [a for a, _ in pairs], [b for _, b in pairs])
            held, size = [(key[whole:], node[whole:], fp[whole:])], 0
    if held:
        pairs = linked(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield batch(schema, [a for a, _ in pairs], [b for _, b in pairs])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Documents -> (doc_id, fingerprint, component_id, fp): one row per document.

    Documents with one fingerprint are one node, named by their smallest doc_id, so copies are
    never paired. First, fingerprints with an equal segment are linked and joined to components;
    then one-wildcard variants link components. A group under one key yields a spanning forest of
    its links, not all of them. A key fixes 20 or 21 bits, so a group has about a 2,000,000th of all
    different fingerprints, and is searched breadth-first: what is reached is not compared again.
    Rows without doc_id keep a fingerprint and have no component. Rows with one doc_id and different
    texts are one document with several fingerprints: all their links count. A tie between names goes
    to the smallest doc_id. A text of any length is hashed by itself. Empty table: no rows.
    """
    fps = written(fingerprints(docs))
    nodes = written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("root")))
    torn = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    own = fps.join(torn, "doc_id").join(nodes, "fp").select("doc_id", "root")
    same = own.join(own.groupBy("doc_id").agg(F.min("root").alias("b")), "doc_id").select(F.col("root").alias("a"), "b")
    for wild in (False, True):
        keyed = nodes.select(F.col("root").alias("node"), "fp").mapInArrow(variants(wild), "key long, node long, fp long").repartition("key").sortWithinPartitions("key")
        found = keyed.mapInArrow(links, "a long, b long")
        roots = connected_components(found if wild else found.unionByName(same))
        nodes = written(nodes.join(roots.withColumnsRenamed({"node": "was", "root": "new"}), F.col("root") == F.col("was"), "left").select("fp", F.coalesce("new", "root").alias("root")))
    named = nodes.withColumnRenamed("root", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(named, "fp", "left").select("doc_id", hexed, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), "fp")
