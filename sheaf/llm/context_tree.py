"""Language-model scores by context-tree weighting over binary-decomposed bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import batch, partitions, remainder, utf8, written

#: Bytes of context, and depths whose nodes are kept for prediction (all, deepest first).
DEPTH = 5
LEVELS = tuple(range(DEPTH, -1, -1))
#: The symbol that ends a text and stands before it: a byte that no UTF-8 text has.
EDGE = b"\xff"
#: Bytes of text that are counted or scored at once, bytes of a pack, and bytes of text for which a bucket is made at least.
AT_ONCE, PACKED, BUCKET = 1 << 20, 16 << 20, 16 << 20


def strings(texts: list[bytes], depth: int, turned: bool = False) -> np.ndarray:
    """Each byte of each text after its ``depth`` bytes of context, as one number, the byte last.

    Before a text stand edges; one more edge ends it. Turned: the nearest byte of the context first.
    """
    pad = EDGE * depth
    x = np.frombuffer(b"".join(pad + t + EDGE for t in texts), np.uint8).astype(np.uint64)
    code = np.zeros(len(x) - depth, np.uint64)
    for i in range(depth + 1):
        code |= x[i : i + len(code)] << np.uint64(8 * (depth - i if not turned else (i + 1) % (depth + 1)))
    size = np.array([len(t) + 1 for t in texts], np.int64)
    start = np.cumsum(size + depth) - size - depth
    return code[np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]


def turned_back(code: np.ndarray) -> np.ndarray:
    """Turned strings of DEPTH bytes of context in the usual order."""
    out = code & np.uint64(255)
    for i in range(1, DEPTH + 1):
        out = out | (code >> np.uint64(8 * i) & np.uint64(255)) << np.uint64(8 * (DEPTH + 1 - i))
    return out


def grouped(texts: Iterator[tuple[object, bytes]], most: int = AT_ONCE) -> Iterator[list[tuple[object, bytes]]]:
    held, size = [], 0
    for k, t in texts:
        held.append((k, t))
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def distinct(rows: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """(text, held out) -> the turned strings of all texts in order, and how often training texts have each."""
    codes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for out in (False, True):
        for held in grouped((None, t) for t, h in rows if h == out):
            c, n = np.unique(strings([t for _, t in held], DEPTH, True), return_counts=True)
            codes.append(c)
            counts.append(n * (not out))
    every, at = np.unique(np.concatenate(codes), return_inverse=True)
    return every, np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)


def bucket_of(turned: np.ndarray, buckets: int) -> np.ndarray:
    """By the two nearest bytes of context, so that all that shares them is in one bucket."""
    return ((turned >> np.uint64(8 * (DEPTH - 1))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov estimate of a string with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Nodes:
    """The binary nodes of one depth at one bit of the byte: (context, bits so far) with counts of zeros and ones."""

    def __init__(self, code: np.ndarray, n: np.ndarray, bit: int):
        seen, self.bit = code >> np.uint64(8 - bit), (code >> np.uint64(7 - bit)) & np.uint64(1)
        self.key, self.of = np.unique(seen, return_inverse=True)
        self.ones = np.bincount(self.of, n * self.bit, len(self.key))
        self.zeros = np.bincount(self.of, n, len(self.key)) - self.ones


def dense(key: np.ndarray, bit: int) -> np.ndarray:
    """Depth-1 nodes of a bit as numbers under 65,536: the context's byte, then a one and the bits so far."""
    low = np.uint64((1 << bit) - 1)
    return (((key >> np.uint64(bit)) & np.uint64(255)) << np.uint64(8) | np.uint64(1 << bit) | key & low).astype(np.int64)


def weighed(nodes: list[Nodes], bit: int, first: int = 0, below: np.ndarray | None = None) -> tuple[list, list[np.ndarray], np.ndarray]:
    """Nodes of the depths from ``first`` on -> (parents' places, shares that stop, logarithms of the first depth's weighted estimates).

    below: the sums of the weighted logarithms under the deepest nodes; None: nothing is under them.
    """
    parent = [None] + [np.searchsorted(nodes[i - 1].key, nodes[i].key & np.uint64((1 << (8 * (first + i - 1) + bit)) - 1)) for i in range(1, len(nodes))]
    stop: list[np.ndarray] = [np.zeros(0)] * len(nodes)
    weighted = None
    for i in range(len(nodes) - 1, -1, -1):
        own = kt(nodes[i].zeros, nodes[i].ones)
        if weighted is None and below is None:
            stop[i], weighted = np.ones(len(own)), own
            continue
        if weighted is not None:
            up, size = parent[i + 1], len(own)
            rest = [np.maximum(0, a - np.bincount(up, b, size)) for a, b in ((nodes[i].zeros, nodes[i + 1].zeros), (nodes[i].ones, nodes[i + 1].ones))]
            below = np.bincount(up, weighted, size) + np.where(rest[0] + rest[1] > 0, kt(*rest), 0.0)
        weighted = np.logaddexp(own, below) - math.log(2)
        stop[i] = np.exp(own - math.log(2) - weighted)
    return parent, stop, weighted


def mixed(tables: list[tuple[np.ndarray, np.ndarray]], levels: tuple[int, ...] = LEVELS, first: int = 0, above=None, below: np.ndarray | None = None):
    """({depth: for each string, the probability of each of its 8 bits} under the weighted mixture of all depths up to it, passed).

    tables: from depth ``first`` on, strings of d bytes of context and a byte, sorted, with counts over all training
    text. above: by dense(), (probability mass, weight left) that depth 1 passes to depth 2, where first is 2;
    below: by dense(), what is under depth 1, where that is the deepest; ``passed`` is then the like of ``above``.
    """
    out = {d: np.zeros((len(tables[d - first][0]), 8)) for d in levels if first <= d < first + len(tables)}
    passed = np.zeros((2, 1 << 16))
    for bit in range(8):
        nodes = [Nodes(c, n.astype(float), bit) for c, n in tables]
        parent, stop, _ = weighed(nodes, bit, first, None if below is None else below[dense(nodes[-1].key, bit)])
        held, left = (np.zeros(1), np.ones(1)) if above is None else above[:, dense(nodes[0].key & np.uint64((1 << (8 + bit)) - 1), bit)]
        for i in range(len(tables)):
            if i:
                held, left = held[parent[i]], left[parent[i]]
            one = (nodes[i].ones + 0.5) / (nodes[i].zeros + nodes[i].ones + 1)
            if first + i in out:
                p = (held + left * one)[nodes[i].of]  # a path that ends here has all its weight left
                out[first + i][:, bit] = np.where(nodes[i].bit == 1, p, 1 - p)
            held, left = held + left * stop[i] * one, left * (1 - stop[i])
        if below is not None:
            passed[:, dense(nodes[-1].key, bit)] = held, left
    return out, passed


def shortened(code: np.ndarray, n: np.ndarray, first: int, last: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Strings and counts by depth of context, from ``first`` to ``last``."""
    out = []
    for d in range(first, last + 1):
        key, of = np.unique(code & np.uint64((1 << (8 * (d + 1))) - 1), return_inverse=True)
        out.append((key, np.bincount(of, n, len(key)).astype(np.int64)))
    return out


class Model:
    """Probabilities of strings by depth. With ``top`` (see crown), the tables are those of depth 2 and more of some contexts."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], levels: tuple[int, ...] = LEVELS, top: dict | None = None):
        first = 0 if top is None else 2
        self.codes, self.bits = (dict(top["codes"]), dict(top["bits"])) if top else ({}, {})
        if len(tables[0][0]):
            self.bits |= mixed(tables, levels, first, None if top is None else top["passed"])[0]
            self.codes |= {d: tables[d - first][0] for d in levels if d >= first}
        self.levels = tuple(d for d in levels if d in self.codes and len(self.codes[d]))

    def bits_of(self, code: np.ndarray) -> np.ndarray:
        """log2 of the probability of each string's last byte after the bytes before it."""
        if not self.levels or not len(code):
            return np.full(len(code), -8.0)
        keys = self.codes[self.levels[0]]
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        hit = keys[at] == code
        out = np.zeros(len(code))
        out[hit] = np.log2(self.bits[self.levels[0]]).sum(axis=1)[at[hit]]
        out[~hit] = self._unseen(code[~hit])
        return out

    def _unseen(self, code: np.ndarray) -> np.ndarray:
        """Bit by bit, from the deepest level that has the node: its bits so far are those of a neighbour in order."""
        total, bit = np.zeros(len(code)), np.zeros(len(code), np.int64)
        for d in self.levels:
            keys, probs = self.codes[d], self.bits[d]
            c = code & np.uint64((1 << (8 * (d + 1))) - 1)
            at = np.searchsorted(keys, c)
            best, agree = np.zeros(len(c), np.int64), np.full(len(c), -1)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(keys) - 1)):
                differ = keys[near] ^ c
                same = np.where(differ == 0, 8, 7 - np.floor(np.log2(np.maximum(differ, 1).astype(float))).astype(np.int64))
                same = np.where(differ >> np.uint64(8) == 0, same, -1)
                best, agree = np.where(same > agree, near, best), np.maximum(same, agree)
            for k in range(8):
                # the node of bit k is here if k bits agree; at the bit that differs, the other outcome is taken
                use = (bit == k) & (agree >= k)
                p = probs[best[use], k]
                total[use] += np.log2(np.where(agree[use] > k, p, 1 - p))
                bit[use] += 1
        return total - (8 - bit)


PACK, WORDS, STRINGS, REPLY, SCORES = range(5)
SENT, SENT_DDL = pa.schema([("place", pa.int64()), ("kind", pa.int32()), ("pack", pa.int64()), ("load", pa.binary())]), "place long, kind int, pack long, load binary"
SUMS, SUMS_DDL = pa.schema([("place", pa.int64()), ("n", pa.int64()), ("below", pa.float64())]), "place long, n long, below double"


def squeeze(*parts: bytes) -> bytes:
    body = b"".join(len(p).to_bytes(8, "little") + p for p in parts)
    return zstandard.ZstdCompressor(level=1).compress(body)


def unsqueeze(load: bytes) -> list[bytes]:
    body, out, at = zstandard.ZstdDecompressor().decompress(load), [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 8], "little")
        out.append(body[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def planes(code: np.ndarray) -> bytes:
    """Ordered strings as differences, byte by byte of the numbers, which compresses well."""
    return np.ascontiguousarray(np.diff(code, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T[: DEPTH + 1]).tobytes()


def from_planes(load: bytes) -> np.ndarray:
    x = np.frombuffer(load, np.uint8).reshape(DEPTH + 1, -1)
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, : DEPTH + 1] = x.T
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def worded(rows: list[tuple[bytes, bool]], buckets: int):
    """(text, held out) -> the pack's distinct words, their buckets and training counts, their order by bucket, and
    by document how many distinct words it has, which (as places in the order), and how often."""
    vocabulary: dict[bytes, int] = {}
    number, times, kinds, train = [], [], [], {}
    for t, held_out in rows:
        own: dict[bytes, int] = {}
        for w in t.lower().split():
            own[w] = own.get(w, 0) + 1
        at = [vocabulary.setdefault(w, len(vocabulary)) for w in own]
        number += at
        times += own.values()
        kinds.append(len(at))
        if not held_out:
            for i, n in zip(at, own.values(), strict=True):
                train[i] = train.get(i, 0) + n
    words = list(vocabulary)
    bucket = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in words], np.int64)
    counts = np.array([train.get(i, 0) for i in range(len(words))], np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return words, bucket, counts, order, np.array(kinds, np.int64), place[np.array(number, np.int64)], np.array(times, np.int64)


def stretches(bucket: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bucket, where its stretch of the order begins, the stretch)."""
    if len(order):
        cut = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1), len(order)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield int(bucket[order[a]]), int(a), order[a:b]


def packs(buckets: int):
    """(doc_id, held_out, text) -> packs of documents, and each pack's distinct words and strings by bucket, with their training counts.

    A pack's number is its task's and its place there. The rows are written before use, and of a task's attempts
    one is written, so no two packs share a number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (((d, h), t) for b in batches for d, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), strict=True))
        task = TaskContext.get().partitionId() << 32
        for key, held in enumerate(grouped(rows, PACKED), task):
            texts = [(t, h) for (_, h), t in held]
            words, bucket, counts, order, *_ = worded(texts, buckets)
            code, n = distinct(texts)
            ids = pa.array([d for (d, _), _ in held], pa.int64())
            known = np.array([d is not None for (d, _), _ in held], bool)
            size = np.array([len(t) for t, _ in texts], np.int64)
            load = squeeze(np.array(ids.fill_null(0).to_pylist(), np.int64).tobytes(), known.tobytes(), np.array([h for _, h in texts], bool).tobytes(), size.tobytes(), b"".join(t for t, _ in texts), planes(code))
            yield batch(SENT, [key], [PACK], [key], [load])
            for b, a, some in stretches(bucket, order):
                yield batch(SENT, [b], [WORDS], [key], [squeeze(b" ".join(words[i] for i in some), counts[some].tobytes(), a.to_bytes(8, "little"))])
            bucket = bucket_of(code, buckets)
            for b, a, some in stretches(bucket, np.argsort(bucket, kind="stable")):
                yield batch(SENT, [b], [STRINGS], [key], [squeeze(planes(code[some]), n[some].tobytes(), a.to_bytes(8, "little"))])

    return run


def gathered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes, np.ndarray]]]:
    """One bucket of strings -> they in order, their training counts, and for each pack (pack, start, where its strings are)."""
    parts = [(p, *unsqueeze(x)) for p, x in zip(rows["pack"].to_pylist(), rows["load"].to_pylist(), strict=True)]
    own = [from_planes(c) for _, c, _, _ in parts]
    code, at = np.unique(turned_back(np.concatenate(own)), return_inverse=True)
    n = np.bincount(at, np.concatenate([np.frombuffer(n, np.int64) for _, _, n, _ in parts]), len(code)).astype(np.int64)
    ends = np.cumsum([len(c) for c in own])
    return code, n, [(p, start, x) for (p, _, _, start), x in zip(parts, np.split(at, ends[:-1]), strict=True)]


def weights(rows: pa.Table) -> pa.Table:
    """One bucket of strings -> (place, n, below): under 65,536 counts of strings of depth 1, above them what the bucket has under their nodes."""
    code, n, _ = gathered(rows)
    code, n = code[n > 0], n[n > 0]
    top, count = shortened(code, n, 1, 1)[0]
    out = [batch(SUMS, top.astype(np.int64), count, np.zeros(len(top)))]
    tables = shortened(code, n, 2, DEPTH)
    for bit in range(8) if len(code) else ():
        nodes = [Nodes(c, k.astype(float), bit) for c, k in tables]
        place, of = np.unique(dense(nodes[0].key & np.uint64((1 << (8 + bit)) - 1), bit), return_inverse=True)
        below = np.bincount(of, weighed(nodes, bit, 2)[2], len(place))
        out.append(batch(SUMS, place + (1 << 16), np.zeros(len(place), np.int64), below))
    return pa.Table.from_batches(out, SUMS)


def crown(rows: list) -> dict:
    """Sums of weights() over all buckets -> probabilities of the strings of depths 1 and 0, and what depth 1 passes to depth 2."""
    count, below = np.zeros(1 << 16, np.int64), np.zeros(1 << 16)
    for r in rows:
        if r.place < 1 << 16:
            count[r.place] = r.n
        else:
            below[r.place - (1 << 16)] = r.below
    code = np.flatnonzero(count).astype(np.uint64)
    tables = shortened(code, count[code.astype(np.int64)], 0, 1)
    bits, passed = mixed(tables, (1, 0), 0, None, below)
    return {"codes": {d: c for d, (c, _) in enumerate(tables)}, "bits": bits, "passed": passed}


def guessed(top):
    """One bucket of strings -> for each pack, log2 of the probability of each of its strings there."""

    def run(rows: pa.Table) -> pa.Table:
        code, n, parts = gathered(rows)
        value = Model(shortened(code[n > 0], n[n > 0], 2, DEPTH), LEVELS, top.value).bits_of(code).astype(np.float32)
        return pa.Table.from_batches([batch(SENT, *zip(*[(p, SCORES, p, squeeze(value[at].tobytes(), start)) for p, start, at in parts], strict=True))])

    return run


def answered(rows: pa.Table) -> pa.Table:
    """One bucket of words -> for each pack, the training counts of its words there, and the bucket's distinct words and tokens."""
    parts = [(p, *unsqueeze(x)) for p, x in zip(rows["pack"].to_pylist(), rows["load"].to_pylist(), strict=True)]
    total: dict[bytes, int] = {}
    for _, words, counts, _ in parts:
        for w, n in zip(words.split(b" "), np.frombuffer(counts, np.int64).tolist(), strict=True):
            total[w] = total.get(w, 0) + n
    out = [(p, REPLY, p, squeeze(np.array([total[w] for w in words.split(b" ")], np.int64).tobytes(), at)) for p, words, _, at in parts]
    seen = sum(n > 0 for n in total.values())
    out.append((-1, REPLY, seen, str(sum(total.values())).encode()))
    return pa.Table.from_batches([batch(SENT, *zip(*out, strict=True))])


def totalled(tokens: int, distinct: int, documents: int, buckets: int):
    """A pack with the replies to it -> its documents' rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def run(rows: pa.Table) -> pa.Table:
        kinds, loads = rows["kind"].to_pylist(), rows["load"].to_pylist()
        replies = {k: [unsqueeze(x) for kind, x in zip(kinds, loads, strict=True) if kind == k] for k in (REPLY, SCORES)}
        out = []
        for load in (x for k, x in zip(kinds, loads, strict=True) if k == PACK):
            ids, known, held, size, text, code = unsqueeze(load)
            size, held, code = np.frombuffer(size, np.int64), np.frombuffer(held, bool), from_planes(code)
            ends = np.cumsum(size).tolist()
            texts = [text[b - n : b] for b, n in zip(ends, size.tolist(), strict=True)]
            words, _, _, _, n, at, times = worded([(t, True) for t in texts], buckets)
            counts = np.zeros(len(words), np.int64)
            for c, start in replies[REPLY]:
                c, start = np.frombuffer(c, np.int64), int.from_bytes(start, "little")
                counts[start : start + len(c)] = c
            value = np.zeros(len(code))
            for v, start in replies[SCORES]:
                v, start = np.frombuffer(v, np.float32), int.from_bytes(start, "little")
                value[start : start + len(v)] = v
            by_code = np.empty(len(code))
            by_code[np.argsort(bucket_of(code, buckets), kind="stable")] = value
            score, first = np.zeros(len(texts)), 0
            for some in grouped((None, t) for t in texts):
                many = np.array([len(t) + 1 for _, t in some], np.int64)
                bits = by_code[np.searchsorted(code, strings([t for _, t in some], DEPTH, True))]
                score[first : first + len(some)] = np.add.reduceat(bits, np.cumsum(many) - many)
                first += len(some)
            doc = np.repeat(np.arange(len(n)), n)
            c = counts[at]
            n_tokens = np.bincount(doc, times, len(n)).astype(np.int64) + 1
            n_known = np.bincount(doc, times * (c > 0), len(n)).astype(np.int64) + (documents > 0)
            base = np.bincount(doc, times * np.log10(c + 1.0), len(n)) + math.log10(documents + 1) - n_tokens * math.log10(tokens + distinct + 1)
            doc_ids = pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(known, bool))
            out.append(batch(schema, doc_ids, held, n_tokens, n_known, np.full(len(n), tokens), base, score * math.log10(2), -score / (size + 1)))
        return pa.Table.from_batches(out, schema)

    return run


def scored(docs: DataFrame) -> DataFrame:
    """Documents -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    Learnt from the texts of rows whose crc32(doc_id) mod 7 is not 2. The score is the log10 probability of the
    text's bytes and its end. Null texts are empty: one end token. Rows with one doc_id, equal or not, are scored one
    by one. No training row: every byte costs 8 bits. Empty table: no rows. A text of any length is counted and
    scored a megabyte at a time. Words and strings of context travel to their counts and back as each
    pack's distinct ones by bucket, never as (document, word) rows. Every string of the training text counts: a
    bucket has all contexts that share two bytes, and only what is under depth 1 (65,536 nodes at most) meets.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(7) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(~F.col("held_out"), 1)).alias("documents")).first()
    documents, buckets = size.documents, max(2 * partitions(spark), (size.bytes or 0) // BUCKET)
    sent = written(rows.mapInArrow(packs(buckets), SENT_DDL))
    asked = sent.where(F.col("kind") == STRINGS)
    below = F.aggregate(F.array_sort(F.collect_list("below")), F.lit(0.0), lambda a, x: a + x)  # in one order, whatever the tasks'
    top = spark.sparkContext.broadcast(crown(asked.groupBy("place").applyInArrow(weights, SUMS_DDL).groupBy("place").agg(F.sum("n").alias("n"), below.alias("below")).collect()))
    guesses = written(asked.groupBy("place").applyInArrow(guessed(top), SENT_DDL))
    top.destroy()  # what needed it is in the shared folder
    replies = written(sent.where(F.col("kind") == WORDS).groupBy("place").applyInArrow(answered, SENT_DDL))
    sums = replies.where("place = -1").agg(F.sum("pack").alias("v"), F.sum(F.col("load").cast("string").cast("long")).alias("n")).first()
    tokens, distinct = (sums.n or 0) + documents, (sums.v or 0) + (documents > 0)
    both = sent.where(F.col("kind") == PACK).unionByName(replies.where("place <> -1")).unionByName(guesses)
    return both.groupBy("pack").applyInArrow(totalled(tokens, distinct, documents, buckets), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
