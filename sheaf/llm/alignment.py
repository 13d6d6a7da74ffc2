"""Cross-tokenizer alignment: overlapping tokens of two vocabularies, counted over the corpus behind a minimal perfect hash."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import batch, texts, written

#: Tokens of both vocabularies after which a chunk of documents ends, lanes of A ids, and bits a key of a hash level.
CHUNK, LANES, ROOM = 2_000_000, 256, 1.6
#: A key is a pair: A's id above, B's id below these bits.
BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)


# -- two tokenizers ------------------------------------------------------------------------------


def byte_level() -> dict[str, int]:
    """Each character of a byte-level vocabulary -> its byte: printable bytes stand for themselves, the others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def tokenizers(path_a: str, path_b: str, ranks_a: str | None = None) -> tuple[Callable, Callable, list[bytes], list[bytes]]:
    """(encode A, encode B, bytes of A's ids, bytes of B's ids); special tokens' strings are plain text.

    ``ranks_a`` is A's vocabulary as ranks; the same merges then run without A's library, with the same ids
    (tested on every code point).
    """
    import public_tokenizers
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    decode = byte_level()
    entries = a.get_vocab()
    bytes_a = [b""] * (max(entries.values()) + 1)
    for s, i in entries.items():
        bytes_a[i] = bytes(decode[c] for c in s) if all(c in decode for c in s) else s.encode()
    if ranks_a:
        with open(ranks_a, "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        encode_a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    else:
        encode_a = lambda t: a.encode(t, add_special_tokens=False).ids
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    piece = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
    return encode_a, lambda t: b.encode(t, num_threads=1), bytes_a, bytes_b


def tokens(text: str | None, encode_a: Callable, encode_b: Callable, bytes_a: list[bytes], bytes_b: list[bytes]) -> tuple[list[int], list[int]]:
    """Ids of " " + text by A and of text by B; none where either's bytes are not those of " " + text."""
    if not text:
        return [], []
    a, b, whole = encode_a(" " + text), encode_b(text), b" " + text.encode()
    if b"".join(map(bytes_a.__getitem__, a)) != whole or b"".join(map(bytes_b.__getitem__, b)) != whole:
        return [], []
    return a, b


# -- alignment -----------------------------------------------------------------------------------


def merged(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of both cuts of the same bytes -> per stretch between two cuts: A's token, B's token, whether both end there.

    A stretch lies in one token of either side, and two tokens overlap in exactly one stretch.
    """
    ends = np.concatenate([end_a, end_b])
    ends.sort(kind="stable")
    once = np.concatenate([ends[1:] != ends[:-1], [True]]) if len(ends) else np.zeros(0, bool)
    both = np.concatenate([[False], ends[1:] == ends[:-1]]) if len(ends) else np.zeros(0, bool)
    ends, both = ends[once], both[once]
    return np.searchsorted(end_a, ends), np.searchsorted(end_b, ends), both


class Chunk:
    """Documents' ids one after the other, aligned at once."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        at_a, at_b, self.both = merged(np.cumsum(size_a[a]), np.cumsum(size_b[b]))
        self.at_a, self.at_b = at_a, at_b
        self.key = a[at_a].astype(np.int64) << BITS | b[at_b]
        first_a = np.concatenate([[0], np.cumsum(n_a)])
        self.cut = np.searchsorted(at_a, first_a)  # links of document i: cut[i] to cut[i + 1]

    def sums(self, per_link: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(per_link)])
        return total[self.cut[1:]] - total[self.cut[:-1]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys by lane, in how many of the documents each stands, place of each link's key among them)."""
        keys, place = np.unique(self.key, return_inverse=True)
        doc = np.repeat(np.arange(len(self.n_a)), np.diff(self.cut))
        count = np.bincount(np.unique(place.astype(np.int64) * max(1, len(self.n_a)) + doc) // max(1, len(self.n_a)), minlength=len(keys))
        order = np.argsort(lane(keys), kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return keys[order], count[order], back[place]

    def groups(self, name_a: np.ndarray, name_b: np.ndarray) -> list[str]:
        """Each document's groups as text; the names are tables (inside a group or at its end, id)."""
        last = np.flatnonzero(self.both)
        end_a, end_b = self.at_a[last], self.at_b[last]  # last tokens of the groups
        group_a = np.searchsorted(end_a, np.arange(len(self.a)))
        group_b = np.searchsorted(end_b, np.arange(len(self.b)))
        is_a, is_b = np.zeros(len(self.a), int), np.zeros(len(self.b), int)
        is_a[end_a], is_b[end_b] = 1, 1
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + np.concatenate([[0], end_b + 1])[group_a]] = name_a[is_a, self.a]
        out[np.arange(len(self.b)) + (end_a + 1)[group_b]] = name_b[is_b, self.b]
        cut = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(out[s:e].tolist())[:-1] for s, e in zip([0, *cut[:-1]], cut, strict=True)]


def lane(keys: np.ndarray) -> np.ndarray:
    """All pairs of an A id are in one lane, which therefore has at most its share of A's ids times B's vocabulary."""
    return ((keys >> BITS).astype(np.uint64) * MIX >> np.uint64(40)).astype(np.int64) % LANES


def squeezed(x: np.ndarray) -> bytes:
    """Numbers as bytes; sorted keys go as differences."""
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def opened(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def differences(keys: np.ndarray) -> bytes:
    return squeezed(np.diff(keys, prepend=0))


def summed(x: bytes) -> np.ndarray:
    return np.cumsum(opened(x, np.int64))


# -- minimal perfect hash ------------------------------------------------------------------------


def spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (keys.astype(np.uint64) + np.uint64(level + 1) * np.uint64(0xD6E8FEB86659FD93)) * MIX
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ h >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Distinct keys -> 0 to n - 1 without gaps: a bit a level for each key that meets no other there; the rest go a level down."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray | None = None):
        self.levels, self.keys = levels, keys
        self.before, n = [], 0
        for bits in levels:
            self.before.append(n + np.cumsum(bits, dtype=np.int64) - bits)
            n += int(bits.sum())

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = int(len(left) * ROOM) + 8
            at = spot(left, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        out = cls(levels)
        out.keys = np.zeros(len(keys), np.int64)
        out.keys[out.place(keys)] = keys
        return out

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; a key that is not among those hashed gets some number or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = spot(keys[left], n, len(bits))
            hit = bits[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out

    def verified(self, keys: np.ndarray) -> np.ndarray:
        """As ``place``, with the stored key compared."""
        out = self.place(keys)
        if (out < 0).any() or (self.keys[out] != keys).any():
            raise ValueError("a pair is missing from the index")
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.keys), *(len(b) for b in self.levels)], np.int64)
        packed = [np.packbits(b).tobytes() for b in self.levels]
        return len(head).to_bytes(8, "little") + head.tobytes() + b"".join(packed) + squeezed(self.keys)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int.from_bytes(data[:8], "little")
        head, at, levels = np.frombuffer(data[8 : 8 + 8 * n], np.int64), 8 + 8 * n, []
        for size in head[1:].tolist():
            levels.append(np.unpackbits(np.frombuffer(data[at : at + (size + 7) // 8], np.uint8), count=size).astype(bool))
            at += (size + 7) // 8
        return cls(levels, opened(data[at:], np.int64))


# -- jobs ----------------------------------------------------------------------------------------

#: chunk, lane (-1: the chunk's documents), and the row's arrays.
CHUNKS = "chunk long, lane int, x binary, y binary, z binary"
CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("lane", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
REST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def chunks(path_a: str, path_b: str, ranks_a: str | None):
    """Documents -> chunks: their ids, their digests (as an Arrow table), and, by lane, the distinct pairs with document counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode_a, encode_b, bytes_a, bytes_b = tokenizers(path_a, path_b, ranks_a)
        size_a, size_b = (np.array(list(map(len, x)), np.int64) for x in (bytes_a, bytes_b))
        names = [np.array([[str(i) + sep for i in range(len(x))] for sep in seps], object) for x, seps in ((bytes_a, ",|"), (bytes_b, ",;"))]
        at, ids, a, b = TaskContext.get().partitionId() << 32, [], [], []

        def turn() -> Iterator[pa.RecordBatch]:
            nonlocal at
            n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
            flat_a, flat_b = np.concatenate(a), np.concatenate(b)
            c = Chunk(flat_a, flat_b, n_a, n_b, size_a, size_b)
            said = [hashlib.sha256(t.encode()).hexdigest() if n else "" for t, n in zip(c.groups(*names), n_a.tolist(), strict=True)]
            digest = [pa.array(x, t) for x, t in ((ids, pa.int64()), (n_a, pa.int64()), (n_b, pa.int64()), (c.sums(c.both), pa.int64()), (np.diff(c.cut), pa.int64()), (said, pa.string()))]
            sink = pa.BufferOutputStream()
            whole = pa.RecordBatch.from_arrays(digest, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            with pa.ipc.new_stream(sink, whole.schema) as w:
                w.write_batch(whole)
            small = lambda x: x.astype("<u2") if x.max(initial=0) < 1 << 16 else x.astype("<i4")
            parts = [squeezed(small(x)) for x in (flat_a, flat_b)]
            wide = bytes(int(x.max(initial=0) >= 1 << 16) for x in (flat_a, flat_b))
            yield batch(CHUNK_SCHEMA, [at], [-1], [wide + parts[0]], [parts[1]], [sink.getvalue().to_pybytes()])
            keys, count, _ = c.pairs()
            own = lane(keys)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]).tolist() if len(own) else [0]
            rows = [(at, int(own[s]), differences(keys[s:e]), squeezed(count[s:e].astype("<u4")), None) for s, e in zip(cut[:-1], cut[1:], strict=True)]
            if rows:
                yield batch(CHUNK_SCHEMA, *zip(*rows, strict=True))
            at += 1
            ids.clear(), a.clear(), b.clear()

        size = 0
        for rows in batches:
            for d, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                x, y = tokens(t, encode_a, encode_b, bytes_a, bytes_b)
                ids.append(d)
                a.append(np.array(x, np.int32))
                b.append(np.array(y, np.int32))
                size += len(x) + len(y)
                if size >= CHUNK:
                    yield from turn()
                    size = 0
        if ids:
            yield from turn()

    return run


LANE_SCHEMA = pa.schema([("lane", pa.int32()), ("part", pa.int64()), ("x", pa.binary())])
LANE = "lane int, part long, x binary"


def union(final: bool):
    """Rows (lane, part, x) of one lane: sets of keys -> their union, or in the end its perfect hash."""

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key = np.zeros(0, np.int64), None
        for b in group:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = row[:2]
                own = np.union1d(own, summed(row[2]))
        if key:
            yield batch(LANE_SCHEMA, [key[0]], [key[1]], [PerfectHash.of(own).dump() if final else differences(own)])

    return run


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lane, part, rank, x, y) in order, the lane's hash first -> the part's dense count vector. A task holds one of each."""
    now, own, count = None, None, None
    for b in batches:
        for one, part, rank, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (one, part) != now:
                if now:
                    yield batch(LANE_SCHEMA, [now[0]], [now[1]], [squeezed(count)])
                now = one, part
            if not rank:
                own = PerfectHash.load(x)
                count = np.zeros(len(own.keys), np.int64)
            else:
                count[own.verified(summed(x))] += opened(y, "<u4")
    if now:
        yield batch(LANE_SCHEMA, [now[0]], [now[1]], [squeezed(count)])


def added(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dense vectors of one lane -> their sum."""
    total, key = None, None
    for b in group:
        for one, part, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            key = one, part
            total = opened(x, np.int64) if total is None else total + opened(x, np.int64)
    if key:
        yield batch(LANE_SCHEMA, [key[0]], [key[1]], [squeezed(total)])


def best(keys: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which pairs have the highest count of their A id."""
    ids, of = np.unique(keys >> BITS, return_inverse=True)
    most = np.zeros(len(ids), np.int64)
    np.maximum.at(most, of, count)
    return count == most[of]


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lane, part, chunk, x, y) in order, the lane's hash and counts first (chunk -1) -> a chunk's counts, signed: best or not."""
    own = signed = None
    for b in batches:
        out = []
        for one, _, chunk, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if chunk < 0:
                own, count = PerfectHash.load(x), opened(y, np.int64)
                signed = np.where(best(own.keys, count), count, -count)
            else:
                got = signed[own.verified(summed(x))]
                small = "<i2" if abs(got).max(initial=0) < 1 << 15 else "<i8"
                out.append((chunk, one, (b"2" if small == "<i2" else b"8") + squeezed(got.astype(small)), None, None))
        if out:
            yield batch(CHUNK_SCHEMA, *zip(*out, strict=True))


def counted(path_a: str, path_b: str):
    """Rows of a chunk in order of the lane, its documents last -> one row a document."""
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, bytes_a, bytes_b = tokenizers(path_a, path_b)
        size_a, size_b = (np.array(list(map(len, x)), np.int64) for x in (bytes_a, bytes_b))
        held: list[np.ndarray] = []
        for b in batches:
            for one, x, y, z in zip(b.column("lane").to_pylist(), *(b.column(c).to_pylist() for c in "xyz"), strict=True):
                if one >= 0:
                    held.append(opened(x[1:], "<i2" if x[:1] == b"2" else "<i8").astype(np.int64))
                    continue
                said = pa.ipc.open_stream(z).read_all().to_batches()[0]
                n_a, n_b = said.column("n_a").to_numpy(), said.column("n_b").to_numpy()
                c = Chunk(opened(x[2:], "<i4" if x[0] else "<u2").astype(np.int32), opened(y, "<i4" if x[1] else "<u2").astype(np.int32), n_a, n_b, size_a, size_b)
                keys, _, place = c.pairs()
                count = np.concatenate(held) if held else np.zeros(0, np.int64)
                if len(count) != len(keys):
                    raise ValueError("a chunk has pairs without counts")
                held = []
                per_link = count[place]
                yield batch(schema, *said.columns[:5], c.sums(per_link > 0), c.sums(abs(per_link)), said.column("groups_sha256"))

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str, ranks_a: str | None = None) -> DataFrame:
    """Documents -> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row a document.

    First pass: documents are tokenized, aligned and written as chunks of ids, with each chunk's distinct pairs.
    The pairs of an A id share one of LANES lanes. A lane's pairs are united in two levels and get a minimal
    perfect hash; counts are dense vectors in its order, summed in two levels, each key verified. Second pass: chunks are aligned
    again from their ids and get the counts of their pairs from the lanes. The tokenizers run once.

    Levels have about the square root of the chunks as their width, so a group holds that many parts of one lane. A pair counts a
    document once, however often it holds it, and a chunk's counts are summed before they travel: a pair that
    all documents hold is one number a chunk. A lane has at most A's ids / LANES * B's ids pairs, at any size.
    Nothing goes through the driver, nothing is broadcast.

    Texts null or empty, and those that a tokenizer does not give back, have zeros and ''. Every row is a document,
    repeated rows and null doc_ids too. Ties for an A id's highest count are all best. A text of any length is cut whole and is a chunk.
    Empty table: no rows.
    """
    cut = written(texts(docs).mapInArrow(chunks(path_a, path_b, ranks_a), CHUNKS))
    pairs, own = cut.where("lane >= 0"), cut.where("lane < 0")
    n = own.count()
    wide = max(1, int(np.sqrt(n)))
    part = F.pmod(F.xxhash64("chunk"), F.lit(wide)).alias("part")
    sets = pairs.select("lane", part, "x").groupBy("lane", "part").applyInArrow(union(False), LANE)
    index = written(sets.withColumn("part", F.lit(0).cast("long")).groupBy("lane").applyInArrow(union(True), LANE).select("lane", "x"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long"))).alias("part")
    none = F.lit(None).cast("binary")
    streams = index.select("lane", every, F.lit(0).alias("rank"), "x", none.alias("y")).unionByName(pairs.select("lane", part, F.lit(1).alias("rank"), "x", "y"))
    dense = streams.repartition("lane", "part").sortWithinPartitions("lane", "part", "rank").mapInArrow(vectors, LANE)
    counts = dense.withColumn("part", F.lit(0).cast("long")).groupBy("lane").applyInArrow(added, LANE).select("lane", F.col("x").alias("y"))
    full = written(index.join(counts, "lane"))
    asked = full.select("lane", every, F.lit(-1).cast("long").alias("chunk"), "x", "y").unionByName(pairs.select("lane", part, "chunk", "x", none.alias("y")))
    told = asked.repartition("lane", "part").sortWithinPartitions("lane", "part", "chunk").mapInArrow(answers, CHUNKS)
    both = told.unionByName(own).repartition("chunk").sortWithinPartitions("chunk", F.col("lane") < 0, "lane")
    return both.mapInArrow(counted(path_a, path_b), REST.replace("groups_sha256 string", "n_best long, count_sum long, groups_sha256 string"))
