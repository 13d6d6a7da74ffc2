"""Benchmark decontamination: BM25 index of test items, block-max WAND, verified overlap with question and answer."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import batch, texts

WORD = re.compile(r"\w+")
#: What stands before the answer of an item: a question mark, or a line that begins with a word for it.
ANSWER = re.compile(r"\?|^[ \t]*(?:answer|solution|a)[ \t]*:", re.IGNORECASE | re.MULTILINE)
#: Words of a shingle, the least share of an item's shingles, the share of the words of question and of answer that must be exceeded, items of an index block, bytes of items in one index.
WIDTH, LEAST, MOST, BLOCK, INDEX_BYTES = 5, 0.8, 0.5, 8, 8 << 20
K1, B = 1.2, 0.75


def parts(text: str) -> tuple[int, int]:
    """Words of the question and of the answer: what follows ANSWER's last match; without one, all is question."""
    for found in reversed(list(ANSWER.finditer(text))):
        head, tail = text[: found.end()], text[found.end() :]
        if WORD.search(text[: found.start()]) and WORD.search(tail):
            return len(WORD.findall(head)), len(WORD.findall(tail))
    return len(WORD.findall(text)), 0


class Index:
    """Postings of BM25 weights scaled so that an item's threshold is 1, with maxima by block of items.

    At the threshold no leak is lost: a passage that has LEAST of an item's shingles lacks at most as
    many of its words as it lacks shingles, so its score is at least the item's own less the largest
    weights of that many words.
    """

    def __init__(self, items: list[tuple[int, str]]):
        kept = [(i, w, t) for i, t in sorted(items) if (w := WORD.findall((t or "").lower()))]
        self.ids = [i for i, _, _ in kept]
        self.split = [parts(t) for _, _, t in kept]
        self.term: dict[str, int] = {}
        words = [[self.term.setdefault(x, len(self.term)) for x in w] for _, w, _ in kept]
        self.most = max(map(len, words), default=1)
        df = Counter(t for w in words for t in set(w))
        mean = sum(map(len, words)) / max(1, len(words))
        post: list[dict[int, float]] = [{} for _ in self.term]
        top: list[dict[int, float]] = [{} for _ in self.term]
        self.shingles: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        self.total = []
        for n, w in enumerate(words):
            weight = {t: np.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in Counter(w).items()}
            width = min(WIDTH, len(w))
            count = len(w) - width + 1
            lacking = sorted(weight.values(), reverse=True)[: int((1 - LEAST) * count + 1e-9)]
            least = max(1e-9, sum(weight.values()) - sum(lacking) - 1e-9)
            for t, x in weight.items():
                post[t][n] = x / least
                top[t][n // BLOCK] = max(top[t].get(n // BLOCK, 0.0), x / least)
            for at in range(count):
                self.shingles[tuple(w[at : at + width])].append((n, at))
            self.total.append(count)
        self.blocks = -(-len(words) // BLOCK)
        self.post, self.top = self._rows(post), self._rows(top)
        self.peak = [max(x.values(), default=0.0) for x in post]
        self.widths = sorted({len(s) for s in self.shingles})

    @staticmethod
    def _rows(by_term: list[dict[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in by_term], np.int64)
        flat = [(k, v) for x in by_term for k, v in sorted(x.items())]
        return np.concatenate([[0], np.cumsum(sizes)]), np.array([k for k, _ in flat], np.int64), np.array([v for _, v in flat])

    @staticmethod
    def _sums(rows, passage: np.ndarray, term: np.ndarray, width: int, count: int) -> np.ndarray:
        start, at, value = rows
        n = start[term + 1] - start[term]
        cell = np.repeat(passage * width, n)
        pick = np.repeat(start[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(cell + at[pick], value[pick], count * width).reshape(count, width)

    def wand(self, terms: list[int]) -> Iterator[int]:
        """Items that score 1 or more for a passage with these terms, in order.

        Lists stand in order of the item that each is at. The pivot is the first at which the peaks add up to 1: no
        item before it can. If the maxima of its block add up to less, all lists up to it go on to the next block.
        """
        start, item, value = self.post
        top_start, top_block, top_value = self.top
        most = {t: dict(zip(top_block[a:b].tolist(), top_value[a:b].tolist(), strict=True)) for t in terms for a, b in [top_start[t : t + 2]]}
        lists = {t: item[start[t] : start[t + 1]].tolist() for t in terms}
        place = dict.fromkeys(terms, 0)
        heads = sorted((own[0], t) for t, own in lists.items() if own)
        while heads:
            reach, pivot = 0.0, -1
            for n, (_, t) in enumerate(heads):
                reach += self.peak[t]
                if reach >= 1 - 1e-9:
                    pivot = n
                    break
            if pivot < 0:
                return
            at = heads[pivot][0]
            while pivot + 1 < len(heads) and heads[pivot + 1][0] == at:
                pivot += 1
            block = at // BLOCK
            if sum(most[t].get(block, 0.0) for _, t in heads[: pivot + 1]) < 1 - 1e-9:
                # those in the block's bound can reach nothing up to its end or the next list's item
                to = (block + 1) * BLOCK
                if pivot + 1 < len(heads):
                    to = min(to, max(heads[pivot + 1][0], at + 1))
            elif heads[0][0] == at:
                if sum(value[start[t] + place[t]] for i, t in heads[: pivot + 1]) >= 1:
                    yield at
                to = at + 1
            else:
                to = at
            moved = []
            for i, t in heads[: pivot + 1]:
                if i < to:
                    place[t] = bisect_left(lists[t], to, place[t])
                if place[t] < len(lists[t]):
                    moved.append((lists[t][place[t]], t))
            heads = sorted(moved + heads[pivot + 1 :])

    def search(self, text: str) -> list[tuple[int, float, float, float, int]]:
        """(item_id, overlap, question overlap, answer overlap, word position) of every leaked item."""
        get = self.term.get
        ids = np.array([get(w, -1) for w in WORD.findall(text.lower())], np.int64)
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return []
        best: dict[int, tuple[float, float, float, int]] = {}
        # every stretch of `most` words lies in one passage of twice that
        for lo in range(0, len(ids), self.most * 512):
            pos = known[(known >= lo) & (known < lo + self.most * 513)]
            if not len(pos):
                continue
            base = (pos - lo) // self.most
            pair = np.unique(np.concatenate([base[base < 512] * len(self.term) + ids[pos[base < 512]], (base[base > 0] - 1) * len(self.term) + ids[pos[base > 0]]]))
            passage, term = pair // len(self.term), pair % len(self.term)
            count = int(passage.max()) + 1
            # most passages reach the threshold in no block; these need no pivot
            for p in np.flatnonzero((self._sums(self.top, passage, term, self.blocks, count) >= 1 - 1e-9).any(axis=1)).tolist():
                at = lo + p * self.most
                words = ids[at : at + 2 * self.most].tolist()
                for n in self.wand(term[passage == p].tolist()):
                    got = self._overlap(words, n)
                    if got[0] >= LEAST and min(got[1:]) > MOST and got > best.get(n, (0.0,))[:3]:
                        best[n] = (*got, at)
        return [(self.ids[n], *x) for n, x in sorted(best.items())]

    def _overlap(self, words: list[int], n: int) -> tuple[float, float, float]:
        """Shares of the item's shingles found, and of the words of its question and its answer that these cover."""
        found = [(at, width) for width in self.widths for i in range(len(words) - width + 1) for m, at in self.shingles.get(tuple(words[i : i + width]), ()) if m == n]
        covered = {at + k for at, width in found for k in range(width)}
        q, a = self.split[n]
        asked = sum(k < q for k in covered)
        return len({at for at, _ in found}) / self.total[n], asked / q, (len(covered) - asked) / a if a else 1.0


def blocks_of(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Test items in blocks of bounded bytes; one block where the benchmark is small, as it is meant to be."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null").distinct().orderBy("i", "t").toLocalIterator():
        held.append((r.i, r.t))
        size += len(r.t or "")
        if size > INDEX_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, overlap, question_overlap, answer_overlap, position): an item found in a document.

    A pair counts if some passage has at least LEAST of the item's five-word shingles (fewer words: the whole
    sequence), and the shingles found cover more than MOST of the words of the question and of the answer, where the
    item has one: a question alone is no leak. answer_overlap is 1 without an answer part. One row per
    document row and item, for its best passage; ties go to the earliest. Null or empty texts
    and items without words match nothing; an empty benchmark gives no rows. Every word of every
    document is queried, one document in memory at a time; the index has a bounded size and a
    larger benchmark takes one pass a block.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("position", pa.int64())])
    ddl = "doc_id long, item_id long, overlap double, question_overlap double, answer_overlap double, position long"
    rows = texts(docs)

    def one(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for x in index.search(t)]
                yield batch(schema, *(zip(*out, strict=True) if out else [[]] * 6))

        return rows.mapInArrow(run, ddl)

    out = None
    for held in blocks_of(items):
        index = Index(held)
        if index.ids:
            out = one(index) if out is None else out.unionByName(one(index))
    return rows.sparkSession.createDataFrame([], ddl) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, columns as they are, in which no test item is found. Null texts stay."""
    out, at = docs, docs.columns.index("text")

    def one(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not (t and index.search(t)) for t in b.column(at).to_pylist()], pa.bool_()))

        return run

    for held in blocks_of(items):
        index = Index(held)
        if index.ids:
            out = out.mapInArrow(one(index), docs.schema)
    return out
