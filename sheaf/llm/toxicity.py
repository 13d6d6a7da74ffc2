"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import partitions, remainder, written

WORD = re.compile(r"\w+")
#: Labelled rows of either class that the classifier is fitted on (expected number, by a hash of doc_id).
EXAMPLES = 8000
#: Examples that a term's toxic share is shrunk by, so that few occurrences weigh little at any number of labels; examples of a block; neighbours.
SHRUNK, BLOCK, NEAREST = 10.0, 64, 25
#: Terms whose lists are kept dense (the longest lists), texts searched together, blocks that a text opens first, examples by which the others are put in order.
DENSE, TOGETHER, FIRST, PIVOTS = 512, 128, 4, 48
#: Distinct terms that a task counts before it gives them out.
HELD = 500_000


def label_sample(labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """(doc_id, toxic, weight): at most about ``most`` rows a class; weight is how many rows one stands for."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = known.where(remainder(5) != 0)
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {k: min(1.0, most / v) for k, v in n.items()}
    rate = F.when(F.col("toxic") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000))
    return known.withColumn("weight", 1 / rate).where(draw < rate * 1_000_000)


def counted(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def alike(term: np.ndarray, row: np.ndarray, x: np.ndarray, long: int, count: int) -> np.ndarray:
    """Of each example, which of PIVOTS examples (spread over all) it is most like in the frequent terms."""
    own = term < long
    dense = np.zeros((count, long), np.float32)
    dense[row[own], term[own]] = x[own]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    return (dense @ dense[np.linspace(0, count - 1, min(PIVOTS, count)).astype(int)].T).argmax(axis=1) if count else np.zeros(0, np.int64)


class Index:
    """Unit TF-IDF vectors of labelled examples, by term.

    The DENSE longest lists are rows of a matrix with the largest weight of each block of examples, so that a block is
    opened for many texts by one product; the others are lists, which are summed whole. Examples stand by their
    likeness to a few of them, so that those of a block are alike. Weights are numbers of 32 bits, sums of 64.
    """

    def __init__(self, terms: pa.Array, idf: np.ndarray, examples: np.ndarray, start: np.ndarray, term: np.ndarray, n: np.ndarray):
        """examples: rows (id, toxic, weight); example i has terms term[start[i]:start[i + 1]], n times each."""
        rank = np.argsort(-np.bincount(term, minlength=len(terms)), kind="stable")
        new = np.empty(len(terms), np.int32)
        new[rank] = np.arange(len(terms), dtype=np.int32)
        self.terms, self.idf, term = terms.take(pa.array(rank)), idf[rank], new[term]
        x = (1 + np.log(n)) * self.idf[term]
        row = np.repeat(np.arange(len(examples), dtype=np.int32), np.diff(start))
        norm = np.sqrt(np.bincount(row, x * x, len(examples)))
        blank = norm == 0
        mean = lambda e: (float((e[:, 1] * e[:, 2]).sum()) + 0.5) / (float(e[:, 2].sum()) + 1)
        self.base = mean(examples[blank] if blank.any() else examples)
        x = (x / np.where(blank, 1, norm)[row]).astype(np.float32)
        self.long = min(DENSE, len(terms))
        order = np.lexsort((np.arange(len(examples)), alike(term, row, x, self.long, len(examples))))
        order = order[~blank[order]]
        at = np.full(len(examples), -1, np.int32)
        at[order] = np.arange(len(order), dtype=np.int32)
        keep = (at[row] >= 0) & (x > 0)
        row, term, x = at[row[keep]], term[keep], x[keep]
        self.ids, self.y, self.weight = examples[order, 0].astype(np.int64), examples[order, 1], examples[order, 2]
        self.blocks = -(-len(order) // BLOCK)
        own = term < self.long
        self.filled = term[own], row[own], x[own]
        row, term, x = row[~own], term[~own] - self.long, x[~own]
        by = np.lexsort((row, term))
        self.post = np.searchsorted(term[by], np.arange(len(terms) - self.long + 1)), row[by], x[by]
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def ready(self) -> Index:
        """With what a search needs: the terms' numbers, the long lists as a matrix, and the largest weight of each block there."""
        self.term = {w: n for n, w in enumerate(self.terms.to_pylist())}
        self.matrix = np.zeros((self.blocks, self.long, BLOCK), np.float32)
        term, row, x = self.filled
        self.matrix[row // BLOCK, term, row % BLOCK] = x
        self.peak = self.matrix.max(axis=2).T.astype(float)
        return self

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) in the order of the counts, whose terms are all known."""
        t = np.fromiter(map(self.term.__getitem__, counts), np.int64, len(counts))
        x = (1 + np.log(np.fromiter(counts.values(), float, len(counts)))) * self.idf[t]
        return t, x / (np.sqrt((x * x).sum()) or 1.0)

    @staticmethod
    def _spread(lists, text: np.ndarray, term: np.ndarray, x: np.ndarray, count: int, width: int) -> np.ndarray:
        """Sum of the lists of some terms, by text."""
        start, at, value = lists
        n = start[term + 1] - start[term]
        pick = np.repeat(start[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(np.repeat(text * width, n) + at[pick], value[pick] * np.repeat(x, n), count * width).reshape(count, width).astype(float, copy=False)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text, exactly the k largest cosines above 0 (ties: earlier example), less the example at the place in ``but`` (-1: none).

        A text opens the FIRST blocks of the highest bounds, and then all whose bound reaches the k-th cosine so far.
        """
        count, width = len(vectors), self.blocks * BLOCK
        if not count or not width:
            return [(np.zeros(0, np.int64), np.zeros(0))] * count
        text = np.repeat(np.arange(count), [len(t) for t, _ in vectors])
        term, x = (np.concatenate(c) for c in zip(*vectors, strict=True))
        own = term < self.long
        long = np.zeros((count, self.long))
        long[text[own], term[own]] = x[own]
        rare = text[~own], term[~own] - self.long, x[~own], count
        sims = self._spread(self.post, *rare, width)
        bound = long @ self.peak + sims.reshape(count, self.blocks, BLOCK).max(axis=2)
        gone = np.arange(count)[but >= 0], but[but >= 0]
        sims[gone] = -1
        shut, least = np.ones((count, self.blocks), bool), np.full(count, 1e-12)
        if self.blocks > FIRST:
            lead = np.argpartition(-bound, FIRST - 1, axis=1)[:, :FIRST]
            np.put_along_axis(shut, lead, False, axis=1)
            self._open(sims, long, ~shut)
            seen = sims.reshape(count, self.blocks, BLOCK)[np.arange(count)[:, None], lead].reshape(count, -1)
            least = np.maximum(least, np.partition(seen, -k, axis=1)[:, -k] - 1e-12)
        self._open(sims, long, shut & (bound >= least[:, None]))
        # what stayed shut has but a part of its sum, which is below its bound
        row, hit = np.nonzero(sims >= least[:, None])
        found = sims[row, hit]
        order = np.lexsort((hit, -found, row))
        row, hit, found = row[order], hit[order], found[order]
        start = np.searchsorted(row, np.arange(count + 1))
        return [(hit[a : min(a + k, b)], found[a : min(a + k, b)]) for a, b in zip(start[:-1], start[1:], strict=True)]

    def _open(self, sims: np.ndarray, long: np.ndarray, ask: np.ndarray) -> None:
        """Add the long lists' part of some texts' blocks; at once, where most are asked for."""
        self.opened = getattr(self, "opened", 0) + int(ask.sum())
        for b in np.flatnonzero(ask.any(axis=0)).tolist():
            some = np.flatnonzero(ask[:, b])
            sims[some, b * BLOCK : (b + 1) * BLOCK] += long[some] @ self.matrix[b].astype(float)

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        """Share of the toxic votes; a vote weighs 1 / (0.05 + cosine distance) times the rows that it stands for."""
        w = self.weight[ids] / (1.05 - np.minimum(sims, 1.0))
        return float((w * self.y[ids]).sum() / w.sum()) if len(ids) else self.base

    def calibrate(self, votes: np.ndarray, place: np.ndarray) -> None:
        """Isotonic steps from the votes on examples, each of which was left out, to observed rates (pool adjacent violators)."""
        pools: list[list[float]] = []
        for n in np.lexsort((place, votes)):
            w = self.weight[place[n]]
            pools.append([votes[n], votes[n], w * self.y[place[n]], w])
            while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
                last = pools.pop()
                pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        x = np.array([p[0] for p in pools] + [p[1] for p in pools])
        y = np.array([p[2] / p[3] for p in pools] * 2)
        order = np.lexsort((y, x))
        self.steps = x[order], y[order]

    def votes(self, texts: list[str | None], but: list[int] | None = None) -> list[tuple[float, list[int], list[str]]]:
        """Of each text: the vote, its nearest examples and the heaviest terms that it shares with the index."""
        out: list[tuple[float, list[int], list[str]]] = []
        place = {int(i): n for n, i in enumerate(self.ids)} if but is not None else {}
        for a in range(0, len(texts), TOGETHER):
            counts = [{w: n for w, n in counted(t).items() if w in self.term} for t in texts[a : a + TOGETHER]]
            vectors = [self.vector(c) for c in counts]
            left = np.array([place.get(i, -1) for i in but[a : a + TOGETHER]] if but is not None else [-1] * len(counts))
            for c, (t, _), (ids, sims) in zip(counts, vectors, self.nearest(vectors, NEAREST, left), strict=True):
                words = list(c)
                out.append((self.vote(ids, sims), self.ids[ids[:3]].tolist(), [words[i] for i in np.lexsort((t, -self.idf[t]))[:5]]))
        return out

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int], list[str]]]:
        """(calibrated score, nearest examples, terms that met) of each text; ``base`` where nothing is shared."""
        got = self.votes(texts)
        return [(min(1.0, max(0.0, float(np.interp(v, *self.steps)) if self.steps is not None and e else v)), e, t) for v, e, t in got]


def shipped(index: Index) -> dict:
    """The arrays of an index: a task needs no import of its class."""
    return {k: v for k, v in vars(index).items() if k not in ("term", "matrix", "peak")}


def received(parts: dict) -> Index:
    index = Index.__new__(Index)
    vars(index).update(parts)
    return index.ready()


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """The index over a bounded sample of labelled training rows, with all their terms.

    A term weighs its IDF over all documents times how far the shrunk toxic share of its examples is from that of all.
    The driver holds the sample's (example, term) numbers; counting and the calibrating searches are Spark jobs.
    """
    spark = docs.sparkSession
    sample = label_sample(labels).collect()  # about 2 * EXAMPLES rows
    rows = spark.createDataFrame([(r.doc_id, r.toxic, r.weight) for r in sample], "doc_id long, toxic int, weight double")
    text = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id").select("doc_id", "toxic", "weight", "text"))
    counts = text.select("doc_id", "toxic", "weight", F.xxhash64("text").alias("same"), "text").mapInArrow(counts_of, "doc_id long, toxic int, weight double, same long, words array<string>, counts array<int>")
    got = counts.toArrow().sort_by([("doc_id", "ascending"), ("same", "ascending")]).combine_chunks()
    examples = np.stack([got[c].to_numpy().astype(float) for c in ("doc_id", "toxic", "weight")], axis=1)
    if not len(examples):
        return Index(pa.array([], pa.string()), np.zeros(0), np.zeros((0, 3)), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
    start = np.concatenate([[0], np.cumsum(pc.list_value_length(got["words"]).to_numpy())])
    words = pc.list_flatten(got["words"]).combine_chunks().dictionary_encode()
    terms, term, n = words.dictionary, words.indices.to_numpy(), pc.list_flatten(got["counts"]).to_numpy()
    del got, words
    told = spark.sparkContext.broadcast(terms)  # of about 2 * EXAMPLES texts
    every = docs.select("text").mapInArrow(frequencies(told), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms))
    df[pc.index_in(every["w"].combine_chunks(), terms).to_numpy()] = every["n"].to_numpy()
    told.destroy()
    del every
    toxic = examples[:, 1][np.repeat(np.arange(len(examples)), np.diff(start))]
    among, share = np.bincount(term, minlength=len(terms)), examples[:, 1].mean()
    idf = (np.log((1 + docs.count()) / (1 + df)) + 1) * np.abs((np.bincount(term, toxic, len(terms)) + SHRUNK * share) / (among + SHRUNK) - share)
    index = Index(terms, idf, examples, start, term, n)
    if len(index.ids):
        held = spark.sparkContext.broadcast(shipped(index))
        votes = text.repartition(partitions(spark)).select("doc_id", "text").mapInArrow(left_out(held), "doc_id long, vote double").toArrow().sort_by([("doc_id", "ascending"), ("vote", "ascending")])
        held.destroy()
        place = {int(i): k for k, i in enumerate(index.ids)}
        known = [(v, place[i]) for i, v in zip(votes["doc_id"].to_pylist(), votes["vote"].to_pylist(), strict=True) if i in place]
        index.calibrate(np.array([v for v, _ in known]), np.array([k for _, k in known]))
    return index


def left_out(held):
    """(doc_id, text) of examples -> the vote on each without itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = received(held.value)
        for b in batches:
            got = index.votes(b.column(1).to_pylist(), b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v for v, _, _ in got], pa.float64())], ["doc_id", "vote"])

    return run


def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., text) -> (..., words, counts)."""
    for b in batches:
        got = [counted(t) for t in b.column(4).to_pylist()]
        columns = [*b.columns[:4], pa.array([list(c) for c in got], pa.list_(pa.string())), pa.array([list(c.values()) for c in got], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "weight", "same", "words", "counts"])


def frequencies(told):
    """(text) -> (term, documents that have it) for the terms that are asked for, added up over parts of a task."""
    give = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["w", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        asked = frozenset(told.value.to_pylist())
        for b in batches:
            for t in b.column(0).to_pylist():
                df.update(asked.intersection(WORD.findall(t.lower())) if t else ())
            if len(df) > HELD:
                yield give(df)
                df = Counter()
        yield give(df)

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents -> (doc_id, held_out, score, predicted, evidence, terms): one row per document.

    Fitted on about EXAMPLES labelled rows of either class whose crc32(doc_id) mod 5 is not 0 (all, if
    fewer), weighted back to their class. A text without an indexed term, null and empty ones included,
    gets the rate of such examples. Repeated labels: toxic if any row says so. Repeated documents are
    scored one by one, equal texts alike; as examples, rows of one doc_id each count. Ties between
    neighbours go to the earlier example. A text of any length is counted whole. No labels: 0.5. Empty
    table: no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(shipped(fit(docs, labels)))
    rows = docs.select("doc_id", (remainder(5) == 0).alias("held_out"), "text")
    schema = rows.drop("text").schema.add("score", "double").add("predicted", "integer").add("evidence", T.ArrayType(T.LongType())).add("terms", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = received(held.value)
        for b in batches:
            texts = b.column(2).to_pylist()
            each = list(dict.fromkeys(texts))
            once = dict(zip(each, index.scores(each), strict=True))
            got = [once[t] for t in texts]
            columns = [*b.columns[:2], pa.array([s for s, _, _ in got], pa.float64()), pa.array([int(s >= 0.5) for s, _, _ in got], pa.int32()), pa.array([e for _, e, _ in got], pa.list_(pa.int64())), pa.array([t for _, _, t in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "evidence", "terms"])

    return rows.mapInArrow(run, schema)
