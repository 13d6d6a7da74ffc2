"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import batch, remainder, written

#: Length of a profile, also the distance of an n-gram that a profile lacks.
TOP = 300
#: Code points below this are looked up in a table, others one by one.
PLAIN = 0x3000


def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(PLAIN)])


def grams(text: str, letter: np.ndarray) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of the words, lower-cased, a 1 marking each word's ends."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(cp):
        return cp
    if cp.max() < PLAIN:
        is_letter = letter[cp]
    else:
        is_letter = np.fromiter((chr(c).isalpha() for c in cp), bool, len(cp))
    cp = np.concatenate([[1], np.where(is_letter, cp, 1), [1]])
    cp = cp[np.concatenate([[True], (cp[1:] != 1) | (cp[:-1] != 1)])]
    if len(cp) < 2:
        return cp[:0]
    two = cp[:-1] << 21 | cp[1:]
    three = (two[:-1] << 21 | cp[2:])[cp[1:-1] != 1]
    return np.concatenate([cp[cp != 1], two, three])


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, ties by code."""
    if len(codes) > 4 * top:
        keep = counts >= np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:top]]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n), summed over the task."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    letter, held = letters(), {}

    def merge(parts):
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parts = held.setdefault(lang, [])
            parts.append(np.unique(grams(text, letter), return_counts=True))
            if len(parts) > 256:
                held[lang] = [merge(parts)]
    for lang, parts in held.items():
        codes, n = merge(parts)
        for i in range(0, len(codes), 50_000):
            yield batch(schema, [lang] * len(codes[i : i + 50_000]), codes[i : i + 50_000], n[i : i + 50_000])


class Profiles:
    """A rank of every known n-gram in every language; TOP where it is not among the most frequent."""

    def __init__(self, by_lang: dict[str, np.ndarray], top: int = TOP):
        self.langs, self.top = sorted(k for k, v in by_lang.items() if len(v)), top
        self.codes = np.unique(np.concatenate([by_lang[k] for k in self.langs])) if self.langs else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.codes)), top, np.int64)
        for i, k in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, by_lang[k])] = np.arange(len(by_lang[k]))

    def predict(self, codes: np.ndarray) -> tuple[str, float]:
        """(language, 1 - distance / largest distance); ties go to the first name in order."""
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = ranked(*np.unique(codes, return_counts=True), self.top)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        rank, place = self.ranks[:, at[known]], np.flatnonzero(known)
        apart = np.where(rank < self.top, np.minimum(np.abs(rank - place), self.top), self.top).sum(axis=1) + self.top * (len(own) - len(place))
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.top * len(own)))


def learn(docs: DataFrame, top: int = TOP) -> Profiles:
    """Profiles of docs(text, lang), counted over all rows whose text and lang are given."""
    rows = docs.where("text is not null and lang is not null").select("lang", "text")
    counts = written(rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    best = {k: counts.where(F.col("lang") == k).orderBy(F.desc("n"), "gram").limit(top).collect() for k in langs}
    return Profiles({k: np.array([r.gram for r in v], np.int64) for k, v in best.items()}, top)


def predict(docs: DataFrame, profiles: Profiles, *keep: str) -> DataFrame:
    """docs -> keep, lang_pred, score. A text that is null or has no letter is 'und' with score 0."""
    rows = docs.select(*keep, F.col("text").alias("_text"))
    out = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters()
        for b in batches:
            found = [profiles.predict(grams(t, letter)) if t else ("und", 0.0) for t in b.column(len(keep)).to_pylist()]
            columns = [*b.columns[: len(keep)], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[: len(keep)], "lang_pred", "score"])

    return rows.mapInArrow(run, out)


def identified(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Documents -> (doc_id, held_out, lang_pred, score), learnt from rows whose crc32(doc_id) mod 3 is not 1.

    Only text and lang are learnt from, only text is predicted from. No usable training row: all
    rows are 'und'. Repeated rows are counted and predicted as often as they stand. Empty table:
    no rows. A text of any length is one array at a time.
    """
    rows = docs.select("doc_id", "text", "lang", (remainder(3) == 1).alias("held_out"))
    profiles = learn(rows.where("not held_out"), top)
    return predict(rows, profiles, "doc_id", "held_out")
