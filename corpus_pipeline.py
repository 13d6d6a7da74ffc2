"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import langid
from sheaf.llm.common import apart, remainder, table, written
from sheaf.llm.decontaminate import without_leaks
from sheaf.llm.packing import packed_documents
from sheaf.llm.queries import tokenizer_files
from sheaf.llm.simhash import near_duplicates
from sheaf.llm.suffix_dedup import without_repeats

#: Least share of the largest out-of-place distance by which a text must be nearer to a profile than a text that shares nothing with it.
LEAST_LIKE = 0.25


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay; a missing ``lang`` becomes the language found.

    What is rejected: null texts, texts without a letter, and texts further than LEAST_LIKE from every profile (another
    script or language, noise). Repeated rows, equal ones included, are judged one by one. A tie between languages goes
    to the first name. No row with text and lang: nothing can be recognised and all rows go. Empty table: no rows.
    A text of any length is one array of a task at a time.
    """
    profiles = langid.learn(docs.where(remainder(3) != 1))
    own = apart(docs, "doc_id", "text")
    told = langid.predict(own, profiles, *own.columns).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LIKE))
    at = docs.columns.index("lang")
    return told.select(*(F.coalesce(F.col(c), F.col("lang_pred")) if n == at else F.col(c) for n, c in enumerate(own.columns))).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id stays.

    Repeated rows (one doc_id and one text) leave one row; of rows with one doc_id and different texts each text stays, as
    one document. Rows without doc_id have no group and stay. Null and blank texts are copies of each other. Empty
    table: no rows. Texts of any length are fingerprinted one at a time and only ids are grouped.
    """
    own = apart(docs, "doc_id", "text")
    kept = near_duplicates(own).where("doc_id = component_id").select("doc_id").distinct()
    return own.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(own.where("doc_id is null")).select(*own.columns).toDF(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes leave the texts, but for the earliest; a text of which nothing is left goes.

    Bytes of a character that was cut become U+FFFD. Null and empty texts, and rows without doc_id, stay as they are.
    Ties in doc_id: see without_repeats. n_chars, where there is one, is counted anew. Empty table: no rows.
    """
    own = apart(docs, "doc_id", "text")
    left = without_repeats(own).where("n_removed = 0 or n_removed < n_bytes")
    text = F.when(F.col("n_removed") > 0, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.length(text)}
    return left.select(*(new[name].cast(kind.dataType) if name in new else F.col(c) for name, c, kind in zip(docs.columns, own.columns, docs.schema, strict=True))).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none. Repeated rows are judged one by one. A text of any length is queried passage by
    passage. Empty table: no rows; empty benchmark: all stay.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document: its place in a sequence of at most 2048 tokens.

    A null or empty text is its end alone. Rows with one doc_id are packed one by one; ties in length go by doc_id and
    start. A document of any length becomes full sequences and a rest. Empty table: no rows.
    """
    return packed_documents(docs, *tokenizer_files())


STAGES = [("language_id", identify), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("pack", pack)]
#: Language profiles, SimHash components and packing are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
