"""Documents into sections and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADING = "^#{1,6} +"


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a source with fewer splits than the session has cores, dealt to all of them; others as they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, heading, start_line, end_line, body) of docs(doc_id, text).

    Each ATX heading opens a section up to the next; text before the first is kept; blank ones are dropped.
    A document's sections are made as one array and then exploded: a row carries its own section alone.
    """
    lines = F.split("text", "\n")
    heads = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.element_at("lines", i).rlike(HEADING))
    starts = F.when(F.element_at("lines", 1).rlike(HEADING), heads).otherwise(F.concat(F.array(F.lit(1)), heads))
    ends = lambda n: F.coalesce(F.try_element_at("starts", n + 2) - 1, F.size("lines"))
    one = lambda start, n: F.struct(start.alias("start_line"), ends(n).alias("end_line"), F.element_at("lines", start).alias("head"), F.array_join(F.slice("lines", start, ends(n) - start + 1), "\n").alias("body"))
    cut = docs.select("doc_id", lines.alias("lines")).select("doc_id", "lines", starts.alias("starts"))
    out = cut.select("doc_id", F.posexplode(F.transform("starts", one)).alias("section_no", "s")).select("doc_id", "section_no", "s.*")
    heading = F.when(F.col("head").rlike(HEADING), F.trim(F.regexp_replace("head", HEADING, ""))).otherwise("")
    return out.where(F.trim("body") != "").select("doc_id", "section_no", heading.alias("heading"), "start_line", "end_line", "body")


def strides(body: Column, step: int) -> Column:
    """The text in consecutive pieces of ``step`` characters, the last one shorter."""
    return F.regexp_extract_all(body, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))


def windows(cut: str, length: str, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters that overlap, the last one up to the end, of the columns that hold a text's strides and its length.

    A window is its stride and the beginning of what follows. The strides must be a column of their own, made before: an
    expression inside the windows' lambda would be worked out again for each of them.
    """
    step = size - overlap
    last = F.when(F.col(length) <= size, 0).otherwise(F.ceil((F.col(length) - size) / step).cast("int"))
    more = range(-(-overlap // step))
    window = lambda part, n: F.substring(F.concat(part, *(F.coalesce(F.get(F.col(cut), n + 1 + i), F.lit("")) for i in more)), 1, size)
    return F.transform(F.slice(cut, 1, last + 1), window)


def chunk_key() -> Column:
    """The chunk_id of (doc_id, chunk_index)."""
    return F.substring(F.sha1(F.concat_ws(":", "doc_id", "chunk_index")), 1, 16)


def chunks(docs: DataFrame, size: int = 2048, overlap: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, chunk_index, chunk_id, start, chunk, *keep). The index counts blank pieces, which are then dropped.

    Work and memory are linear in a text's length (tested at 2 to 8 MB).
    """
    cut = docs.select("doc_id", *keep, strides(F.col("text"), size - overlap).alias("_cut"), F.length("text").alias("_length"))
    out = cut.select("doc_id", *keep, F.posexplode(windows("_cut", "_length", size, overlap)).alias("chunk_index", "chunk"))
    start = F.col("chunk_index") * (size - overlap)
    return out.where(F.trim("chunk") != "").select("doc_id", "chunk_index", chunk_key().alias("chunk_id"), start.alias("start"), "chunk", *keep)
