"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import context_tree
from sheaf.llm.alignment import aligned
from sheaf.llm.ann import neighbours
from sheaf.llm.caps import near_vectors
from sheaf.llm.common import table
from sheaf.llm.decontaminate import leaks
from sheaf.llm.langid import identified
from sheaf.llm.licenses import scanned
from sheaf.llm.negatives import hard_negatives
from sheaf.llm.packing import packed_documents
from sheaf.llm.sharding import shards_by_bytes
from sheaf.llm.simhash import near_duplicates
from sheaf.llm.suffix_dedup import without_repeats
from sheaf.llm.toxicity import scored


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scored(table(spark, sf_dir, "documents"))


def tokenizer_files() -> tuple[str, str]:
    """The vocabulary, and the same one as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), *tokenizer_files())


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_by_bytes(table(spark, sf_dir, "documents"), 40)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives(rows, shift=F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary, ranks = tokenizer_files()
    return aligned(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.path("piece_bpe_32k.model"), ranks)


OP11_SQL = """
WITH RECURSIVE own AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v,
    vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid
  FROM embeddings
), link AS (
  SELECT a.r, a.vec_id, b.vec_id AS other FROM own a JOIN own b ON a.valid AND b.valid AND a.r <> b.r AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS root FROM own WHERE vec_id IS NOT NULL
  UNION
  SELECT l.vec_id, p.root FROM reach p JOIN link l ON l.other = p.vec_id
), component AS (
  SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id
), counted AS (
  SELECT r, count(*) AS n FROM link GROUP BY r
)
SELECT o.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, o.vec_id = component_id AS kept
FROM own o LEFT JOIN counted USING (r) LEFT JOIN component c ON c.vec_id = o.vec_id
"""

OP12_SQL = """
WITH own AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score
  FROM own a JOIN own e ON a.vec_id <> e.vec_id
  WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffix_dedup": op1_suffix_dedup, "op2_langid": op2_langid, "op3_toxicity": op3_toxicity, "op4_simhash": op4_simhash, "op5_licenses": op5_licenses, "op6_context_tree": op6_context_tree, "op7_packing": op7_packing, "op8_ann": op8_ann, "op9_sharding": op9_sharding, "op10_decontamination": op10_decontamination, "op11_embedding_dedup": op11_embedding_dedup, "op12_hard_negatives": op12_hard_negatives, "op13_token_alignment": op13_token_alignment}


def oracle_sql() -> dict[str, str]:
    return {"op11_embedding_dedup": OP11_SQL, "op12_hard_negatives": OP12_SQL}
