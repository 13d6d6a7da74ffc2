"""Queries over chunking, retrieval, the graph and the index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import text
from sheaf.operators import chunking, graph, index, ranking, retrieval
from sheaf.plans.binding import Plans, docs, table, with_docs
from sheaf.plans.scalars import fold_sql, js, squeeze_sql

P = Plans()
c = F.col

CHUNKS_SQL = """chunks AS (SELECT doc_id, i AS chunk_index, substring(sha1(doc_id || ':' || i), 1, 16) AS chunk_id, i * 1792 AS start, rel_path AS source_path, lang AS section, project, doc_type, source_channel, 'high' AS reliability, ticket_ids, people, visibility, cast(doc_date AS varchar) AS date, substring(text, i * 1792 + 1, 2048) AS text
    FROM (SELECT *, unnest(range(0, CASE WHEN length(text) <= 2048 THEN 1 ELSE cast(ceil((length(text) - 2048) / 1792.0) AS bigint) + 1 END)) AS i FROM docs) WHERE trim(substring(text, i * 1792 + 1, 2048)) <> '')"""


def chunk_table(spark, d):
    labels = ("source_path", "section", "project", "doc_type", "source_channel", "reliability", "ticket_ids", "people", "visibility", "date")
    rows = docs(spark, d).select("doc_id", "text", c("rel_path").alias("source_path"), c("lang").alias("section"), "project", "doc_type", "source_channel", F.lit("high").alias("reliability"), "ticket_ids", "people", "visibility", c("doc_date").cast("string").alias("date"))
    return chunking.chunks(chunking.spread(rows), keep=labels).withColumnRenamed("chunk", "text")


LABELS = ("source_path", "section", "project", "doc_type", "source_channel", "reliability", "ticket_ids", "people", "visibility", "date")


def labelled(spark, d):
    """The documents with the labels that are searched, and their hashes."""
    rows = docs(spark, d).select("doc_id", "text", c("rel_path").alias("source_path"), c("lang").alias("section"), "project", "doc_type", "source_channel", F.lit("high").alias("reliability"), "ticket_ids", "people", "visibility", c("doc_date").cast("string").alias("date"), "content_hash")
    return chunking.spread(rows.withColumn("meta_hash", F.sha2(F.to_json(F.struct(*LABELS)), 256)))


def kept(spark, d):
    """The index of a table's documents in the session's shared folder, which may not be built yet."""
    return index.TextIndex(spark, f"{graph.shared_folder(spark)}/index-{spark.sparkContext.applicationId}-{abs(hash(d))}", LABELS, None, LetterCounts())


def built(spark, d):
    """The kept index: built by the first query that asks, read by the others."""
    at = kept(spark, d)
    if not at.current()[0]:
        at.build(labelled(spark, d))
        at.forget_at_exit()
    return at


def stored(spark, rows, name, *by):
    """rows from a folder of the session, written by the first query that asks."""
    at = f"{graph.shared_folder(spark)}/{name}"
    rows.write.mode("ignore").option("compression", "zstd").partitionBy(*by).parquet(at)
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(rows.schema).parquet(at)


def tenants(spark, d):
    """The chunks in folders by tenant: a reader of one or two tenants reads no other's. They need no index."""
    at = kept(spark, d)
    rows = (at.read("chunks") if at.current()[0] else chunk_table(spark, d)).withColumn("tenant", F.when(c("project") < "src15", "own").otherwise("shared"))
    return stored(spark, rows, f"tenants-{spark.sparkContext.applicationId}-{abs(hash(d))}", "tenant")


def known(spark, d):
    """What answers a few questions: the index where it is built, else the chunks, written once, as an index pays for many batches and not for one."""
    at = kept(spark, d)
    return at if at.current()[0] else retrieval.Corpus(stored(spark, chunk_table(spark, d), f"chunks-{spark.sparkContext.applicationId}-{abs(hash(d))}"))


def ticket_graph(spark, d):
    """The kept graph of MENTIONS edges from chunks to tickets, as ``built``."""
    at = index.GraphTable(spark, f"{graph.shared_folder(spark)}/graph-{spark.sparkContext.applicationId}-{abs(hash(d))}", index.LEAST)
    if not at.current()[0]:
        at.upsert(edges=known(spark, d).places().select(c("chunk_id").alias("from_id"), F.lit("MENTIONS").alias("relation"), F.explode(F.array_distinct("ticket_ids")).alias("to_id"), "doc_id"))
        at.forget_at_exit()
    return at


class LetterCounts:
    """Vectors that SQL can make as well: how often each letter stands in the text, plus one."""

    size = 26

    def attach(self, rows, text):
        at = rows.columns.index(text)

        def run(batches):
            for b in batches:
                low = pc.utf8_lower(b.column(at))
                count = [np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=123)[97:123] + 1.0 if x.is_valid else None for x in low]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(count, pa.list_(pa.float64()))], names=[*b.schema.names, "embedding"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


QUESTIONS = [(1, "TKT-3 status of the erand"), (2, "src2/en/doc-42.md"), (3, "erand Thth"), (4, "what is the plan of Person C on src1"), (5, "report TKT-7 email timeline"), (6, "who does phu trach golive of src3 erand")]
#: What the questions' variants by REGISTRY are (the last one is of question 4), and their terms, worked out by hand.
REGISTRY, VARIANT = [("src1", ["src10"])], (7, 4, "what is the plan of Person C on src10")
EXACT = [(1, "tkt-3"), (2, "doc-42.md"), (3, "erand thth"), (5, "tkt-7")]
KEYWORDS = {1: ["tkt-3", "status", "erand"], 2: ["src2/en/doc-42.md"], 3: ["erand", "thth"], 4: ["plan", "person", "src1"], 5: ["report", "tkt-7", "email", "timeline"], 6: ["who", "does", "phu", "trach", "golive", "src3", "erand"]}
ALL_KEYWORDS = KEYWORDS | {7: ["plan", "person", "src10"]}


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "question_id int, text string")


def values(rows):
    return "(VALUES " + ", ".join(f"({', '.join(repr(x) for x in r)})" for r in rows) + ")"


_whole = lambda h: f"regexp_matches({h}, '(^|[^a-z0-9])' || regexp_escape(t) || '([^a-z0-9]|$)')"
EXACT_SQL = f"""f AS (SELECT chunk_id, source_path, chunk_index, lower(source_path) AS p, lower(section) AS s, lower(project) AS j, lower(doc_type) AS d, {squeeze_sql('lower(text)')} AS x FROM chunks),
    e AS (SELECT q, chunk_id, source_path, chunk_index, sum(CASE WHEN p = t OR ends_with(p, '/' || t) THEN 200 WHEN contains(p, t) THEN 120 ELSE 0 END + contains(s, t)::int * 40 + contains(j, t)::int * 30 + contains(d, t)::int * 20 + contains(x, t)::int * 10) + max(contains(x, w)::int * 15) AS score
    FROM f, {values([(q, t, dict((i, x.lower()) for i, x in QUESTIONS)[q]) for q, t in EXACT])} v(q, t, w) GROUP BY ALL),
    exact AS (SELECT q AS question_id, chunk_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, source_path, chunk_index) AS rank FROM e WHERE score > 0)"""


def keyword_sql(words) -> str:
    return f"""g AS (SELECT chunk_id, source_path, chunk_index, lower(source_path) AS p, lower(section) AS s, lower(project) AS j, lower(doc_type) AS d, source_channel AS h, reliability AS r, list_transform(ticket_ids, lambda z: lower(z)) AS k, list_transform(people, lambda z: lower(z)) AS w, {fold_sql('text')} AS x FROM chunks),
    ks AS (SELECT q, chunk_id, source_path, chunk_index, (len(list_filter(k, lambda z: contains(z, t))) > 0)::int * 120 + (len(list_filter(w, lambda z: contains(z, t))) > 0)::int * 60 + CASE WHEN {_whole('p')} THEN 50 WHEN contains(p, t) THEN 30 ELSE 0 END
    + {_whole('s')}::int * 30 + contains(j, t)::int * 20 + contains(d, t)::int * 15 + {_whole('h')}::int * 8 + {_whole('r')}::int * 5 + CASE WHEN {_whole('x')} THEN 12 WHEN contains(x, t) THEN 6 ELSE 0 END AS score FROM g, {values([(q, t) for q, ts in words.items() for t in ts])} v(q, t)),
    kt AS (SELECT q, chunk_id, source_path, chunk_index, sum(score) + CASE WHEN count(*) > 1 THEN count(*) * 10 ELSE 0 END AS score FROM ks WHERE score > 0 GROUP BY ALL),
    keyword AS (SELECT q AS question_id, chunk_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, source_path, chunk_index) AS rank FROM kt)"""


KEYWORD_SQL, ALL_KEYWORD_SQL = keyword_sql(KEYWORDS), keyword_sql(ALL_KEYWORDS)


def with_chunks(sql: str, *parts: str) -> str:
    return with_docs("WITH " + ", ".join((CHUNKS_SQL, *parts)) + " " + sql)


P.over_docs("wn1_heading_sections", lambda d: chunking.sections(d.select("doc_id", F.regexp_replace("text", "(?m)^([A-E])", "# $1").alias("text"))).select("doc_id", "section_no", "heading", "start_line", "end_line", F.md5("body").alias("body")),
    """WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '(?m)^([A-E])', '# \\1', 'g'), chr(10)) AS s FROM docs)), h AS (SELECT *, sum((starts_with(line, '# ') OR n = 1)::int) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS k FROM l),
    a AS (SELECT doc_id, cast(k AS int) AS section_no, cast(min(n) AS int) AS start_line, cast(max(n) AS int) AS end_line, string_agg(line, chr(10) ORDER BY n) AS body, arg_min(line, n) AS head FROM h GROUP BY 1, 2)
    SELECT doc_id, section_no, CASE WHEN starts_with(head, '# ') THEN trim(substring(head, 3)) ELSE '' END AS heading, start_line, end_line, md5(body) AS body FROM a WHERE trim(body) <> ''""")  # fmt: skip


@P.query("wn2_wn3_chunks", with_chunks("SELECT doc_id, chunk_index, chunk_id, md5(text) AS body FROM chunks"))
def wn2(spark, d):
    return chunking.chunks(docs(spark, d)).select("doc_id", "chunk_index", "chunk_id", F.md5("chunk").alias("body"))


@P.query("jn4_rt1_exact_retrieval", with_chunks("SELECT question_id, chunk_id, score, rank FROM exact WHERE rank <= 10", EXACT_SQL))
def rt1(spark, d):
    at = kept(spark, d)
    return retrieval.exact(questions(spark), at if at.current()[0] else chunk_table(spark, d), 10)  # one pass, for which chunks need not be written


@P.query("jn4_rt2_keyword_retrieval", with_chunks("SELECT question_id, chunk_id, score, rank FROM keyword WHERE rank <= 10", KEYWORD_SQL))
def rt2(spark, d):
    return retrieval.keyword(questions(spark), built(spark, d), 10)


def vector_queries(spark, d, metric="l2"):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id < 10").select(c("vec_id").alias("question_id"), c("embedding").alias("q"))
    return retrieval.vectors(q, e.where("label < 7"), 5, metric)


@P.query("rt3_vector_retrieval", "SELECT question_id, vec_id, distance, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, vec_id) AS n FROM (SELECT q.vec_id AS question_id, e.vec_id, round(sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::double - z[2]::double) ** 2))), 6) AS distance FROM embeddings q, embeddings e WHERE q.vec_id < 10 AND e.label < 7)) WHERE n <= 5")
def rt3(spark, d):
    return vector_queries(spark, d)


@P.query("rt3_vector_retrieval_cosine", "SELECT question_id, vec_id, distance, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, vec_id) AS n FROM (SELECT q.vec_id AS question_id, e.vec_id, round(1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) AS distance FROM embeddings q, embeddings e WHERE q.vec_id < 10 AND e.label < 7)) WHERE n <= 5")
def rt3c(spark, d):
    return vector_queries(spark, d, "cosine")


_tf = {1: ["tkt-3", "status", "the", "erand"], 2: ["src2/en/doc-42.md"], 3: ["erand", "thth"], 4: ["what", "the", "plan", "person", "src1"], 5: ["report", "tkt-7", "email", "timeline"], 6: ["who", "does", "phu", "trach", "golive", "src3", "erand"]}
FREQUENCY_SQL = f"""frequency AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q AS question_id, chunk_id, sum((length(text) - length(replace(lower(text), t, ''))) // length(t)) AS score FROM chunks, {values([(q, t) for q, ts in _tf.items() for t in ts])} v(q, t) WHERE contains(lower(text), t) GROUP BY 1, 2))"""
_letters = lambda e: f"list_transform(range(97, 123), lambda i: (length({e}) - length(replace(lower({e}), chr(cast(i AS int)), '')) + 1)::double)"
VECTOR_SQL = f"""vq AS (SELECT q, {_letters('x')} AS e FROM {values(QUESTIONS)} v(q, x)), ve AS (SELECT chunk_id, project, {_letters('text')} AS e FROM chunks),
    near AS (SELECT q AS question_id, chunk_id, project, round(1 - list_cosine_similarity(ve.e, vq.e), 6) AS distance FROM ve, vq),
    vector AS (SELECT question_id, chunk_id, distance, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank FROM near WHERE question_id NOT IN (SELECT question_id FROM exact WHERE rank <= 20 GROUP BY 1 HAVING count(*) >= 20))"""


@P.query("rt4_term_frequency", with_chunks("SELECT question_id, chunk_id, score, rank FROM frequency WHERE rank <= 10", FREQUENCY_SQL))
def rt4(spark, d):
    return retrieval.term_frequency(questions(spark), built(spark, d), 10)


@P.query("rt5_filename_relevance", with_docs("SELECT q AS question_id, source, source_path, score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q, source ORDER BY score DESC, source_path) AS n FROM (SELECT q, source, rel_path AS source_path, count(*) AS score FROM docs, (VALUES (1, 'doc-42.md'), (1, 'en'), (1, 'doc'), (2, 'de'), (2, '7')) v(q, t) WHERE contains(lang || ' ' || 'doc-' || doc_id || '.md', t) GROUP BY 1, 2, 3)) WHERE n <= 6"))
def rt5(spark, d):
    q = spark.createDataFrame([(1, "doc-42.md en doc"), (2, "de 7")], "question_id int, text string")
    return retrieval.names(q, docs(spark, d).select(c("rel_path").alias("source_path"), "source"), 6)


@P.query("rt8_conditional_branches", with_chunks("SELECT question_id, count(*) FILTER (via = 'e') AS n_exact, count(*) FILTER (via = 'v') AS n_vector, count(*) FILTER (via = 'k') AS n_keyword FROM (SELECT question_id, 'e' AS via FROM exact WHERE rank <= 20 UNION ALL SELECT question_id, 'v' FROM vector WHERE rank <= 20 UNION ALL SELECT question_id, 'k' FROM keyword WHERE rank <= 20 AND question_id NOT IN (SELECT question_id FROM exact WHERE question_id IN (2, 3) AND rank <= 20 GROUP BY 1 HAVING count(*) >= 3)) GROUP BY 1", EXACT_SQL, KEYWORD_SQL, VECTOR_SQL))
def rt8(spark, d):
    found = retrieval.lists(questions(spark), known(spark, d), 20, None, LetterCounts())
    return found.where("list_no < 3").groupBy("question_id").agg(*(F.count_if(c("list_no") == i).alias(n) for i, n in enumerate(("n_exact", "n_vector", "n_keyword"))))


_own, _shared = "project < 'src15'", "project >= 'src15'"
_list = lambda of, where, w: f"SELECT question_id, chunk_id, {w} AS w, row_number() OVER (PARTITION BY question_id ORDER BY {'distance, chunk_id' if of == 'near' else 'rank'}) AS rank FROM {of} {'' if of == 'near' else 'JOIN (SELECT chunk_id, project FROM chunks) USING (chunk_id)'} WHERE {where}"


_side = lambda where, share, at: " UNION ALL ".join(
    f"SELECT question_id, chunk_id, {no + at} AS no, {w * share}::double AS w, row_number() OVER (PARTITION BY question_id ORDER BY {order}) AS rank FROM {of} WHERE ({where}) {skip}"
    for no, (of, w, order, skip) in enumerate((
        (f"(SELECT e.*, source_path AS sp, chunk_index AS ci, project FROM exact e JOIN (SELECT chunk_id, source_path, chunk_index, project FROM chunks) USING (chunk_id))", 4.0, "score DESC, sp, ci", ""),
        ("near", 3.5, "distance, chunk_id", f"AND question_id NOT IN (SELECT question_id FROM exact JOIN (SELECT chunk_id, project FROM chunks) USING (chunk_id) WHERE {where} GROUP BY 1 HAVING count(*) >= 10)"),
        ("(SELECT k.*, source_path AS sp, chunk_index AS ci, project FROM keyword k JOIN (SELECT chunk_id, source_path, chunk_index, project FROM chunks) USING (chunk_id))", 2.0, "score DESC, sp, ci", f"AND question_id NOT IN (SELECT question_id FROM exact JOIN (SELECT chunk_id, project FROM chunks) USING (chunk_id) WHERE {where} AND question_id IN (2, 3) GROUP BY 1 HAVING count(*) >= 3)"),
        ("(SELECT f.*, project FROM frequency f JOIN (SELECT chunk_id, project FROM chunks) USING (chunk_id))", 3.0, "score DESC, chunk_id", ""),
    ))
)


@P.query("rt9_federation", with_chunks(f"SELECT question_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT question_id, chunk_id, sum(w / (10.0::double + rank)) AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(sum(w / (10.0::double + rank)), 9) DESC, min(struct_pack(a := no, b := rank))) AS rank FROM ({_side(_own, 1.0, 0)} UNION ALL {_side(_shared, 0.6, 4)}) WHERE rank <= 10 GROUP BY 1, 2) WHERE rank <= 20", EXACT_SQL, KEYWORD_SQL, FREQUENCY_SQL, VECTOR_SQL))
def rt9(spark, d):
    """All four lists of a tenant and of a shared one, from tables partitioned by tenant."""
    rows = tenants(spark, d)
    sides = [(rows.where("tenant = 'own'").drop("tenant"), 1.0), (rows.where("tenant = 'shared'").drop("tenant"), retrieval.SHARED)]
    return retrieval.federate(questions(spark), sides, 10, None, LetterCounts()).select("question_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


P.over_docs("rt10_document_search", lambda d: retrieval.search(d, "the er", True).select("doc_id", "rel_path"), "SELECT doc_id, rel_path FROM docs WHERE visibility = 'shared' AND contains(lower(concat_ws(chr(10), rel_path, project, text)), 'the') AND contains(lower(concat_ws(chr(10), rel_path, project, text)), 'er') ORDER BY doc_date DESC, rel_path DESC LIMIT 20")


@P.query("rt11_context_pack", with_chunks("""SELECT question_id, cast(count(*) AS int) AS n_blocks, string_agg(chunk_id, '|' ORDER BY place) AS chunk_ids FROM (SELECT *, sum(size) OVER (PARTITION BY question_id ORDER BY place) AS used FROM (SELECT question_id, chunk_id, length('[' || source_channel || ' | ' || date || ' | ' || source_path || '#' || section || ']' || chr(10) || text || chr(10)) AS size, row_number() OVER (PARTITION BY question_id ORDER BY r, f) AS place FROM (SELECT k.question_id, k.chunk_id, k.rank, h.*, row_number() OVER (PARTITION BY question_id, source_path ORDER BY rank) AS r, min(rank) OVER (PARTITION BY question_id, source_path) AS f FROM keyword k JOIN (SELECT chunk_id AS cid, * EXCLUDE (chunk_id) FROM chunks) h ON h.cid = k.chunk_id WHERE rank <= 20))) WHERE used <= 24000 GROUP BY 1""", KEYWORD_SQL))
def rt11(spark, d):
    ch = built(spark, d)
    found = graph.cut(retrieval.keyword(questions(spark), ch, 20).withColumnRenamed("rank", "place"))
    packed = retrieval.pack(found, ch.rows(found))
    return packed.select("question_id", "n_blocks", js(c("chunk_ids")).alias("chunk_ids"))


@P.query("ag25_context_stats", with_chunks("SELECT question_id, count(*) AS candidates, count(DISTINCT source_path) AS sources, count(*) - count(DISTINCT source_path) AS repeats FROM keyword JOIN (SELECT chunk_id, source_path FROM chunks) USING (chunk_id) WHERE rank <= 20 GROUP BY 1", KEYWORD_SQL))
def ag25(spark, d):
    ch = built(spark, d)
    j = retrieval.keyword(questions(spark), ch, 20).join(ch.places().select("chunk_id", "source_path"), "chunk_id")
    return j.groupBy("question_id").agg(F.count("*").alias("candidates"), F.count_distinct("source_path").alias("sources"), (F.count("*") - F.count_distinct("source_path")).alias("repeats"))


def _rerank_sql(of: str = "keyword WHERE rank <= 10") -> str:
    """The additive score for questions without process codes in path or section, spelled out per term."""
    kinds = [(q, t, True) for q, t in EXACT] + [(q, t, False) for q, ts in KEYWORDS.items() for t in ts]
    anchors = {1: ["tkt-3", "status", "erand"], 2: ["src2/en/doc-42.md"], 3: ["erand", "thth"], 4: ["plan", "person", "src1"], 5: ["report", "tkt-7", "email"], 6: ["does", "trach", "src3", "erand"]}
    ctx = [(q, text_.lower().replace("?", ""), q == 6, q == 5, q == 6) for q, text_ in QUESTIONS]
    return f"""c0 AS (SELECT k.question_id, k.chunk_id, k.rank, g.* EXCLUDE (chunk_id) FROM (SELECT question_id, chunk_id, rank FROM {of}) k JOIN g USING (chunk_id)),
    fs AS (SELECT question_id, chunk_id, sum((len(list_filter(k, lambda z: contains(z, t))) > 0)::int * CASE WHEN ex THEN 140 ELSE 70 END + (len(list_filter(w, lambda z: contains(z, t))) > 0)::int * CASE WHEN ex THEN 80 ELSE 35 END + contains(p, t)::int * CASE WHEN ex THEN 70 ELSE 30 END + contains(s, t)::int * CASE WHEN ex THEN 40 ELSE 18 END + contains(j, t)::int * CASE WHEN ex THEN 30 ELSE 14 END + contains(d, t)::int * CASE WHEN ex THEN 18 ELSE 8 END + (contains(h, t)::int + contains(r, t)::int) * CASE WHEN ex THEN 8 ELSE 4 END + contains(x, t)::int * CASE WHEN ex THEN 16 ELSE 10 END) AS v FROM c0 JOIN {values(kinds)} u(q, t, ex) ON q = question_id GROUP BY 1, 2),
    am AS (SELECT question_id, chunk_id, sum(contains(j, t)::int * 3 + contains(p, t)::int * 3 + contains(s, t)::int * 2 + contains(x, t)::int) AS m FROM c0 JOIN {values([(q, t) for q, ts in anchors.items() for t in ts])} u(q, t) ON q = question_id GROUP BY 1, 2),
    rr AS (SELECT c0.question_id, c0.chunk_id, c0.rank, contains(x, qn)::int * 30 + contains(p, qn)::int * 80 + v + m * 20 + least(m, 8) * 10 + CASE WHEN ppl THEN least(len(w), 4) * 20 + (regexp_matches(x, 'phu trach|dau moi|spoc|review ho so|thu tuc golive'))::int * 90 ELSE 0 END + CASE WHEN tim THEN regexp_matches(p, 'cap nhat|tien do|mom|ho chieu|ocr|golive')::int * 70 ELSE 0 END + CASE WHEN ops THEN 50 ELSE 0 END + least(len(k), 3) * 3 + least(len(w), 4) * 2 AS score FROM c0 JOIN fs USING (question_id, chunk_id) JOIN am USING (question_id, chunk_id) JOIN {values(ctx)} z(q, qn, ppl, tim, ops) ON q = c0.question_id)"""


@P.query("wn11_rerank", with_chunks("SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS place FROM rr", KEYWORD_SQL, _rerank_sql()))
def wn11(spark, d):
    ch, q = built(spark, d), questions(spark)
    found = graph.cut(retrieval.keyword(q, ch, 10).drop("score"))
    return retrieval.rerank(found, q, ch.rows(found))


_variant = lambda of, n: f"""{n} AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY v, r) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY v, r) AS once FROM (SELECT CASE question_id WHEN {VARIANT[0]} THEN {VARIANT[1]} ELSE question_id END AS question_id, question_id AS v, chunk_id, rank AS r FROM {of} WHERE rank <= 20)) WHERE once = 1)"""
HYBRID_SQL = (
    _variant("keyword", "by_word"),
    f"""lists AS (SELECT question_id, chunk_id, rank, 0 AS no, 4.0::double AS w FROM exact WHERE rank <= 20 UNION ALL SELECT question_id, chunk_id, rank, 1, 3.5 FROM vector WHERE rank <= 20 UNION ALL
    SELECT question_id, chunk_id, rank, 2, 2.0 FROM by_word WHERE rank <= 20 AND question_id NOT IN (SELECT question_id FROM exact WHERE question_id IN (2, 3) AND rank <= 20 GROUP BY 1 HAVING count(*) >= 3) UNION ALL SELECT question_id, chunk_id, rank, 3, 3.0 FROM frequency WHERE rank <= 20),
    fused AS (SELECT * FROM (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY round(sum(w / (10.0::double + rank)), 9) DESC, min(struct_pack(a := no, b := rank))) AS rank FROM lists GROUP BY 1, 2) WHERE rank <= 20),
    related AS (SELECT * FROM (SELECT q AS question_id, chunk_id, row_number() OVER (PARTITION BY q ORDER BY source_path, chunk_index) AS rank FROM chunks, {values([(1, 'TKT-3'), (5, 'TKT-7')])} v(q, t) WHERE list_contains(ticket_ids, t)) WHERE rank <= 20),
    added AS (SELECT question_id, chunk_id, r, n, count(*) OVER (PARTITION BY question_id) AS g FROM (SELECT x.question_id, x.chunk_id, row_number() OVER (PARTITION BY x.question_id ORDER BY x.rank, x.chunk_id) AS r, n FROM related x JOIN (SELECT question_id, count(*) AS n FROM fused GROUP BY 1) USING (question_id) ANTI JOIN fused f ON f.question_id = x.question_id AND f.chunk_id = x.chunk_id) WHERE r <= greatest(1, n // 2)),
    both_ AS (SELECT question_id, chunk_id, rank FROM (SELECT f.*, count(*) OVER (PARTITION BY question_id) AS n, coalesce((SELECT max(g) FROM added a WHERE a.question_id = f.question_id), 0) AS g FROM fused f) WHERE rank <= n - g UNION ALL SELECT question_id, chunk_id, n - g + r FROM added)""",
    _rerank_sql("both_"),
    "placed AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS place FROM rr)",
)


@P.query("rt7_hybrid_query", with_chunks("""SELECT question_id, cast(count(*) AS int) AS n_blocks, string_agg(chunk_id, '|' ORDER BY place) AS chunk_ids FROM (SELECT *, sum(size) OVER (PARTITION BY question_id ORDER BY place) AS used FROM (SELECT question_id, chunk_id, length('[' || source_channel || ' | ' || date || ' | ' || source_path || '#' || section || ']' || chr(10) || text || chr(10)) AS size, row_number() OVER (PARTITION BY question_id ORDER BY r, f) AS place FROM (SELECT k.question_id, k.chunk_id, h.*, row_number() OVER (PARTITION BY question_id, source_path ORDER BY k.place) AS r, min(k.place) OVER (PARTITION BY question_id, source_path) AS f FROM placed k JOIN (SELECT chunk_id AS cid, * EXCLUDE (chunk_id) FROM chunks) h ON h.cid = k.chunk_id))) WHERE used <= 24000 GROUP BY 1""", EXACT_SQL, ALL_KEYWORD_SQL, FREQUENCY_SQL, VECTOR_SQL, *HYBRID_SQL))
def rt7(spark, d):
    """Variants, four lists, fusion, graph chunks, reranking, diversification and the budget, over all chunks."""
    ch, q = known(spark, d), questions(spark)
    registry = spark.createDataFrame(REGISTRY, "canonical string, aliases array<string>")
    ranked = graph.cut(retrieval.hybrid(q, ch, 20, registry, LetterCounts(), retrieval.related(q, ticket_graph(spark, d), ch.places(), 20)))
    packed = retrieval.pack(ranked, ch.rows(ranked))
    return packed.select("question_id", "n_blocks", js(c("chunk_ids")).alias("chunk_ids"))


# graph ---------------------------------------------------------------------------------------------------------------
EDGES_SQL = "edges AS (SELECT DISTINCT 'o' || l_orderkey AS from_id, 'MENTIONS' AS relation, 'p' || l_partkey AS to_id FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 'DEPENDS_ON', 's' || l_suppkey FROM lineitem UNION SELECT 's' || s_suppkey, 'BELONGS_TO', 'n' || s_nationkey FROM supplier)"


def links(spark, d):
    """The edges as they come, repeats among them."""
    li = table(spark, d, "lineitem")
    tag = lambda p, col: F.concat(F.lit(p), col.cast("string"))
    a = li.select(tag("o", c("l_orderkey")).alias("from_id"), F.lit("MENTIONS").alias("relation"), tag("p", c("l_partkey")).alias("to_id"))
    b = li.select(tag("p", c("l_partkey")), F.lit("DEPENDS_ON"), tag("s", c("l_suppkey")))
    s = table(spark, d, "supplier").select(tag("s", c("s_suppkey")), F.lit("BELONGS_TO"), tag("n", c("s_nationkey")))
    return a.union(b).union(s)


def edges(spark, d):
    return links(spark, d).distinct()


@P.query("jn12_k_hop", f"WITH {EDGES_SQL}, h1 AS (SELECT * FROM edges WHERE from_id IN ('o10', 's3') OR to_id IN ('o10', 's3')), n1 AS (SELECT from_id AS id FROM h1 UNION SELECT to_id FROM h1), h2 AS (SELECT * FROM edges WHERE from_id IN (SELECT id FROM n1) OR to_id IN (SELECT id FROM n1)) SELECT from_id, relation, to_id, CASE WHEN (from_id, relation, to_id) IN (SELECT from_id, relation, to_id FROM h1) THEN 1 ELSE 2 END AS hop FROM h2")
def jn12(spark, d):
    return graph.k_hop(links(spark, d), spark.createDataFrame([("o10",), ("s3",)], "id string"), 2)


@P.query("jn12_k_hop_each", f"WITH RECURSIVE {EDGES_SQL}, seeds AS (SELECT o_orderkey AS q, 'o' || o_orderkey AS id FROM orders WHERE o_orderkey % 1000 < 8), b AS (SELECT from_id AS x, to_id AS y, * FROM edges UNION ALL SELECT to_id, from_id, * FROM edges), n1 AS (SELECT DISTINCT q, y AS id FROM seeds JOIN b ON x = id), h AS (SELECT q, from_id, relation, to_id, 1 AS hop FROM seeds JOIN b ON x = id UNION ALL SELECT q, from_id, relation, to_id, 2 FROM n1 JOIN b ON x = id) SELECT q AS question_id, from_id, relation, to_id, min(hop) AS hop FROM h GROUP BY ALL")
def jn12_each(spark, d):
    """Two hops from a set of orders, each a question of its own."""
    o = table(spark, d, "orders").where("o_orderkey % 1000 < 8").select(c("o_orderkey").alias("question_id"), F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return graph.k_hop_each(links(spark, d), o, 2)


@P.query("jn13_seed_entities", f"WITH {EDGES_SQL} SELECT DISTINCT to_id AS id FROM edges WHERE relation = 'MENTIONS' AND from_id IN ('o10', 'o20', 'o30')")
def jn13(spark, d):
    return graph.seed_entities(links(spark, d), spark.createDataFrame([("o10",), ("o20",), ("o30",)], "chunk_id string"))


@P.query("jn14_subgraph_expand", f"WITH {EDGES_SQL}, s AS (SELECT DISTINCT to_id AS id FROM edges WHERE relation = 'MENTIONS' AND from_id IN ('o10', 'o20')) SELECT from_id, relation, to_id, 1 AS hop FROM edges WHERE from_id IN (SELECT id FROM s) OR to_id IN (SELECT id FROM s)")
def jn14(spark, d):
    e = links(spark, d)
    return graph.k_hop(e, graph.seed_entities(e, spark.createDataFrame([("o10",), ("o20",)], "chunk_id string")), 1)


def relations(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    rel = li.distinct().select(c("l_orderkey").alias("chunk_id"), F.concat(F.lit("part "), "l_partkey").alias("from_name"), F.when(c("l_partkey") % 3 == 0, "MADE_BY").otherwise("DEPENDS_ON").alias("relation"), F.concat(F.lit("supplier "), "l_suppkey").alias("to_name"))
    part, supplier = li.where("l_partkey % 4 > 0").select("l_orderkey", "l_partkey").distinct(), li.select("l_orderkey", "l_suppkey").distinct()  # made distinct as numbers, which take a fraction of the names' memory
    ent = part.select(c("l_orderkey").alias("chunk_id"), F.concat(F.lit("part "), "l_partkey").alias("name"), F.concat(F.lit("p"), "l_partkey").alias("node_id"), F.lit("Part").alias("type")).union(
        supplier.select("l_orderkey", F.concat(F.lit("supplier "), "l_suppkey"), F.concat(F.lit("s"), "l_suppkey"), F.when(c("l_suppkey") % 2 == 0, "Supplier").otherwise("Person")))
    return rel, ent


_rel = "li AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem), rel AS (SELECT l_orderkey AS chunk_id, 'p' || l_partkey AS from_id, CASE WHEN l_partkey % 3 = 0 THEN 'MADE_BY' ELSE 'DEPENDS_ON' END AS relation, 's' || l_suppkey AS to_id, CASE WHEN l_suppkey % 2 = 0 THEN 'Supplier' ELSE 'Person' END AS to_type FROM li WHERE l_partkey % 4 > 0)"


@P.query("jn15_relation_endpoints", f"WITH {_rel} SELECT chunk_id, from_id, relation, to_id FROM rel")
def jn15(spark, d):
    return graph.resolve_endpoints(*relations(spark, d)).select("chunk_id", "from_id", "relation", "to_id")


@P.query("jn16_ontology_validation", f"WITH {_rel} SELECT chunk_id, from_id, relation, to_id, relation = 'DEPENDS_ON' AND to_type = 'Supplier' AS valid FROM rel")
def jn16(spark, d):
    ontology = spark.createDataFrame([("DEPENDS_ON", "Part", "Supplier")], "relation string, from_type string, to_type string")
    kept, lost = graph.validated(graph.resolve_endpoints(*relations(spark, d)), ontology)
    cols = ["chunk_id", "from_id", "relation", "to_id"]
    return kept.select(*cols, F.lit(True).alias("valid")).union(lost.select(*cols, F.lit(False)))


@P.query("jn33_graph_agreement", f"WITH {EDGES_SQL}, a AS (SELECT * FROM edges WHERE hash(from_id) IS NOT NULL AND NOT ends_with(to_id, '1')), b AS (SELECT * FROM edges WHERE NOT ends_with(to_id, '2')) SELECT side, count(*) AS n FROM (SELECT CASE WHEN b.from_id IS NULL THEN 'first' WHEN a.from_id IS NULL THEN 'second' ELSE 'both' END AS side FROM a FULL JOIN b ON a.from_id = b.from_id AND a.relation = b.relation AND a.to_id = b.to_id) GROUP BY 1")
def jn33(spark, d):
    e = edges(spark, d)
    return graph.agreement(e.where(~c("to_id").endswith("1")), e.where(~c("to_id").endswith("2")))


@P.query("jn34_near_pairs", """WITH e AS (SELECT vec_id, embedding::double[] AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding::double[], lambda x: x * 2) FROM embeddings WHERE vec_id % 7 = 0),
    u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS w FROM e), k AS (SELECT w, min(vec_id) AS id FROM u GROUP BY w)
    SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.w, b.w), 6) AS cosine FROM k a JOIN k b ON a.id < b.id WHERE round(list_cosine_similarity(a.w, b.w), 6) >= 0.92 UNION ALL SELECT k.id, u.vec_id, 1.0 FROM u JOIN k USING (w) WHERE u.vec_id > k.id""")
def jn34(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("embedding"))  # and doubles of a seventh, which have the same directions
    copies = e.where("vec_id % 7 = 0").select(c("vec_id") + 1000000, F.transform("embedding", lambda x: x * 2))
    return graph.near_pairs(e.union(copies), 0.92)


@P.query("ag23_entity_resolution", """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, min(l_orderkey) OVER (PARTITION BY l_partkey) AS b FROM lineitem), x AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(n, m) USING KEY (n) AS (SELECT DISTINCT a, a FROM x UNION (SELECT f.n, min(g.m) FROM r g JOIN x ON x.a = g.n JOIN recurring.r f ON f.n = x.b WHERE g.m < f.m GROUP BY f.n)) SELECT n AS mention_id, m AS node_id FROM r""")
def ag23(spark, d):
    m = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("mention_id")).agg(F.collect_set(c("l_partkey").cast("string")).alias("aliases")).withColumn("type", F.lit("Order"))
    return graph.resolve_entities(m)


@P.query("rt14_graph_build", f"WITH {_rel} SELECT from_id, relation, to_id, count(*) AS mentions FROM rel WHERE relation = 'DEPENDS_ON' AND to_type = 'Supplier' AND chunk_id % 10 > 0 GROUP BY 1, 2, 3")
def rt14(spark, d):
    rel, ent = relations(spark, d)
    open_ = rel.where("chunk_id % 10 > 0")  # confidential chunks are not extracted from
    kept, _ = graph.validated(graph.resolve_endpoints(open_, ent), spark.createDataFrame([("DEPENDS_ON", "Part", "Supplier")], "relation string, from_type string, to_type string"))
    return kept.groupBy("from_id", "relation", "to_id").agg(F.count("*").alias("mentions"))


# index ---------------------------------------------------------------------------------------------------------------
@P.query("rt13_index_build", with_chunks("SELECT doc_id, chunk_index, md5(CASE WHEN old THEN 'old' ELSE text END) AS body FROM (SELECT *, doc_id % 17 > 0 AND doc_id % 11 > 0 AND doc_id % 13 > 0 AS old FROM chunks)"))
def rt13(spark, d):
    rows = docs(spark, d).withColumn("meta_hash", F.md5("visibility"))
    state = rows.where("doc_id % 17 > 0").select("doc_id", c("prev_hash").alias("content_hash"), "meta_hash")
    old = chunking.chunks(rows.where("doc_id % 17 > 0")).withColumn("chunk", F.lit("old"))
    new, _ = index.build_plan(rows, state, old)
    return new.select("doc_id", "chunk_index", F.md5("chunk").alias("body"))


_tokens = lambda e: f"string_split({squeeze_sql(f'lower({e})')}, ' ')"


@P.query("rt13_text_index", with_chunks(f"SELECT token, count(DISTINCT chunk_id) AS n FROM (SELECT chunk_id, unnest(list_concat({_tokens('text')}, {_tokens('source_path')}, {_tokens('section')}, {_tokens('project')}, {_tokens('doc_type')})) AS token FROM chunks) WHERE token <> '' GROUP BY 1"))
def rt13_index(spark, d):
    """The dictionary of the kept index with its document frequencies."""
    return built(spark, d).read("low_terms").select("token", "n")


@P.query("rt15_vector_attach", with_chunks(f"SELECT chunk_id, array_to_string(list_transform({_letters('text')}, lambda x: cast(x AS int)), '|') AS embedding FROM chunks"))
def rt15(spark, d):
    """Vectors by a model that the executors load."""

    def load():
        return lambda texts: [[x.lower().count(chr(97 + i)) + 1 for i in range(26)] for x in texts]

    rows = index.attach_vectors(chunking.chunks(docs(spark, d)), index.ExecutorModel(load, 26))
    return rows.select("chunk_id", js(F.transform("embedding", lambda x: x.cast("int").cast("string"))).alias("embedding"))


@P.query("ux6_split_function", with_chunks("SELECT doc_id, piece, md5(text) AS body FROM (SELECT doc_id, cast(chunk_index AS int) AS piece, text FROM chunks)"))
def ux6(spark, d):
    from sheaf.functions.tables import register

    register(spark)
    docs(spark, d).select("doc_id", "text").createOrReplaceTempView("ux6_docs")
    return spark.sql("SELECT doc_id, piece, md5(body) AS body FROM ux6_docs, LATERAL split_pieces(text, 1792, 256)")


P.over_docs("rt16_provider_route", lambda d: d.groupBy("project").agg(F.when(F.bool_or(c("sensitivity") == "confidential"), "local").otherwise("remote").alias("route")), "SELECT project, CASE WHEN bool_or(sensitivity = 'confidential') THEN 'local' ELSE 'remote' END AS route FROM docs GROUP BY 1")


def lane_context(d):
    rows = d.where((c("doc_type") == "mom") | (c("doc_date") >= F.date_sub(F.lit("2024-12-01").cast("date"), 200))).select("project", F.length("text").alias("size"), F.struct((c("doc_type") != "mom").alias("log"), F.datediff(F.lit("2025-01-01"), "doc_date").alias("age"), c("doc_id").alias("doc_id")).alias("key"), "doc_id")
    return ranking.budget_skip(rows, "project", "size", "key", 40000, ~c("key.log")).select("project", "doc_id")


P.over_docs("rt19_lane_context", lane_context, """WITH RECURSIVE o AS (SELECT project, doc_id, length(text) AS s, row_number() OVER (PARTITION BY project ORDER BY date '2025-01-01' - doc_date, doc_id) AS n, (SELECT coalesce(sum(length(text)), 0) FROM docs a WHERE a.project = docs.project AND a.doc_type = 'mom') AS notes FROM docs WHERE doc_type <> 'mom' AND doc_date >= date '2024-12-01' - 200),
    f AS (SELECT project, doc_id, n, notes + CASE WHEN notes + s <= 40000 THEN s ELSE 0 END AS used, notes + s <= 40000 AS kept FROM o WHERE n = 1 UNION ALL SELECT o.project, o.doc_id, o.n, CASE WHEN f.used + o.s <= 40000 THEN f.used + o.s ELSE f.used END, f.used + o.s <= 40000 FROM f JOIN o ON o.project = f.project AND o.n = f.n + 1) SELECT project, doc_id FROM f WHERE kept UNION ALL SELECT project, doc_id FROM docs WHERE doc_type = 'mom'""".replace("WITH RECURSIVE", "WITH"))  # fmt: skip
P.ORACLE["rt19_lane_context"] = P.ORACLE["rt19_lane_context"].replace("WITH docs", "WITH RECURSIVE docs", 1)

QUERIES, ORACLE = P.QUERIES, P.ORACLE
