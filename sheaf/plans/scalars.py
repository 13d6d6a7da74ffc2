"""Queries over the scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import dates, labels, text
from sheaf.operators import threads
from sheaf.plans.binding import Plans, docs, table, with_docs

P = Plans()
c = F.col


def js(col):
    """An array as one string, so that both engines compare alike."""
    return F.array_join(col, "|")


def fold_sql(e: str, table_only: bool = False) -> str:
    src, dst = (text.MARKED + "đ", text.PLAIN + "d") if table_only else (text.MARKED + text.OTHER_MARKED, text.PLAIN + text.OTHER_PLAIN)
    return f"trim(regexp_replace(translate(lower({e}), '{src}', '{dst}'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


def any_sql(e: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({e}, '{p}')" for p in phrases) + ")"


def squeeze_sql(e: str) -> str:
    return f"trim(regexp_replace({e}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


def distinct_sql(e: str) -> str:
    """First of each value kept, in order."""
    return f"list_transform(list_filter(list_zip({e}, range(1, len({e}) + 1)), lambda z: list_position({e}, z[1]) = z[2]), lambda z: z[1])"


P.over_docs("fn1_doc_type_guess", lambda d: d.select("doc_id", labels.doc_type(F.concat(c("doc_type"), F.lit("-"), c("title"))).alias("kind")),
    "SELECT doc_id, CASE WHEN contains(lower(doc_type || '-' || title), 'mom') THEN 'mom' WHEN contains(lower(doc_type || '-' || title), 'backlog') THEN 'backlog' WHEN contains(lower(doc_type || '-' || title), 'baocao') OR contains(lower(doc_type || '-' || title), 'report') THEN 'report' ELSE 'solution_doc' END AS kind FROM docs")
P.over_docs("fn3_confidential_clamp", lambda d: d.select("doc_id", labels.clamp_visibility(c("sensitivity"), F.when(c("doc_id") % 2 == 0, "shared").otherwise("guest")).alias("visibility")),
    "SELECT doc_id, CASE WHEN sensitivity = 'confidential' THEN 'owner' WHEN doc_id % 2 = 0 THEN 'shared' ELSE 'guest' END AS visibility FROM docs")
P.over_docs("fn4_source_channel", lambda d: d.select("doc_id", labels.source_channel(F.when(c("doc_id") % 3 == 0, "artifacts/x.pdf").when(c("doc_id") % 3 == 1, "zalo-capture"), F.element_at(F.array(*map(F.lit, ("msg", "pdf", "pdf-ocr-v2", "odd"))), (c("doc_id") % 4 + 1).cast("int"))).alias("channel")),
    "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'zalo-capture' ELSE (CASE doc_id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'document' WHEN 2 THEN 'pdf-ocr' ELSE 'document' END) END AS channel FROM docs")
P.over_docs("fn5_date_fallback", lambda d: d.select("doc_id", F.coalesce(F.when(c("doc_id") % 3 == 0, c("doc_date").cast("string")), F.when(c("doc_id") % 3 == 1, F.substring(F.concat(c("doc_date").cast("string"), F.lit("T10:00:00")), 1, 10)), F.lit("2023-12-31")).alias("date")),
    "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '2023-12-31' ELSE cast(doc_date AS varchar) END AS date FROM docs")
P.over_docs("fn6_ticket_ids", lambda d: d.select("doc_id", js(text.ticket_ids(c("note"), c("rel_path"), ("TKT", "RE"))).alias("tickets")),
    "SELECT doc_id, 'TKT-' || (doc_id % 50) || '|RE-' || (doc_id % 9) AS tickets FROM docs")
P.over_docs("fn7_people", lambda d: d.select("doc_id", js(text.people(c("note"))).alias("people")),
    "SELECT doc_id, 'Person ' || chr(cast(65 + doc_id % 26 AS int)) || '|Bob Lee|Ann Ray|Nguyễn Văn An' AS people FROM docs")
P.over_docs("fn8_hashes", lambda d: d.select("doc_id", F.substring(F.sha1("rel_path"), 1, 16).alias("id16"), F.sha2("text", 256).alias("content_hash"), F.substring(F.sha1(F.concat(F.lit("t1:"), c("rel_path"))), 1, 16).alias("tenant_id16")),
    "SELECT doc_id, substring(sha1(rel_path), 1, 16) AS id16, sha256(text) AS content_hash, substring(sha1('t1:' || rel_path), 1, 16) AS tenant_id16 FROM docs")
P.over_docs("fn9_fold_keep_stroke", lambda d: d.select("doc_id", text.fold_keep_stroke(F.concat(F.lit("Đường ẤM "), c("text"))).alias("folded")), f"SELECT doc_id, {fold_sql("'Đường ẤM ' || text")} AS folded FROM docs")
P.over_docs("fn10_fold_table", lambda d: d.select("doc_id", text.fold_table(F.concat(F.lit("Đường ẤM "), c("text"))).alias("folded")), f"SELECT doc_id, {fold_sql("'Đường ẤM ' || text", True)} AS folded FROM docs")
P.over_docs("fn12_squash", lambda d: d.select("doc_id", text.squash(c("title")).alias("squashed")), f"SELECT doc_id, regexp_replace({fold_sql('title')}, '[^a-z0-9]+', '', 'g') AS squashed FROM docs")
_codes = {k: any_sql("f", (*a, *(v.lower() for v in labels.code_variants(k)))) for k, a in labels.PROCESS_ALIASES.items()}
P.over_docs("fn13_process_codes", lambda d: d.select("doc_id", js(labels.process_codes(c("question"))).alias("codes"), labels.has_code(c("question")).alias("explicit")),
    f"SELECT doc_id, concat_ws('|', {', '.join(f'CASE WHEN {v} THEN {chr(39)}{k}{chr(39)} END' for k, v in _codes.items())}) AS codes, {any_sql('f', [v.lower() for k in labels.PROCESS_ALIASES for v in labels.code_variants(k)])} AS explicit FROM (SELECT doc_id, {fold_sql('question', True)} AS f FROM docs)")
P.over_docs("fn15_exact_terms", lambda d: d.select("doc_id", js(text.exact_terms(c("question"))).alias("terms")),
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'TKT-' || (doc_id % 50) WHEN 3 THEN 'report-v1.pdf' WHEN 4 THEN 'QT.IT.009'
    ELSE (CASE WHEN length(trim(question)) <= 80 AND NOT trim(question) LIKE '%?' AND len(regexp_split_to_array(trim(question), '[ \\t\\n\\r\\f\\x0B]+')) <= 3 THEN trim(question) ELSE '' END) END AS terms FROM docs""")  # fmt: skip
_stop = ", ".join(f"'{w}'" for w in text.STOPWORDS)
KEYWORDS_SQL = lambda e: distinct_sql("list_filter(list_transform(regexp_extract_all(" + fold_sql(e) + f", '[a-z0-9][a-z0-9._/-]+'), lambda t: regexp_replace(t, '^[._/-]+|[._/-]+$', '', 'g')), lambda t: length(t) >= 2 AND t NOT IN ({_stop}))")
P.over_docs("fn16_keyword_terms", lambda d: d.select("doc_id", js(text.keyword_terms(c("question"))).alias("terms")), f"SELECT doc_id, array_to_string({KEYWORDS_SQL('question')}, '|') AS terms FROM docs")
_gen, _short = ", ".join(f"'{w}'" for w in text.GENERIC_TERMS), ", ".join(f"'{w}'" for w in text.SHORT_ANCHORS)
P.over_docs("fn17_anchor_terms", lambda d: d.select("doc_id", js(text.anchor_terms(text.keyword_terms(c("question")))).alias("anchors")),
    f"SELECT doc_id, array_to_string(list_filter({KEYWORDS_SQL('question')}, lambda t: t NOT IN ({_gen}) AND (length(t) >= 4 OR t IN ({_short}))), '|') AS anchors FROM docs")
P.over_docs("fn18_intent_hints", lambda d: d.withColumn("f", text.fold_keep_stroke(c("question"))).select("doc_id", *(text.any_phrase(c("f"), h).alias(n) for n, h in (("people", text.PEOPLE_HINTS), ("timeline", text.TIME_HINTS), ("ops", text.OPS_HINTS)))),
    f"SELECT doc_id, {any_sql('f', text.PEOPLE_HINTS)} AS people, {any_sql('f', text.TIME_HINTS)} AS timeline, {any_sql('f', text.OPS_HINTS)} AS ops FROM (SELECT doc_id, {fold_sql('question')} AS f FROM docs)")
P.over_docs("fn19_planner_mode", lambda d: d.select("doc_id", text.planner_mode(F.size(text.words(c("question"))), c("doc_id") % 3, c("doc_id") % 2 == 0).alias("mode")),
    "SELECT doc_id, CASE WHEN len(list_filter(regexp_split_to_array(trim(question), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) >= 4 OR doc_id % 3 > 1 THEN 'mixed' WHEN doc_id % 2 = 0 THEN 'exact' ELSE 'semantic' END AS mode FROM docs")


def _gate(d):
    q = c("question")
    anchors = F.size(text.anchor_terms(text.keyword_terms(q)))
    hint = text.any_phrase(F.lower(q), text.OPS_HINTS + text.TIME_HINTS)
    exact = F.size(text.exact_terms(q)) > 0
    return d.select("doc_id", F.when(labels.has_code(q), True).when(exact & (F.size(text.words(q)) <= 3), False).otherwise(~((anchors >= 2) | ((anchors > 0) & hint))).alias("expand"))


P.over_docs("fn20_expansion_gate", _gate, f"""SELECT doc_id, CASE WHEN {any_sql(fold_sql('question', True), [v.lower() for k in labels.PROCESS_ALIASES for v in labels.code_variants(k)])} THEN true
    WHEN (doc_id % 6 IN (0, 3, 4) OR (len(w) <= 3 AND length(trim(question)) <= 80)) AND len(w) <= 3 THEN false
    ELSE NOT (len(a) >= 2 OR (len(a) > 0 AND {any_sql('lower(question)', text.OPS_HINTS + text.TIME_HINTS)})) END AS expand
    FROM (SELECT *, list_filter(regexp_split_to_array(trim(question), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '') AS w, list_filter({KEYWORDS_SQL('question')}, lambda t: t NOT IN ({_gen}) AND (length(t) >= 4 OR t IN ({_short}))) AS a FROM docs)""")  # fmt: skip
P.over_docs("fn21_snippet", lambda d: d.select("doc_id", text.snippet(c("text"), F.lit("zzqx erand the")).alias("snippet")),
    f"""SELECT doc_id, CASE WHEN p IS NULL THEN substring(b, 1, 240) ELSE CASE WHEN p > 81 THEN '...' ELSE '' END || trim(substring(b, cast(greatest(p - 81, 0) + 1 AS bigint), cast(least(length(b), p - 1 + 160) - greatest(p - 81, 0) AS bigint))) || CASE WHEN p - 1 + 160 < length(b) THEN '...' ELSE '' END END AS snippet
    FROM (SELECT doc_id, b, coalesce(nullif(instr(lower(b), 'zzqx'), 0), nullif(instr(lower(b), 'erand'), 0), nullif(instr(lower(b), 'the'), 0)) AS p FROM (SELECT doc_id, {squeeze_sql('text')} AS b FROM docs))""")  # fmt: skip
P.over_docs("fn22_month_bucket", lambda d: d.select("doc_id", F.coalesce(F.substring(F.when(c("doc_id") % 7 > 0, c("doc_date").cast("string")), 1, 7), F.lit("unknown")).alias("month")), "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE strftime(doc_date, '%Y-%m') END AS month FROM docs")
P.over_docs("fn23_document_card", lambda d: d.select("doc_id", "rel_path", "project", "source_channel", c("doc_date").cast("string").alias("date"), js(F.slice("people", 1, 10)).alias("people"), js(labels.process_codes(c("note"))).alias("codes")),
    f"SELECT doc_id, rel_path, project, source_channel, cast(doc_date AS varchar) AS date, people[1] AS people, concat_ws('|', {', '.join(f'CASE WHEN {v} THEN {chr(39)}{k}{chr(39)} END' for k, v in _codes.items())}) AS codes FROM (SELECT *, {fold_sql('note', True)} AS f FROM docs)")


def _flow(d):
    expected = F.array(F.lit("A1"), F.lit("A2"), F.lit("A3"))
    have = F.array_compact(F.array(*(F.when(c("doc_id") % n == 0, F.lit(k)) for k, n in (("A1", 2), ("A2", 3), ("A3", 5)))))
    covered, missing = F.array_intersect(expected, have), F.array_except(expected, have)
    return d.select("doc_id", js(covered).alias("covered"), js(missing).alias("missing"), F.concat(F.size(covered), F.lit("/3")).alias("ratio"), F.when(F.size(missing) == 0, "complete").when(F.size(covered) > 0, "partial").otherwise("missing").alias("status"))


P.over_docs("fn24_process_flow", _flow, """SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 2 = 0 THEN 'A1' END, CASE WHEN doc_id % 3 = 0 THEN 'A2' END, CASE WHEN doc_id % 5 = 0 THEN 'A3' END) AS covered, concat_ws('|', CASE WHEN doc_id % 2 <> 0 THEN 'A1' END, CASE WHEN doc_id % 3 <> 0 THEN 'A2' END, CASE WHEN doc_id % 5 <> 0 THEN 'A3' END) AS missing,
    n || '/3' AS ratio, CASE n WHEN 3 THEN 'complete' WHEN 0 THEN 'missing' ELSE 'partial' END AS status FROM (SELECT doc_id, (doc_id % 2 = 0)::int + (doc_id % 3 = 0)::int + (doc_id % 5 = 0)::int AS n FROM docs)""")  # fmt: skip
_d = "try_cast(printf('%04d-%02d-%02d', 2024 + doc_id % 3, doc_id % 13 + 1, doc_id % 33 + 1) AS date)"
P.over_docs("fn25_first_date", lambda d: d.select("doc_id", F.date_format(dates.first_date(c("note")), "yyyy-MM-dd HH:mm").alias("at")), f"SELECT doc_id, strftime({_d}, '%Y-%m-%d') || CASE WHEN doc_id % 3 = 0 THEN ' 08:30' ELSE ' 00:00' END AS at FROM docs")
P.over_docs("fn26_loose_date", lambda d: d.withColumn("t", F.concat(F.lit("by "), c("doc_id") % 33 + 1, F.lit("/"), c("doc_id") % 13 + 1, F.when(c("doc_id") % 2 == 0, "/25").otherwise(""))).select("doc_id", dates.loose_date(c("t"), 2026)[0].alias("label"), dates.loose_date(c("t"), 2026)[1].cast("string").alias("date")),
    "SELECT doc_id, (doc_id % 33 + 1) || '/' || (doc_id % 13 + 1) || CASE WHEN doc_id % 2 = 0 THEN '/25' ELSE '' END AS label, cast(try_cast(printf('%04d-%02d-%02d', CASE WHEN doc_id % 2 = 0 THEN 2025 ELSE 2026 END, doc_id % 13 + 1, doc_id % 33 + 1) AS date) AS varchar) AS date FROM docs")
P.over_docs("fn27_all_dates", lambda d: d.select("doc_id", js(F.transform(dates.all_dates(F.concat(c("note"), F.lit(" 03/04/2025 31/02/2025 3/4/2025"))), lambda x: x.cast("string"))).alias("dates")), f"SELECT doc_id, concat_ws('|', cast({_d} AS varchar), CASE WHEN {_d} IS DISTINCT FROM date '2025-04-03' THEN '2025-04-03' END) AS dates FROM docs")
P.over_docs("fn28_quarter", lambda d: d.select("doc_id", dates.quarter_of(c("note")).alias("quarter")), f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE coalesce(cast(quarter({_d}) AS int), 3) END AS quarter FROM docs")
P.over_docs("fn29_deadline_window", lambda d: d.withColumn("t", F.when(c("doc_id") % 2 == 0, F.concat(F.lit("Q"), c("doc_id") % 4 + 1, F.lit("/2025"))).otherwise(c("note"))).select("doc_id", *(x.cast("string").alias(n) for x, n in zip(dates.deadline_window(c("t")), ("from_day", "to_day"), strict=True))),
    f"SELECT doc_id, cast(CASE WHEN doc_id % 2 = 0 THEN make_date(2025, cast(doc_id % 4 * 3 + 1 AS int), 1) ELSE {_d} END AS varchar) AS from_day, cast(CASE WHEN doc_id % 2 = 0 THEN cast(make_date(2025, cast(doc_id % 4 * 3 + 1 AS int), 1) + interval 3 month - interval 1 day AS date) ELSE {_d} END AS varchar) AS to_day FROM docs")


@P.query("fn30_timeline_bar", """SELECT o_orderkey, round(l, 6) AS left_pct, round(greatest(least(greatest((e - date '1995-01-01') / 365.0, 0), 1) * 100 - l, 1.2), 6) AS width_pct
    FROM (SELECT o_orderkey, cast(o_orderdate AS date) + 30 AS e, least(greatest((cast(o_orderdate AS date) - date '1995-01-01') / 365.0, 0), 1) * 100 AS l FROM orders)""")  # fmt: skip
def fn30(spark, d):
    day = c("o_orderdate").cast("date")
    left, width = dates.bar(F.lit("1995-01-01").cast("date"), F.lit("1996-01-01").cast("date"), day, F.date_add(day, 30))
    return table(spark, d, "orders").select("o_orderkey", F.round(left, 6).alias("left_pct"), F.round(width, 6).alias("width_pct"))


@P.query("fn31_axis_bounds", "SELECT o_orderpriority, cast(date_trunc('month', min(cast(o_orderdate AS date))) AS date)::varchar AS axis_start, last_day(max(cast(o_orderdate AS date)))::varchar AS axis_end FROM orders GROUP BY 1")
def fn31(spark, d):
    day = c("o_orderdate").cast("date")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.trunc(F.min(day), "month").cast("string").alias("axis_start"), F.last_day(F.max(day)).cast("string").alias("axis_end"))


_NOT_WORD = "[^\\p{L}\\p{N}_]"


def canonical_sql(e: str) -> str:
    """The canonical title; separators are doubled, as one may stand between two words that go."""
    for pattern, by in (("<[^>]+>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        e = f"regexp_replace({e}, '{pattern}', '{by}', 'g')"
    e = f"lower(translate({e}, '‐‑‒–—', '-----'))"
    steps = [("\\[[^\\]]+\\]", " "), ("\\([^)]*\\)", " "), (f"({_NOT_WORD})", "\\1\\1"), (f"(^|{_NOT_WORD})((?:qlyc|yc|re|pa)-+[0-9]+)($|{_NOT_WORD})", "\\1 \\3")]
    steps += [(f"(^|{_NOT_WORD})({'|'.join(w.replace(' ', '  ') for w in labels.STOCK_WORDS)})($|{_NOT_WORD})", "\\1 \\3"), (f"[^0-9a-z{labels.VIETNAMESE}]+", " ")]
    for pattern, by in steps:
        e = f"regexp_replace({e}, '{pattern}', '{by}', 'g')"
    return squeeze_sql(e)


def tiers_sql(e: str, tiers, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(e, words)} THEN '{label}'" for label, words in tiers) + f" ELSE {default} END"


_fold = lambda e: squeeze_sql(f"translate(lower({e}), '{text.MARKED}đ', '{text.PLAIN}d')")
P.over_docs("fn34_workflow_labels", lambda d: d.select("doc_id", labels.workflow_status(c("label")).alias("status"), labels.workflow_priority(c("label")).alias("priority")),
    f"SELECT doc_id, {tiers_sql('t', labels.WORKFLOW_STATUS, f'CASE WHEN t <> {chr(39)}{chr(39)} THEN {chr(39)}{labels.IN_WORK}{chr(39)} ELSE {chr(39)}{labels.NO_LABEL}{chr(39)} END')} AS status, {tiers_sql('t', labels.WORKFLOW_PRIORITY, chr(39) + labels.NO_LABEL + chr(39))} AS priority FROM (SELECT doc_id, {_fold(canonical_sql('label'))} AS t FROM docs)")
P.over_docs("fn36_cell_status", lambda d: d.select("doc_id", labels.cell_status(F.concat(F.lit('<b class="status-tag '), c("lang"), F.lit('">x</b> '), c("state"))).alias("status")), "SELECT doc_id, CASE WHEN contains(lower(state), 'cancel') THEN 'cancelled' ELSE lang END AS status FROM docs")
P.over_docs("fn37_backlog_key", lambda d: d.select("doc_id", labels.backlog_key(F.concat(F.lit(" qlyc–"), c("doc_id"))).alias("key")), "SELECT doc_id, cast(doc_id AS varchar) AS key FROM docs")
P.over_docs("fn38_title_tokens", lambda d: threads.once(d.select("doc_id", "label"), title=labels.canonical_title(c("label"))).select("doc_id", F.md5("title").alias("canonical"), F.md5(js(F.array_sort(labels.canonical_tokens(c("title"))))).alias("tokens")),
    f"SELECT doc_id, md5(t) AS canonical, md5(array_to_string(list_sort(list_filter(list_distinct(string_split({_fold('t')}, ' ')), lambda w: length(w) >= 3)), '|')) AS tokens FROM (SELECT doc_id, {canonical_sql('label')} AS t FROM docs)")
P.over_docs("fn39_excerpt", lambda d: d.select("doc_id", text.excerpt(c("text")).alias("excerpt")), "SELECT doc_id, CASE WHEN length(trim(text)) <= 110 THEN trim(text) ELSE (CASE WHEN contains(substring(trim(text), 1, 110), ' ') THEN regexp_extract(substring(trim(text), 1, 110), '(?s)^(.*) [^ ]*$', 1) ELSE substring(trim(text), 1, 110) END) || '…' END AS excerpt FROM (SELECT doc_id, replace(text, '**', '') AS text FROM docs)")
P.over_docs("fn43_priority_guess", lambda d: d.select("doc_id", labels.priority(c("state"), c("title")).alias("priority")),
    f"SELECT doc_id, CASE WHEN {any_sql('lower(state)', labels.HIGH)} THEN 'high' WHEN {any_sql('lower(state)', labels.MEDIUM)} THEN 'medium' WHEN {any_sql('lower(state)', labels.LOW)} THEN 'low' WHEN {any_sql('lower(title)', labels.URGENT)} THEN 'high' ELSE 'medium' END AS priority FROM docs")
P.over_docs("fn44_category_guess", lambda d: d.select("doc_id", labels.category(F.concat_ws(" ", "title", F.when(c("doc_id") % 3 == 0, "fix it").when(c("doc_id") % 3 == 1, "tech  debt"))).alias("category")),
    f"SELECT doc_id, CASE {' '.join(f'WHEN {any_sql(chr(116), v)} THEN {chr(39)}{k}{chr(39)}' for k, v in labels.CATEGORIES)} ELSE 'feature' END AS category FROM (SELECT doc_id, lower(title) || CASE doc_id % 3 WHEN 0 THEN ' fix it' WHEN 1 THEN ' tech debt' ELSE '' END AS t FROM docs)")
_sample = lambda: F.concat(F.element_at(F.array(*map(F.lit, ("User story ", "Test plan: ", "# data model ", "Stakeholders\n", "Executive summary\nbusiness objectives of ", ""))), (c("doc_id") % 6 + 1).cast("int")), F.lit("** Scope **\n## Part "), "lang", F.lit("\nAPI of it\napis\n"), c("text"))
P.over_docs("fn47_document_kind", lambda d: d.withColumn("s", _sample()).select("doc_id", labels.document_kind(c("s")).alias("kind"), js(labels.clue_lines(c("s"), F.when(c("doc_id") % 2 == 0, F.concat("source", F.lit(".docx"))).otherwise(""))).alias("clues")),
    f"""SELECT doc_id, CASE WHEN contains(l, '{labels.BRD_WORDS[0]}') AND contains(l, '{labels.BRD_WORDS[1]}') THEN '{labels.BRD_KIND}' ELSE {tiers_sql('l', labels.DOCUMENT_KINDS, chr(39) + labels.OTHER_KIND + chr(39))} END AS kind,
    array_to_string(list_slice(list_concat(CASE WHEN doc_id % 2 = 0 THEN [source || '.docx'] ELSE [] END, list_slice(list_transform(list_filter(list_transform(string_split(s, chr(10)), lambda x: [trim(x), regexp_replace(trim(x), '^[#*\\- \t]+|[#*\\- \t]+$', '', 'g')]),
    lambda z: z[2] <> '' AND (starts_with(z[1], '#') OR ends_with(z[1], ':') OR regexp_matches(z[2], '(?i)^({'|'.join(labels.CLUE_STARTS)})([^A-Za-z0-9_]|$)'))), lambda z: substring(z[2], 1, {labels.CLUE})), 1, {labels.CLUES})), 1, {labels.CLUES}), '|') AS clues
    FROM (SELECT doc_id, source, s, lower(s) AS l FROM (SELECT doc_id, source, substring(['User story ', 'Test plan: ', '# data model ', 'Stakeholders' || chr(10), 'Executive summary' || chr(10) || 'business objectives of ', ''][cast(doc_id % 6 + 1 AS int)] || '** Scope **' || chr(10) || '## Part ' || lang || chr(10) || 'API of it' || chr(10) || 'apis' || chr(10) || text, 1, {labels.SAMPLE}) AS s FROM docs))""")  # fmt: skip
P.over_docs("fn57_presence_flags", lambda d: d.select("doc_id", (c("project") != "").alias("has_project"), c("doc_date").isNotNull().alias("has_date"), (F.size("ticket_ids") > 1).alias("has_two_tickets"), (c("prev_hash").isNotNull() & (c("prev_hash") != c("content_hash"))).alias("stale")),
    "SELECT doc_id, project <> '' AS has_project, doc_date IS NOT NULL AS has_date, len(ticket_ids) > 1 AS has_two_tickets, prev_hash IS NOT NULL AND prev_hash <> content_hash AS stale FROM docs")
P.over_docs("fn58_citation", lambda d: d.select("doc_id", F.concat(c("rel_path"), F.lit("#"), F.coalesce(F.when(c("doc_id") % 2 == 0, c("lang")), F.lit("root"))).alias("reference"), F.concat(F.lit("["), F.concat_ws(" | ", "source_channel", c("doc_date").cast("string"), "rel_path"), F.lit("]")).alias("citation")),
    "SELECT doc_id, rel_path || '#' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'root' END AS reference, '[' || source_channel || ' | ' || doc_date || ' | ' || rel_path || ']' AS citation FROM docs")
P.over_docs("fn59_scope_key", lambda d: d.select("doc_id", *(x.alias(n) for x, n in zip(labels.scope_key(F.concat(F.lit("./"), F.when(c("doc_id") % 2 == 0, c("rel_path")).otherwise(c("source")), F.lit("/"))), ("project_key", "workspace_key"), strict=True))),
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN rel_path ELSE '' END AS project_key, source AS workspace_key FROM docs")
P.over_docs("fn55_line_offset", lambda d: d.select("doc_id", text.line_of(c("text"), F.lit(120)).alias("line"), text.n_lines(c("text")).alias("n_lines")),
    "SELECT doc_id, length(substring(text, 1, 120)) - length(replace(substring(text, 1, 120), chr(10), '')) + 1 AS line, len(string_split(text, chr(10))) AS n_lines FROM docs")
P.over_docs("fn56_people_identities", lambda d: d.select("doc_id", F.explode(F.arrays_zip(text.matches(c("note"), "([A-Z][A-Za-z ]{2,60}?) *<([a-z]+@[a-z.]+)>", 1).alias("name"), text.matches(c("note"), "([A-Z][A-Za-z ]{2,60}?) *<([a-z]+@[a-z.]+)>", 2).alias("mail"))).alias("p")).select("doc_id", F.trim("p.name").alias("name"), "p.mail"),
    "SELECT doc_id, people[1] AS name, 'p@x.io' AS mail FROM docs")
P.over_docs("src25_preview", lambda d: d.select("doc_id", F.substring("text", 1, 12000).alias("preview"), (F.length("text") > 12000).alias("truncated"), text.n_lines(c("text")).alias("n_lines")), "SELECT doc_id, substring(text, 1, 12000) AS preview, length(text) > 12000 AS truncated, len(string_split(text, chr(10))) AS n_lines FROM docs")


@P.query("fn2_prefix_label", with_docs("WITH r(ord, prefix, label) AS (VALUES (1, 'src1/en', 'shared'), (2, 'src1', 'team'), (3, 'src2/', 'shared')) SELECT d.doc_id, coalesce(min_by(r.label, r.ord), 'internal') AS label FROM docs d LEFT JOIN r ON starts_with(d.rel_path, r.prefix) GROUP BY 1"))
def fn2(spark, d):
    from sheaf.operators.joins import prefix_labels

    rules = spark.createDataFrame([(1, "src1/en", "shared"), (2, "src1", "team"), (3, "src2/", "shared")], "ord int, prefix string, label string")
    return prefix_labels(docs(spark, d), rules, "rel_path", "internal").select("doc_id", "label")


@P.query("fn46_text_quality", f"""WITH m AS (SELECT conv_id, turn, text, {squeeze_sql('lower(text)')} AS n FROM conversations),
    p AS (SELECT conv_id, turn, x, count(*) AS k FROM (SELECT conv_id, turn, unnest(list_transform(regexp_split_to_array(n, '[,;.!?\\n]+'), lambda x: regexp_replace(x, '^[ -]+|[ -]+$', '', 'g'))) AS x FROM m) WHERE length(x) >= 8 GROUP BY ALL),
    b AS (SELECT conv_id, turn, max(k) AS k, max_by(length(x), k * 1000000 + length(x)) AS len FROM p GROUP BY ALL)
    SELECT m.conv_id, m.turn, CASE WHEN contains(n, 'thanks for watching') THEN 'boilerplate' WHEN coalesce(b.k >= 3 AND b.k * b.len >= greatest(48, 0.55 * length(n)), false) THEN 'repetition'
    WHEN length(n) >= 80 AND len(t) >= 12 AND len(list_distinct(t)) / len(t) <= 0.45 THEN 'low-entropy' END AS flag FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9à-ỹđ_]+') AS t FROM m) m LEFT JOIN b USING (conv_id, turn)""")  # fmt: skip
def fn46(spark, d):
    n = text.squeeze(F.lower("text"))
    k, size = text.dominant_phrase(c("text"))
    tokens = text.matches(F.lower("text"), "[a-z0-9à-ỹđ_]+")
    low = (F.length(n) >= 80) & (F.size(tokens) >= 12) & (text.unique_ratio(c("text")) <= 0.45)
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(n.contains("thanks for watching"), "boilerplate").when((k >= 3) & (k * size >= F.greatest(F.lit(48.0), 0.55 * F.length(n))), "repetition").when(low, "low-entropy").alias("flag"))


@P.query("fn49_conversation_title", "SELECT conv_id, turn, coalesce(nullif(trim(substring(CASE WHEN starts_with(lower(trim(text)), 'hello') THEN trim(substring(trim(text), 6), '!, ') ELSE trim(text) END, 1, 60)), ''), 'New Conversation') AS title FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Hello, ' ELSE '' END || text AS text FROM conversations) WHERE NOT regexp_matches(lower(trim(text)), '^(xin chào|chào|hi|hey)')")
def fn49(spark, d):
    q = F.trim(F.concat(F.when(c("turn") % 2 == 0, "Hello, ").otherwise(""), c("text")))
    title = F.regexp_replace(q, "(?i)^(xin chào|chào|hello|hi|hey)[!, ]*", "")
    plain = F.when(q.rlike("(?i)^(xin chào|chào|hello|hi|hey)"), F.regexp_replace(title, "[!, ]+$", "")).otherwise(q)
    rows = table(spark, d, "conversations").where(~F.lower(q).rlike("^(xin chào|chào|hi|hey)"))
    return rows.select("conv_id", "turn", F.coalesce(F.nullif(F.trim(F.substring(plain, 1, 60)), F.lit("")), F.lit("New Conversation")).alias("title"))


@P.query("fn50_collapse_clean", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('<details open>' || html || '</details><summary>x</summary>', '<details[^>]*>', '', 'g'), '</details>', '', 'g'), '(?s)<summary[^>]*>.*?</summary>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS body FROM pages")
def fn50(spark, d):
    b = F.concat(F.lit("<details open>"), c("html"), F.lit("</details><summary>x</summary>"))
    for p, r in (("<details[^>]*>", ""), ("</details>", ""), ("(?s)<summary[^>]*>.*?</summary>", ""), ("(?s)<!--.*?-->", ""), ("\\n{3,}", "\n\n")):
        b = F.regexp_replace(b, p, r)
    return table(spark, d, "pages").select("page_id", F.regexp_replace(b, "^[ \\n]+|[ \\n]+$", "").alias("body"))


@P.query("src10_html_text", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', ' ', 'g'), '(?is)<style.*?>.*?</style>', ' ', 'g'), '(?is)<noscript.*?>.*?</noscript>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS body FROM pages")
def src10(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_tags(c("html")).alias("body"))


QUERIES, ORACLE = P.QUERIES, P.ORACLE
