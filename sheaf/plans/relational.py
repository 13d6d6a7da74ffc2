"""Queries over filters, joins, aggregates, windows, set operations and sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheaf.functions import labels, text
from sheaf.operators import filters, joins, ledger, links, ranking
from sheaf.plans.binding import Plans, docs, table, with_docs
from sheaf.plans.scalars import distinct_sql, js, squeeze_sql

P = Plans()
c = F.col


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


# filters -------------------------------------------------------------------------------------------------------------
P.over_docs("fl1_access_filter", lambda d: ranking.top(filters.readable(d, guest=True), ["lang"], 5, c("doc_date").desc(), c("doc_id")).select("lang", "rank", "doc_id"),
    "SELECT lang, rank, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_date DESC, doc_id) AS rank FROM docs WHERE visibility = 'shared') WHERE rank <= 5")
P.over_docs("fl2_facet_filters", lambda d: filters.facets(d, {"source_channel": "EMAIL"}, {"ticket_ids": "tkt-3"}, "2024-02-01", "2024-11-30").select("doc_id"),
    "SELECT doc_id FROM docs WHERE source_channel = 'email' AND list_contains(ticket_ids, 'TKT-3') AND doc_date BETWEEN date '2024-02-01' AND date '2024-11-30'")
P.over_docs("fl3_all_terms", lambda d: d.where(filters.all_terms(F.concat_ws("\n", "rel_path", "project", "text"), "Src1 the er")).select("doc_id"),
    "SELECT doc_id FROM (SELECT doc_id, lower(concat_ws(chr(10), rel_path, project, text)) AS h FROM docs) WHERE contains(h, 'src1') AND contains(h, 'the') AND contains(h, 'er')")
P.over_docs("fl6_leak_gate", lambda d: filters.leaks(d, {"mail": "[A-Za-z0-9._]+@[A-Za-z0-9.]+", "url": "http", "digits": "[0-9]{6,}"}, d.where("doc_id % 10 = 0").select("doc_id"), 10000),
    """SELECT doc_id, rule FROM (SELECT doc_id, unnest(['mail', 'url', 'digits']) AS rule, unnest([regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+'), contains(text, 'http'), regexp_matches(text, '[0-9]{6,}')]) AS hit FROM docs WHERE doc_id % 10 <> 0) WHERE hit UNION ALL SELECT doc_id, 'size' FROM docs WHERE length(text) > 10000""")  # fmt: skip
P.over_docs("fl7_name_fragment", lambda d: d.select("doc_id", F.concat(F.element_at(F.array(*map(F.lit, ("(", "x)", "(y)", ""))), (c("doc_id") % 4 + 1).cast("int")), c("people")[0]).alias("name")).where(filters.name_fragment(c("name"))),
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '(' WHEN 1 THEN 'x)' ELSE '(y)' END || people[1] AS name FROM docs WHERE doc_id % 4 < 3")
P.over_docs("fl10_recency_split", lambda d: filters.recent(d, "2024-12-01", 14, c("doc_type") == "mom").select("doc_id"), "SELECT doc_id FROM docs WHERE doc_type = 'mom' OR doc_date >= date '2024-11-17'")
P.over_docs("fl11_transcript_gate", lambda d: d.withColumn("t", F.concat(F.when(c("doc_id") % 2 == 0, "Transcript\n").otherwise(""), F.lit("An Ray   03:0"), c("doc_id") % 10)).where(c("t").contains("Transcript")).select("doc_id", F.regexp_extract("t", "(?m)^([A-Z][A-Za-z ]+?) {2,}[0-9]{2}:[0-9]{2}$", 1).alias("speaker")), "SELECT doc_id, 'An Ray' AS speaker FROM docs WHERE doc_id % 2 = 0")
P.over_docs("src4_prune_paths", lambda d: d.where(~filters.pruned_path(F.concat(F.element_at(F.array(*map(F.lit, (".git/", "a/build/", "pkg.egg-info/", "ok/"))), (c("doc_id") % 4 + 1).cast("int")), c("rel_path")), ("build", "node_modules"))).select("doc_id"), "SELECT doc_id FROM docs WHERE doc_id % 4 = 3")


@P.query("fl12_sentinel_exists", with_docs("SELECT path FROM (VALUES ('src1'), ('src2/en'), ('src3/xx'), ('src0/en/doc-0.md'), ('none')) t(path) WHERE EXISTS (SELECT 1 FROM docs WHERE rel_path = path OR starts_with(rel_path, path || '/'))"))
def fl12(spark, d):
    want = frame(spark, [("src1",), ("src2/en",), ("src3/xx",), ("src0/en/doc-0.md",), ("none",)], "path string")
    return filters.present(want, docs(spark, d).select(c("rel_path").alias("path")))


@P.query("fl4_visible_sessions", "SELECT o_orderkey FROM orders o WHERE o_orderpriority <> '5-LOW' AND (o_orderstatus = 'F' OR o_custkey = 7 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'))")
def fl4(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'")
    public = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"))
    plain = (c("o_orderstatus") == "F") | (c("o_custkey") == 7)
    return o.where(plain).select("o_orderkey").union(o.where(~plain).join(public, "o_orderkey", "left_semi").select("o_orderkey"))


@P.query("fl5_public_items", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')")
def fl5(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_linestatus = 'O'").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


# joins ---------------------------------------------------------------------------------------------------------------
def state(d):
    return d.where("doc_id % 17 <> 0").select("doc_id", c("prev_hash").alias("content_hash"))


P.over_docs("jn1_changed_documents", lambda d: joins.changed(d, state(d)).select("doc_id"), "SELECT doc_id FROM docs WHERE doc_id % 17 = 0 OR prev_hash IS NULL OR prev_hash <> content_hash")
P.over_docs("jn2_deleted_documents", lambda d: joins.deleted(d.where("doc_id % 5 > 0"), state(d)).select("doc_id"), "SELECT doc_id FROM docs WHERE doc_id % 17 <> 0 AND doc_id % 5 = 0")
P.over_docs("jn3_freshness", lambda d: joins.freshness(d.where("doc_id % 6 > 0").select("doc_id", c("content_hash").alias("hash"), c("doc_date").alias("updated")), d.where("doc_id % 7 > 0").select("doc_id", F.coalesce("prev_hash", F.lit("")).alias("hash"), F.lit("2024-10-01").cast("date").alias("built"))),
    """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'orphaned' WHEN doc_id % 7 = 0 THEN 'missing' WHEN coalesce(prev_hash, '') <> content_hash THEN 'changed' ELSE 'stale' END AS status FROM docs WHERE (doc_id % 6 > 0 OR doc_id % 7 > 0) AND (doc_id % 6 = 0 OR doc_id % 7 = 0 OR coalesce(prev_hash, '') <> content_hash OR doc_date > date '2024-10-01')""")  # fmt: skip
P.over_docs("jn5_fetch_by_ids", lambda d: d.join(F.broadcast(d.sparkSession.range(0, 400, 7).toDF("doc_id")), "doc_id").select("doc_id", "rel_path"), "SELECT doc_id, rel_path FROM docs WHERE doc_id < 400 AND doc_id % 7 = 0")


@P.query("jn6_seen_messages", "SELECT conv_id, turn FROM conversations WHERE sha1(trim(text)) NOT IN (SELECT sha1(trim(text)) FROM conversations WHERE conv_id % 3 = 0)")
def jn6(spark, d):
    m = table(spark, d, "conversations")
    return joins.unseen(m, m.where("conv_id % 3 = 0").select(joins.message_key(c("text")).alias("msg_hash"))).select("conv_id", "turn")


@P.query("jn7_capture_preview", "SELECT conv_id, count(*) AS total, count(*) FILTER (seen) AS n_seen, count(*) FILTER (NOT seen) AS n_new, arg_min(seen, turn) AS oldest_seen FROM (SELECT conv_id, turn, sha1(trim(text)) IN (SELECT sha1(trim(text)) FROM conversations WHERE turn % 2 = 0) AS seen FROM conversations) GROUP BY 1")
def jn7(spark, d):
    m = table(spark, d, "conversations").withColumn("h", joins.message_key(c("text")))
    return ledger.capture_preview(m, m.where("turn % 2 = 0"), "conv_id", "turn", "h")


@P.query("jn8_capture_status", "SELECT c_custkey, count(o_orderkey) AS n, cast(max(o_orderdate) AS date)::varchar AS latest FROM customer LEFT JOIN orders ON CASE WHEN c_custkey % 2 = 0 THEN o_custkey = c_custkey ELSE 'Customer#' || lpad(cast(o_custkey AS varchar), 9, '0') = trim(c_name) END GROUP BY 1")
def jn8(spark, d):
    o = table(spark, d, "orders").withColumn("day", c("o_orderdate").cast("date"))
    by_id = (c("c_custkey") % 2 == 0, c("c_custkey"), c("o_custkey"))
    by_name = (F.lit(True), F.trim("c_name"), F.concat(F.lit("Customer#"), F.lpad(c("o_custkey").cast("string"), 9, "0")))
    return ledger.capture_status(table(spark, d, "customer"), o, "c_custkey", [by_id, by_name], "day", "o_orderkey").withColumn("latest", c("latest").cast("string"))


REGISTRY = [(f"Person {chr(65 + i)}", [f"P{i}"], [f"Person {chr(65 + (i + 1) % 26)}"]) for i in range(0, 26, 2)]
REGISTRY_SQL = "(VALUES " + ", ".join(f"('{a}', '{b[0]}', '{d[0]}')" for a, b, d in REGISTRY) + ") r(canonical, alias, dep)"


def registry(spark):
    return frame(spark, REGISTRY, "canonical string, aliases array<string>, depends_on array<string>")


@P.query("jn9_unmapped_identities", with_docs(f"SELECT DISTINCT people[1] AS name FROM docs WHERE people[1] NOT IN (SELECT canonical FROM {REGISTRY_SQL}) AND people[1] <> 'Person B'"))
def jn9(spark, d):
    return joins.unmapped(docs(spark, d).select(F.explode("people").alias("name")).distinct(), registry(spark), frame(spark, [("Person B",)], "name string"))


_q = lambda d: d.select(c("doc_id").alias("question_id"), F.concat(F.lit("who asked "), c("people")[0], F.lit("?")).alias("text"))


@P.query("jn10_alias_expansion", with_docs(f"SELECT doc_id AS question_id, 'who asked ' || people[1] || '?' AS variant FROM docs UNION ALL SELECT doc_id, 'who asked ' || alias || '?' FROM docs JOIN {REGISTRY_SQL} ON canonical = people[1]"))
def jn10(spark, d):
    return joins.alias_variants(_q(docs(spark, d)), registry(spark)).select("question_id", "variant")


@P.query("jn11_dependency_expansion", with_docs(f"SELECT doc_id AS question_id, 'who asked ' || people[1] || '?' AS variant FROM docs UNION ALL SELECT doc_id, 'who asked ' || unnest([alias, dep]) || '?' FROM docs JOIN {REGISTRY_SQL} ON canonical = people[1]"))
def jn11(spark, d):
    wide = registry(spark).select("canonical", "aliases", c("depends_on").alias("more"))
    own = registry(spark).select(c("canonical").alias("name")).join(docs(spark, d).select(F.explode("people").alias("name")).distinct(), "name", "left_semi")
    return joins.alias_variants(_q(docs(spark, d)), wide.join(own, c("canonical") == c("name"), "left_semi")).select("question_id", "variant").distinct()


@P.query("jn17_fuzzy_titles", f"""WITH w AS (SELECT p_partkey AS id, list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 3) AS l FROM part), a AS (SELECT id, {distinct_sql('l')} AS t FROM w), b AS (SELECT id + 1000000 AS id, CASE WHEN id % 3 = 0 AND len(t) > 1 THEN t[2:] ELSE t END AS t FROM a),
    s AS (SELECT a.id AS left_id, b.id AS right_id, len(list_intersect(a.t, b.t)) AS k, least(len(a.t), len(b.t)) AS m FROM a, b), r AS (SELECT left_id, right_id, k / m + CASE WHEN k = m THEN 0.2 ELSE 0 END AS score FROM s WHERE k > 0 AND k / m + CASE WHEN k = m THEN 0.2 ELSE 0 END >= 0.3)
    SELECT left_id, right_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(score, 9) DESC, right_id) AS n FROM r) WHERE n = 1""")  # fmt: skip
def jn17(spark, d):
    t = table(spark, d, "part").select(c("p_partkey").alias("id"), F.array_distinct(F.filter(F.split(F.lower("p_name"), " "), lambda w: F.length(w) >= 3)).alias("tokens"))
    cut = F.when((c("id") % 3 == 0) & (F.size("tokens") > 1), F.slice("tokens", 2, 99)).otherwise(c("tokens"))  # copies, of which some lack their first word
    return joins.fuzzy_titles(t, t.select((c("id") + 1000000).alias("id"), cut.alias("tokens")), 0.3).withColumn("score", F.round("score", 6))


@P.query("jn18_cascading_keys", "SELECT p.p_partkey, CASE WHEN p.p_partkey % 3 = 0 THEN p.p_partkey WHEN p.p_partkey % 3 = 1 THEN p.p_partkey END AS hit, CASE p.p_partkey % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'key' ELSE 'none' END AS via FROM part p")
def jn18(spark, d):
    p = table(spark, d, "part")
    rows = p.select("p_partkey", F.when(c("p_partkey") % 3 == 0, c("p_partkey")).alias("id"), F.when(c("p_partkey") % 3 == 1, F.concat(F.lit("K"), "p_partkey")).alias("key"))
    known = p.select(c("p_partkey").alias("target"), c("p_partkey").alias("known_id"), F.concat(F.lit("K"), "p_partkey").alias("known_key"))
    return ledger.cascade(rows, known, "target", [("id", "known_id"), ("key", "known_key")]).select("p_partkey", "hit", "via")


@P.query("jn19_nearest_event", """SELECT id, event_id, tier FROM (SELECT id, event_id, tier, row_number() OVER (PARTITION BY id ORDER BY tier, CASE WHEN tier = 2 THEN -gap ELSE abs(gap) END, event_id) AS n FROM (SELECT *, CASE WHEN gap = 0 THEN 0 WHEN abs(gap) = 1 THEN 1 WHEN gap < 0 THEN 2 ELSE 3 END AS tier FROM (SELECT a.o_orderkey AS id, b.o_orderkey AS event_id, cast(b.o_orderdate AS date) - cast(a.o_orderdate AS date) AS gap FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1))) WHERE n = 1""")
def jn19(spark, d):
    o = table(spark, d, "orders").withColumn("day", c("o_orderdate").cast("date"))
    return joins.nearest_event(o.where("o_orderkey % 2 = 0").select(c("o_orderkey").alias("id"), "o_custkey", "day"), o.where("o_orderkey % 2 = 1").select(c("o_orderkey").alias("event_id"), "o_custkey", c("day").alias("event_day")), "o_custkey")


@P.query("jn23_items_without_change", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def jn23(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@P.query("jn24_change_upsert", "SELECT coalesce(n.k, o.k) AS change_key, coalesce(n.v, o.v) AS total, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'keep' ELSE 'update' END AS action FROM (SELECT printf('CHG-%03d-%02d', l_orderkey % 1000, l_linenumber) AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1) o FULL JOIN (SELECT printf('CHG-%03d-%02d', l_orderkey % 1000, l_linenumber) AS k, min(l_extendedprice) AS v FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1) n ON o.k = n.k")
def jn24(spark, d):
    li = table(spark, d, "lineitem").withColumn("k", F.format_string("CHG-%03d-%02d", c("l_orderkey") % 1000, c("l_linenumber")))
    old = li.where("l_orderkey % 3 <> 0").groupBy(c("k").alias("change_key")).agg(F.max("l_extendedprice").alias("total"))
    new = li.where("l_orderkey % 4 <> 0").groupBy(c("k").alias("change_key")).agg(F.min("l_extendedprice").alias("total"))
    return ledger.upserted(old, new, "change_key", "total")


@P.query("jn25_latest_change_key", "SELECT o_orderkey, (SELECT arg_max(l_partkey, l_linenumber * 100000000 + l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS latest FROM orders")
def jn25(spark, d):
    last = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("latest"))
    return table(spark, d, "orders").select("o_orderkey").join(last, "o_orderkey", "left")


@P.query("jn26_relevant_changes", "SELECT o_orderkey, c_name, coalesce(n_name, 'none') AS nation FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 WHERE o_orderstatus = 'O' OR c_custkey < 50 ORDER BY o_orderkey DESC LIMIT 50")
def jn26(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), c("c_custkey") == c("o_custkey")).join(table(spark, d, "nation").where("n_regionkey < 3"), c("n_nationkey") == c("c_nationkey"), "left")
    return j.where("o_orderstatus = 'O' or c_custkey < 50").orderBy(c("o_orderkey").desc()).limit(50).select("o_orderkey", "c_name", F.coalesce("n_name", F.lit("none")).alias("nation"))


P.over_docs("jn27_scanned_projects", lambda d: ledger.scanned(d.where("doc_id % 3 = 0"), d.where("doc_id % 20 <> 3"), "project", "doc_date"),
    "SELECT coalesce(a.project, b.project) AS project, coalesce(n, 0) AS n, coalesce(seen_at, 'never') AS scanned FROM (SELECT project, count(*) AS n FROM docs WHERE doc_id % 3 = 0 GROUP BY 1) a FULL JOIN (SELECT project, max(cast(doc_date AS varchar)) AS seen_at FROM docs WHERE doc_id % 20 <> 3 GROUP BY 1) b ON a.project = b.project")
P.over_docs("jn28_workspace_rollup", lambda d: d.sparkSession.createDataFrame([("src1",), ("src2",), ("nope",)], "workspace string").join(d.groupBy(c("project").alias("workspace")).agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs")), "workspace", "left").select("workspace", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("langs", F.lit(0)).alias("langs")),
    "SELECT workspace, coalesce(n, 0) AS n, coalesce(langs, 0) AS langs FROM (VALUES ('src1'), ('src2'), ('nope')) w(workspace) LEFT JOIN (SELECT project, count(*) AS n, count(DISTINCT lang) AS langs FROM docs GROUP BY 1) ON project = workspace")


@P.query("jn29_drafts_listing", "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 10 OR p_size > 40 ORDER BY l_orderkey DESC, l_linenumber, p_name, s_name LIMIT 100")
def jn29(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), c("p_partkey") == c("l_partkey")).join(table(spark, d, "supplier"), c("s_suppkey") == c("l_suppkey"))
    return j.where("s_nationkey < 10 or p_size > 40").orderBy(c("l_orderkey").desc(), "l_linenumber", "p_name", "s_name").limit(100).select("l_orderkey", "l_linenumber", "p_name", "s_name")


@P.query("jn30_valid_sessions", "SELECT event_id, c_name FROM events JOIN customer ON c_custkey = user_id WHERE ts >= (SELECT max(ts) - interval 10 day FROM events)")
def jn30(spark, d):
    e = table(spark, d, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("last")))).where(c("ts") >= c("last") - F.expr("interval 10 days")).join(table(spark, d, "customer"), c("c_custkey") == c("user_id")).select("event_id", "c_name")


_kw = ["the", "ther", "and", "der", "que", "les", "erand", "ung"]


@P.query("jn31_longest_keyword", "SELECT line_id, arg_min(k, struct_pack(a := -length(k), b := k)) AS keyword, arg_min(s, struct_pack(a := -length(k), b := k)) AS source FROM (SELECT conv_id * 1000 + turn AS line_id, text FROM conversations) JOIN (VALUES " + ", ".join(f"('{k}', 's{i}')" for i, k in enumerate(_kw)) + ") w(k, s) ON contains(lower(text), k) GROUP BY 1")
def jn31(spark, d):
    lines = table(spark, d, "conversations").select((c("conv_id") * 1000 + c("turn")).alias("line_id"), "text")
    return joins.longest_keyword(lines, frame(spark, [(k, f"s{i}") for i, k in enumerate(_kw)], "keyword string, source string"))


@P.query("jn32_confirmations", "SELECT event_id, event_type, coalesce(who, 0) AS confirmed_by FROM events LEFT JOIN (SELECT event_id AS id, user_id AS who FROM events WHERE event_id % 3 = 0) ON id = event_id")
def jn32(spark, d):
    e = table(spark, d, "events")
    return e.join(e.where("event_id % 3 = 0").select("event_id", c("user_id").alias("who")), "event_id", "left").select("event_id", "event_type", F.coalesce("who", F.lit(0)).alias("confirmed_by"))


# aggregates ----------------------------------------------------------------------------------------------------------
def facet_counts(d):
    return links.facet_counts(d, {"project": "project", "channel": "source_channel", "type": "doc_type", "ticket": "ticket_ids", "person": "people"})


P.over_docs("ag1_facet_counts", facet_counts, "WITH v AS (SELECT 'project' AS facet, project AS value FROM docs UNION ALL SELECT 'channel', source_channel FROM docs UNION ALL SELECT 'type', doc_type FROM docs UNION ALL SELECT 'ticket', unnest(ticket_ids) FROM docs UNION ALL SELECT 'person', unnest(people) FROM docs) SELECT facet, value, n FROM (SELECT facet, value, count(*) AS n, row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, value) AS r FROM v GROUP BY 1, 2) WHERE r <= 20")
_maps = lambda d, key: links.link_map(d, key).withColumns({"projects": js(c("projects")), "channels": js(c("channels")), "latest": c("latest").cast("string")})
_maps_sql = lambda key, src="docs": f"SELECT {key} AS key, count(*) AS n_docs, string_agg(DISTINCT project, '|' ORDER BY project) AS projects, string_agg(DISTINCT source_channel, '|' ORDER BY source_channel) AS channels, count(DISTINCT doc_type) AS n_types, count(*) FILTER (doc_type = 'backlog') AS n_backlog, cast(max(doc_date) AS varchar) AS latest FROM {src} GROUP BY 1"
P.over_docs("ag2_links_by_project", lambda d: _maps(d, c("project")), _maps_sql("project"))
P.over_docs("ag2_links_by_channel", lambda d: _maps(d, c("source_channel")), _maps_sql("source_channel"))
P.over_docs("ag2_links_by_month", lambda d: _maps(d, F.date_format("doc_date", "yyyy-MM")), _maps_sql("strftime(doc_date, '%Y-%m')"))
P.over_docs("ag2_links_by_ticket", lambda d: _maps(d, "ticket_ids"), _maps_sql("t", "(SELECT *, unnest(ticket_ids) AS t FROM docs)"))
P.over_docs("ag2_links_by_person", lambda d: _maps(d, "people"), _maps_sql("p", "(SELECT *, unnest(people) AS p FROM docs)"))
P.over_docs("ag3_link_totals", links.link_totals, "SELECT count(DISTINCT project) AS projects, count(DISTINCT source_channel) AS channels, count(DISTINCT strftime(doc_date, '%Y-%m')) AS months, count(*) AS documents FROM docs")
P.over_docs("ag4_backlink_groups", lambda d: links.backlinks(d.where("project = 'src1'"), "ticket_ids").withColumnRenamed("link", "ticket"), "SELECT t AS ticket, count(*) AS hits FROM (SELECT unnest(ticket_ids) AS t FROM docs WHERE project = 'src1') GROUP BY 1 ORDER BY hits DESC, ticket LIMIT 8")
P.over_docs("ag5_anchor_detail", lambda d: links.anchor_detail(d, "ticket_ids", "TKT-3").withColumns({"projects": js(c("projects")), "people": js(c("people")), "latest": c("latest").cast("string")}), "SELECT count(*) AS n_docs, string_agg(DISTINCT project, '|' ORDER BY project) AS projects, string_agg(DISTINCT people[1], '|' ORDER BY people[1]) AS people, cast(max(doc_date) AS varchar) AS latest FROM docs WHERE list_contains(ticket_ids, 'TKT-3')")


P.over_docs("ag6_related_documents", lambda d: links.related(d, "doc_id", 3), "SELECT d.doc_id, (d.project = a.project)::int * 3 + 4 * len(list_intersect(d.ticket_ids, a.ticket_ids)) + 2 * len(list_intersect(d.people, a.people)) + (d.source_channel = a.source_channel)::int + (strftime(d.doc_date, '%Y-%m') = strftime(a.doc_date, '%Y-%m'))::int AS score FROM docs d, docs a WHERE a.doc_id = 3 AND d.doc_id <> 3 ORDER BY score DESC, d.doc_date, d.rel_path LIMIT 12")
_cov = {"project": "project <> ''", "channel": "doc_id % 3 > 0", "date": "doc_id % 7 > 0", "tickets": "doc_id % 2 = 0", "people": "doc_id % 5 > 0", "reliability": "doc_id % 11 > 0", "type": "doc_type <> 'report'"}
P.over_docs("ag7_metadata_coverage", lambda d: d.agg(F.count("*").alias("total"), *(F.count_if(F.expr(e)).alias(f"n_{k}") for k, e in _cov.items()), *(F.round(F.avg(F.expr(e).cast("int")) * 100, 1).alias(f"pct_{k}") for k, e in _cov.items())), "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER ({e}) AS n_{k}, round(avg(({e})::int) * 100, 1) AS pct_{k}" for k, e in _cov.items()) + " FROM docs")
P.over_docs("ag8_health_summary", lambda d: d.agg(F.count_if(F.expr("prev_hash is null")).alias("missing"), F.count_if(F.expr("prev_hash <> content_hash")).alias("changed"), F.count_if(F.expr("prev_hash = content_hash")).alias("fresh")), "SELECT count(*) FILTER (prev_hash IS NULL) AS missing, count(*) FILTER (prev_hash <> content_hash) AS changed, count(*) FILTER (prev_hash = content_hash) AS fresh FROM docs")
P.over_docs("ag9_knowledge_home", lambda d: d.orderBy(c("doc_date").desc(), c("rel_path").desc()).limit(10).select(F.lit("recent").alias("list"), c("rel_path").alias("item"), c("doc_date").cast("string").alias("detail")).unionByName(d.groupBy("project").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "project").limit(8).select(F.lit("active").alias("list"), c("project").alias("item"), c("n").cast("string").alias("detail"))), "SELECT * FROM (SELECT 'recent' AS list, rel_path AS item, cast(doc_date AS varchar) AS detail FROM docs ORDER BY doc_date DESC, rel_path DESC LIMIT 10) UNION ALL SELECT * FROM (SELECT 'active', project, cast(count(*) AS varchar) FROM docs GROUP BY 2 ORDER BY count(*) DESC, project LIMIT 8)")


@P.query("ag10_alerts_report", "SELECT event_type AS severity, count(*) AS total, count(*) FILTER (event_id % 4 <> 0) AS open, cast(date_trunc('second', max(ts)) AS varchar) AS last_run FROM events GROUP BY 1")
def ag10(spark, d):
    return table(spark, d, "events").groupBy(c("event_type").alias("severity")).agg(F.count("*").alias("total"), F.count_if(c("event_id") % 4 != 0).alias("open"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_run"))


@P.query("ag11_usage_totals", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS used FROM events GROUP BY 1 ORDER BY round(sum(value), 4) DESC, user_id LIMIT 10")
def ag11(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("used")).orderBy(c("used").desc(), "user_id").limit(10)


@P.query("ag12_daily_totals", "SELECT cast(cast(ts AS date) AS varchar) AS day, round(sum(value), 4) AS used FROM events WHERE cast(ts AS date) > (SELECT max(cast(ts AS date)) - 14 FROM events) GROUP BY 1")
def ag12(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    last = F.broadcast(e.agg(F.date_sub(F.max("day"), 14).alias("since")))
    return e.crossJoin(last).where("day > since").groupBy(c("day").cast("string").alias("day")).agg(F.round(F.sum("value"), 4).alias("used"))


@P.query("ag13_session_item_counts", "SELECT o_orderkey, count(l_linenumber) AS total, count(*) FILTER (l_returnflag = 'R') AS public, coalesce(sum((l_linestatus = 'O' OR l_returnflag = 'R')::int), 0) AS visible FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def ag13(spark, d):
    items = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("total"), F.count_if(c("l_returnflag") == "R").alias("public"), F.count_if((c("l_linestatus") == "O") | (c("l_returnflag") == "R")).alias("visible"))
    return table(spark, d, "orders").select("o_orderkey").join(items, "o_orderkey", "left").na.fill(0)


@P.query("ag14_role_counts", "SELECT conv_id, count(*) AS total, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants FROM conversations GROUP BY 1")
def ag14(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("total"), F.count_if(c("role") == "user").alias("users"), F.count_if(c("role") == "assistant").alias("assistants"))


@P.query("ag15_run_history", "SELECT o_orderkey, c_name AS label, count(l_linenumber) AS artifacts FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def ag15(spark, d):
    n = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("artifacts"))
    return table(spark, d, "orders").join(n, "o_orderkey", "left").join(table(spark, d, "customer"), c("c_custkey") == c("o_custkey"), "left").select("o_orderkey", c("c_name").alias("label"), F.coalesce("artifacts", F.lit(0)).alias("artifacts"))


@P.query("ag16_phase_status", "SELECT o_orderpriority AS phase, CASE WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN 'completed' WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'running' ELSE 'pending' END AS status, count(*) AS agents FROM orders GROUP BY 1")
def ag16(spark, d):
    n = lambda s: F.count_if(c("o_orderstatus") == s)
    return table(spark, d, "orders").groupBy(c("o_orderpriority").alias("phase")).agg(F.when(n("F") == F.count("*"), "completed").when(n("P") > 0, "running").otherwise("pending").alias("status"), F.count("*").alias("agents"))


@P.query("ag17_phase_completion", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS total FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def ag17(spark, d):
    return table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").groupBy("o_custkey").agg(F.count_if(c("o_orderstatus") == "F").alias("done"), F.count("*").alias("total"))


P.over_docs("ag18_tenant_rollup", lambda d: d.rollup("source", "lang").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("*")).alias("org"), F.coalesce("lang", F.lit("*")).alias("workspace"), "n"), "SELECT coalesce(source, '*') AS org, coalesce(lang, '*') AS workspace, count(*) AS n FROM docs GROUP BY ROLLUP (source, lang)")
P.over_docs("ag19_folder_counts", lambda d: d.groupBy(F.split("rel_path", "/")[0].alias("folder")).agg(F.count("*").alias("notes"), F.bool_or(c("sensitivity") == "confidential").alias("has_confidential")), "SELECT split_part(rel_path, '/', 1) AS folder, count(*) AS notes, bool_or(sensitivity = 'confidential') AS has_confidential FROM docs GROUP BY 1")
P.over_docs("ag20_quarter_groups", lambda d: d.sparkSession.range(1, 5).select(c("id").cast("int").alias("quarter")).join(d.where("doc_id % 4 <> 3").groupBy(F.quarter("doc_date").alias("quarter")).agg(F.count("*").alias("n")), "quarter", "left").select("quarter", F.coalesce("n", F.lit(0)).alias("n")), "SELECT cast(q AS int) AS quarter, count(doc_id) AS n FROM range(1, 5) t(q) LEFT JOIN docs ON quarter(doc_date) = q AND doc_id % 4 <> 3 GROUP BY 1")
P.over_docs("ag22_senders_with_groups", lambda d: d.select(F.explode("people").alias("name"), "project").groupBy("name").agg(js(F.sort_array(F.collect_set("project"))).alias("groups")), "SELECT people[1] AS name, string_agg(DISTINCT project, '|' ORDER BY project) AS groups FROM docs GROUP BY 1")


@P.query("ag24_upsert_dedupe", "SELECT l_partkey, l_suppkey, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS n FROM lineitem) WHERE n = 1")
def ag24(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return ranking.latest(li, ["l_partkey", "l_suppkey"], -c("l_orderkey"), -c("l_linenumber"), -c("l_quantity")).select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity")


# windows -------------------------------------------------------------------------------------------------------------
@P.query("wn4_diversify", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY r, f) AS place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS f FROM orders)")
def wn4(spark, d):
    rows = table(spark, d, "orders").select(c("o_custkey").alias("question_id"), c("o_orderkey").alias("rank"), c("o_orderpriority").alias("source_path"))
    return ranking.diversify(rows).select(c("question_id").alias("o_custkey"), c("rank").alias("o_orderkey"), "place")


@P.query("wn5_budget_stop", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS used FROM orders) WHERE used <= 500000")
def wn5(spark, d):
    return ranking.budget_stop(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey", 500000).select("o_custkey", "o_orderkey")


@P.query("wn6_budget_skip", """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, cast(floor(o_totalprice) AS bigint) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    f AS (SELECT o_custkey, o_orderkey, n, CASE WHEN s <= 300000 THEN s ELSE 0 END AS used, s <= 300000 AS kept FROM o WHERE n = 1 UNION ALL SELECT o.o_custkey, o.o_orderkey, o.n, CASE WHEN f.used + o.s <= 300000 THEN f.used + o.s ELSE f.used END, f.used + o.s <= 300000 FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.n = f.n + 1)
    SELECT o_custkey, o_orderkey FROM f WHERE kept""")  # fmt: skip
def wn6(spark, d):
    o = table(spark, d, "orders").withColumn("s", F.floor("o_totalprice"))
    return ranking.budget_skip(o, "o_custkey", "s", "o_orderkey", 300000).select("o_custkey", "o_orderkey")


@P.query("wn7_first_occurrence", "SELECT l_orderkey, l_partkey, r AS rank FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY m, l_partkey) AS r FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS m FROM lineitem GROUP BY ALL)) WHERE r <= 3")
def wn7(spark, d):
    return ranking.first_occurrence(table(spark, d, "lineitem"), ["l_orderkey"], "l_partkey", 3, c("l_linenumber"), c("l_partkey")).select("l_orderkey", "l_partkey", "rank")


@P.query("wn8_variant_fill", "SELECT q AS question_id, chunk, r AS rank FROM (SELECT q, chunk, row_number() OVER (PARTITION BY q ORDER BY v, k, chunk) AS r FROM (SELECT l_suppkey AS q, l_partkey AS chunk, min(l_linenumber) AS v, arg_min(l_orderkey, struct_pack(a := l_linenumber, b := l_orderkey)) AS k FROM lineitem GROUP BY 1, 2)) WHERE r <= 10")
def wn8(spark, d):
    return ranking.first_occurrence(table(spark, d, "lineitem").select(c("l_suppkey").alias("question_id"), c("l_partkey").alias("chunk"), "l_linenumber", "l_orderkey"), ["question_id"], "chunk", 10, c("l_linenumber"), c("l_orderkey"), c("chunk")).select("question_id", "chunk", "rank")


_lists = "SELECT l_suppkey AS question_id, l_linenumber AS list_no, CASE l_linenumber WHEN 1 THEN 4.0 WHEN 2 THEN 3.5 WHEN 3 THEN 2.0 ELSE 3.0 END AS weight, l_partkey AS chunk_id, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_partkey, l_orderkey) AS rank FROM lineitem WHERE l_linenumber <= 4"


def lists(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber <= 4")
    weight = F.when(c("l_linenumber") == 1, 4.0).when(c("l_linenumber") == 2, 3.5).when(c("l_linenumber") == 3, 2.0).otherwise(3.0)
    rank = F.row_number().over(Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_partkey", "l_orderkey"))
    return li.select(c("l_suppkey").alias("question_id"), c("l_linenumber").alias("list_no"), weight.alias("weight"), c("l_partkey").alias("chunk_id"), rank.alias("rank"))


@P.query("wn9_rank_fusion", f"SELECT question_id, chunk_id, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, seen) AS r FROM (SELECT question_id, chunk_id, sum(weight / (10.0::double + rank)) AS score, min(struct_pack(a := list_no, b := rank)) AS seen FROM ({_lists}) GROUP BY 1, 2)) WHERE r <= 20")
def wn9(spark, d):
    return ranking.fuse(lists(spark, d), 20).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@P.query("wn10_graph_budget", f"""WITH l AS ({_lists}), p AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY rank, chunk_id) AS rank FROM (SELECT question_id, chunk_id, min(rank) AS rank FROM l WHERE list_no = 1 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank, chunk_id) <= 8),
    n AS (SELECT question_id, count(*) AS n FROM p GROUP BY 1), e AS (SELECT question_id, chunk_id, min(rank) AS rank FROM l WHERE list_no = 2 GROUP BY 1, 2), x AS (SELECT e.question_id, chunk_id, n, row_number() OVER (PARTITION BY e.question_id ORDER BY rank, chunk_id) AS r FROM e JOIN n USING (question_id) WHERE (e.question_id, chunk_id) NOT IN (SELECT question_id, chunk_id FROM p)),
    t AS (SELECT * FROM x WHERE r <= greatest(1, n // 2)), g AS (SELECT question_id, count(*) AS g FROM t GROUP BY 1)
    SELECT question_id, chunk_id, cast(rank AS int) AS place, 'list' AS via FROM p JOIN n USING (question_id) LEFT JOIN g USING (question_id) WHERE rank <= n - coalesce(g, 0) UNION ALL SELECT question_id, chunk_id, cast(n - g + r AS int), 'graph' FROM t JOIN g USING (question_id)""")  # fmt: skip
def wn10(spark, d):
    one = lambda n: lists(spark, d).where(c("list_no") == n).groupBy("question_id", "chunk_id").agg(F.min("rank").alias("rank"))
    primary = ranking.top(one(1), ["question_id"], 8, c("rank"), c("chunk_id"), rank="place").select("question_id", "chunk_id", c("place").alias("rank"))
    return ranking.graph_budget(primary, one(2))


@P.query("wn12_project_quota", "SELECT o_custkey, o_orderkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders JOIN (SELECT o_custkey, greatest(2, 8 // count(DISTINCT o_orderpriority)) AS most FROM orders GROUP BY 1) USING (o_custkey)) WHERE k <= most) WHERE r <= 8")
def wn12(spark, d):
    return ranking.quota(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", 8, c("o_totalprice").desc(), c("o_orderkey")).select("o_custkey", "o_orderkey", "rank")


@P.query("wn13_latest_version", "SELECT l_orderkey, max(l_linenumber) AS version, arg_max(l_partkey, l_linenumber * 100000000 + l_partkey) AS artifact FROM lineitem GROUP BY 1")
def wn13(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return ranking.latest(li, ["l_orderkey"], -c("l_linenumber"), -c("l_partkey")).select("l_orderkey", c("l_linenumber").alias("version"), c("l_partkey").alias("artifact"))


@P.query("wn14_next_version", "SELECT o_orderkey, count(l_linenumber) + 1 AS by_count, coalesce(max(l_linenumber), 0) + 1 AS by_max FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'N' GROUP BY 1")
def wn14(spark, d):
    n = table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m"))
    return table(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", (F.coalesce("n", F.lit(0)) + 1).alias("by_count"), (F.coalesce("m", F.lit(0)) + 1).alias("by_max"))


@P.query("wn15_last_messages", "SELECT conv_id, turn, substring(text, 1, 400) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 20")
def wn15(spark, d):
    return ranking.top(table(spark, d, "conversations"), ["conv_id"], 20, c("turn").desc()).select("conv_id", "turn", F.substring("text", 1, 400).alias("text"))


@P.query("wn16_transcript", "SELECT conv_id, row_number() OVER (ORDER BY conv_id DESC) AS number, string_agg(role || ': ' || substring(text, 1, CASE WHEN role = 'user' THEN 200 ELSE 80 END), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1")
def wn16(spark, d):
    m = table(spark, d, "conversations").withColumn("line", F.concat("role", F.lit(": "), F.when(c("role") == "user", F.substring("text", 1, 200)).otherwise(F.substring("text", 1, 80))))
    t = m.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("transcript"))
    return t.join(ranking.numbered(m.select("conv_id").distinct(), c("conv_id").desc()), "conv_id")


P.over_docs("wn17_sequence_restart", lambda d: d.select("doc_id", F.quarter("doc_date").alias("quarter"), F.row_number().over(Window.partitionBy(F.quarter("doc_date")).orderBy("doc_date", "doc_id")).alias("number")), "SELECT doc_id, cast(quarter(doc_date) AS int) AS quarter, row_number() OVER (PARTITION BY quarter(doc_date) ORDER BY doc_date, doc_id) AS number FROM docs")
_wn19 = "[date '2024-01-10', date '2024-06-01', date '2024-09-15']"
P.over_docs("wn19_anchor_date", lambda d: d.withColumn("x", F.when(c("doc_id") % 3 > 0, F.expr("array(date '2024-01-10', date '2024-06-01', date '2024-09-15')")).otherwise(F.expr("cast(array() as array<date>)"))).select("doc_id", F.coalesce(F.try_element_at(F.filter("x", lambda y: y <= c("doc_date")), F.lit(-1)), F.try_element_at("x", F.lit(-1)), c("doc_date")).cast("string").alias("anchor")), f"SELECT doc_id, cast(CASE WHEN doc_id % 3 = 0 THEN doc_date ELSE coalesce(list_filter({_wn19}, lambda y: y <= doc_date)[-1], date '2024-09-15') END AS varchar) AS anchor FROM docs")


@P.query("src15_sender_forward_fill", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'me' ELSE coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'thread') END AS sender FROM (SELECT *, CASE WHEN turn % 3 = 0 AND role <> 'assistant' THEN 'P' || turn END AS s FROM conversations)")
def src15(spark, d):
    m = table(spark, d, "conversations").withColumn("s", F.when((c("turn") % 3 == 0) & (c("role") != "assistant"), F.concat(F.lit("P"), "turn")))
    seen = F.last("s", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return m.select("conv_id", "turn", F.when(c("role") == "assistant", "me").otherwise(F.coalesce(seen, F.lit("thread"))).alias("sender"))


# sorts and sets ------------------------------------------------------------------------------------------------------
P.over_docs("sr1_score_sort", lambda d: d.select("doc_id", (F.length("text") % 10).alias("score"), "rel_path").orderBy(c("score").desc(), "rel_path").limit(25), "SELECT doc_id, length(text) % 10 AS score, rel_path FROM docs ORDER BY score DESC, rel_path LIMIT 25")
P.over_docs("sr2_newest_first", lambda d: d.orderBy(c("doc_date").desc(), c("rel_path").desc()).limit(20).select("doc_id"), "SELECT doc_id FROM docs ORDER BY doc_date DESC, rel_path DESC LIMIT 20")
P.over_docs("sr3_multi_key_sort", lambda d: d.groupBy("project", "lang").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "project", c("lang").desc()).limit(15), "SELECT project, lang, count(*) AS n FROM docs GROUP BY 1, 2 ORDER BY n DESC, project, lang DESC LIMIT 15")


@P.query("sr4_offset_paging", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def sr4(spark, d):
    return table(spark, d, "orders").orderBy(c("o_totalprice").desc(), "o_orderkey").offset(100).limit(50).select("o_orderkey")


@P.query("sr6_limit_clamp", "SELECT event_id, least(100, greatest(1, coalesce(CASE WHEN event_id % 9 > 0 THEN cast(floor(value) AS int) - 50 END, 20))) AS most FROM events")
def sr6(spark, d):
    return table(spark, d, "events").select("event_id", ranking.clamp(F.when(c("event_id") % 9 > 0, F.floor("value").cast("int") - 50)).alias("most"))


P.over_docs("sr5_undated_last", lambda d: d.select("doc_id", F.when(c("doc_id") % 4 > 0, c("doc_date")).alias("x")).orderBy(c("x").desc_nulls_last(), "doc_id").limit(170).select("doc_id", c("x").cast("string").alias("day")), "SELECT doc_id, cast(x AS varchar) AS day FROM (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN doc_date END AS x FROM docs) ORDER BY x DESC NULLS LAST, doc_id LIMIT 170")
P.over_docs("sr7_priority_sort", lambda d: d.select("doc_id", labels.priority(c("state"), c("title")).alias("p")).withColumn("legacy", F.row_number().over(Window.partitionBy(c("doc_id") % 16).orderBy(c("p").desc(), "doc_id"))).withColumn("ordinal", F.row_number().over(Window.partitionBy(c("doc_id") % 16).orderBy(F.when(c("p") == "high", 0).when(c("p") == "medium", 1).otherwise(2), "doc_id"))).drop("p"),
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY p DESC, doc_id) AS legacy, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY CASE p WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, doc_id) AS ordinal FROM (" + __import__("sheaf.plans.scalars", fromlist=["P"]).P.ORACLE["fn43_priority_guess"].split("FROM documents) ", 1)[1].replace(" AS priority", " AS p") + ")")
P.over_docs("st1_ordered_union", lambda d: d.select("doc_id", js(F.array_distinct(F.concat("people", F.array("project", "lang"), "ticket_ids", F.array("project")))).alias("variants")), "SELECT doc_id, concat_ws('|', people[1], project, lang, array_to_string(ticket_ids, '|')) AS variants FROM docs")
P.over_docs("st3_difference", lambda d: d.select("doc_id").exceptAll(d.where("doc_id % 3 = 0").select("doc_id")), "SELECT doc_id FROM docs WHERE doc_id % 3 <> 0")


@P.query("st4_known_names", f"SELECT canonical AS name FROM {REGISTRY_SQL} UNION SELECT alias FROM {REGISTRY_SQL} UNION SELECT DISTINCT 'Person ' || chr(cast(65 + doc_id % 26 AS int)) FROM documents WHERE doc_id % 2 = 1")
def st4(spark, d):
    r = registry(spark)
    return r.select(c("canonical").alias("name")).union(r.select(F.explode("aliases"))).union(docs(spark, d).where("doc_id % 2 = 1").select(F.explode("people"))).distinct()


P.over_docs("st6_shared_tags", lambda d: d.select("doc_id", js(F.array_intersect("ticket_ids", F.array(*(F.lit(f"TKT-{i}") for i in range(5))))).alias("shared")), "SELECT doc_id, array_to_string(list_filter(ticket_ids, lambda t: t IN ('TKT-0', 'TKT-1', 'TKT-2', 'TKT-3', 'TKT-4')), '|') AS shared FROM docs")


# sources that are relational -----------------------------------------------------------------------------------------
P.over_docs("src14_message_blocks", lambda d: d.select("doc_id", F.posexplode(F.split(F.concat(F.lit("[group]\n\n"), c("text")), "\n\n")).alias("pos", "block")).select("doc_id", "pos", "block", ((c("pos") == 0) & c("block").startswith("[")).alias("header")), "SELECT doc_id, cast(pos - 1 AS int) AS pos, block, pos = 1 AND starts_with(block, '[') AS header FROM (SELECT doc_id, unnest(string_split('[group]' || chr(10) || chr(10) || text, chr(10) || chr(10))) AS block, generate_subscripts(string_split('[group]' || chr(10) || chr(10) || text, chr(10) || chr(10)), 1) AS pos FROM docs)")
P.over_docs("src16_convert_ledger", lambda d: ledger.convert_ledger(d, d.where("doc_id % 5 > 0").select("doc_id", c("prev_hash").alias("content_hash")), "doc_id", "content_hash", c("doc_id") % 29 == 0, c("doc_id") % 4 == 0), "SELECT doc_id, CASE WHEN doc_id % 5 > 0 AND prev_hash = content_hash THEN 'unchanged' WHEN doc_id % 29 = 0 THEN 'error' WHEN doc_id % 4 = 0 THEN 'needs_ocr' ELSE 'converted' END AS status FROM docs")
P.over_docs("src17_convert_summary", lambda d: d.groupBy(F.when(c("prev_hash") == c("content_hash"), "unchanged").otherwise("converted").alias("status")).agg(F.count("*").alias("n")), "SELECT CASE WHEN prev_hash = content_hash THEN 'unchanged' ELSE 'converted' END AS status, count(*) AS n FROM docs GROUP BY 1")


@P.query("src20_event_props", "SELECT event_id, props->>'$.page' AS page FROM events ORDER BY ts DESC, event_id LIMIT 500")
def src20(spark, d):
    return table(spark, d, "events").orderBy(c("ts").desc(), "event_id").limit(500).select("event_id", F.get_json_object("props", "$.page").alias("page"))


@P.query("src21_usage_report", "SELECT c_custkey, coalesce(n, 0) AS used, round(coalesce(n, 0) * 100.0 / greatest(cast(floor(c_acctbal) AS bigint), 1), 1) AS pct FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def src21(spark, d):
    n = table(spark, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("used"))
    j = table(spark, d, "customer").join(n, "c_custkey", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return j.select("c_custkey", "used", F.round(c("used") * 100.0 / F.greatest(F.floor("c_acctbal"), F.lit(1)), 1).alias("pct"))


@P.query("src23_capture_dedupe", "SELECT conv_id, count(*) FILTER (new) AS written, count(*) FILTER (NOT new) AS skipped FROM (SELECT conv_id, sha1(trim(text)) NOT IN (SELECT sha1(trim(text)) FROM conversations WHERE conv_id % 4 = 0) AS new FROM conversations) GROUP BY 1")
def src23(spark, d):
    m = table(spark, d, "conversations").withColumn("h", joins.message_key(c("text")))
    j = m.join(m.where("conv_id % 4 = 0").select("h").distinct().withColumn("hit", F.lit(1)), "h", "left")
    return j.groupBy("conv_id").agg(F.count_if(c("hit").isNull()).alias("written"), F.count_if(c("hit").isNotNull()).alias("skipped"))


QUERIES, ORACLE = P.QUERIES, P.ORACLE
