"""Queries over reports, parsed sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheaf.functions import labels
from sheaf.operators import ranking, reports
from sheaf.operators.graph import shared_folder
from sheaf.plans.binding import Plans, table
from sheaf.plans.scalars import any_sql, distinct_sql, fold_sql, js, squeeze_sql, tiers_sql
from sheaf.sources import payloads
from sheaf.streaming import events as streams

P = Plans()
c = F.col

P.over_docs("m14_alerts", lambda d: reports.alerts(d.select(c("project").alias("ticket"), F.concat(F.lit("- [2024-05-01 08:00] [bot] ["), "lang", F.lit("]"), F.when(c("doc_id") % 2 == 0, " [DA_XU_LY]").otherwise(""), F.when(c("doc_id") % 3 == 0, " [PIC: Ann]").otherwise(""), F.lit(" see "), "rel_path").alias("line"))).select("severity", "status", "pic", "message", "alert_id"),
    "SELECT lang AS severity, CASE WHEN doc_id % 2 = 0 THEN 'DA_XU_LY' ELSE 'MO' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'Ann' END AS pic, 'see ' || rel_path AS message, substring(sha1(project || '|bot|see ' || rel_path), 1, 12) AS alert_id FROM docs")
P.over_docs("fn32_fn33_plan_status", lambda d: d.withColumn("bar", F.concat(F.lit("x tl-"), F.element_at(F.array(*map(F.lit, ("done", "progress", "blocked", "onhold", "cancelled", "open", "other"))), (c("doc_id") % 7 + 1).cast("int")))).select("doc_id", reports.text_status(c("remark"), c("doc_id") % 23 == 0, c("doc_id") % 19 == 0, F.when(c("doc_id") % 2 == 0, reports.manual_status(c("remark")))).alias("status"), reports.manual_status(c("remark")).alias("manual"), reports.bar_status(c("bar")).alias("bar")),
    f"""SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'cancelled' WHEN doc_id % 19 = 0 THEN 'done' ELSE {tiers_sql('l', labels.ROW_STATUS, "coalesce(CASE WHEN doc_id % 2 = 0 THEN m END, 'open')")} END AS status, m AS manual, nullif(['done', 'progress', 'blocked', 'onhold', 'cancelled', 'open', ''][cast(doc_id % 7 + 1 AS int)], '') AS bar
    FROM (SELECT *, {tiers_sql('l', labels.MANUAL_STATUS, 'NULL')} AS m FROM (SELECT doc_id, lower(remark) AS l FROM docs))""")  # fmt: skip
P.over_docs("fn52_checklist", lambda d: d.select("doc_id", F.md5(js(reports.checklist(F.element_at(F.array(F.to_json(F.array(F.lit("a"), "text", F.lit("a"))), F.concat(F.lit("- a\n2) b\n- a\n"), "text"), F.concat(F.lit("a | b | a | "), F.translate("text", "\n", " "))), (c("doc_id") % 3 + 1).cast("int"))))).alias("items")),
    f"""SELECT doc_id, md5(array_to_string(list_filter({distinct_sql('y')}, lambda x: x <> ''), '|')) AS items FROM (SELECT doc_id, list_transform(CASE doc_id % 3 WHEN 0 THEN ['a', text, 'a'] WHEN 1 THEN string_split('- a' || chr(10) || '2) b' || chr(10) || '- a' || chr(10) || text, chr(10)) ELSE string_split('a | b | a | ' || translate(text, chr(10), ' '), '|') END, lambda x: trim(regexp_replace(x, '^[ \t]*([-*•]|[0-9]+[.)])[ \t]*', ''))) AS y FROM docs)""")
P.over_docs("fn53_fn54_llm_entities", lambda d: reports.valid_entities(d.select(c("doc_id").alias("chunk_id"), reports.llm_rows(F.when(c("doc_id") % 4 == 0, c("text")).otherwise(F.concat(F.lit('```json\n[{"type":"Person","name":" P'), c("doc_id"), F.lit(' ","aliases":'), F.to_json(F.array("text")), F.lit('},{"type":"Odd","name":"y"},{"type":"System","name":""}]\n```'))), "struct<type:string,name:string,aliases:array<string>>").alias("entities")), ("Person", "System")).select("chunk_id", "type", "name", F.md5(js(c("aliases"))).alias("aliases")), "SELECT doc_id AS chunk_id, 'Person' AS type, 'P' || doc_id AS name, md5(text) AS aliases FROM docs WHERE doc_id % 4 > 0")
P.over_docs("ag21_coverage_percent", lambda d: d.select("doc_id", reports.coverage_percent(F.to_json(F.map_from_entries(F.transform(F.array_distinct(F.split("text", " ")), lambda w: F.struct(w, F.struct((F.length(w) % 2 == 0).alias("covered"))))))).alias("pct")), "SELECT doc_id, round(len(list_filter(list_distinct(string_split(text, ' ')), lambda w: length(w) % 2 = 0)) * 100 / 7.0::double, 1) AS pct FROM docs")
P.over_docs("ag26_lane_summary", lambda d: reports.lane_summary(d.select(c("project").alias("lane"), reports.text_status(c("remark"), F.lit(False), F.lit(False)).alias("status"), F.when(c("doc_id") % 2 == 0, "high").otherwise("low").alias("priority"))),
    f"SELECT project AS lane, count(*) AS tasks, count(*) FILTER (s NOT IN ('cancelled', 'done')) AS open, count(*) FILTER (s = 'blocked') AS risks, max(CASE WHEN s = 'blocked' THEN CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END END) AS risk_level FROM (SELECT *, {tiers_sql('lower(remark)', labels.ROW_STATUS, chr(39) + 'open' + chr(39))} AS s FROM docs) GROUP BY 1")
P.over_docs("ag28_pages", lambda d: reports.pages(d.select("doc_id", F.concat(c("text"), F.lit("\n## Trang 1\ntotal: "), c("doc_id"), F.lit("\n"), c("text"), F.lit("\n## Trang 2\n"), c("text"), F.lit("\ndone: 4")).alias("text"))).select("doc_id", "page", F.md5("body").alias("body"), F.to_json(reports.metrics(c("body"), ("total", "done"))).alias("metrics")), "SELECT doc_id, 1 AS page, md5(trim('total: ' || doc_id || chr(10) || text || chr(10), ' ' || chr(10))) AS body, '{\"total\":' || doc_id || '}' AS metrics FROM docs UNION ALL SELECT doc_id, 2, md5(ltrim(text || chr(10) || 'done: 4', ' ' || chr(10))), '{\"done\":4}' FROM docs")
P.over_docs("jn20_merged_groups", lambda d: reports.merged_groups(d.where("doc_id % 2 = 0").select(c("doc_id").alias("key"), F.array(F.when(c("doc_id") % 4 == 0, "real").otherwise(" ")).alias("items")), d.where("doc_id % 3 = 0").select(c("doc_id").alias("key"), F.array(F.lit("extra")).alias("items"))).select("key", js(c("items")).alias("items"), "via"),
    "SELECT doc_id AS key, CASE WHEN doc_id % 4 = 0 THEN 'real' WHEN doc_id % 3 = 0 THEN 'extra' ELSE '' END AS items, CASE WHEN doc_id % 4 = 0 THEN 'primary' ELSE 'supplement' END AS via FROM docs WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
P.over_docs("jn22_cited_documents", lambda d: reports.cited_documents(d.select("doc_id", F.concat(c("text"), F.lit(" see nope.md and doc-"), c("doc_id") % 50, F.lit(".md "), c("text")).alias("text")), d.select(c("rel_path").alias("path"))), "SELECT a.doc_id, b.rel_path AS path FROM docs a JOIN docs b ON b.doc_id = a.doc_id % 50")
P.over_docs("jn35_id_snippets", lambda d: reports.id_snippets(d.select("doc_id", F.concat(c("text"), F.lit("\na YC-7\n"), c("text"), F.lit("\nc YC-7 x\nd YC-7\nYC-"), c("doc_id") % 3).alias("text"))).select("doc_id", "key", js(c("snippets")).alias("snippets")), "SELECT doc_id, 'YC-7' AS key, 'a YC-7|c YC-7 x' AS snippets FROM docs UNION ALL SELECT doc_id, 'YC-' || (doc_id % 3), 'YC-' || (doc_id % 3) FROM docs")
P.over_docs("wn18_timeline_groups", lambda d: reports.timeline_groups(d.where("doc_id % 4 = 0").select(c("lang").alias("group"), c("doc_id").alias("root_id"), c("doc_date").alias("day"), "title"), d.where("doc_id % 4 > 0").select(c("lang").alias("group"), c("doc_id").alias("id"), c("doc_date").alias("day"), c("rel_path").alias("title"))).select("root_id", js(c("items")).alias("items")),
    """WITH g AS (SELECT l.doc_id, l.doc_date, l.rel_path, r.doc_id AS root_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY t, CASE WHEN t = 2 THEN l.doc_date - r.doc_date ELSE abs(r.doc_date - l.doc_date) END, r.doc_id) AS n FROM (SELECT *, 0 AS z FROM docs WHERE doc_id % 4 > 0) l JOIN (SELECT * FROM docs WHERE doc_id % 4 = 0) r ON l.lang = r.lang, LATERAL (SELECT CASE WHEN r.doc_date = l.doc_date THEN 0 WHEN abs(r.doc_date - l.doc_date) = 1 THEN 1 WHEN r.doc_date < l.doc_date THEN 2 ELSE 3 END AS t))
    SELECT root_id, string_agg(rel_path, '|' ORDER BY doc_date, rel_path, doc_id) AS items FROM g WHERE n = 1 GROUP BY 1""")  # fmt: skip
P.over_docs("wn20_newest_source", lambda d: reports.newest_source(d.select(c("project").alias("kind"), F.concat(F.lit("r-"), F.when(c("doc_id") % 3 > 0, c("doc_date").cast("string")).otherwise("x"), F.lit("-"), "doc_id").alias("path"), F.lit("2024-01-05").cast("timestamp").alias("modified"))), "SELECT project AS kind, arg_max(p, struct_pack(a := CASE WHEN doc_id % 3 > 0 THEN doc_date ELSE date '2024-01-05' END, b := p)) AS path FROM (SELECT *, 'r-' || CASE WHEN doc_id % 3 > 0 THEN cast(doc_date AS varchar) ELSE 'x' END || '-' || doc_id AS p FROM docs) GROUP BY 1")
P.over_docs("rt17_project_timeline", lambda d: reports.timeline(*((k, d.where(c("doc_id") % 6 == i).select(F.when(c("doc_id") % 5 > 0, F.date_format("doc_date", "dd/MM/yyyy")).otherwise("n/a").alias("date_text"), c("rel_path").alias("title"), c("lang").alias("body"))) for i, k in enumerate(("alerts", "decision", "raid", "milestone", "adr", "retro")))).select("lane", F.date_format("event_ts", "yyyy-MM-dd").alias("day"), "title", "text"), "SELECT ['alerts', 'decision', 'raid', 'milestone', 'adr', 'retro'][cast(doc_id % 6 + 1 AS int)] AS lane, CASE WHEN doc_id % 5 > 0 THEN cast(doc_date AS varchar) END AS day, rel_path AS title, lang AS text FROM docs")
P.over_docs("rt18_plan_rows", lambda d: reports.plan_rows(d.select(F.concat(F.lit("YC-"), "doc_id").alias("key"), "title", c("state").alias("note"), F.when(c("doc_id") % 2 == 0, F.concat(F.lit("Q"), c("doc_id") % 4 + 1, F.lit("/2024"))).otherwise(F.when(c("doc_id") % 3 == 0, F.date_format("doc_date", "dd/MM/yyyy")).otherwise("soon")).alias("deadline")), "2024-01-01", "2024-12-31").select("key", "left_pct", "width_pct"),
    """SELECT cast(doc_id AS varchar) AS key, round(l, 1) AS left_pct, CASE WHEN l IS NOT NULL THEN round(greatest(r - l, 1.2), 1) END AS width_pct FROM (SELECT doc_id, CASE WHEN lo IS NOT NULL THEN least(greatest((lo - date '2024-01-01') / 365.0::double, 0), 1) * 100 END AS l, least(greatest((hi - date '2024-01-01') / 365.0::double, 0), 1) * 100 AS r FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN make_date(2024, cast(doc_id % 4 * 3 + 1 AS int), 1) WHEN doc_id % 3 = 0 THEN doc_date END AS lo, CASE WHEN doc_id % 2 = 0 THEN cast(make_date(2024, cast(doc_id % 4 * 3 + 1 AS int), 1) + interval 3 month - interval 1 day AS date) WHEN doc_id % 3 = 0 THEN doc_date END AS hi FROM docs))""")  # fmt: skip
P.over_docs("rt12_trim_context", lambda d: d.select("doc_id", F.md5(reports.trim_context(F.concat(c("text"), F.lit("\n---\n"), c("text")), 1500)).alias("h")), "SELECT doc_id, md5(CASE WHEN length(x) <= 1500 THEN x WHEN length(text) + 5 <= 1500 AND length(text) > 750 THEN text ELSE substring(x, 1, 1500) END) AS h FROM (SELECT doc_id, text, text || chr(10) || '---' || chr(10) || text AS x FROM docs)")
P.over_docs("src12_pipe_tables", lambda d: payloads.pipe_tables(d.select("doc_id", F.concat(c("text"), F.lit("\n| a | b |\n|---|---|\n| "), c("lang"), F.lit(" | "), c("doc_id"), F.lit(" |\n| "), F.translate("text", "\n|", "  "), F.lit(" | z |\n"), c("text"), F.lit("\n| no | no |")).alias("text"))).select("doc_id", F.md5(js(c("cells"))).alias("cells")), "SELECT doc_id, md5(lang || '|' || doc_id) AS cells FROM docs UNION ALL SELECT doc_id, md5(trim(translate(text, chr(10) || '|', '  ')) || '|z') FROM docs")
_sheet = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
_more = f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"
_told = lambda title, rest: f"lower({squeeze_sql(f"concat_ws(' ', {title}, 'first' || chr(10) || {_more}, {rest})")})"
P.over_docs("src13_tab_sheets", lambda d: payloads.tab_sheets(d.select("doc_id", _sheet("note\twithout a sheet\n=== Sheet: 01_Kho ===\nBáo cáo\tx\nSTT\tHạng mục\tMô tả\tƯu tiên\tLoại\tQuý\tSố yêu cầu\tGhi chú\n1\t- A", c("doc_id"), "\tfirst\tP2\tType\tQ1\t3\tsee\tthere\n", c("text"), "\n2\tTổng\t9\n3\tB\t\tlow\n=== Sheet: s2 ===\nFeature\tDescription\tSprint\nC", c("doc_id"), "\tfirst\tq3\n", c("text"), "\nC", c("doc_id"), "\tfirst\tq3\n", c("text")).alias("text"))).withColumn("description", F.md5("description")),
    f"""SELECT doc_id, 'Kho' AS sheet, 'Kho - A' || doc_id AS title, md5('Kỳ: Q1. 3 yêu cầu chi tiết. ' || regexp_replace('first' || chr(10) || {_more}, '[ .]+$', '') || '. Ghi chú: see there') AS description, 'medium' AS priority, {tiers_sql(_told("'A' || doc_id", "'Type'"), labels.CATEGORIES, "'feature'")} AS category FROM docs
    UNION ALL SELECT doc_id, 's2', 's2 - C' || doc_id, md5('Kỳ: q3. ' || regexp_replace('first' || chr(10) || {_more}, '[ .]+$', '')), 'medium', {tiers_sql(_told("'C' || doc_id", "NULL"), labels.CATEGORIES, "'feature'")} FROM docs""")  # fmt: skip


@P.query("src9_page_blocks")
def src9(spark, d):
    return payloads.page_blocks(table(spark, d, "pages"))


@P.query("src11_page_cells", """WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
    SELECT o_custkey AS page_id, 0 AS table_no, cast(n AS int) AS row_no, cast(k AS int) AS col_no, CASE k WHEN 0 THEN 'of ' || o_custkey WHEN 1 THEN cast(o_orderkey AS varchar) ELSE o_orderpriority END AS text FROM r, unnest([0, 1, 2]) t(k)
    UNION ALL SELECT DISTINCT o_custkey, 0, 0, cast(k AS int), CASE k WHEN 0 THEN 'customer' ELSE 'order' END FROM orders, unnest([0, 1, 2]) t(k)""")
def src11(spark, d):
    """A page a customer with a table of the orders: the customer's cell spans all rows, one heading spans two columns."""
    o = table(spark, d, "orders")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda r: F.concat(F.lit("<td>"), r["o_orderkey"], F.lit("</td><td>"), r["o_orderpriority"], F.lit("</td>")))
    html = F.concat(F.lit("<p>x</p><table><tr><th>customer</th><th colspan=2>order</th></tr><tr><td rowspan="), F.count("*"), F.lit(">of "), c("o_custkey"), F.lit("</td>"), F.array_join(rows, "</tr><tr>"), F.lit("</tr></table>"))
    pages = o.groupBy("o_custkey").agg(html.alias("html")).select(c("o_custkey").alias("page_id"), "html")
    return payloads.page_cells(pages)


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))


def event_stream(spark, d):
    return spark.readStream.schema(streams.EVENTS).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").withColumn("ts", c("ts").cast("timestamp"))


def drained(df, mode: str = "append", key: tuple[str, ...] = ()):
    """A stream run to its end into the shared folder, a folder a batch (a batch that is tried again replaces its own), read back.

    append: all rows; complete: those of the last batch; update: of each key the row of its last batch.
    """
    spark = df.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    put = lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/rows/_n={n}")
    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(df.schema.add("_n", "long")).parquet(f"{out}/rows")
    if mode == "complete":
        return rows.where(c("_n") == rows.agg(F.max("_n")).first()[0]).drop("_n")
    return rows.drop("_n") if mode == "append" else ranking.latest(rows, list(key), -c("_n")).drop("_n")


@P.query("sm3_sm4_distinct_events", "SELECT event_id, user_id FROM events")
def sm3(spark, d):
    return drained(streams.distinct_messages(event_stream(spark, d))).select("event_id", "user_id")


@P.query("sm5_cursors", "SELECT user_id, cast(date_trunc('second', max(ts)) AS varchar) AS cursor, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS last_id FROM events GROUP BY 1")
def sm5(spark, d):
    return streams.cursors(events(spark, d)).select("user_id", F.date_format("cursor", "yyyy-MM-dd HH:mm:ss").alias("cursor"), "last_id")


@P.query("sm6_thread_memory", "SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1, 2")
def sm6(spark, d):
    return streams.thread_memory(events(spark, d))


@P.query("sm7_daily_usage", "SELECT cast(cast(ts AS date) AS varchar) AS day, round(sum(value), 4) AS used FROM events GROUP BY 1")
def sm7(spark, d):
    return streams.daily_usage(events(spark, d)).select(c("day").cast("string").alias("day"), F.round("used", 4).alias("used"))


@P.query("sm8_quota_charges", "SELECT user_id, event_id, round(used, 4) AS used, round(greatest(1000 - used, 0), 4) AS remaining FROM (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events)")
def sm8(spark, d):
    return streams.quota_charges(events(spark, d), 1000.0).select("user_id", "event_id", F.round("used", 4).alias("used"), F.round("remaining", 4).alias("remaining"))


@P.query("sm_sessions", "SELECT user_id, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < interval 30 minute THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def sm_sessions(spark, d):
    return streams.sessions(events(spark, d)).select("user_id", "n")


@P.query("sm_sliding", "SELECT cast(w AS varchar) AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(interval 6 hour, ts), time_bucket(interval 6 hour, ts) - interval 6 hour, time_bucket(interval 6 hour, ts) - interval 12 hour, time_bucket(interval 6 hour, ts) - interval 18 hour]) AS w FROM events) GROUP BY 1, 2")
def sm_sliding(spark, d):
    return streams.sliding_usage(events(spark, d)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


# the same by streams that run to their end
@P.query("sm5_cursors_stream", P.ORACLE["sm5_cursors"])
def sm5_stream(spark, d):
    return drained(streams.cursors(event_stream(spark, d)), "update", ("user_id",)).select("user_id", F.date_format("cursor", "yyyy-MM-dd HH:mm:ss").alias("cursor"), "last_id")


@P.query("sm7_daily_usage_stream", P.ORACLE["sm7_daily_usage"])
def sm7_stream(spark, d):
    return drained(streams.daily_usage(event_stream(spark, d)), "complete").select(c("day").cast("string").alias("day"), F.round("used", 4).alias("used"))


@P.query("sm_sessions_stream", P.ORACLE["sm_sessions"])
def sm_sessions_stream(spark, d):
    return drained(streams.sessions(event_stream(spark, d)), "complete").select("user_id", "n")


@P.query("sm_sliding_stream", P.ORACLE["sm_sliding"])
def sm_sliding_stream(spark, d):
    return drained(streams.sliding_usage(event_stream(spark, d)), "complete").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


QUERIES, ORACLE = P.QUERIES, P.ORACLE
