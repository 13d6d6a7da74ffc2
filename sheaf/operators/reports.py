"""Reports over logs, plans and status texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import dates, labels, text
from sheaf.functions.labels import first_of
from sheaf.functions.text import any_phrase, fold_table
from sheaf.operators.threads import once

c = F.col


def alerts(lines: DataFrame) -> DataFrame:
    """lines(ticket, line) '- [time] [agent] [severity] ([MO|DA_XU_LY])? ([PIC: x])? message' -> columns and a stable alert_id."""
    p = "^- \\[([^\\]]+)\\] \\[([^\\]]+)\\] \\[([^\\]]+)\\](?: \\[(MO|DA_XU_LY)\\])?(?: \\[PIC: ([^\\]]+)\\])? (.+)$"
    g = lambda i: F.regexp_extract("line", p, i)
    out = lines.where(c("line").rlike(p)).select("ticket", g(1).alias("time"), g(2).alias("agent"), g(3).alias("severity"), F.coalesce(F.nullif(g(4), F.lit("")), F.lit("MO")).alias("status"), F.nullif(g(5), F.lit("")).alias("pic"), g(6).alias("message"))
    return out.withColumn("alert_id", F.substring(F.sha1(F.concat_ws("|", "ticket", "agent", "message")), 1, 12))


def text_status(t: Column, closed: Column, done: Column, manual: Column | None = None) -> Column:
    """Status of a plan row: listed ids first, then words in order of precedence, then what a person set, else open."""
    default = F.lit("open") if manual is None else F.coalesce(manual, F.lit("open"))
    by = first_of((closed, "cancelled"), (done, "done"), *labels.by_words(F.lower(t), labels.ROW_STATUS))
    return F.coalesce(by, default)


def manual_status(t: Column) -> Column:
    """Status by the words of a manual note; null without any."""
    return first_of(*labels.by_words(F.lower(t), labels.MANUAL_STATUS))


def bar_status(name: Column) -> Column:
    """Status by the class of a timeline bar; null without one."""
    return first_of(*labels.by_words(F.coalesce(name, F.lit("")), labels.BAR_STATUS))


# Statuses of log events by the log's type: the first pattern of its type that the folded text has, and the type's own.
LOG_STATUS = {
    "alerts": ((), "Cảnh báo"),
    "decision-log": ((("superseded", "Superseded"), ("da bac bo|bi bac bo", "Bác bỏ"), ("active", "Active")), "Quyết định"),
    "raid-log": ((("overdue", "Overdue"), ("\\b(closed|da dong)\\b", "Closed"), ("\\b(open|chua dong)\\b", "Open")), "Issue"),
    "milestone-log": ((("doi moc|tre|delay", "Dời mốc"),), "Milestone"),
    "change-cr-log": ((("chua duyet|chua xac minh|pending", "Pending"),), "CR"),
    "raci-daci-register": ((), "Vai trò"),
    "retro": ((), "Tổng hợp"),
    "adr": ((), "ADR"),
}
LOG_RECORD = "Ghi nhận"
# Tasks and cells of a plan row that say nothing yet.
NO_WORK, NO_TASK, UNCLEAR, OPEN_DEADLINE = ("chua trien khai", "chua co task pic trien khai"), ("chua co task", "chua ro"), ("", "chua ro"), ("", "chua chot", "chua ro")


def log_status(kind: Column, declared: Column, t: Column) -> Column:
    """A declared status, canonical, wins; else the log's type and the words of its text and snippets decide."""
    f, k = fold_table(t), F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    by = F.lit(LOG_RECORD)
    for name, (patterns, own) in LOG_STATUS.items():
        of_type = F.lit(own)
        for pattern, label in reversed(patterns):
            of_type = F.when(f.rlike(pattern), label).otherwise(of_type)
        by = F.when(k == name, of_type).otherwise(by)
    return F.coalesce(F.nullif(labels.canonical_title(F.coalesce(declared, F.lit(""))), F.lit("")), by)


def placeholder(task: Column, subbacklog: Column, pic: Column, status: Column, deadline: Column) -> Column:
    """A plan row without work: a task that says so, or an unclear task with nothing else said."""
    t, s, p, u, d = (fold_table(labels.canonical_title(F.coalesce(x, F.lit("")))) for x in (task, subbacklog, pic, status, deadline))
    return t.isin(*NO_WORK) | (t.isin(*NO_TASK) & s.isin(*UNCLEAR) & p.isin(*UNCLEAR) & u.isin(*UNCLEAR) & d.isin(*OPEN_DEADLINE))


def requirement_facts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) of file sections '### folder/file' -> (doc_id, file, purpose, requirements, scenarios) of the sections that have any.

    A purpose's first 160 characters; up to five '### REQ-..' headings with what their description line says; up to two Given lines.
    Purposes lose blanks and line ends about them, all else any kind of space.
    """
    trim, gap = lambda x: F.trim(x, F.lit(text.SPACES)), text.BLANK
    part = docs.select("doc_id", F.explode(F.split("text", "\n(?=### [^\n]+/[^\n]+\n)")).alias("part")).where(c("part").startswith("### ") & F.substring("part", 5, 1).rlike("."))
    end = F.instr("part", "\n")
    part = part.select("doc_id", trim(F.regexp_extract("part", "^### ([^\n]+)", 1)).alias("file"), F.when(end > 0, F.substring("part", end, F.length("part"))).otherwise("").alias("body"))
    after = lambda p: F.locate("\n##", p, 2)
    purpose = text.bound(F.regexp_extract("body", f"(?s)##\\s*Purpose[{gap}]*\n+(.+)", 1), lambda p: F.when(after(p) > 0, F.substring(p, F.lit(1), after(p) - 1)).otherwise(p))
    purpose = F.regexp_extract(purpose, f"(?s)^[{gap}]*([^{gap}](?:.*[^{gap}])?)[{gap}]*\\z", 1)
    # a requirement is found once, from its heading through its description; what it says is cut out of what was found
    head = "###\\s+(REQ-[A-Z0-9\\-]+[^\n]*)\n"
    told = F.regexp_extract("body", "(?s)^.*\\*\\*Mô tả:\\*\\*\\s*[^\n]{0,150}", 0)  # headings after the last description would each look through the rest
    found = F.slice(text.matches(told, f"{head}(?s:.*?)\\*\\*Mô tả:\\*\\*\\s*[^\n]{{0,150}}"), 1, 5)
    said = lambda m: F.regexp_extract(m, f"(?s)^{head}.*?\\*\\*Mô tả:\\*\\*\\s*(.*)", 2)
    lines = F.transform(found, lambda m: F.concat(trim(F.regexp_extract(m, f"^{head}", 1)), F.lit(": "), F.substring(trim(said(m)), 1, 120)))
    given = F.slice(F.transform(text.matches(c("body"), "\\*\\*Given:\\*\\*\\s*([^\n]{0,100})", 1), trim), 1, 2)
    out = once(part, purpose=F.substring(purpose, 1, 160), requirements=lines, scenarios=given).select("doc_id", "file", "purpose", "requirements", "scenarios")
    return out.where((c("purpose") != "") | (F.size("requirements") > 0) | (F.size("scenarios") > 0))


def checklist(value: Column) -> Column:
    """Items of a JSON list, or of text cut at lines, or else at bars; trimmed, without bullets, first kept."""
    parsed = F.from_json(value, "array<string>")
    split = F.when(value.contains("\n"), F.split(value, "\n")).otherwise(F.split(value, "\\|"))
    items = F.transform(F.coalesce(F.when(F.trim(value).startswith("["), parsed), split), lambda x: F.trim(F.regexp_replace(x, "^[ \\t]*([-*•]|[0-9]+[.)])[ \\t]*", "")))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def llm_rows(value: Column, schema: str) -> Column:
    """An array of objects out of a model's answer: a code fence is taken off; what is no list is empty."""
    bare = F.trim(F.regexp_replace(value, "(?s)^\\s*```[a-z]*\\s*|\\s*```\\s*$", ""))
    return F.when(bare.startswith("["), F.filter(F.coalesce(F.from_json(bare, f"array<{schema}>"), F.from_json(F.lit("[]"), f"array<{schema}>")), lambda x: x.isNotNull())).otherwise(F.from_json(F.lit("[]"), f"array<{schema}>"))


def valid_entities(rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """rows(chunk_id, entities array<struct<type,name,aliases>>) -> one row an entity of an allowed type with a name."""
    e = rows.select("chunk_id", F.explode("entities").alias("e"))
    return e.select("chunk_id", c("e.type").alias("type"), F.trim("e.name").alias("name"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases")).where(c("type").isin(*types) & (c("name") != ""))


def coverage_percent(value: Column, dimensions: int = 7) -> Column:
    """Covered dimensions of a JSON map of {name: {covered: bool}}, in percent."""
    m = F.from_json(value, "map<string,struct<covered:boolean>>")
    return F.round(F.coalesce(F.size(F.filter(F.map_values(m), lambda v: v["covered"])), F.lit(0)) * 100 / dimensions, 1)


def lane_summary(tasks: DataFrame) -> DataFrame:
    """tasks(lane, status, priority): tasks, open ones and risks (blocked tasks) a lane, the risks' highest priority."""
    rank = F.when(c("priority") == "high", 3).when(c("priority") == "medium", 2).otherwise(1)
    blocked = c("status") == "blocked"
    return tasks.groupBy("lane").agg(F.count("*").alias("tasks"), F.count_if(~c("status").isin("done", "cancelled")).alias("open"), F.count_if(blocked).alias("risks"), F.max(F.when(blocked, rank)).alias("risk_level"))


# Rows that the tables of two pages have at least.
LEAST_ROWS = {"page3": 6, "page11": 5}


def report_issues(snapshots: DataFrame, key: str = "report") -> DataFrame:
    """Snapshots of reports -> (report, n, level, code, message), in the order of the rules.

    snapshots(report, missing_pages array<int>, report_date, template_date, strict_date boolean, page3_done, page3_total, page11_done, page11_total,
    page4_burn_done, page4_burn_total, page11_burn_done, page11_burn_total, page3_rows, page11_rows, n_goals, sections map<string, string>).
    """
    differ = lambda a, b: ~c(a).eqNullSafe(c(b))
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    rules = (
        ("missing_pages", F.size("missing_pages") > 0, F.concat(F.lit("Thiếu các trang bắt buộc: "), F.array_join(F.transform("missing_pages", lambda x: x.cast("string")), ", "))),
        ("report_date_missing", blank(c("report_date")), F.lit("Không parse được ngày báo cáo từ Trang 1.")),
        ("template_date_missing", blank(c("template_date")), F.lit("Không parse được ngày trong file template PPTX.")),
        ("template_date_mismatch", c("strict_date") & ~blank(c("report_date")) & ~blank(c("template_date")) & (c("report_date") != c("template_date")), F.concat(F.lit("Template PPTX và source markdown không cùng ngày. Source="), "report_date", F.lit(", template="), "template_date", F.lit(". Chặn build để tránh dùng nhầm timeline/bảng tĩnh."))),
        ("metric_mismatch_done_total", differ("page3_done", "page11_done") | differ("page3_total", "page11_total"), F.lit("Metric Done/Total giữa Trang 3 và Trang 11 không khớp.")),
        ("metric_mismatch_burn", differ("page4_burn_done", "page11_burn_done") | differ("page4_burn_total", "page11_burn_total"), F.lit("Metric Burn giữa Trang 4 và Trang 11 không khớp.")),
        ("page3_table_short", c("page3_rows") < LEAST_ROWS["page3"], F.concat(F.lit("Trang 3 parse được quá ít dòng lane ("), "page3_rows", F.lit(")."))),
        ("page11_table_short", c("page11_rows") < LEAST_ROWS["page11"], F.concat(F.lit("Trang 11 parse được quá ít dòng lane ("), "page11_rows", F.lit(")."))),
        ("goals_missing", c("n_goals") == 0, F.lit("Không parse được danh sách mục tiêu trọng tâm ở Trang 13.")),
    )
    issue = lambda code, message: F.struct(F.lit("error").alias("level"), code.alias("code"), message.alias("message"))
    one = F.array(*(F.when(F.coalesce(hit, F.lit(False)), issue(F.lit(code), message)) for code, hit, message in rules))
    empty = F.transform(F.filter(F.map_entries("sections"), lambda e: (e["key"] != "page12") & blank(e["value"])), lambda e: issue(F.concat(e["key"], F.lit("_empty")), F.concat(e["key"], F.lit(" không có nội dung để dựng report."))))
    found = F.array_compact(F.concat(one, F.coalesce(empty, F.array().cast("array<struct<level:string,code:string,message:string>>"))))
    return snapshots.select(c(key).alias("report"), F.posexplode(found).alias("n", "i")).select("report", "n", "i.*")


def pages(report: DataFrame, mark: str = "Trang") -> DataFrame:
    """report(doc_id, text) -> (doc_id, page, body) at '## <mark> N' headings."""
    parts = F.filter(F.split("text", f"(?m)^(?=## {mark} [0-9]+)"), lambda x: x.startswith("## "))
    p = report.select("doc_id", F.explode(parts).alias("part"))
    return p.select("doc_id", F.regexp_extract("part", f"^## {mark} ([0-9]+)", 1).cast("int").alias("page"), F.regexp_replace(F.regexp_replace("part", "^[^\\n]*\\n?", ""), "^[ \\n]+|[ \\n]+$", "").alias("body"))


def metrics(body: Column, names: tuple[str, ...]) -> Column:
    """{name: number} of 'name: number' lines."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.nullif(F.regexp_extract(body, f"(?mi)^[-* ]*{n} *: *([0-9]+)", 1), F.lit("")).cast("int") for n in names))), lambda k, v: v.isNotNull())


STATUS_ID = "(?:QLYC-[0-9]+|(?<!QL)YC-[0-9]+|EK[0-9]+)"


def status_chunks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, key, body): a page's text from an id to the next, with the id; a key's first stays.

    Where two numbers stand together as in 'QLYC-1 / 2', the second has the first's text, if it has none of its own.
    """
    parts = docs.select("doc_id", "text", F.filter(F.split("text", f"(?={STATUS_ID})"), lambda x: x.rlike(f"^{STATUS_ID}")).alias("parts"))
    one = parts.select("doc_id", F.posexplode("parts").alias("n", "body")).withColumn("key", labels.backlog_key(F.regexp_extract("body", f"^{STATUS_ID}", 0)))
    first = one.groupBy("doc_id", "key").agg(F.min_by("body", "n").alias("body"))
    known = first.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "body"))).alias("known"))
    d = parts.select("doc_id", "text").join(known, "doc_id")
    pair = "QLYC-([0-9]+)\\s*/\\s*([0-9]+)"
    pairs = F.zip_with(text.matches(c("text"), pair, 1), text.matches(c("text"), pair, 2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    step = lambda m, p: F.when(F.map_contains_key(m, p["a"]) & ~F.map_contains_key(m, p["b"]), F.map_concat(m, F.create_map(p["b"], F.element_at(m, p["a"])))).otherwise(m)
    return d.select("doc_id", F.explode(F.aggregate(pairs, c("known"), step)).alias("key", "body"))


def id_snippets(docs: DataFrame, most: int = 2, pattern: str = "(?:QLYC|YC)-[0-9]+") -> DataFrame:
    """docs(doc_id, text) -> (doc_id, key, snippets): up to ``most`` lines that name each id."""
    k = docs.select("doc_id", "text", F.explode(F.array_distinct(text.matches(c("text"), pattern))).alias("key"))
    return k.select("doc_id", "key", F.slice(F.filter(F.split("text", "\n"), lambda x: F.contains(x, c("key"))), 1, most).alias("snippets"))


def cited_documents(docs: DataFrame, files: DataFrame) -> DataFrame:
    """docs(doc_id, text), files(path) -> (doc_id, path): the first cited file name that is there."""
    cited = docs.select("doc_id", F.posexplode(text.matches(c("text"), "([A-Za-z0-9_-]+\\.(?:md|pdf|docx))", 1)).alias("n", "name"))
    f = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    return cited.join(f, "name").groupBy("doc_id").agg(F.min_by("path", F.struct("n", "path")).alias("path"))


def merged_groups(primary: DataFrame, supplement: DataFrame) -> DataFrame:
    """(key, items, via): the supplement's items only where the primary has none that is real."""
    real = F.filter(c("p"), lambda x: F.trim(x) != "")
    j = primary.select("key", c("items").alias("p")).join(supplement.select("key", c("items").alias("s")), "key", "full_outer")
    has = F.coalesce(F.size(real) > 0, F.lit(False))
    return j.select("key", F.when(has, real).otherwise(F.coalesce("s", F.array().cast("array<string>"))).alias("items"), F.when(has, "primary").otherwise("supplement").alias("via"))


def newest_source(files: DataFrame) -> DataFrame:
    """files(kind, path, modified) -> (kind, path): by the date in the name, else by modification."""
    day = F.coalesce(F.try_to_date(F.regexp_extract("path", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd"), F.to_date("modified"))
    return files.groupBy("kind").agg(F.max_by("path", F.struct(day.alias("d"), c("path"))).alias("path"))


def timeline(*lanes: tuple[str, DataFrame], since: str | None = None) -> DataFrame:
    """Lanes (name, rows(date_text, title, body)) as one table in date order, undated last: (lane, event_ts, title, text)."""
    out = None
    for name, rows in lanes:
        one = rows.select(F.lit(name).alias("lane"), dates.first_date(c("date_text")).alias("event_ts"), text.excerpt(c("title")).alias("title"), text.excerpt(c("body")).alias("text"))
        out = one if out is None else out.unionByName(one)
    if since:
        out = out.withColumn("event_ts", F.greatest("event_ts", F.lit(since).cast("timestamp")))
    return out.orderBy(c("event_ts").asc_nulls_last(), "lane", "title")


def timeline_groups(roots: DataFrame, logs: DataFrame) -> DataFrame:
    """roots(group, root_id, day, title), logs(group, id, day, title) -> (root_id, items): each log at its nearest root, in order (undated last)."""
    from sheaf.operators.joins import nearest_event

    at = nearest_event(logs.where("day is not null").select("id", "group", "day"), roots.select("group", c("root_id").alias("event_id"), c("day").alias("event_day")), "group").select("id", c("event_id").alias("root_id"))
    first = roots.groupBy("group").agg(F.min_by("root_id", F.struct("day", "root_id")).alias("first_root"))
    placed = logs.join(at, "id", "left").join(first, "group").withColumn("root_id", F.coalesce("root_id", "first_root"))
    item = F.struct(c("day").isNull().alias("undated"), "day", "title", "id")
    return placed.groupBy("root_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["title"]).alias("items"))


def plan_rows(rows: DataFrame, start: str, end: str) -> DataFrame:
    """rows(key, title, note, deadline) with status and bar on the axis."""
    lo, hi = dates.deadline_window(c("deadline"))
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    left, width = dates.bar(s, e, c("lo"), c("hi"))
    return rows.withColumns({"lo": lo, "hi": hi}).select(labels.backlog_key(c("key")).alias("key"), "title", text_status(c("note"), F.lit(False), F.lit(False)).alias("status"), F.when(c("lo").isNotNull(), F.round(left, 1)).alias("left_pct"), F.when(c("lo").isNotNull(), F.round(width, 1)).alias("width_pct"))


# Words that tell no artifact, points by where its words stand, and how many of its parts are looked at.
ARTIFACT_STOP = """the and for with from this that draft tai lieu document file ban nhap thu mau
yeu cau nghiep vu thiet ke kiem thu markdown docx pdf output files""".split()
ARTIFACT_POINTS = {"name": 24, "key": 18, "history": 8, "word_file": 6, "word_text": 3, "heading": 5}
ARTIFACT_PARTS = {"lines": 10, "items": 12, "words": 40, "headings": 6, "names": 3, "texts": 2}


def plain_words(value: str) -> str:
    """A setting's text as words: marks off, lower case, anything but letters and digits a space."""
    import re
    import unicodedata

    bare = "".join(ch for ch in unicodedata.normalize("NFD", value or "") if unicodedata.category(ch) != "Mn")
    return re.sub("[^a-z0-9]+", " ", bare.lower()).strip()


def artifact_candidates(uploads: DataFrame, artifacts: list[dict]) -> DataFrame:
    """uploads(upload_id, names array, texts array, history array of keys) -> (upload_id, artifact_key, name, score, has_history, place), best first.

    ``artifacts`` are settings: {artifact_key, name, description, template, checklist}. An artifact scores by whether its name, its key, its words
    and its headings stand in the names or texts of an upload, and by its history there. Ties: with history first, then by name. Texts are read whole.
    """
    p, n = ARTIFACT_POINTS, ARTIFACT_PARTS
    rows = []
    for a in artifacts:
        lines = (a.get("template") or "").splitlines()
        told = [a["artifact_key"], a.get("name") or "", a.get("description") or "", *(x for x in lines[: n["lines"]] if x.strip().startswith(("#", "*", "-"))), *(a.get("checklist") or [])[: n["items"]]]
        words = sorted({w for x in told for w in plain_words(x).split() if len(w) >= 3 and w not in ARTIFACT_STOP}, key=lambda w: (-len(w), w))[: n["words"]]
        heads = [h for x in [x.strip("#*- ") for x in lines if x.strip().startswith("#")][: n["headings"]] if (h := plain_words(x))]
        rows.append((a["artifact_key"], a.get("name") or a["artifact_key"], plain_words(a.get("name") or a["artifact_key"]), plain_words(a["artifact_key"]), words, heads))
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    one = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(name).alias("name"), F.lit(nw).alias("name_words"), F.lit(kw).alias("key_words"), strings(w).alias("words"), strings(h).alias("heads")) for k, name, nw, kw, w, h in rows))
    bare = lambda xs, most, mark: F.trim(F.regexp_replace(text.fold_keep_stroke(F.array_join(F.slice(xs, 1, most), mark)), "[^a-z0-9]+", " "))
    u = uploads.select("upload_id", "history", bare("names", n["names"], " ").alias("file"), bare("texts", n["texts"], "\n").alias("body"), F.explode(one).alias("a"))
    has = lambda where, x: (x != "") & F.contains(c(where), x)
    points = lambda hit, k: F.when(hit, p[k]).otherwise(0)
    total = lambda xs, f: F.aggregate(xs, F.lit(0), lambda s, x: s + f(x))
    history = F.coalesce(F.array_contains("history", c("a.key")), F.lit(False))
    score = points(has("file", c("a.name_words")), "name") + points(has("file", c("a.key_words")), "key") + points(history, "history")
    score = score + total(c("a.words"), lambda w: F.when(F.contains(c("file"), w), p["word_file"]).when(F.contains(c("body"), w), p["word_text"]).otherwise(0)) + total(c("a.heads"), lambda h: points(F.contains(c("body"), h), "heading"))
    out = u.select("upload_id", c("a.key").alias("artifact_key"), c("a.name").alias("name"), score.alias("score"), history.alias("has_history"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("upload_id").orderBy(c("score").desc(), c("has_history").desc(), F.lower("name"))))


def trim_context(context: Column, most: int, mark: str = "\n---\n") -> Column:
    """Cut at the last mark if that lies past half of the limit, else hard."""
    cut = F.substring(context, 1, most)
    last = F.length(cut) - F.length(F.regexp_extract(cut, f"(?s)^(.*){mark}", 1))
    head = F.regexp_extract(cut, f"(?s)^(.*){mark}", 1)
    return F.when(F.length(context) <= most, context).when((last < F.length(cut)) & (F.length(head) > most / 2), head).otherwise(cut)
