"""Payloads of trackers, wikis, pages, sheets and Markdown tables as rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import labels
from sheaf.functions.text import squeeze

ISSUE = "struct<key:string, fields:struct<summary:string, status:struct<name:string>, assignee:struct<displayName:string>, priority:struct<name:string>, updated:string, attachment:array<struct<filename:string,content:string>>>>"
CONVERTIBLE = ("pdf", "docx", "pptx", "xlsx", "msg", "eml", "html", "htm")


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def flatten_rich(node) -> str:
    """Text of a nested content tree: a line break between a node's parts, a blank line between a list's nodes."""
    if isinstance(node, list):
        return "\n\n".join(t for t in map(flatten_rich, node) if t)
    if not isinstance(node, dict):
        return ""
    if node.get("type") == "text":
        return str(node.get("text") or "")
    if node.get("type") == "hardBreak":
        return "\n"
    inner = node.get("content") or []
    if node.get("type") in ("doc", "bulletList", "orderedList"):
        return flatten_rich(inner)
    return "".join(flatten_rich(x) for x in inner)


def rich_text(rows: DataFrame, column: str) -> DataFrame:
    """rows with ``column`` (JSON of a recursive tree, which no fixed schema holds) replaced by its text."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(at).to_pylist():
                try:
                    out.append(flatten_rich(json.loads(x)) if x else "")
                except ValueError:
                    out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else col for i, col in enumerate(b.columns)], b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def issues(raw: DataFrame) -> DataFrame:
    """raw(value) of tracker JSON -> one document row an issue, with defaults for what is missing."""
    x = raw.select(F.from_json("value", ISSUE).alias("i"), F.get_json_object("value", "$.fields.description").alias("description")).where("i.key is not null")
    f = lambda c, d: F.coalesce(c, F.lit(d))
    out = x.select(F.col("i.key").alias("key"), f(F.col("i.fields.summary"), "").alias("title"), f(F.col("i.fields.status.name"), "unknown").alias("status"), f(F.col("i.fields.assignee.displayName"), "unassigned").alias("assignee"), f(F.col("i.fields.priority.name"), "none").alias("priority"), F.substring("i.fields.updated", 1, 10).alias("date"), "description", F.col("i.fields.attachment").alias("attachment"))
    return rich_text(out, "description")


def attachments(issue_rows: DataFrame) -> DataFrame:
    """(key, filename, content, convertible) of every attachment."""
    a = issue_rows.select("key", F.explode("attachment").alias("a"))
    return a.select("key", "a.filename", "a.content", F.lower(F.element_at(F.split("a.filename", "\\."), -1)).isin(*CONVERTIBLE).alias("convertible"))


def wiki_pages(raw: DataFrame) -> DataFrame:
    """raw(value) of wiki JSON -> (page_id, space, title, slug, date, html) of its pages."""
    kind = "struct<id:string,type:string,title:string,space:struct<key:string>,version:struct<when:string>,body:struct<storage:struct<value:string>>>"
    p = raw.select(F.from_json("value", kind).alias("p")).where("p.type = 'page'")
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("p.title"), "[^a-z0-9à-ỹđ]+", "-"), "^-|-$", ""), 1, 60)
    return p.select(F.col("p.id").alias("page_id"), F.col("p.space.key").alias("space"), F.col("p.title").alias("title"), slug.alias("slug"), F.substring("p.version.when", 1, 10).alias("date"), F.col("p.body.storage.value").alias("html"))


class Blocks(HTMLParser):
    """Blocks of a page in document order, and the cells of its tables."""

    BLOCK = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6, "p": 0, "li": 0, "pre": 0, "blockquote": 0}
    SKIP = {"script", "style", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.cells, self.open, self.skip = [], [], None, 0
        self.table = self.row = self.col = -1
        self.down: dict[int, tuple[int, str]] = {}

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "table":
            self.table, self.row, self.down = self.table + 1, -1, {}
        elif tag == "tr":
            self.row, self.col = self.row + 1, 0
        elif tag in ("td", "th"):
            a = dict(attrs)
            number = lambda k: min(1000, int(a[k])) if str(a.get(k) or "").isdigit() else 1
            self.flush()
            self.open = (tag, number("colspan"), number("rowspan"), [])
        elif tag in self.BLOCK and not (self.open and self.open[0] in ("td", "th")):
            self.flush()
            self.open = (tag, 0, 0, [])

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif self.open and tag == self.open[0]:
            self.flush()
        elif tag == "tr":
            self.fill()

    def handle_data(self, data):
        if self.skip:
            return
        if self.open is None and data.strip():
            self.open = ("text", 0, 0, [])
        if self.open:
            self.open[3].append(data)

    def fill(self):
        """Cells that reach down from rows above."""
        while self.down.get(self.col, (0, ""))[0] > 0:
            n, text = self.down[self.col]
            self.cells.append((self.table, self.row, self.col, text))
            self.down[self.col] = (n - 1, text)
            self.col += 1

    def flush(self):
        if self.open is None:
            return
        tag, across, down, parts = self.open
        self.open, text = None, " ".join("".join(parts).split())
        if tag in ("td", "th") and self.table >= 0 and self.row >= 0:
            for _ in range(across):
                self.fill()
                self.cells.append((self.table, self.row, self.col, text))
                self.down[self.col] = (down - 1, text)
                self.col += 1
        elif text:
            self.blocks.append(("heading" if tag[0] == "h" and tag[1:].isdigit() else tag, self.BLOCK.get(tag, 0), text))


def parsed(html: str | None) -> Blocks:
    p = Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p


def page_blocks(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> (page_id, ord, kind, level, text): headings, paragraphs and items in document order."""
    schema = pa.schema([("page_id", pa.int64()), ("ord", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows_of(schema, [(i, n, *x) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, x in enumerate(parsed(h).blocks)])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, ord int, kind string, level int, text string")


def page_cells(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> (page_id, table_no, row_no, col_no, text), spans expanded."""
    schema = pa.schema([("page_id", pa.int64()), ("table_no", pa.int32()), ("row_no", pa.int32()), ("col_no", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows_of(schema, [(i, *x) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in parsed(h).cells])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, table_no int, row_no int, col_no int, text string")


def pipe_tables(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, row_no, cells): the first Markdown table's rows without header and rule."""
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("is_row", F.trim("line").startswith("|"))
    by = Window.partitionBy("doc_id").orderBy("n")
    run = F.sum((F.col("is_row") & ~F.lag("is_row", 1, False).over(by)).cast("int")).over(by)
    first = line.withColumn("run", run).where("is_row and run = 1").withColumn("row_no", F.row_number().over(by) - 1)
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), "^\\||\\|$", ""), "\\|"), lambda x: F.trim(x))
    return first.where((F.col("row_no") > 0) & ~F.col("line").rlike("^[ |:-]+$")).select("doc_id", "row_no", cells.alias("cells"))


#: The break before a line '=== Sheet: name ===', which may end with white space and one more line break.
OPENS = "\n(?= *===[ \\t\\x0B\\f\\r]*Sheet:[^\\n\\r\\u0085\\u2028\\u2029]*===[ \\t\\x0B\\f\\r]*[\\u0085\\u2028\\u2029]?(?:\n|\\z))"


def tab_sheets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) of '=== Sheet: name ===' parts -> (doc_id, sheet, title, description, priority, category).

    A sheet's header is its first tabbed line with a title and a description column (labels.HEADER_ROLES); a line
    without a tab continues the description above it; totals and rows without title or description are dropped; one
    row a normalised (title, description) of a document. A text is cut into sheets, and a sheet into items, where it lies: only
    items are shuffled.
    """
    c, cells = F.col, lambda x: F.transform(F.split(x, "\t"), lambda y: F.trim(y))
    part = docs.select("doc_id", F.posexplode(F.split(F.concat(F.lit("\n"), F.replace("text", F.lit("\r\n"), F.lit("\n"))), OPENS)).alias("sheet_no", "part")).where("sheet_no > 0")
    low = lambda x: F.transform(cells(x), lambda y: squeeze(F.lower(y)))
    heads = lambda x: x.contains("\t") & (labels.role_of(low(x), "title") > 0) & (labels.role_of(low(x), "description") > 0)
    first = F.aggregate(F.split("part", "\n"), F.lit(None).cast("string"), lambda found, x: F.when(found.isNotNull(), found).when(heads(x), x))
    # explode stands between what is worked out and the conditions on it, which would be worked out a second time below it
    sheet = part.select("doc_id", "sheet_no", "part", F.explode(F.array_compact(F.array(first))).alias("header"))
    line = lambda x: F.concat(F.lit("\n"), x, F.lit("\n"))
    rest = F.substring("part", F.instr(line(c("part")), line(c("header"))) + F.length("header"), F.length("part"))
    sheet = sheet.select("doc_id", "sheet_no", F.trim(F.regexp_extract(F.substring_index("part", "\n", 1), "===\\s*Sheet:(.*?)===", 1)).alias("sheet"), low(c("header")).alias("header"), rest.alias("rest"))
    sheet = sheet.withColumn("at", F.struct(F.size("header").alias("last"), *(labels.role_of(c("header"), r).alias(r) for r in labels.HEADER_ROLES)))
    head = lambda x: F.substring_index(x, "\n", 1)
    more = lambda x: F.array_join(F.filter(F.transform(F.split(F.substring(x, F.length(head(x)) + 2, F.length(x)), "\n"), lambda y: F.trim(y)), lambda y: y != ""), "\n")
    item = sheet.select("doc_id", "sheet_no", "sheet", "at", F.posexplode(F.transform(F.split("rest", "\n(?=[^\n\t]*+\t)"), lambda x: F.struct(cells(head(x)).alias("cells"), more(x).alias("more")))).alias("item", "x")).where("item > 0")
    item = item.select("doc_id", "sheet_no", "sheet", "at", "item", "x.cells", "x.more")
    last = c("at.last")
    whole = F.when(F.size("cells") > last, F.concat(F.slice("cells", F.lit(1), last - 1), F.array(F.trim(F.array_join(F.slice("cells", last, F.size("cells")), " "))))).otherwise(c("cells"))
    item = item.withColumn("cells", whole)
    cell = lambda role: F.coalesce(F.get("cells", F.nullif(c(f"at.{role}"), F.lit(0)) - 1), F.lit(""))
    norm = lambda x: squeeze(F.lower(x))
    strip = lambda x, marks: F.regexp_replace(x, f"^[{marks}]+|[{marks}]+$", "")
    label = F.coalesce(F.nullif(strip(F.regexp_replace("sheet", "^[0-9]+[_\\s-]*", ""), " _-"), F.lit("")), c("sheet"))
    out = item.select("doc_id", "sheet_no", "item", label.alias("sheet"), strip(cell("title"), " •\t-").alias("title"), F.trim(F.concat_ws("\n", F.nullif(cell("description"), F.lit("")), F.nullif("more", F.lit("")))).alias("body"), *(cell(r).alias(r) for r in ("priority", "category", "quarter", "count", "notes")))
    out = out.where((c("title") != "") & (c("body") != "") & ~norm(c("title")).isin(*labels.TOTALS) & ~norm(c("title")).startswith(labels.TOTALS[0] + " "))
    out = out.withColumn("low", norm(c("body")))
    when = lambda hit, x: F.when(hit, F.regexp_replace(x, "[ .]+$", ""))
    parts = (when(c("quarter") != "", F.concat(F.lit(labels.PERIOD), c("quarter"))), when(c("count") != "", F.concat(c("count"), F.lit(labels.DETAILS))), when(F.lit(True), c("body")), when((c("notes") != "") & ~c("low").contains(norm(c("notes"))), F.concat(F.lit(labels.NOTES), c("notes"))))
    named = (c("sheet") != "") & ~norm(c("title")).contains(norm(c("sheet")))
    full = F.substring(F.when(named, F.concat_ws(" - ", "sheet", "title")).otherwise(c("title")), 1, 200)
    told = lambda *x: F.concat_ws(" ", *(F.nullif(y, F.lit("")) for y in x))
    urgent, words = told(norm(c("title")), c("low"), norm(c("sheet"))), told(norm(c("title")), c("low"), norm(c("category")))
    out = out.select("doc_id", "sheet_no", "item", "sheet", full.alias("title"), F.trim(F.concat_ws(". ", *parts)).alias("description"), labels.priority(F.coalesce(F.nullif("priority", F.lit("")), c("quarter")), urgent, squeezed=True).alias("priority"), labels.category(words, squeezed=True).alias("category"))
    # descriptions are normalised only where one title has several
    own = Window.partitionBy("doc_id", "_title")
    out = out.withColumn("_title", norm(c("title"))).withColumn("_several", F.min("description").over(own) != F.max("description").over(own)).withColumn("_key", F.when(c("_several"), norm(c("description"))))
    first = F.row_number().over(Window.partitionBy("doc_id", "_title", "_key").orderBy("sheet_no", "item"))
    return out.withColumn("_r", first).where("_r = 1").drop("_r", "_key", "_several", "_title", "item", "sheet_no")
