"""Mail and chat threads: subject, sender, channel, title, who raised it, event blocks, root events, best sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import dates, text
from sheaf.functions.text import any_phrase, fold_table, squeeze

c = F.col

# Headings that tell nothing, lines of metadata and of mail headers, openings that are no subject, words of business.
GENERIC = ("noi dung",)
GENERIC_PAGE = "^(trang|page) [0-9]+$"
METADATA = "(?i)^(source|converted_at|converter|date|project|reliability|basis|corroborated_by|log_type|last_updated|people_mentions):"
HEADERS = "(?i)^(Từ|From|To|Tới|Cc|Bcc|Ngày|Date):"
OPENINGS = ("dear ", "em gui lai noi dung cuoc hop", "gui trong meeting")
BUSINESS = ("qlyc-", "hop", "meeting", "daily", "mom", "ticket", "backlog", "golive")
EVENT_BUSINESS = ("qlyc-", "hop", "meeting", "daily", "mom", "golive", "kiosk")
LEAST_LETTERS = 18
# Names of channels, marks of paths and file names.
ZALO, TEAMS, EMAIL, DOCUMENT = "Zalo", "Teams", "Email", "Tài liệu"
ZALO_PATH, TEAMS_NAME, LOG_PATH, REPLIES = "_zalo-notes", "[Teams]", "_project-logs", ("RE ", "FW ", "FWD ")
IDS = "(?i)(?<![\\p{L}\\p{N}_])(?:QLYC|YC|RE|PA)-[0-9]+"


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are worked out once a row, however often later expressions and filters name them.

    They come out of a generator of one row, into which the optimizer neither moves a filter nor writes them out where they are used:
    inside a function over a text's lines that would be done again for each line.
    """
    one = F.explode_outer(F.array(F.struct(*(e.alias(n) for n, e in columns.items())))).alias("_once")
    return rows.select("*", one).select(*(c for c in rows.columns if c not in columns), "_once.*")


def generic(value: Column) -> Column:
    """A heading that says nothing: blank, a word for content, or a page."""
    return text.bound(fold_table(F.coalesce(value, F.lit(""))), says_nothing)


def says_nothing(f: Column) -> Column:
    """``generic`` of what is folded already."""
    return (f == "") | f.isin(*GENERIC) | f.rlike(GENERIC_PAGE)


def first_line(body: Column, pattern: str) -> Column:
    """What stands after a pattern at a line's start, squeezed; empty where no line has it."""
    return squeeze(F.regexp_extract(body, "(?md)" + pattern + "\\s*(.+)$", 1))


def first_heading(body: Column) -> Column:
    """The first line that opens with #, without its marks; empty without any."""
    return F.trim(F.regexp_replace(F.regexp_extract(body, "(?md)^#.*$", 0), "^#+|\\r$", ""))


def line_subject(lines: Column) -> Column:
    """The first line that reads like a subject of business; null without any."""

    def fits(raw: Column) -> Column:
        return text.bound(F.trim(F.regexp_replace(raw, "^\\s+|\\s+$", "")), lambda x: text.bound(fold_table(x), lambda f: tells(x, f)))

    def tells(x: Column, f: Column) -> Column:
        out = says_nothing(f) | x.startswith("#") | x.startswith("---") | x.rlike("(?i)^https?://\\S+$") | x.rlike(METADATA) | x.rlike(HEADERS)
        for opening in OPENINGS:
            out = out | f.startswith(opening)
        return ~out & (F.length(x) >= LEAST_LETTERS) & any_phrase(f, BUSINESS)

    return squeeze(F.try_element_at(F.filter(lines, fits), F.lit(1)))


def reply_subject(lines: Column) -> Column:
    return squeeze(F.try_element_at(F.filter(lines, lambda x: F.trim(x).rlike("(?i)^(RE|FW|FWD):")), F.lit(1)))


def mail_subject(body: Column) -> Column:
    """A Subject header, else a reply's line, else the first line of business; empty without any."""
    lines = F.split(body, "\n")
    header = F.coalesce(F.nullif(first_line(body, "^Subject:"), F.lit("")), F.nullif(first_line(body, "^Tiêu đề:"), F.lit("")))
    return F.coalesce(header, reply_subject(lines), line_subject(lines), F.lit(""))


def mail_sender(body: Column) -> Column:
    """What the From header says; empty without one."""
    return F.coalesce(F.nullif(first_line(body, "^From:"), F.lit("")), F.nullif(first_line(body, "^Từ:"), F.lit("")), F.lit(""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), "(?<=.)\\.[^.]*$", "")


def with_meta(docs: DataFrame) -> DataFrame:
    """docs(path, text, hint, ...) with channel, title, raised_by and subject; ``hint`` is the frontmatter's source, or null.

    By the path (chat notes), by the file's name (meetings), else by mail marks in the text, else by the hint; a title that is blank or generic
    gives way to the subject, the first heading, the file's name.
    """
    body, name, own, hint = c("text"), file_name(c("path")), stem(c("path")), F.coalesce("hint", F.lit(""))
    d = once(docs, subject=mail_subject(body), _sender=mail_sender(body), _head=first_heading(body))
    zalo, teams = c("path").contains(ZALO_PATH), name.contains(TEAMS_NAME)
    reply = F.lit(False)
    for r in REPLIES:
        reply = reply | F.upper(name).startswith(r)
    mail = ~zalo & ~teams & ((c("subject") != "") | (c("_sender") != "") | reply)
    group = F.trim(F.regexp_extract(body, "\\[(?:Nhóm|Nh\\S{1,6}m):\\s*(.*?)\\s*\\|", 1))
    marked = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x).startswith("[") & x.contains("| ID:") & x.contains(":")), lambda x: F.regexp_replace(F.split(F.regexp_replace(F.trim(x), "^[^:]*:", ""), "\\|")[0], "^[\\[\\] ]+|[\\[\\] ]+$", ""))
    marked = F.try_element_at(F.filter(marked, lambda x: x != ""), F.lit(1))
    spoke = F.trim(F.regexp_extract(body, "\\[[0-9]{4}-[0-9]{2}-[0-9]{2} [^\\]]+\\]\\s*([^:]+):", 1))
    said = F.trim(F.regexp_extract(body, "(?m)^\\s*[-*]?\\s*([^:]{2,60}):", 1))
    meeting = F.regexp_replace(F.replace(F.replace(name, F.lit(".md"), F.lit("")), F.lit(TEAMS_NAME), F.lit("")), "^[ -]+|[ -]+$", "")
    title = F.when(zalo, F.coalesce(F.nullif(group, F.lit("")), marked)).when(teams, meeting).when(mail, F.coalesce(F.nullif(c("subject"), F.lit("")), own))
    for other in (c("subject"), F.coalesce(F.nullif(c("_head"), F.lit("")), own)):
        title = F.when(generic(title), other).otherwise(title)
    low = F.lower(hint)
    told = F.when(hint.contains(TEAMS_NAME), TEAMS).when(low.contains("zalo"), ZALO).when(low.contains("mail") | low.contains("pdf"), EMAIL)
    channel = F.when(zalo, ZALO).when(teams, TEAMS).when(mail, EMAIL).otherwise(F.coalesce(told, F.lit(DOCUMENT)))
    raised = F.coalesce(F.nullif(F.when(zalo, spoke).when(teams, said), F.lit("")), c("_sender"))
    return once(d, channel=channel, title=title, raised_by=raised).drop("_sender").withColumnRenamed("_head", "heading")


def event_blocks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, path, text) -> (doc_id, block_no, body): a thread cut where an event starts; what stands before the first start is a block too.

    A start is a Subject or reply line, or a line of business with a mail header among the next five. Chat notes and meetings are
    one block. Blocks are made as one array of a document's lines, so no line is shuffled.
    """
    whole = c("path").contains(ZALO_PATH) | file_name(c("path")).contains(TEAMS_NAME)
    d = once(docs.select("doc_id", "path", "text"), whole=whole, lines=F.split("text", "\n"))

    def starts(i: Column) -> Column:
        x = F.trim(F.regexp_replace(F.element_at("lines", i), "^\\s+|\\s+$", ""))
        return text.bound(x, lambda x: text.bound(fold_table(x), lambda f: opens(i, x, f)))

    def opens(i: Column, x: Column, f: Column) -> Column:
        near = F.array_join(F.slice("lines", i + 1, 5), "\n")
        event = x.rlike("(?i)^Subject:\\s*.+$") | x.rlike("(?i)^(RE|FW|FWD):\\s*.+$") | (any_phrase(f, EVENT_BUSINESS) & near.rlike("(?mi)^(Từ|From|Ngày|Date):"))
        return ~says_nothing(f) & ~x.startswith("#") & ~x.startswith("---") & event

    at = F.when(c("whole"), F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(1), F.size("lines")), starts))
    d = once(d, at=at)
    d = once(d, at=F.when((F.size("at") > 0) & (F.element_at("at", 1) == 1), c("at")).otherwise(F.concat(F.array(F.lit(1)), "at")))
    cut = F.transform("at", lambda s, n: F.regexp_replace(F.array_join(F.slice("lines", s, F.coalesce(F.get("at", n + 1), F.size("lines") + 1) - s), "\n"), "^\\s+|\\s+$", ""))
    d = once(d, blocks=F.when(F.size("at") > 1, F.filter(cut, lambda x: x != "")).otherwise(F.array()))
    blocks = F.when(F.size("blocks") > 0, c("blocks")).otherwise(F.array("text"))
    return d.select("doc_id", F.posexplode_outer(blocks).alias("block_no", "body"))


def root_events(docs: DataFrame, default_year: int) -> DataFrame:
    """docs(doc_id, path, text, hint, date) -> (doc_id, channel, title, raised_by, date_label, day, detail) of texts that may root a timeline.

    Dated by the first date of title, detail or text, else by ``date``, the frontmatter's; without a date they go, as do documents that
    nobody raised and exports.
    """
    d = with_meta(docs)
    own = stem(c("path"))  # the rules read few columns from here on, each worked out once
    detail = F.when(~generic(c("heading")), c("heading")).when(c("subject") != "", c("subject")).when(~generic(c("title")), c("title")).otherwise(own)
    d = once(d, _detail=detail)
    seed = F.array_join(F.filter(F.array("title", "_detail", "text"), lambda x: x != ""), " ")
    label, day = dates.loose_date(seed, default_year)
    told, known = dates.loose_date(F.coalesce("date", F.lit("")), default_year)
    named = fold_table(F.when(c("title") != "", c("title")).otherwise(c("_detail")))
    exported = named.startswith("ngay xuat:") | named.contains("jira subtasks") | fold_table(own).contains("export")
    d = once(d, _day=day, _label=label, _known=known, _told=told)
    d = d.where(F.coalesce("_day", "_known").isNotNull() & ~((c("channel") == DOCUMENT) & (c("raised_by") == "")) & ~exported)
    short = squeeze(c("_detail"))
    short = F.when(F.length(short) <= 180, short).otherwise(F.concat(F.rtrim(F.substring(short, 1, 179)), F.lit("…")))
    return d.select("doc_id", "channel", "title", "raised_by", F.when(c("_day").isNotNull(), c("_label")).otherwise(c("_told")).alias("date_label"), F.coalesce("_day", "_known").alias("day"), short.alias("detail"))


def best_source(docs: DataFrame) -> DataFrame:
    """docs(path, text, hint) -> (key, path, channel, title, raised_by, score): the source that tells most of each id in paths and texts.

    2 for a channel, 2 for a title, 1 for who raised it, 2 for the id in the file's name; ties to the smaller path. Project logs do not count.
    """
    d = with_meta(docs.where(~c("path").contains(LOG_PATH)))
    ids = F.array_distinct(F.transform(text.matches(F.concat_ws("\n", "path", "text"), IDS), F.upper))
    d = d.select("path", "channel", "title", "raised_by", F.explode(ids).alias("key"))
    score = F.when(c("channel") != "", 2).otherwise(0) + F.when(c("title") != "", 2).otherwise(0) + F.when(c("raised_by") != "", 1).otherwise(0) + F.when(F.contains(F.upper(file_name(c("path"))), c("key")), 2).otherwise(0)
    one = F.struct("path", "channel", "title", "raised_by", score.alias("score"))
    return d.groupBy("key").agg(F.min_by(one, F.struct(-score, c("path"))).alias("r")).select("key", "r.*")
