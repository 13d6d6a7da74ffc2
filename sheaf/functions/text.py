"""Column functions over text: folding, terms, ids, people, snippets, quality. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Precomposed letters and what they fold to. The letter with a stroke keeps it under fold A, loses it under fold B.
MARKED = "áàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵ"
PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyy"
OTHER_MARKED, OTHER_PLAIN = "äëïöüÿçñåîûìòùõãčďěňřšťůžćńóśźżğąęý", "aeiouycnaiuiouoacdenrstuzcnoszzgaey"

# Words that are no keyword.
STOPWORDS = """a an and are as at bị by cho các cần còn có của da dang de den di do for from gi gì hay how in is khi không ko
là làm len lên một nao nào những như of on or ra sau show sẽ tai tại the theo thi thì this to tren trên trong tu từ và ve về với what""".split()
# Words too general to anchor a question, and short words that may.
GENERIC_TERMS = """quy trinh golive go live production uat release test ho so thu tuc review van hanh handover blocker project du an
tiep nhan yeu cau phat trien cong nghe fast lane demand intake backlog sprint pending recent change""".split()
SHORT_ANCHORS = "ocr sdk tch cmp cdp api".split()
# Cues of a question about people, times or operations.
PEOPLE_HINTS = ("ai ", "phu trach", "dau moi", "spoc", "tham gia")
TIME_HINTS = ("timeline", "tien do", "ke hoach", "moc", "deadline", "bao gio", "khi nao", "thoi diem")
OPS_HINTS = ("golive", "go live", "ho so", "thu tuc", "review", "handover", "van hanh", "blocker")

# What an identifier looks like (ticket, request, process code, document code, file name), in order.
IDENTIFIERS = (
    "(?<![A-Za-z0-9_])[A-Z]{2,10}-[0-9]+(?![A-Za-z0-9_])",
    "(?i)(?<![A-Za-z0-9_])RE-[0-9]+(?![A-Za-z0-9_])",
    "(?i)(?<![A-Za-z0-9_])(?:QT|QĐ|QD)\\.IT\\.[0-9]+(?![A-Za-z0-9_])",
    "(?i)(?<![A-Za-z0-9_])SIDLC[_A-Z0-9,.-]+",
    "(?i)(?<![A-Za-z0-9_])[A-Za-z0-9_ .()-]+\\.(?:md|pdf|docx|pptx|xlsx|msg|html?)(?![A-Za-z0-9_])",
)
# A question of at most so many letters and words that has such a mark is itself a term.
SHORT_LETTERS, SHORT_WORDS, SHORT_MARK = 80, 3, "[A-Z0-9._\\\\/-]"

SPACE = "[ \\t\\n\\r\\f\\x0B]+"
#: Blanks and line ends as RE2 has them in \\s, for use between brackets; all separators of category Zs.
BLANK, SPACES = " \\t\\n\\r\\f", " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def marks_off(c: Column) -> Column:
    """Lower case, marks off; decomposed marks are dropped, the stroke of d stays."""
    return F.regexp_replace(F.translate(F.lower(c), MARKED + OTHER_MARKED, PLAIN + OTHER_PLAIN), "\\p{Mn}", "")


def fold_keep_stroke(c: Column) -> Column:
    """Fold A: ``marks_off`` with spaces squeezed."""
    return squeeze(marks_off(c))


def fold_table(c: Column) -> Column:
    """Fold B: lower case and a fixed table, the stroke of d off too; decomposed text is left alone."""
    return squeeze(F.translate(F.lower(c), MARKED + "đ", PLAIN + "d"))


def squash(c: Column) -> Column:
    return F.regexp_replace(fold_keep_stroke(c), "[^a-z0-9]+", "")


def ordered_distinct(c: Column) -> Column:
    return F.array_distinct(c)


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def ticket_ids(text: Column, path: Column, prefixes: tuple[str, ...]) -> Column:
    """Ids of each prefix in text, then in path, upper-cased, first kept."""
    found = [matches(c, f"(?i)(?<![A-Za-z0-9_]){p}-[0-9]+(?![A-Za-z0-9_])") for c in (text, path) for p in prefixes]
    return ordered_distinct(F.transform(F.concat(*found), F.upper))


def clean_person(c: Column) -> Column:
    """A name without mail address and brackets; null if it has under three letters or a digit."""
    for pattern in ("<[^>]+>", "\\([^)]*\\)", "[^ \\t\\n]+@[^ \\t\\n]+"):
        c = F.regexp_replace(c, pattern, "")
    c = F.regexp_replace(squeeze(c), "^[-: ]+|[-: ]+$", "")
    return F.when((F.length(c) >= 3) & ~c.rlike("[0-9]"), c)


def people(text: Column, labels: tuple[str, ...] = ("Từ", "Tới", "Cc")) -> Column:
    """Names in header lines, message headers and before a bracket, first kept, at most 50."""
    lines = [F.flatten(F.transform(matches(text, f"(?m)^{x}:[ \\t]*(.+)$", 1), lambda v: F.split(v, " *, *"))) for x in labels]
    heads = matches(text, "(?m)^\\[[0-9]{4}-[0-9]{2}-[0-9]{2} [^\\]]+\\][ \\t]*([^:\\n]+):", 1)
    inline = matches(text, "(?<![A-Za-zĐđ])([A-ZĐ][a-zà-ỹđ]+(?: +[A-ZĐ][a-zà-ỹđ]+){1,4}) *\\(", 1)
    names = F.filter(F.transform(F.concat(*lines, heads, inline), clean_person), lambda x: x.isNotNull())
    return F.slice(ordered_distinct(names), 1, 50)


def exact_terms(question: Column) -> Column:
    """Identifier-like terms; a short question that looks like one is its own term."""
    q = F.trim(question)
    found = F.concat(*(matches(q, p) for p in IDENTIFIERS))
    short = (F.length(q) >= 1) & (F.length(q) <= SHORT_LETTERS) & ~q.endswith("?") & (F.size(F.split(q, SPACE)) <= SHORT_WORDS) & q.rlike(SHORT_MARK)
    return F.when(F.size(found) > 0, ordered_distinct(found)).when(short, F.array(q)).otherwise(F.array().cast("array<string>"))


def keyword_terms(question: Column) -> Column:
    """Folded tokens of two letters or more that are no stop word, first kept."""
    raw = matches(fold_keep_stroke(question), "[a-z0-9][a-z0-9._/-]+")
    cut = F.transform(raw, lambda t: F.regexp_replace(t, "^[._/-]+|[._/-]+$", ""))
    return ordered_distinct(F.filter(cut, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS)))


def anchor_terms(keywords: Column) -> Column:
    return F.filter(keywords, lambda t: ~t.isin(*GENERIC_TERMS) & ((F.length(t) >= 4) | t.isin(*SHORT_ANCHORS)))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value worked out once, however often f names it: an expression is written out wherever it is named, a variable is not."""
    return F.element_at(F.transform(F.array(value), f), 1)


def any_phrase(c: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in phrases])


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), SPACE), lambda w: w != "")


def planner_mode(n_words: Column, n_variants: Column, exact: Column) -> Column:
    mixed = (n_words >= 4) | (n_variants > 1)
    return F.when(mixed, "mixed").when(exact, "exact").otherwise("semantic")


def snippet(text: Column, query: Column, limit: int = 240) -> Column:
    """A window about the first query word that the squeezed text has, with dots where it is cut."""
    body = squeeze(F.coalesce(text, F.lit("")))
    at = F.try_element_at(F.filter(F.transform(words(F.lower(query)), lambda w: F.instr(F.lower(body), w)), lambda p: p > 0), F.lit(1))
    start = F.greatest(at - 1 - 80, F.lit(0))
    end = F.least(F.length(body), at - 1 + limit - 80)
    cut = F.trim(F.substring(body, start + 1, end - start))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < F.length(body), "...").otherwise(""))
    return F.when(at.isNull(), F.substring(body, 1, limit)).otherwise(cut)


def excerpt(text: Column, most: int = 110) -> Column:
    """Without bold marks; cut back to a word's end."""
    t = F.trim(F.replace(text, F.lit("**"), F.lit("")))
    cut = F.substring(t, 1, most)
    whole = F.regexp_extract(cut, "(?s)^(.*) [^ ]*$", 1)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.when(cut.contains(" "), whole).otherwise(cut), F.lit("…")))


def strip_tags(html: Column) -> Column:
    """Text of markup: scripts, comments and tags off, common entities undone, spaces squeezed."""
    t = F.regexp_replace(html, "(?is)<(script|style|noscript).*?>.*?</\\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, "(?s)<!--.*?-->", " "), "(?s)<[^>]+>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(mark))
    return squeeze(t)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\\n")) + 1


def n_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def unique_ratio(c: Column) -> Column:
    t = matches(F.lower(c), "[a-z0-9à-ỹđ_]+")
    return F.size(F.array_distinct(t)) / F.greatest(F.size(t), F.lit(1))


def dominant_phrase(c: Column) -> tuple[Column, Column]:
    """(times, length) of the most repeated phrase of eight letters or more between punctuation."""
    p = F.filter(F.transform(F.split(squeeze(F.lower(c)), "[,;.!?\\n]+"), lambda x: F.regexp_replace(x, "^[ -]+|[ -]+$", "")), lambda x: F.length(x) >= 8)
    counts = F.transform(F.array_distinct(p), lambda x: F.struct(F.size(F.filter(p, lambda y: y == x)).alias("n"), F.length(x).alias("len")))
    best = F.array_max(counts)
    return best["n"], best["len"]
