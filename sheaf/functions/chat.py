"""Column functions over chat messages: context tags, change keys, what is asked of an upload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Messages that ask nothing of an upload.
IDLE = ("file này", "file nay", "đây", "day", "này", "nay", "xem file này", "xem file nay", "gửi file này", "gui file nay")
# Words that ask for a deed where they stand alone, and phrases that do anywhere.
DEED_WORDS = ("review", "tóm tắt", "summary", "compare", "extract", "find", "tìm", "search", "map", "gắn", "convert", "generate", "tạo", "viết", "lập", "draft", "translate", "dịch", "lưu", "save", "xuất")
DEED_PHRASES = ("rà soát", "thẩm định", "đánh giá", "kiểm tra", "so sánh", "đối chiếu", "trích", "rút ra", "liệt kê", "xác định", "tra cứu", "chuyển thành", "giải thích", "phân tích", "tạo backlog", "tạo ticket")
# What names the upload, and what asks for its content; both together are a request.
FILE_WORDS, FILE_PHRASES = ("file",), ("tài liệu", "tai lieu", "document", "attachment", "upload", "pdf", "doc", "ppt", "htm")
CONTENT_WORDS = ("đọc", "doc")
CONTENT_PHRASES = (
    "nội dung", "noi dung", "ý chính", "y chinh", "main point", "key point", "nói gì", "noi gi", "có gì", "co gi", "gồm gì", "gồm những gì", "gom gi", "gom nhung gi", "đề cập", "de cap", "bao gồm", "bao gom",
    "what does", "what is in", "what's in", "requirement", "yêu cầu", "yeu cau", "user story", "user stories", "acceptance criteria", "open question", "rủi ro", "rui ro", "tóm lược", "tom luoc", "trả lời", "tra loi",
    "cho tôi biết", "cho toi biet",
)
# Questions about content that need not name the upload: beginnings with what must follow, and phrases.
DIRECT = (("nội dung", "là gì"), ("noi dung", "la gi"), ("ý chính", "là gì"), ("y chinh", "la gi"))
DIRECT_PHRASES = ("requirement nào", "yeu cau nao", "các yêu cầu", "cac yeu cau", "tóm tắt", "tom tat", "phân tích", "phan tich", "giải thích", "giai thich")
#: Context tags that are taken off a message at most, and the letters of one at most.
TAGS, TAG = 8, 220


def without_tags(message: Column) -> Column:
    """A message without the bracketed context tags before it."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(message, F.lit("")), f"^(\\s*\\[[^\\]\\n]{{1,{TAG}}}\\]\\s*){{1,{TAGS}}}", ""), "^\\s+|\\s+$", "")


def change_key(message: Column) -> Column:
    """The first change key after the tags, upper-cased; null without one."""
    return F.upper(F.nullif(F.regexp_extract(without_tags(message), "(?i)(?<![\\p{L}\\p{N}_])CHG-[0-9]{3}-[0-9]{2}(?![\\p{L}\\p{N}_])", 0), F.lit("")))


def says(message: Column, words: tuple[str, ...], phrases: tuple[str, ...]) -> Column:
    """Any of the words alone, or of the phrases anywhere."""
    quoted = lambda xs: "|".join(x.replace(".", "\\.") for x in xs)
    alone = f"(?<![\\p{{L}}\\p{{N}}_])(?:{quoted(words)})(?![\\p{{L}}\\p{{N}}_])|" if words else ""
    return message.rlike(alone + f"(?:{quoted(phrases)})")


def upload_intent(message: Column) -> Column:
    """Whether a message beside an upload says what to do with it: a deed, a question about the file's content, or one about content as such."""
    plain = F.lower(without_tags(message))
    direct = says(plain, (), DIRECT_PHRASES)
    for start, end in DIRECT:
        direct = direct | plain.rlike(f"^{start}.*{end}")
    about = says(plain, FILE_WORDS, FILE_PHRASES) & says(plain, CONTENT_WORDS, CONTENT_PHRASES)
    return (plain != "") & ~plain.isin(*IDLE) & (says(plain, DEED_WORDS, DEED_PHRASES) | about | direct)
