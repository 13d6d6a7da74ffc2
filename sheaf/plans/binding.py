"""Registration of queries, and the views that bind the operators to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Queries of a module with the SQL that must give the same rows."""

    def __init__(self):
        self.QUERIES: dict[str, Query] = {}
        self.ORACLE: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        assert name not in self.QUERIES, name
        self.QUERIES[name] = query
        if sql:
            self.ORACLE[name] = sql

    def query(self, name: str, sql: str | None = None):
        return lambda f: self.add(name, f, sql) or f

    def over_docs(self, name: str, select: Callable[[DataFrame], DataFrame], sql: str) -> None:
        """A query over the ``docs`` view; in ``sql`` the view is named docs."""
        self.add(name, lambda spark, d: select(docs(spark, d)), with_docs(sql))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The same expressions in both engines: metadata that the invented texts lack is derived from doc_id.
DOCS = {
    "doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source",
    "rel_path": "concat(source, '/', lang, '/doc-', cast(doc_id as string), '.md')",
    "project": "source",
    "source_channel": "case doc_id % 4 when 0 then 'email' when 1 then 'document' when 2 then 'chat' else 'wiki' end",
    "doc_type": "case doc_id % 4 when 0 then 'mom' when 1 then 'backlog' when 2 then 'report' else 'solution_doc' end",
    "doc_date": "date_add(date '2024-01-01', cast(doc_id % 365 as int))",
    "sensitivity": "case when doc_id % 10 = 0 then 'confidential' else 'internal' end",
    "visibility": "case when doc_id % 10 = 0 then 'owner' when doc_id % 3 = 0 then 'shared' else 'owner' end",
    "ticket_ids": "case when doc_id % 50 = doc_id % 7 then array(concat('TKT-', cast(doc_id % 50 as string))) else array(concat('TKT-', cast(doc_id % 50 as string)), concat('TKT-', cast(doc_id % 7 as string))) end",
    "people": "array(concat('Person ', chr(cast(65 + doc_id % 26 as int))))",
    "content_hash": "sha2(text, 256)",
    "prev_hash": "case when doc_id % 11 = 0 then null when doc_id % 13 = 0 then 'changed' else sha2(text, 256) end",
    "note": "concat('Từ: Person ', chr(cast(65 + doc_id % 26 as int)), ' <p@x.io>, Bob Lee (IT)\n[2024-01-02 10:00] Ann Ray: see tkt-', cast(doc_id % 50 as string), ' and RE-', cast(doc_id % 9 as string), ' due ', cast(doc_id % 33 + 1 as string), '/', cast(doc_id % 13 + 1 as string), '/', cast(2024 + doc_id % 3 as string), case when doc_id % 3 = 0 then ' 08:30' else '' end, case when doc_id % 4 = 0 then ' in Q2/2025' else '' end, case when doc_id % 5 = 0 then ' QT.IT.019 go live' else '' end, '\nNguyễn Văn An (PO) **', text, '**')",
    "title": "concat(case doc_id % 4 when 0 then '[QLYC-12] ' when 1 then 'YC-7 – ' else '' end, 'Kế hoạch golive ', text, case when doc_id % 3 = 0 then ' (phase 2)' else '' end)",
    "state": "case doc_id % 9 when 0 then 'Blocked by vendor' when 1 then 'Cancelled' when 2 then 'DONE' when 3 then 'Hoàn thành' when 4 then 'To do' when 5 then 'Kế hoạch' when 6 then 'In review, P1' when 7 then '' else 'trung bình p3' end",
    "remark": "concat(case doc_id % 24 when 0 then 'Blocked by vendor. ' when 1 then 'rủi ro golive ' when 2 then 'Đóng yêu cầu ' when 3 then 'đóng tiếp nhận; ' when 4 then 'Cancelled: ' when 5 then 'on-hold ' when 6 then 'On hold ' when 7 then 'Hoàn thành ' when 8 then 'it is done ' when 9 then 'tồn tại và done ' when 10 then 'Đang thực hiện ' when 11 then 'đang dev ' when 12 then 'dev/sit ' when 13 then 'Ready UAT ' when 14 then 'ready golive ' when 15 then 'đang xử lý ' when 16 then 'in progress ' when 17 then 'Kế hoạch ' when 18 then 'To do ' when 19 then 'chưa cập nhật ' when 20 then 'chưa có ' when 21 then 'Mới mở ' when 22 then 'rủi ro ' else 'chưa ' end, text)",
    "label": "concat(case doc_id % 16 when 0 then '[Done] ' when 1 then '<b>Blocked</b> ' when 2 then 'On hold &amp; ' when 3 then 'cancelled (done) ' when 4 then 'DONE-YC-12 ' when 5 then 'hoàn thành ' when 6 then 'golive plan ' when 7 then 'To do: ' when 8 then 'kế hoạch ' when 9 then 'Mới mở ' when 10 then 'đầu mối highest ' when 11 then 'Nhóm nguồn medium ' when 12 then 'trung bình ' when 13 then 'low ' when 14 then '(đã xong)' else '' end, case when doc_id % 3 = 0 then '' else text end)",
    "question": "concat(case doc_id % 6 when 0 then 'TKT-' when 1 then 'Who phụ trách project ' when 2 then 'timeline of ' when 3 then 'report-v1.pdf ' when 4 then 'QT.IT.009 release ' when 5 then case when doc_id % 12 = 11 then 'what is the fast lane ' else 'what is the ' end end, cast(doc_id % 50 as string), ' ', substring(text, 1, case when doc_id % 2 = 0 then 4 else 60 end))",
}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {n}" for n, e in DOCS.items()))


def _duck(e: str) -> str:
    e = e.replace("sha2(text, 256)", "sha256(text)").replace("array(", "list_value(").replace("as string)", "as varchar)")
    return e.replace("date_add(date '2024-01-01', cast(doc_id % 365 as int))", "date '2024-01-01' + cast(doc_id % 365 as int)")


DOCS_SQL = "SELECT " + ", ".join(f"{_duck(e)} AS {n}" for n, e in DOCS.items()) + " FROM documents"


def with_docs(sql: str) -> str:
    """``sql`` after the docs view as its first common table expression."""
    rest = sql.strip()
    return f"WITH docs AS ({DOCS_SQL})" + (", " + rest[5:] if rest.lower().startswith("with ") else " " + rest)
