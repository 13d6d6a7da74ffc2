"""Scans of note and code trees, frontmatter, and note sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.filters import pruned_path


def note_folders(spark: SparkSession, root: str) -> list[str]:
    """The root, and every folder under it whose name starts with an underscore: those a recursive scan passes over."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs, todo, found = hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration()), [root], [root]
    while todo:
        for s in fs.listStatus(hadoop(todo.pop())):
            if s.isDirectory() and not s.getPath().getName().startswith("."):
                path = s.getPath().toString()
                todo.append(path)
                found += [path] if s.getPath().getName().startswith("_") else []
    return found


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, modified, raw): every *.md under the root but README.md; blank files are left out."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(note_folders(spark, root), wholetext=True)
    path = F.regexp_replace("_metadata.file_path", "^.*?" + root.removeprefix("file:").rstrip("/") + "/", "")
    rows = raw.select(path.alias("rel_path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("raw"))
    return rows.where((F.element_at(F.split("rel_path", "/"), -1) != "README.md") & F.col("raw").rlike("\\S"))


def frontmatter(raw: Column) -> tuple[Column, Column, Column]:
    """(map of its keys, body, lines before the body); no or broken frontmatter: an empty map and the whole text."""
    parts = F.split(raw, "---", 3)
    has = raw.startswith("---") & (F.size(parts) == 3)
    lines = F.regexp_extract_all(parts[1], F.lit("(?m)^([A-Za-z_][A-Za-z0-9_]*): *(.*?) *$"), F.lit(1))
    values = F.transform(F.regexp_extract_all(parts[1], F.lit("(?m)^([A-Za-z_][A-Za-z0-9_]*): *(.*?) *$"), F.lit(2)), lambda v: F.regexp_replace(v, "^['\"]|['\"]$", ""))
    pairs = F.map_from_entries(F.transform(F.array_distinct(lines), lambda k: F.struct(k, F.element_at(values, F.array_position(lines, k).cast("int")))))
    body = F.when(has, F.regexp_replace(parts[2], "^\\n", "")).otherwise(raw)
    before = F.when(has, F.size(F.split(parts[1], "\n"))).otherwise(0)
    return F.when(has, pairs).otherwise(F.expr("cast(map() as map<string,string>)")), body, before


def documents(notes: DataFrame, tenant: str) -> DataFrame:
    """Notes as documents with ids, hashes and labels; blank bodies are left out."""
    meta, body, before = frontmatter(F.col("raw"))
    m = notes.withColumns({"meta": meta, "text": body, "lines_before": before}).where(F.col("text").rlike("\\S"))
    get = lambda k: F.try_element_at("meta", F.lit(k))
    date = F.coalesce(get("date"), F.substring(get("converted_at"), 1, 10), F.date_format("modified", "yyyy-MM-dd"))
    return m.select(
        F.substring(F.sha1(F.concat(F.lit(f"{tenant}:"), "rel_path")), 1, 16).alias("doc_id"), "rel_path", "meta", "text", "lines_before", date.alias("date"), F.try_to_date(date).alias("doc_date"),
        F.sha2("text", 256).alias("content_hash"), F.sha2(F.to_json("meta"), 256).alias("meta_hash"), get("project").alias("project"), get("source").alias("source"), F.coalesce(get("sensitivity"), F.lit("internal")).alias("sensitivity"),
    )


def read_code(spark: SparkSession, root: str, folders: tuple[str, ...] = ("node_modules", "__pycache__", "venv", "build", "dist")) -> DataFrame:
    """(rel_path, text) of every *.py under the root outside pruned folders; files that vanish meanwhile are skipped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").option("ignoreMissingFiles", True).load(root)
    path = F.regexp_replace("path", "^.*?" + root.removeprefix("file:").rstrip("/") + "/", "")
    rows = raw.select(path.alias("rel_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return rows.where(~pruned_path(F.col("rel_path"), folders))


def code_sections(files: DataFrame) -> DataFrame:
    """files(rel_path, text) -> (rel_path, name, start_line, end_line, body): module head, functions, class heads, methods; a file that does not parse is one section."""
    import ast

    schema = pa.schema([("rel_path", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("body", pa.string())])

    def cuts(source: str) -> list[tuple[str, int, int]]:
        n = max(1, len(source.splitlines()))
        try:
            top = ast.parse(source).body
        except (SyntaxError, ValueError):
            return [("file", 1, n)]
        first = lambda x: min([x.lineno, *(d.lineno for d in x.decorator_list)])
        kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
        found = []
        for node in (x for x in top if isinstance(x, (*kinds, ast.ClassDef))):
            methods = [m for m in node.body if isinstance(m, kinds)] if isinstance(node, ast.ClassDef) else []
            found.append((node.name, first(node), first(methods[0]) - 1 if methods else node.end_lineno))
            found += [(f"{node.name}.{m.name}", first(m), m.end_lineno) for m in methods]
        head = (found[0][1] if found else n + 1) - 1
        return ([("module", 1, head)] if head >= 1 else []) + found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = (source or "").splitlines()
                rows += [(path, name, a, z, body) for name, a, z in cuts(source or "") if (body := "\n".join(lines[a - 1 : z])).strip()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema, strict=True)], schema=schema)

    return files.select("rel_path", "text").mapInArrow(run, "rel_path string, name string, start_line int, end_line int, body string")


def note_text(title: Column, status: Column, priority: Column, date: Column, body: Column, item_id: Column) -> Column:
    """A record as a Markdown note with frontmatter."""
    head = F.concat(F.lit("---\nsource: backlog\ndate: "), date, F.lit("\nbacklog_item_id: "), item_id, F.lit("\nstatus: "), status, F.lit("\npriority: "), priority, F.lit("\n---\n"))
    return F.concat(head, F.lit("## "), title, F.lit("\n\n**"), status, F.lit("** "), body, F.lit("\n"))


def write_notes(records: DataFrame, folder: str) -> None:
    """One folder a record, its note inside; a full snapshot, so that deleted records go."""
    note = note_text(*(F.col(c).cast("string") for c in ("title", "status", "priority", "date", "body", "item_id")))
    records.select("item_id", note.alias("value")).write.mode("overwrite").partitionBy("item_id").text(folder)
