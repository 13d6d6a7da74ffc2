"""Registries of converters and lanes, and the union of sources that survives one of them failing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.operators import reports

Convert = Callable[[DataFrame], DataFrame]


class Converters:
    """Converters by file extension: each takes files(path, content) and gives (path, text)."""

    def __init__(self):
        self.known: dict[str, tuple[str, Convert]] = {}

    def register(self, name: str, *extensions: str):
        def add(f: Convert) -> Convert:
            self.known |= {x.lower(): (name, f) for x in extensions}
            return f

        return add

    def convert(self, files: DataFrame) -> DataFrame:
        """(path, text, converter, status): 'ok', 'empty' where a converter finds no text, 'unsupported' where there is no converter.

        Every converter sees its own files alone, and all run in one job.
        """
        ext = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
        out = files.where(~ext.isin(*self.known)).select("path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("converter"), F.lit("unsupported").alias("status"))
        by: dict[str, tuple[Convert, list[str]]] = {}
        for x, (name, f) in self.known.items():
            by.setdefault(name, (f, []))[1].append(x)
        for name, (f, own) in by.items():
            rows = f(files.where(ext.isin(*own)).select("path", "content")).select("path", "text")
            blank = F.coalesce(F.trim("text") == "", F.lit(True))
            out = out.unionByName(rows.select("path", "text", F.lit(name).alias("converter"), F.when(blank, "empty").otherwise("ok").alias("status")))
        return out


def standard_converters() -> Converters:
    """Plain text and markup; formats that need a parser of their own are registered by who has one."""
    known = Converters()
    utf8 = F.make_valid_utf8(F.col("content").cast("string"))
    known.register("text", "md", "txt")(lambda files: files.select("path", utf8.alias("text")))
    known.register("html", "html", "htm")(lambda files: files.select("path", text.strip_tags(utf8).alias("text")))
    return known


class Lanes:
    """Named lanes of a timeline, in the order in which they were registered: each makes rows(date_text, title, body)."""

    def __init__(self):
        self.known: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str):
        return lambda f: self.known.setdefault(name, f)

    def timeline(self, spark: SparkSession, *names: str, since: str | None = None) -> DataFrame:
        """The named lanes (all, if none is named) in date order."""
        unknown = set(names) - set(self.known)
        if unknown:
            raise KeyError(f"no lane {sorted(unknown)}")
        return reports.timeline(*((n, f(spark)) for n, f in self.known.items() if not names or n in names), since=since)


def union_sources(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(rows of all sources that can be read, with ``origin``; why the others can't). A column that one lacks is null there.

    A source is tried by reading its first row, so that a folder that is gone or unreadable is found before the job.
    """
    out, failed = None, {}
    for name, load in sources.items():
        try:
            rows = load()
            rows.limit(1).collect()
        except (PySparkException, OSError, ValueError) as e:
            failed[name] = str(e).split("\n", 1)[0]
            continue
        rows = rows.withColumn("origin", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, failed
