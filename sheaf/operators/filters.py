"""Predicates and filters that stay declarative, so that they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def readable(rows: DataFrame, guest: bool) -> DataFrame:
    """A guest sees shared rows alone. Applied before any ranking."""
    return rows.where(F.col("visibility") == "shared") if guest else rows


def facets(rows: DataFrame, scalars: dict[str, str], members: dict[str, str], since: str | None = None, until: str | None = None, date: str = "doc_date") -> DataFrame:
    """Case-insensitive equality on scalars, membership in arrays, an inclusive date range that null dates pass."""
    for name, want in scalars.items():
        rows = rows.where(F.lower(name) == want.lower())
    for name, want in members.items():
        rows = rows.where(F.array_contains(F.transform(name, F.lower), want.lower()))
    if since:
        rows = rows.where(F.col(date).isNull() | (F.col(date) >= F.lit(since).cast("date")))
    if until:
        rows = rows.where(F.col(date).isNull() | (F.col(date) <= F.lit(until).cast("date")))
    return rows


def all_terms(hay: Column, query: str) -> Column:
    """Every word of the query is a part of the text."""
    out = F.lit(True)
    for w in query.lower().split():
        out = out & F.lower(hay).contains(w)
    return out


def pruned_path(path: Column, folders: tuple[str, ...]) -> Column:
    """A parent folder is listed, hidden or ends in .egg-info."""
    parents = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.exists(parents, lambda s: s.isin(*folders) | s.startswith(".") | s.endswith(".egg-info"))


def name_fragment(name: Column) -> Column:
    return name.startswith("(") | (name.contains(")") & ~name.contains("("))


def leaks(rows: DataFrame, patterns: dict[str, str], allowed: DataFrame, most: int) -> DataFrame:
    """(doc_id, rule): texts that match a pattern and are not allowed, and texts over the size limit."""
    rules = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in patterns.items())))
    hits = rows.select("doc_id", F.explode(rules).alias("rule")).join(allowed, "doc_id", "left_anti")
    return hits.unionByName(rows.where(F.length("text") > most).select("doc_id", F.lit("size").alias("rule")))


def recent(rows: DataFrame, today: str, days: int, always: Column, date: str = "doc_date") -> DataFrame:
    return rows.where(always | (F.col(date) >= F.date_sub(F.lit(today).cast("date"), days)))


def present(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """wanted(path) that is listed as a file, or is a folder with a note under it (an equality on every parent)."""
    parts = F.split("path", "/")
    places = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return wanted.join(listing.select(F.explode(places).alias("path")).distinct(), "path", "left_semi")
