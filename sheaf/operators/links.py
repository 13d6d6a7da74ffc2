"""Link reports over labelled documents: facets, maps by a key, backlinks, one anchor's detail, related documents. Columns are named by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.operators import ranking

# Points of a related document: same project, a shared ticket each, a shared person each (up to a number), same channel, same month.
RELATED = {"project": 3, "ticket": 4, "person": 2, "person_most": 3, "channel": 1, "month": 1}


def facet_counts(docs: DataFrame, facets: dict[str, str], most: int = 20) -> DataFrame:
    """(facet, value, n): the most frequent values of each facet's column, single or array; ties by value. One pass over the documents."""
    many = lambda name: isinstance(docs.schema[name].dataType, T.ArrayType)
    of = lambda facet, name: F.transform(F.col(name) if many(name) else F.array(name), lambda v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("value")))
    pairs = docs.select(F.explode(F.concat(*(of(facet, name) for facet, name in facets.items()))).alias("p")).select("p.*").where("value is not null")
    return ranking.top(pairs.groupBy("facet", "value").agg(F.count("*").alias("n")), ["facet"], most, F.col("n").desc(), F.col("value")).select("facet", "value", "n")


def _values(name: str) -> Column:
    return F.sort_array(F.collect_set(name))


def link_map(docs: DataFrame, key: str | Column, project: str = "project", channel: str = "source_channel", kind: str = "doc_type", day: str = "doc_date", counted: str = "backlog") -> DataFrame:
    """(key, n_docs, projects, channels, n_types, n_backlog, latest) by a column or expression; of an array column by each of its values."""
    key = F.col(key) if isinstance(key, str) else key
    rows = docs.withColumn("_key", key)
    if isinstance(rows.schema["_key"].dataType, T.ArrayType):
        rows = rows.withColumn("_key", F.explode("_key"))
    return rows.groupBy(F.col("_key").alias("key")).agg(
        F.count("*").alias("n_docs"), _values(project).alias("projects"), _values(channel).alias("channels"), F.count_distinct(kind).alias("n_types"), F.count_if(F.col(kind) == counted).alias("n_backlog"), F.max(day).alias("latest")
    )


def link_totals(docs: DataFrame, project: str = "project", channel: str = "source_channel", day: str = "doc_date") -> DataFrame:
    return docs.agg(F.count_distinct(project).alias("projects"), F.count_distinct(channel).alias("channels"), F.count_distinct(F.date_format(day, "yyyy-MM")).alias("months"), F.count("*").alias("documents"))


def backlinks(docs: DataFrame, links: str, most: int = 8) -> DataFrame:
    """(link, hits): what some documents link to most often; ties by name."""
    return docs.select(F.explode(links).alias("link")).groupBy("link").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "link").limit(most)


def anchor_detail(docs: DataFrame, links: str, value: str, project: str = "project", people: str = "people", day: str = "doc_date") -> DataFrame:
    """(n_docs, projects, people, latest) of the documents that link to a value."""
    return docs.where(F.array_contains(links, value)).agg(F.count("*").alias("n_docs"), _values(project).alias("projects"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(people)))).alias("people"), F.max(day).alias("latest"))


def related(docs: DataFrame, key: str, value, most: int = 12, project: str = "project", tickets: str = "ticket_ids", people: str = "people", channel: str = "source_channel", day: str = "doc_date", path: str = "rel_path") -> DataFrame:
    """(key, score) of the documents that share most with one of them (RELATED); ties by day and path. One row is looked up, then one pass."""
    own = docs.where(F.col(key) == value).select(project, tickets, people, channel, F.date_format(day, "yyyy-MM").alias("month")).first()
    if own is None:
        return docs.select(key, F.lit(0).alias("score")).limit(0)
    p = RELATED
    shared = lambda name, values: F.size(F.array_intersect(F.coalesce(F.col(name), F.array().cast("array<string>")), F.array(*map(F.lit, values)).cast("array<string>")))
    same = lambda e, v, n: F.when(e == F.lit(v), n).otherwise(0)
    score = same(F.col(project), own[0], p["project"]) + p["ticket"] * shared(tickets, own[1] or []) + p["person"] * F.least(shared(people, own[2] or []), F.lit(p["person_most"])) + same(F.col(channel), own[3], p["channel"]) + same(F.date_format(day, "yyyy-MM"), own[4], p["month"])
    return docs.where(F.col(key) != value).withColumn("score", score).where("score > 0").orderBy(F.desc("score"), day, path).limit(most).select(key, "score")
