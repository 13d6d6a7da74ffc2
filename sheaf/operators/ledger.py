"""Ledgers: what was seen, converted, scanned or changed before, against what is there now. Columns are named by the caller."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def capture_preview(messages: DataFrame, seen: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """(by, total, n_seen, n_new, oldest_seen): how many of each thread's messages a store has already, by their key."""
    known = seen.select(key).distinct().withColumn("_hit", F.lit(True))
    j = messages.join(known, key, "left").withColumn("_seen", F.col("_hit").isNotNull())
    return j.groupBy(by).agg(F.count("*").alias("total"), F.count_if("_seen").alias("n_seen"), F.count_if(~F.col("_seen")).alias("n_new"), F.min_by("_seen", order).alias("oldest_seen"))


def capture_status(bindings: DataFrame, captures: DataFrame, binding: str, rules: list[tuple[Column, Column, Column]], day: str, counted: str) -> DataFrame:
    """(binding, n, latest) of each binding's captures. rules [(which bindings, their key, the captures' key)], each binding by the first that applies."""
    out, left = None, F.lit(True)
    for which, own, other in rules:
        some = bindings.where(left & F.coalesce(which, F.lit(False))).select(binding, own.cast("string").alias("_key"))
        one = some.join(captures.select(other.cast("string").alias("_key"), day, counted), "_key", "left").select(binding, day, counted)
        out = one if out is None else out.unionByName(one)
        left = left & ~F.coalesce(which, F.lit(False))
    return out.groupBy(binding).agg(F.count(counted).alias("n"), F.max(day).alias("latest"))


def cascade(rows: DataFrame, known: DataFrame, target: str, keys: list[tuple[str, str]]) -> DataFrame:
    """rows with ``hit``, the target of the first key that known(target, *keys) has, and ``via``, that key's name, or 'none'. keys [(name in rows, name in known)]."""
    out = rows
    for n, (own, other) in enumerate(keys):
        side = known.where(F.col(other).isNotNull()).groupBy(F.col(other).alias(own)).agg(F.min(target).alias(f"_hit{n}"))
        out = out.join(side, own, "left")
    hits = [F.col(f"_hit{n}") for n in range(len(keys))]
    via = reduce(lambda a, n: F.when(hits[n].isNotNull(), keys[n][0]).otherwise(a), reversed(range(len(keys))), F.lit("none"))
    return out.select(*rows.columns, F.coalesce(*hits).alias("hit"), via.alias("via"))


def upserted(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, action): new values win; 'insert', 'update' or 'keep'. One row a key on either side."""
    o, n = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_is")), new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_comes"))
    j = o.join(n, key, "full_outer")
    return j.select(key, F.when(F.col("_comes"), F.col("_new")).otherwise(F.col("_old")).alias(value), F.when(F.col("_is").isNull(), "insert").when(F.col("_comes").isNull(), "keep").otherwise("update").alias("action"))


def scanned(items: DataFrame, scans: DataFrame, project: str, at: str) -> DataFrame:
    """(project, n, scanned): items of each project that has items or a scan, and its last scan, or 'never'."""
    n = items.groupBy(project).agg(F.count("*").alias("n"))
    last = scans.groupBy(project).agg(F.max(F.col(at).cast("string")).alias("scanned"))
    return n.join(last, project, "full_outer").select(project, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("scanned", F.lit("never")).alias("scanned"))


def convert_ledger(files: DataFrame, ledger: DataFrame, key: str, digest: str, failed: Column, scan: Column) -> DataFrame:
    """(key, status): 'unchanged' where the ledger has the file with this digest, else 'error', 'needs_ocr' or 'converted'."""
    j = files.join(ledger.select(key, F.col(digest).alias("_before")), key, "left")
    status = F.when(F.col("_before") == F.col(digest), "unchanged").when(F.coalesce(failed, F.lit(False)), "error").when(F.coalesce(scan, F.lit(False)), "needs_ocr").otherwise("converted")
    return j.select(key, status.alias("status"))
