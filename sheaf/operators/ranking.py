"""Ranked lists: first occurrences, fusion, diversification, budgets, quotas, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(rows: DataFrame, by: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def clamp(n, low: int = 1, high: int = 100, default: int = 20):
    """A user's limit within bounds; a column of limits or one number, the default where there is none."""
    if isinstance(n, Column):
        return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(n, F.lit(default))))
    return max(low, min(default if n is None else n, high))


def first_occurrence(rows: DataFrame, by: list[str], key: str, k: int, *order: Column) -> DataFrame:
    """Each key once, where it stands first, and the first k of those."""
    once = rows.withColumn("_first", F.row_number().over(Window.partitionBy(*by, key).orderBy(*order))).where("_first = 1").drop("_first")
    return top(once, by, k, *order)


def fuse(lists: DataFrame, k: int, base: float = 10.0) -> DataFrame:
    """Weighted reciprocal-rank fusion of lists(question_id, list_no, weight, rank, chunk_id); ties by who was seen first."""
    scored = lists.groupBy("question_id", "chunk_id").agg(F.sum(F.col("weight") / (F.lit(base) + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    return top(scored, ["question_id"], k, F.round("score", 9).desc(), F.col("seen")).drop("seen")


def graph_budget(primary: DataFrame, extras: DataFrame) -> DataFrame:
    """primary(question_id, rank, chunk_id) with room for graph chunks: extras not already there get min(#extras, max(1, n // 2)) places."""
    n = primary.groupBy("question_id").agg(F.count("*").alias("n"))
    new = extras.join(primary.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    new = new.withColumn("r", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "chunk_id"))).join(n, "question_id")
    taken = new.where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 2)))
    cap = taken.groupBy("question_id").agg(F.count("*").alias("g"))
    kept = primary.join(n, "question_id").join(cap, "question_id", "left").where(F.col("rank") <= F.col("n") - F.coalesce("g", F.lit(0)))
    return kept.select("question_id", "chunk_id", F.col("rank").alias("place"), F.lit("list").alias("via")).unionByName(
        taken.join(cap, "question_id").select("question_id", "chunk_id", (F.col("n") - F.col("g") + F.col("r")).cast("int").alias("place"), F.lit("graph").alias("via"))
    )


def diversify(rows: DataFrame) -> DataFrame:
    """rows(question_id, rank, source_path): round-robin over sources in the order in which they are first seen; new order in ``place``."""
    own = Window.partitionBy("question_id", "source_path")
    r = rows.withColumn("round", F.row_number().over(own.orderBy("rank"))).withColumn("seen", F.min("rank").over(own))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("round", "seen"))).drop("round", "seen")


def budget_stop(rows: DataFrame, by: list[str], size: str, order: str, budget: int) -> DataFrame:
    """Rows in order until the first that does not fit; that one and all after it are left out."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def budget_skip(rows: DataFrame, by: str, size: str, order: str, budget: int, always: Column | None = None) -> DataFrame:
    """Rows in order, skipping those that do not fit; smaller ones after them may. Rows that are ``always`` kept take up budget first, even beyond it.

    A group is a sorted run over ranges, of any number of tasks, and what it has used is handed from range to range: each
    wave takes every group one range on, past ranges whose smallest row no longer fits. So a group of ordinary size takes one wave, and no
    task holds more of a group than its range. Orders (distinct in a group) and sizes alone travel; null sizes count as 0.
    """
    import numpy as np
    import pyarrow as pa

    from sheaf.operators.graph import cut

    keep = F.lit(False) if always is None else F.coalesce(always, F.lit(False))
    spent = rows.groupBy(by).agg(F.coalesce(F.sum(F.when(keep, F.col(size))), F.lit(0)).cast("long").alias("_used"))
    rest = rows.where(~keep).select(by, order, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    rest = cut(rest.repartitionByRange(by, order).sortWithinPartitions(by, order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    ranges = cut(rest.groupBy(by, "_part").agg(F.min("_size").alias("_least")))
    kind = rows.schema[by].dataType.simpleString()

    def fold(group: pa.Table) -> pa.Table:
        t = group.sort_by("_at")
        used, kept = int(t.column("_used")[0].as_py()), []
        for at, s in zip(t.column("_at").to_pylist(), t.column("_size").to_pylist(), strict=True):
            if used + s <= budget:
                used += s
                kept.append(at)
        n = len(kept)
        return pa.table({"g": t.column("_g").take(pa.array(np.zeros(n + 1, int))), "part": pa.array([t.column("_part")[0].as_py()] * (n + 1), pa.int32()), "at": pa.array([*kept, None], pa.int64()), "used": pa.array([None] * n + [used], pa.int64())})

    next_range = lambda todo: todo.join(ranges, by).where((F.col("_part") > F.col("_last")) & (F.col("_least") <= budget - F.col("_used"))).groupBy(by, "_used").agg(F.min("_part").alias("_part"))
    todo, taken = cut(next_range(spent.withColumn("_last", F.lit(-1)))), None
    while todo.limit(1).count():
        some = rest.join(todo, [by, "_part"]).select(F.col(by).alias("_g"), "_part", "_at", "_size", "_used")
        wave = cut(some.groupBy("_g", "_part").applyInArrow(fold, f"g {kind}, part int, at long, used long"))
        one = wave.where("at is not null").select("at")
        taken = one if taken is None else taken.unionByName(one)
        todo = cut(next_range(wave.where("at is null").select(F.col("g").alias(by), F.col("used").alias("_used"), F.col("part").alias("_last"))))
    first = rows.where(keep)
    if taken is None:
        return first
    kept = rest.join(taken.withColumnRenamed("at", "_at"), "_at").select(by, order)
    return first.unionByName(rows.where(~keep).join(kept, [by, order], "left_semi").select(rows.columns))


def quota(rows: DataFrame, by: list[str], group: str, limit: int, *order: Column) -> DataFrame:
    """At most max(2, limit // groups) rows of each group, then the limit."""
    groups = rows.groupBy(*by).agg(F.greatest(F.lit(2), F.floor(F.lit(limit) / F.count_distinct(group))).alias("most"))
    some = rows.join(groups, by).withColumn("_r", F.row_number().over(Window.partitionBy(*by, group).orderBy(*order))).where("_r <= most").drop("_r", "most")
    return top(some, by, limit, *order)


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in the order. An aggregate, so that a hot key is combined before it is shuffled."""
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("r")).select(*key, "r.*")


def numbered(rows: DataFrame, order: Column, name: str = "number") -> DataFrame:
    """Rows numbered from 1 in one order (of distinct values), without one task for all: ranges are counted, then numbered apart."""
    from sheaf.operators.graph import cut

    part = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    counts = part.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return part.withColumn("_at", at).join(before, "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")
