"""Entity graphs as tables: traversal, resolution, validation, near pairs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The cluster's shared folder. A local session, which has one machine, may do with a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sheaf-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, so that rounds do not grow a lineage. The files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Edges of a node above which its edges are dealt over several keys.
HUB = 10_000


def neighbours(edges, frontier: DataFrame) -> DataFrame:
    """(node, salt, n_salts, other, from_id, relation, to_id): the edges at the nodes of frontier(node), in one scan; a hub's edges are dealt over salts.

    ``edges`` is a table, which may repeat edges (what the frontier meets is made distinct, not the table), or an index that gives the edges at some nodes from their buckets (``at``).
    """
    rows = edges if isinstance(edges, DataFrame) else edges.at(frontier)
    ends = F.array(F.struct(F.col("from_id").alias("node"), F.col("to_id").alias("other")), F.struct(F.col("to_id").alias("node"), F.col("from_id").alias("other")))
    both = rows.select("from_id", "relation", "to_id", F.explode(ends).alias("e")).select("e.*", "from_id", "relation", "to_id")
    near = cut(both.join(frontier, "node", "left_semi").distinct())
    hubs = near.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("node", F.ceil(F.col("n") / HUB).cast("int").alias("n_salts"))
    salted = near.join(hubs, "node", "left").withColumn("n_salts", F.coalesce("n_salts", F.lit(1)))
    return salted.withColumn("salt", F.pmod(F.xxhash64("from_id", "relation", "to_id"), F.col("n_salts")).cast("int"))


def k_hop_each(edges, seeds: DataFrame, hops: int) -> DataFrame:
    """seeds(question_id, id) -> (question_id, from_id, relation, to_id, hop): each question's breadth-first search over both directions, all at once.

    ``edges`` is a table of edges, or gives the edges at some nodes (``at(frontier)``, frontier(node)), so that an index is read
    where the search goes alone. A question meets an edge once, at the first hop. What a layer's nodes are joined to lies in the
    layer before, the same, or the next, so two layers a question are all that is remembered.
    """
    key = ["question_id", "node"]
    front = cut(seeds.select("question_id", F.col("id").alias("node")).distinct())
    before, found = front.limit(0), None
    for hop in range(1, hops + 1):
        near = neighbours(edges, cut(front.select("node").distinct()))
        hubs = near.where("n_salts > 1").select("node", "n_salts").distinct()
        asked = front.join(hubs, "node", "left").select(*key, F.explode(F.sequence(F.lit(0), F.coalesce("n_salts", F.lit(1)) - 1)).alias("salt"))
        met = asked.join(near, ["node", "salt"])
        old = before.select("question_id", F.col("node").alias("other"))
        new = cut(met.join(old, ["question_id", "other"], "left_anti").select("question_id", "from_id", "relation", "to_id", "other").distinct())
        edges_now = new.select("question_id", "from_id", "relation", "to_id", F.lit(hop).alias("hop")).distinct()
        found = edges_now if found is None else found.unionByName(edges_now)
        if hop == hops:
            break
        ahead = cut(new.select("question_id", F.col("other").alias("node")).distinct().join(front, key, "left_anti"))
        before, front = front, ahead
        if not front.limit(1).count():
            break
    return found


def k_hop(edges, seeds: DataFrame, hops: int) -> DataFrame:
    """seeds(id) -> (from_id, relation, to_id, hop): each edge once, at the hop at which breadth-first search over both directions meets it."""
    return k_hop_each(edges, seeds.select(F.lit(0).alias("question_id"), "id"), hops).drop("question_id")


def seed_entities(edges: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Targets of MENTIONS edges of the chunks."""
    return edges.where("relation = 'MENTIONS'").join(chunk_ids.select(F.col("chunk_id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()


def resolve_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations(chunk_id, from_name, relation, to_name) with node ids of entities(chunk_id, name, node_id, type); rows without both ends go."""
    end = lambda side: entities.select("chunk_id", F.col("name").alias(f"{side}_name"), F.col("node_id").alias(f"{side}_id"), F.col("type").alias(f"{side}_type"))
    return relations.join(end("from"), ["chunk_id", "from_name"]).join(end("to"), ["chunk_id", "to_name"])


def validated(relations: DataFrame, ontology: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) by ontology(relation, from_type, to_type), a small configuration table.

    It goes to all tasks: dealt by its few keys, all relations of a kind would meet in one.
    """
    on, ontology = ["relation", "from_type", "to_type"], F.broadcast(ontology)
    return relations.join(ontology, on, "left_semi"), relations.join(ontology, on, "left_anti")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): edges in both builds, or in one."""
    key = ["from_id", "relation", "to_id"]
    both = a.select(*key).distinct().withColumn("a", F.lit(1)).join(b.select(*key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    return both.groupBy(F.when(F.col("b").isNull(), "first").when(F.col("a").isNull(), "second").otherwise("both").alias("side")).agg(F.count("*").alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges(a, b): smallest label over each connected component.

    Each round gives a node to that one of itself and its neighbours whose hash is least, and keeps the edges between what nodes were given to, without
    loops and repeats. A round has its own hash, so what is left shrinks by a part of it whatever the edges look like, long chains as well, and all rounds
    together cost a few times the first. Then the nodes are led back, last round first, and the smallest node of a component names it.
    Edges with a null end are left out.
    """
    at = cut(edges.select("a", "b").where("a is not null and b is not null"))
    rounds = []
    while not rounds or at.limit(1).count():
        order = lambda x, seed=len(rounds): F.xxhash64(F.col(x), F.lit(seed))
        near = at.union(at.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min_by("b", order("b")).alias("near"))
        lead = cut(near.select("node", F.when(order("node") <= order("near"), F.col("node")).otherwise(F.col("near")).alias("lead")))
        rounds.append(lead)
        to = lambda x, lead=lead: lead.select(F.col("node").alias(x), F.col("lead").alias(f"{x}_lead"))
        left = at.where("a <> b").join(to("a"), "a").select("a_lead", "b").join(to("b"), "b").where("a_lead <> b_lead")
        at = cut(left.select(F.least("a_lead", "b_lead").alias("a"), F.greatest("a_lead", "b_lead").alias("b")).distinct())
    labels = rounds.pop().withColumnRenamed("lead", "root")
    while rounds:
        labels = rounds.pop().join(labels.select(F.col("node").alias("lead"), "root"), "lead", "left").select("node", F.coalesce("root", "lead").alias("root"))
    labels = cut(labels)
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))


def resolve_entities(mentions: DataFrame) -> DataFrame:
    """(mention_id, node_id): mentions(mention_id, type, aliases) of one type that share an alias, transitively, are one node."""
    names = mentions.select("mention_id", "type", F.explode("aliases").alias("alias")).select("mention_id", F.concat_ws(":", "type", "alias").alias("name"))
    hub = names.groupBy("name").agg(F.min("mention_id").alias("b"))
    linked = components(names.join(hub, "name").select(F.col("mention_id").alias("a"), "b").union(mentions.select("mention_id", "mention_id")))
    return linked.select(F.col("node").alias("mention_id"), F.col("root").alias("node_id"))


#: Vectors of a block, pivots at most, and vectors that pivots are chosen from.
UNIT, PIVOTS, SAMPLE = 4096, 1024, 20_000
#: Coordinates of the first look at a pair.
PREFIX = 16


def near_pairs(vectors: DataFrame, least: float, compared=None) -> DataFrame:
    """(a, b, cosine) of vectors(vec_id, embedding) at ``least`` cosine or more, a < b, between the classes of equal directions. None is missed.

    A class is named by its smallest id; its other members are given with it alone, at cosine 1, so a direction that many
    vectors have never makes all their pairs. Zero vectors have no direction and take no part.

    Directions belong to the cell of their nearest pivot; cells are dealt, in order, to blocks of about UNIT directions, each one row. Blocks meet
    in a cross join of what was written, so each is shuffled once, however many it meets, and those whose pivots lie too far apart for
    any pair do not meet. Of a pair of blocks, a direction is compared with the cells that the triangle inequality leaves open - it lies
    within the cell's radius and the threshold's angle of the pivot, and no more than twice that angle farther than its own - first by
    PREFIX coordinates and the length of the rest. So work shrinks where the vectors cluster; for directions spread evenly in many
    dimensions no bound helps and it is all pairs, in blocks.
    ``compared``: an accumulator that counts the pairs that had to be compared whole.
    """
    import numpy as np
    import pyarrow as pa

    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    rows = vectors.withColumn("norm", norm).where("norm > 0").select("vec_id", F.transform("embedding", lambda v: v.cast("double") / F.col("norm")).alias("way"))
    members = cut(rows)
    classes = cut(members.groupBy("way").agg(F.min("vec_id").alias("vec_id")))
    n = classes.count()
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(min(1.0, SAMPLE / max(1, n)) * 1_000_000)
    sample = np.array([r.way for r in classes.where(draw).select("way").limit(2 * SAMPLE).collect()])
    k = max(1, min(PIVOTS, n // 256, len(sample)))
    pivots = sample[np.random.default_rng(3).choice(len(sample), k, replace=False)] if len(sample) else np.zeros((1, 1))
    reach = float(np.arccos(np.clip(least - 1e-6, -1, 1))) + 1e-7
    turned = lambda x, y: np.arccos(np.clip(x @ y.T, -1, 1))
    ways = lambda b: b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)

    def homes(batches):
        for b in batches:
            if b.num_rows:
                far = turned(ways(b), pivots)
                own = far.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int64()), pa.array(far[np.arange(len(own)), own])], names=["way", "vec_id", "cell", "far"])

    placed = cut(classes.select("way", F.col("vec_id").cast("long").alias("vec_id")).mapInArrow(homes, "way array<double>, vec_id long, cell long, far double"))
    radius, group, first, units = np.zeros(k), np.zeros(k, np.int64), np.zeros(k, np.int64), np.ones(k, np.int64)
    room, n_groups, n_blocks = 0, 0, 0
    for r in placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).orderBy("cell").collect():  # PIVOTS rows
        if r.n > room:  # a block of its own or, for a large cell, some
            units[r.cell], room = -(-r.n // UNIT), UNIT if r.n <= UNIT else 0
            n_groups, n_blocks = n_groups + 1, n_blocks + int(units[r.cell])
        radius[r.cell], group[r.cell], first[r.cell], room = r.radius, n_groups - 1, n_blocks - units[r.cell], max(0, room - r.n)
    apart = turned(pivots, pivots)
    open_ = (apart <= radius[:, None] + radius + reach + 1e-7) & (apart <= 2 * radius[:, None] + 2 * reach + 1e-7) | np.eye(k, dtype=bool)

    def dealt(batches):
        for b in batches:
            cell, ids = b.column(2).to_numpy(), b.column(1).to_numpy()
            mine = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first[cell] + mine % units[cell])], names=[*b.schema.names, "block"])

    packed_row = pa.schema([("block", pa.int64()), ("grp", pa.int64()), ("meets", pa.list_(pa.int64())), ("ids", pa.binary()), ("cells", pa.binary()), ("fars", pa.binary()), ("ways", pa.binary())])

    def packed(t):
        b = t.sort_by([("cell", "ascending"), ("vec_id", "ascending")]).combine_chunks().to_batches()[0]
        cell = b.column(2).to_numpy()
        meets = np.unique(group[open_[np.unique(cell)].any(0)])
        out = [b.column("block")[0].as_py(), int(group[cell[0]]), meets[meets <= group[cell[0]]].tolist(), *(x.tobytes() for x in (b.column(1).to_numpy(), cell, b.column(3).to_numpy(), ways(b)))]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(out, packed_row, strict=True)], schema=packed_row)

    pair = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])

    def met(batches):
        def near(x, y, same):
            """Pairs of a row of y and a row of x; ``same``: both are one block."""
            own_cells, slot = np.unique(x["cells"], return_inverse=True)
            for s in range(0, len(y["ids"]), 512):
                ids, cell, far, way = (y[c][s : s + 512] for c in ("ids", "cells", "fars", "ways"))
                to = turned(way, pivots[own_cells])
                meets = (cell[:, None] > own_cells) & (to <= radius[own_cells] + reach) & (to <= far[:, None] + 2 * reach) | (cell[:, None] == own_cells)
                at = np.flatnonzero(meets.any(0)[slot])
                some = x["ways"][at]
                looked = way[:, :PREFIX] @ some[:, :PREFIX].T + np.outer(np.sqrt(np.maximum(1 - (way[:, :PREFIX] ** 2).sum(1), 0)), np.sqrt(np.maximum(1 - (some[:, :PREFIX] ** 2).sum(1), 0)))
                hope = looked >= least - 1e-6
                if not meets.all():
                    hope &= meets[:, slot[at]]
                if same:
                    hope &= (cell[:, None] != x["cells"][at]) | (ids[:, None] > x["ids"][at])
                i, j = np.nonzero(hope)
                if compared is not None:
                    compared.add(len(i))
                cosine = (way @ some.T)[i, j] if len(i) > hope.size // 8 else (way[i] * some[j]).sum(1)
                hit = cosine >= least - 1e-6
                a, b = ids[i[hit]], x["ids"][at][j[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cosine[hit])], schema=pair)

        kinds = {"ids": np.int64, "cells": np.int64, "fars": np.float64, "ways": np.float64}
        for b in batches:
            for n in range(b.num_rows):
                x, y = ({c: np.frombuffer(b.column(f"{side}_{c}")[n].as_buffer(), t) for c, t in kinds.items()} for side in "xy")
                for z in (x, y):
                    z["ways"] = z["ways"].reshape(len(z["ids"]), -1)
                yield from near(x, y, b.column("x_block")[n] == b.column("y_block")[n])

    blocks = placed.mapInArrow(dealt, "way array<double>, vec_id long, cell long, far double, block long").groupBy("block").applyInArrow(packed, "block long, grp long, meets array<long>, ids binary, cells binary, fars binary, ways binary")
    blocks = cut(blocks)
    x, y = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in blocks.columns)) for side in "xy")
    both = y.join(x, F.expr("x_block <= y_block and array_contains(y_meets, x_grp)")).select(*(f"{side}_{c}" for side in "xy" for c in ("block", "ids", "cells", "fars", "ways")))
    near = both.mapInArrow(met, "a long, b long, cosine double").withColumn("cosine", F.round("cosine", 6)).where(F.col("cosine") >= least)
    same = members.join(classes.withColumnRenamed("vec_id", "a"), "way").where("vec_id > a").select("a", F.col("vec_id").alias("b"), F.lit(1.0).alias("cosine"))
    return near.unionByName(same)
