"""Tables that grow by document: chunks and graph, in buckets of immutable files, with state and history."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from sheaf.operators import graph, ranking, retrieval

from sheaf.operators.chunking import chunk_key, chunks
from sheaf.operators.joins import changed, deleted

#: Buckets of a table by the hash of its key, and parts that a bucket is written in at once.
BUCKETS, SPREAD = 64, 4
#: Letters of text for which an index whose number of buckets is left open has a bucket, and its least number.
LETTERS, LEAST = 8_000_000, 8


def build_plan(docs: DataFrame, state: DataFrame, old: DataFrame, size: int = 2048, overlap: int = 256) -> tuple[DataFrame, DataFrame]:
    """(chunks, state) after a build: chunks of changed documents anew, of deleted ones gone, of the rest as they were.

    docs(doc_id, text, content_hash, meta_hash, ...); a changed label alone carries no re-chunking. A document that no
    longer has chunks loses its old ones.
    """
    new = changed(docs, state)
    gone = new.select("doc_id").unionByName(deleted(docs, state).select("doc_id"))
    kept = old.join(gone, "doc_id", "left_anti")
    return kept.unionByName(chunks(new, size, overlap)), docs.select("doc_id", "content_hash", "meta_hash")


class Embedder(Protocol):
    """What gives rows their ``embedding``: a column of array<float> of ``size`` numbers over the text column."""

    size: int

    def attach(self, rows: DataFrame, text: str) -> DataFrame: ...


class HashedTerms:
    """Hashed term counts of unit length: the offline stand-in for a model's vectors."""

    def __init__(self, size: int = 256):
        self.size = size

    def attach(self, rows: DataFrame, text: str) -> DataFrame:
        from pyspark.ml.feature import HashingTF, Normalizer
        from pyspark.ml.functions import vector_to_array

        words = rows.withColumn("_w", F.split(F.lower(text), "[^0-9a-zà-ỹđ]+"))
        unit = Normalizer(inputCol="_t", outputCol="_u").transform(HashingTF(inputCol="_w", outputCol="_t", numFeatures=self.size).transform(words))
        return unit.withColumn("embedding", vector_to_array("_u", "float32")).drop("_w", "_t", "_u")


class ExecutorModel:
    """An embedder whose model lives on the executors: ``load()`` gives a function from a list of texts to their vectors.

    A worker process loads the model once and keeps it for all its tasks. Texts go to it in batches of at most ``most`` bytes (a longer
    text alone); where a batch fails its texts are tried one by one, and a text that fails has a null vector, as has a null text.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], list]], size: int, most: int = 1 << 20):
        self.load, self.size, self.most, self.name = load, size, most, uuid.uuid4().hex

    def attach(self, rows: DataFrame, text: str) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
        at, load, size, most, name = rows.columns.index(text), self.load, self.size, self.most, self.name

        def model():
            import sys
            import types

            # a module of the process outlives the task, whose own functions are made anew
            kept = sys.modules.setdefault("_models_of_this_worker", types.ModuleType("_models_of_this_worker"))
            if not hasattr(kept, name):
                setattr(kept, name, load())
            return getattr(kept, name)

        def embedded(texts: list[str]) -> list:
            try:
                out = [None if v is None else [float(x) for x in v] for v in model()(texts)]
                if len(out) != len(texts) or any(v is not None and len(v) != size for v in out):
                    raise ValueError("a model must give one vector of its size for each text")
                return out
            except Exception:
                return [None] if len(texts) == 1 else [v for x in texts for v in embedded([x])]

        def run(batches):
            for b in batches:
                values, out, part, held = b.column(at).to_pylist(), [None] * b.num_rows, [], 0
                for n, x in [*enumerate(values), (None, None)]:
                    length = len(x.encode()) if x is not None else 0
                    if part and (n is None or held + length > most):
                        for i, v in zip(part, embedded([values[i] for i in part]), strict=True):
                            out[i] = v
                        part, held = [], 0
                    if x is not None:
                        part.append(n)
                        held += length
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

        return rows.mapInArrow(run, schema)


def attach_vectors(rows: DataFrame, embedder: Embedder | int = 256, text: str = "chunk") -> DataFrame:
    """rows with ``embedding``, by an embedder or by hashed terms of a size."""
    return (HashedTerms(embedder) if isinstance(embedder, int) else embedder).attach(rows, text)


class Buckets:
    """Tables under a folder, each cut into buckets by the hash of a key, each bucket a folder of files that never change.

    A numbered pointer file names the folder of every bucket of every table. A write makes new folders for the buckets
    that it touches, then a pointer: a reader sees the tables before or after it, and buckets that it does not touch
    are neither read nor written. Of two writers at once the second fails, as its pointer is there already.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.buckets = spark, folder, keys, buckets
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._seen = "", ""

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def current(self) -> tuple[int, dict]:
        """(number, {table: {"schema", "at": {bucket: folder}}}) of the newest pointer."""
        if not self._fs.exists(self._path("")):
            return 0, {}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")) if s.getPath().getName().startswith("pointer-"))
        if not names:
            return 0, {}
        if names[-1] != self._seen[0]:  # pointers never change
            source = self._fs.open(self._path(names[-1]))
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
            source.close()
            self._seen = names[-1], text
        return int(names[-1].split("-")[1]), json.loads(self._seen[1])

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """All rows of a table, or those of some buckets; None before the first write."""
        known = self.current()[1].get(table)
        if known is None:
            return None
        schema = T.StructType.fromJson(known["schema"])
        paths = [f"{self.folder}/{at}/{table}/_bucket={b}" for b, at in sorted(known["at"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, keys: DataFrame, column: str) -> list[int]:
        """The buckets that some keys are in: at most ``buckets`` numbers."""
        return sorted(r[0] for r in keys.select(self._bucket(column).alias("b")).distinct().collect())

    def dealt(self, table: str, rows: DataFrame) -> DataFrame:
        """rows with ``_bucket``, each bucket's together in SPREAD parts."""
        return rows.withColumn("_bucket", self._bucket(self.keys[table])).repartition("_bucket", F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(SPREAD)))

    def put(self, at: str, /, **tables: DataFrame) -> None:
        """Write tables into a new folder, side by side; rows that have a ``_bucket`` are dealt already. No reader sees them before ``point``."""
        def put_down(table: str, rows: DataFrame) -> None:
            put = rows if "_bucket" in rows.columns else self.dealt(table, rows)
            put.sortWithinPartitions("_bucket", self.keys[table]).write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.folder}/{at}/{table}")

        with ThreadPoolExecutor(len(tables)) as pool:  # the jobs of the tables side by side
            list(pool.map(inheritable_thread_target(self.spark)(put_down), tables, tables.values()))

    def was_put(self, at: str, table: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{at}/{table}").select(*schema.names)

    def point(self, at: str, touched: list[int] | dict[str, list[int]], schemas: dict[str, T.StructType]) -> None:
        """Make the tables of a new folder the touched buckets of the kept ones."""
        number, known = self.current()
        for table, schema in schemas.items():
            there = {s.getPath().getName().removeprefix("_bucket=") for s in self._fs.listStatus(self._path(f"{at}/{table}")) if s.isDirectory()}
            old = known.get(table, {"at": {}})["at"]
            mine = set(touched[table] if isinstance(touched, dict) else touched)
            known[table] = {"schema": schema.jsonValue(), "buckets": self.buckets, "at": {b: f for b, f in old.items() if int(b) not in mine} | dict.fromkeys(there, at)}
        out = self._fs.create(self._path(f"pointer-{number + 1:09d}"), False)
        out.write(bytearray(json.dumps(known).encode()))
        out.close()

    def folder_of_next(self) -> str:
        return f"v{self.current()[0] + 1:09d}-{uuid.uuid4().hex}"

    def write(self, touched: list[int] | dict[str, list[int]], **tables: DataFrame) -> None:
        """Give the touched buckets (of each table its own, or the same) of each table these rows, all of them, and none others. A bucket's rows are in order of the key."""
        at = self.folder_of_next()
        self.put(at, **tables)
        self.point(at, touched, {t: rows.schema for t, rows in tables.items()})

    def vacuum(self) -> int:
        """Remove folders that the newest pointer does not name, once no reader is on an older one; how many went."""
        number, known = self.current()
        used = {f for t in known.values() for f in t["at"].values()}
        old = [x for s in self._fs.listStatus(self._path("")) if (x := s.getPath().getName()) and ((x[0] == "v" and x not in used) or (x.startswith("pointer-") and int(x[8:]) < number))]
        for x in old:
            self._fs.delete(self._path(x), True)
        return len(old)

    def reset(self) -> None:
        self._fs.delete(self._path(""), True)

    def forget_at_exit(self) -> None:
        """The tables go when the session ends."""
        self._fs.deleteOnExit(self._path(""))


class ChunkTable(Buckets):
    """Chunks of documents and the state (hashes) that they were made from."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        super().__init__(spark, folder, {"chunks": "doc_id", "state": "doc_id"}, buckets)

    def all(self, kind: str = "chunks") -> DataFrame | None:
        return self.read(kind)

    def _merge(self, new: DataFrame, gone: DataFrame, size: int, overlap: int) -> None:
        """Put new or changed documents and remove others, in their buckets alone."""
        ids = new.select("doc_id").unionByName(gone.select("doc_id"))
        touched = self.touched(ids, "doc_id")
        tables = {"chunks": chunks(new, size, overlap), "state": new.select("doc_id", "content_hash", "meta_hash")}
        for table, rows in tables.items():
            old = self.read(table, touched)
            tables[table] = rows if old is None else old.join(ids, "doc_id", "left_anti").unionByName(rows)
        self.write(touched, **tables)

    def upsert(self, docs: DataFrame, size: int = 2048, overlap: int = 256) -> dict[str, int]:
        """Documents as they are now: those whose hash is new get new chunks, others are left alone."""
        mine = self.touched(docs, "doc_id")
        state = self.read("state", mine)
        new = docs if state is None else changed(docs, state)
        event = {"changed": new.count(), "deleted": 0}
        if event["changed"]:
            self._merge(new, docs.limit(0), size, overlap)
        return self._told(event)

    def build(self, docs: DataFrame, size: int = 2048, overlap: int = 256) -> dict[str, int]:
        """The whole corpus as it is now: an upsert, and documents that are no longer there go."""
        state = self.read("state")
        if state is None:
            event = {"changed": docs.count(), "deleted": 0}
            self._merge(docs, docs.limit(0), size, overlap)
            return self._told(event)
        new, gone = changed(docs, state), deleted(docs, state)
        event = {"changed": new.count(), "deleted": gone.count()}
        if any(event.values()):
            self._merge(new, gone, size, overlap)
        return self._told(event)

    def _told(self, event: dict[str, int]) -> dict[str, int]:
        row = self.spark.createDataFrame([(event["changed"], event["deleted"])], "changed long, deleted long")
        row.withColumn("at", F.current_timestamp()).write.mode("append").json(f"{self.folder}/history")
        return event

    def history(self, n: int = 20) -> DataFrame:
        return self.spark.read.schema("changed long, deleted long, at timestamp").json(f"{self.folder}/history").orderBy(F.desc("at")).limit(n)

    def get(self, ids: DataFrame) -> DataFrame:
        return self.all().join(ids.select("chunk_id"), "chunk_id", "left_semi")

    def list(self, limit: int | None = None, **equal) -> DataFrame:
        """Chunks whose columns have these values, in order of their place; at most a clamped limit of them, where one is given."""
        rows = self.all()
        for name, value in equal.items():
            rows = rows.where(F.col(name) == value)
        return rows if limit is None else rows.orderBy("doc_id", "chunk_index").limit(ranking.clamp(limit))

    def search(self, questions: DataFrame, k: int, embedder: Embedder | None = None, metric: str = "cosine", where: str | None = None) -> DataFrame:
        """The k nearest chunks of each of questions(question_id, text) by an embedder's vectors; ``where`` filters the chunks before."""
        by = embedder or HashedTerms()
        rows = self.all() if where is None else self.all().where(where)
        asked = by.attach(questions, "text").select("question_id", F.col("embedding").alias("q"))
        near = retrieval.vectors(asked, by.attach(rows, "chunk").select(F.col("chunk_id").alias("vec_id"), "embedding"), k, metric)
        return near.withColumnRenamed("vec_id", "chunk_id")

    def delete(self, doc_ids: DataFrame) -> None:
        mine = self.touched(doc_ids, "doc_id")
        if mine and self.current()[0]:
            gone = doc_ids.select("doc_id")
            self.write(mine, **{t: self.read(t, mine).join(gone, "doc_id", "left_anti") for t in ("chunks", "state")})


#: Keys up to which a lookup names them to the scan, so that row groups without them are skipped.
NAMED = 1000


class TextIndex(ChunkTable):
    """An inverted index that grows by document: chunks with their labels, postings of both kinds by token, and dictionaries.

    docs(doc_id, text, content_hash, meta_hash, *labels) where the labels have the names that retrieval searches
    (source_path, section, project, doc_type, source_channel, reliability, ticket_ids, people, ...). A build or an upsert reads and
    writes the buckets of the documents that changed, and of the tokens that they have or had. A row of postings is a token of a chunk
    with all its places. A lookup
    scans the dictionary (token, n: chunks that hold it), then the buckets of the tokens found, and chunks only
    to show them. It serves wherever retrieval takes a chunk table.
    """

    def __init__(self, spark: SparkSession, folder: str, labels: tuple[str, ...], buckets: int | None = None, embedder: Embedder | None = None):
        Buckets.__init__(self, spark, folder, {"chunks": "doc_id", "state": "doc_id", "low": "token", "words": "token", "low_terms": "token", "words_terms": "token"}, buckets or self.kept(spark, folder))
        self.labels, self.embedder = labels, embedder
        self.near = VectorIndex(spark, f"{folder}/vectors") if embedder else None

    @staticmethod
    def kept(spark: SparkSession, folder: str) -> int:
        """The number of buckets that the tables in a folder have; 0 before the first write."""
        known = Buckets(spark, folder, {}).current()[1]
        return max((t.get("buckets", BUCKETS) for t in known.values()), default=0)

    def build(self, docs: DataFrame, size: int = 2048, overlap: int = 256) -> dict[str, int]:
        if not self.buckets:
            self.buckets = max(LEAST, (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // LETTERS)
        return super().build(self._hashed(docs), size, overlap)

    def upsert(self, docs: DataFrame, size: int = 2048, overlap: int = 256) -> dict[str, int]:
        return self.build(docs, size, overlap) if not self.buckets else super().upsert(self._hashed(docs), size, overlap)

    @staticmethod
    def _hashed(docs: DataFrame) -> DataFrame:
        """Labels are searched, so a changed one counts as a change of the document."""
        return docs.withColumn("content_hash", F.concat_ws(":", "content_hash", "meta_hash"))

    def _chunks(self, docs: DataFrame, size: int, overlap: int) -> DataFrame:
        return chunks(docs, size, overlap, self.labels).withColumnRenamed("chunk", "text")

    def _merge(self, new: DataFrame, gone: DataFrame, size: int, overlap: int) -> None:
        """Put new or changed documents and remove others, in their buckets and their tokens' buckets alone.

        Chunks are written first; their postings are made from them, and the dictionaries from the postings, so nothing is written twice.
        """
        at = self.folder_of_next()
        ids = graph.cut(new.select("doc_id").unionByName(gone.select("doc_id")))
        touched = {"chunks": self.touched(ids, "doc_id")}
        touched["state"] = touched["chunks"]
        old = self.read("chunks", touched["chunks"])
        was = None if old is None else old.join(ids, "doc_id", "left_semi")
        tables = {"chunks": self._chunks(new, size, overlap), "state": new.select("doc_id", "content_hash", "meta_hash")}
        for table in ("chunks", "state"):
            kept = self.read(table, touched[table])
            tables[table] = tables[table] if kept is None else tables[table].unionByName(kept.join(ids, "doc_id", "left_anti"))
        schemas = {t: rows.schema for t, rows in tables.items()}
        self.put(at, **tables)
        fresh = self.was_put(at, "chunks", schemas["chunks"])
        if old is not None:
            fresh = fresh.join(new.select("doc_id"), "doc_id", "left_semi")
        tables = {}
        for kind in retrieval.KINDS:
            if old is None:
                mine = list(range(self.buckets))
            else:
                mine = self.touched(retrieval.packed(fresh, kind).select("token").union(retrieval.packed(was, kind).select("token")), "token")
            kept = self.read(kind, mine)
            tables[kind] = self._postings(fresh, kind, len(mine))
            if kept is not None:
                tables[kind] = tables[kind].unionByName(self.dealt(kind, kept.join(ids, "doc_id", "left_anti")))
            touched[kind] = touched[f"{kind}_terms"] = mine
            schemas[kind] = tables[kind].drop("_bucket").schema
        self.put(at, **tables)
        terms = {f"{kind}_terms": self.was_put(at, kind, schemas[kind]).groupBy("token").agg(F.count("*").alias("n")) for kind in retrieval.KINDS}
        self.put(at, **terms)
        self.point(at, touched, schemas | {t: rows.schema for t, rows in terms.items()})
        if self.near:
            self.near.delete(ids.select("doc_id"), "doc_id")
            self.near.upsert(self.embedder.attach(fresh, "text").select(F.col("chunk_id").alias("vec_id"), "embedding", "doc_id"))

    def _bucket(self, key: str):
        return F.pmod(F.crc32("token"), F.lit(self.buckets)).cast("int") if key == "token" else super()._bucket(key)

    def _postings(self, chunks: DataFrame, kind: str, parts: int) -> DataFrame:
        """Packed postings (token, doc_id, chunk_index, at, _bucket), each bucket's together.

        A batch of chunks leaves its task as one compressed block a bucket, so that a shuffle moves blocks and no single postings.
        """
        key = ("doc_id", "chunk_index")
        words, fields, positions = retrieval.KINDS[kind]
        rows, pack, buckets, spread = words(chunks, key), retrieval.packing(2, len(fields), positions), self.buckets, SPREAD
        kept = retrieval.packed_type(rows, key)
        out = T.StructType([kept["token"], kept["doc_id"], kept["chunk_index"], kept["at"], T.StructField("_bucket", T.IntegerType())])

        whole = {n: "DELTA_BINARY_PACKED" for n in ("doc_id", "chunk_index") if isinstance(kept[n].dataType, (T.IntegerType, T.LongType))}
        encoded = {"use_dictionary": ["token"], "column_encoding": whole | {"at.list.element": "DELTA_BINARY_PACKED"}}

        def blocks(batches):
            for no, b in enumerate(batches):
                of = []

                def order(found):  # by bucket, then as they come
                    of.append(np.array([zlib.crc32(t.encode()) % buckets for t in found.to_pylist()], np.int64))  # noqa: B023
                    by = np.empty(len(found), np.int64)
                    by[np.argsort(of[0], kind="stable")] = np.arange(len(found))  # noqa: B023
                    return by

                row, code, found, entry, ends = pack(b, order)
                own = of[0][code]
                edges = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
                table = pa.RecordBatch.from_arrays([found.take(pa.array(code)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.ListArray.from_arrays(pa.array(ends), pa.array(entry))], names=["token", "doc_id", "chunk_index", "at"])
                part = (zlib.crc32(str(b.column(0)[0]).encode()) + no) % spread if b.num_rows else 0
                sent = []
                for i, j in zip(edges, edges[1:]):
                    sink = pa.BufferOutputStream()
                    pq.write_table(pa.table([*(pa.concat_arrays([c.slice(i, j - i)]) for c in table.columns)], table.schema.names), sink, compression="zstd", write_statistics=False, store_schema=False, **encoded)
                    sent.append((int(own[i]), part, sink.getvalue().to_pybytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sent], pa.int32()), pa.array([x[1] for x in sent], pa.int32()), pa.array([x[2] for x in sent], pa.binary())], names=["bucket", "part", "block"])

        def opened(batches):
            for b in batches:
                for bucket, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    for rows in pq.ParquetFile(pa.py_buffer(block.as_py())).iter_batches(1 << 16):
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, bucket, np.int32))], names=[*rows.schema.names, "_bucket"])

        # a number of partitions that is not merged by the blocks' compressed sizes
        return rows.mapInArrow(blocks, "bucket int, part int, block binary").repartition(max(1, parts), "bucket", "part").select("bucket", "block").mapInArrow(opened, out)

    def delete(self, doc_ids: DataFrame) -> None:
        if self.current()[0]:
            state = self.read("state")
            there = graph.cut(state.join(doc_ids.select("doc_id"), "doc_id", "left_semi"))
            if there.limit(1).count():
                empty = self.read("chunks").limit(0)
                labels = [c for c in self.labels if c not in ("doc_id", "text")]
                self._merge(empty.select("doc_id", "text", *labels, F.lit("").alias("content_hash"), F.lit("").alias("meta_hash")), there, 2048, 256)

    def tokens(self, kind: str) -> DataFrame:
        return self.read(f"{kind}_terms").select("token")

    def postings(self, kind: str, found: DataFrame) -> DataFrame:
        rows = named(self, kind, "token", found)
        if "at" not in rows.columns:
            raise ValueError("this index keeps its postings in an older form: reset it and build it anew")
        return retrieval.unpacked(rows, kind, chunk_key().alias("chunk_id"), "doc_id")

    def places(self) -> DataFrame:
        return self.read("chunks").drop("text")

    def rows(self, ids: DataFrame) -> DataFrame:
        ids = ids.select("chunk_id").distinct()
        return named(self, "chunks", "doc_id", self.places().select("chunk_id", "doc_id").join(ids, "chunk_id", "left_semi")).join(ids, "chunk_id", "left_semi")

    def nearest(self, asked: DataFrame, embedder: Embedder, k: int, probes: int | None = 0) -> DataFrame:
        """The k nearest chunks of asked(question_id, q): exactly (``probes`` 0), or in so many cells (None: as many as were found to do)."""
        return self.near.search(asked, k, "cosine", probes).withColumnRenamed("vec_id", "chunk_id")


class VectorIndex(Buckets):
    """An inverted file: vectors(vec_id, embedding, *labels) in a folder for each cell of nearest centroids, and where each vec_id lies.

    Centroids are fitted once, on about SAMPLE vectors of the first write; each vector goes to its nearest. A search reads the cells
    that its questions probe and no others; a filter on labels is part of that scan, so rows that a reader may not see are
    never compared. How many cells to probe is found by comparing TRIED vectors with all rows.
    """

    SAMPLE, TRIED, CELLS, RECALL = 20_000, 32, 1024, 0.97

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        super().__init__(spark, folder, {"vectors": "cell", "at": "vec_id"}, buckets)

    def _bucket(self, key: str):
        return F.col("cell") if key == "cell" else super()._bucket(key)

    def centroids(self) -> np.ndarray | None:
        if not self._fs.exists(self._path("centroids")):
            return None
        return np.array([r.c for r in self.spark.read.parquet(f"{self.folder}/centroids").orderBy("cell").collect()], float)

    def _fit(self, rows: DataFrame) -> np.ndarray:
        """Some rounds of k-means over a sample; about as many cells as a cell has vectors, at most CELLS and a 16th of the sample."""
        n = rows.count()
        draw = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(min(1.0, self.SAMPLE / max(1, n)) * 1_000_000)
        x = np.array([r.embedding for r in rows.where(draw).orderBy("vec_id").limit(2 * self.SAMPLE).collect()], float)
        if not len(x):
            x = np.array([rows.first().embedding], float)
        k = max(1, min(int(np.sqrt(n)), self.CELLS, len(x) // 16))
        c = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
        for _ in range(8):
            own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            total = np.zeros_like(c)
            np.add.at(total, own, x)
            size = np.bincount(own, minlength=k)[:, None]
            c = np.where(size > 0, total / np.maximum(size, 1), c)
        self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell long, c array<double>").write.parquet(f"{self.folder}/centroids")
        return c

    def _celled(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())])
        at, square = rows.columns.index("embedding"), (centres * centres).sum(1)

        def run(batches):
            for b in batches:
                x = np.array(b.column(at).to_pylist(), float).reshape(b.num_rows, -1)
                cell = (square - 2 * x @ centres.T).argmin(1) if b.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64())], names=[*b.schema.names, "cell"])

        return rows.mapInArrow(run, schema)

    def upsert(self, rows: DataFrame) -> None:
        """Rows as they are now, one a vec_id; vectors that are null or empty have no place. Cells that neither gain nor lose a row are not touched."""
        rows = graph.cut(rows.where("embedding is not null and size(embedding) > 0"))
        if not rows.limit(1).count():
            return
        centres = self.centroids()
        new = graph.cut(self._celled(rows, self._fit(rows) if centres is None else centres))
        self._swap(new.select("vec_id"), new)

    def delete(self, ids: DataFrame, column: str = "vec_id") -> None:
        """Rows go whose column has one of these values; by another column than vec_id, of the labels, all cells are looked through."""
        if not self.current()[0]:
            return
        if column != "vec_id":
            ids = graph.cut(self.read("vectors").join(ids.select(column).distinct(), column, "left_semi").select("vec_id"))
        self._swap(ids.select("vec_id"), None)

    def _swap(self, ids: DataFrame, new: DataFrame | None) -> None:
        mine = self.touched(ids, "vec_id")
        at = self.read("at", mine)
        was = None if at is None else graph.cut(at.join(ids, "vec_id", "left_semi"))
        if new is None and not was.limit(1).count():
            return
        cells = set() if new is None else {r.cell for r in new.select("cell").distinct().collect()}
        cells |= set() if was is None else {r.cell for r in was.select("cell").distinct().collect()}
        tables = {"vectors": new, "at": None if new is None else new.select("vec_id", "cell")}
        for table, touched in (("vectors", sorted(cells)), ("at", mine)):
            old = self.read(table, touched)
            kept = None if old is None else old.join(ids, "vec_id", "left_anti")
            tables[table] = kept if tables[table] is None else tables[table] if kept is None else kept.unionByName(tables[table])
        self.write({"vectors": sorted(cells), "at": mine}, **tables)

    def _order(self, q: np.ndarray, metric: str) -> np.ndarray:
        """Each question's cells, the nearest first."""
        c = self.centroids()
        if metric == "cosine":
            far = -(q @ c.T) / np.maximum(np.linalg.norm(c, axis=1), 1e-12)
        else:
            far = (c * c).sum(1) - 2 * q @ c.T
        return far.argsort(axis=1, kind="stable")

    def probes(self, k: int, metric: str, where: str | None = None) -> int:
        """Cells that find RECALL of the k nearest of TRIED of the rows."""
        rows = self.read("vectors") if where is None else self.read("vectors").where(where)
        tried = rows.orderBy(F.xxhash64("vec_id")).select("vec_id", "embedding").limit(self.TRIED).collect()
        near = retrieval.nearest([(n, r.embedding) for n, r in enumerate(tried)], rows.select("vec_id", "embedding"), k, metric).join(self.read("at"), "vec_id").select("question", "cell").collect()
        order = self._order(np.array([r.embedding for r in tried], float), metric)
        need = sorted(int(np.flatnonzero(order[r.question] == r.cell)[0]) + 1 for r in near)
        return need[min(len(need) - 1, int(self.RECALL * len(need)))] if need else 1

    def search(self, queries: DataFrame, k: int, metric: str = "l2", probes: int | None = None, where: str | None = None, block: int = retrieval.BLOCK) -> DataFrame:
        """The k nearest of each of queries(question_id, q): (question_id, vec_id, distance, rank), exactly reranked.

        ``probes``: cells looked through a question, 0 for all (exact), None for as many as are found to do. ``where`` filters the rows before.
        Questions go in blocks of about ``block``.
        """
        if not self.current()[0]:
            return retrieval.vectors(queries.limit(0), self.spark.createDataFrame([], "vec_id long, embedding array<double>"), k, metric)
        rows = self.read("vectors")
        if probes == 0:
            return retrieval.vectors(queries, rows if where is None else rows.where(where), k, metric, block)
        many = probes or self.probes(k, metric, where)
        blocks = max(1, -(-queries.count() // block))
        out = None
        for b in range(blocks):
            some = queries.select("question_id", "q").where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b)
            asked = [(r.question_id, r.q) for r in some.collect() if r.q]
            of: dict[int, list[int]] = {}
            order = self._order(np.array([v for _, v in asked], float), metric)[:, :many] if asked else []
            for n, cells in enumerate(order):
                for cell in cells.tolist():
                    of.setdefault(cell, []).append(n)
            own = self.read("vectors", sorted(of))
            own = own if where is None else own.where(where)
            named = self.spark.createDataFrame([(n, i) for n, (i, _) in enumerate(asked)], T.StructType([T.StructField("question", T.LongType()), some.schema["question_id"]]))
            one = retrieval.nearest(asked, own.select("vec_id", "embedding", "cell"), k, metric, of).join(F.broadcast(named), "question").select("question_id", "vec_id", "distance", "rank")
            out = one if out is None else out.unionByName(one)
        return out


def named(at: Buckets, table: str, column: str, keys: DataFrame) -> DataFrame | None:
    """Rows of a table in the buckets of some keys; few keys are named to the scan, so that row groups without them are skipped. None before the first write."""
    if table not in at.current()[1]:
        return None
    some = keys.select(column, at._bucket(column).alias("b")).distinct().limit(NAMED + 1).collect()
    if len(some) > NAMED:
        return at.read(table, at.touched(keys, column)).join(keys.select(column).distinct(), column, "left_semi")
    return at.read(table, sorted({r.b for r in some})).where(F.col(column).isin([r[0] for r in some]))


class GraphTable(Buckets):
    """Nodes (node_id, type, name) and edges (from_id, relation, to_id, doc_id): one row a node, one an edge and document.

    Edges are kept by either end, so that a traversal reads the buckets of the nodes that it meets.
    """

    NODES, EDGES = "node_id string, type string, name string", "from_id string, relation string, to_id string, doc_id string"
    EDGE = ("from_id", "relation", "to_id", "doc_id")

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        super().__init__(spark, folder, {"nodes": "node_id", "edges": "from_id", "back": "to_id", "by_doc": "doc_id"}, buckets)

    def nodes(self) -> DataFrame:
        rows = self.read("nodes")
        return self.spark.createDataFrame([], self.NODES) if rows is None else rows

    def edges(self) -> DataFrame:
        rows = self.read("edges")
        return self.spark.createDataFrame([], self.EDGES) if rows is None else rows

    def upsert(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """New rows win over old ones of the same node, or of the same edge and document; repeats count once."""
        for names, rows, key, ddl in ((("nodes",), nodes, ["node_id"], self.NODES), (("edges", "back", "by_doc"), edges, list(self.EDGE), self.EDGES)):
            if rows is not None:
                rows = graph.cut(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl))).dropDuplicates(key))
                self._put({t: (self.touched(rows, self.keys[t]), rows, key, rows) for t in names})

    def _put(self, changes: dict[str, tuple]) -> None:
        """{table: (buckets, rows that go, by which key, rows that come)}, all under one pointer."""
        if not any(mine for mine, *_ in changes.values()):
            return
        tables = {}
        for table, (mine, gone, key, new) in changes.items():
            old = self.read(table, mine)
            tables[table] = new if old is None else new.unionByName(old.join(gone, key, "left_anti"))
        self.write({t: mine for t, (mine, *_) in changes.items()}, **tables)

    def replace(self, doc_ids: DataFrame, edges: DataFrame) -> None:
        """The edges of some documents as they are now: old ones of these documents go, also where none come. Other buckets stay unread."""
        gone = graph.cut(doc_ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct())
        new = graph.cut(edges.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(self.EDGES))).dropDuplicates(list(self.EDGE)))
        was = named(self, "by_doc", "doc_id", gone)
        both = graph.cut(new if was is None else new.unionByName(was.select(*self.EDGE)))
        self._put({t: (self.touched(both.select(self.keys[t]).union(gone) if t == "by_doc" else both, self.keys[t]), gone, ["doc_id"], new) for t in ("edges", "back", "by_doc")})

    def delete(self, doc_ids: DataFrame) -> None:
        """Edges that come from some documents go; nodes that no edge is left of stay, as they may be named elsewhere."""
        if "edges" in self.current()[1]:
            self.replace(doc_ids, self.edges().limit(0))

    def support(self) -> DataFrame:
        """(from_id, relation, to_id, n): in how many documents each edge stands."""
        return self.edges().groupBy("from_id", "relation", "to_id").agg(F.count_distinct("doc_id").alias("n"))

    def at(self, frontier: DataFrame) -> DataFrame:
        """The edges at the nodes of frontier(node), from the buckets of those nodes."""
        ends = [named(self, t, k, frontier.select(F.col("node").cast("string").alias(k))) for t, k in (("edges", "from_id"), ("back", "to_id"))]
        if ends[0] is None:
            return self.edges()
        return ends[0].select(*self.EDGE).unionByName(ends[1].select(*self.EDGE))

    def k_hop(self, seeds: DataFrame, hops: int) -> DataFrame:
        return graph.k_hop(self, seeds, hops)

    def k_hop_each(self, seeds: DataFrame, hops: int) -> DataFrame:
        """seeds(question_id, id): each question's own search."""
        return graph.k_hop_each(self, seeds, hops)


class EntityTable(Buckets):
    """Entity resolution that grows by document: mentions of one type that share an alias, transitively, are one node, named by its smallest mention.

    Kept are a mention's names, by mention, by name and by document, and its node, by mention and by node. A change
    dissolves only the components that the changed documents' mentions had or now touch, and resolves those anew;
    buckets without any of them are neither read nor written.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        super().__init__(spark, folder, {"names": "mention_id", "by_name": "name", "by_doc": "doc_id", "labels": "mention_id", "members": "node_id"}, buckets)

    def labels(self) -> DataFrame:
        rows = self.read("labels")
        return self.spark.createDataFrame([], "mention_id long, node_id long") if rows is None else rows

    def replace(self, doc_ids: DataFrame, mentions: DataFrame) -> None:
        """The mentions(mention_id, doc_id, type, aliases) of some documents as they are now; documents without any are deleted. A mention_id is of one document."""
        gone = graph.cut(doc_ids.select("doc_id").distinct())
        empty = F.array(F.lit(None).cast("string"))  # a mention without an alias is a node of its own
        new = graph.cut(mentions.select(F.col("mention_id").cast("long").alias("mention_id"), "doc_id", "type", F.explode(F.when(F.size("aliases") > 0, F.col("aliases")).otherwise(empty)).alias("alias")).select("mention_id", "doc_id", F.when(F.col("alias").isNotNull(), F.concat_ws(":", "type", "alias")).otherwise(F.concat(F.lit("\0"), F.col("mention_id").cast("string"))).alias("name")).distinct())
        was = named(self, "by_doc", "doc_id", gone)
        old = new.limit(0) if was is None else graph.cut(was.select(*new.columns))
        # components that are touched: of the old mentions, and of mentions that share a name with a new one
        near = named(self, "by_name", "name", new)
        seeds = old.select("mention_id") if near is None else old.select("mention_id").union(near.select("mention_id"))
        seeds = graph.cut(seeds.distinct())
        nodes = named(self, "labels", "mention_id", seeds)
        hit = None if nodes is None else graph.cut(nodes.select("node_id").distinct())
        members = None if hit is None else named(self, "members", "node_id", hit)
        dissolved = seeds.limit(0).withColumn("node_id", F.col("mention_id")) if members is None else graph.cut(members.select("mention_id", "node_id"))
        stay = dissolved.select("mention_id").join(old.select("mention_id"), "mention_id", "left_anti")
        known = named(self, "names", "mention_id", graph.cut(stay))
        rows = graph.cut(new if known is None else new.unionByName(known.select(*new.columns)))
        hub = rows.groupBy("name").agg(F.min("mention_id").alias("b"))
        linked = graph.components(rows.join(hub, "name").select(F.col("mention_id").alias("a"), "b").union(rows.select("mention_id", "mention_id"))) if rows.limit(1).count() else dissolved.select(F.col("mention_id").alias("node"), F.col("node_id").alias("root")).limit(0)
        fresh = graph.cut(linked.select(F.col("node").alias("mention_id"), F.col("root").alias("node_id")))
        change = {t: (old.unionByName(new), ["doc_id"], gone, new) for t in ("names", "by_name", "by_doc")} | {t: (dissolved.unionByName(fresh), ["mention_id"], dissolved.select("mention_id"), fresh) for t in ("labels", "members")}
        tables, touched = {}, {}
        for table, (both, key, out, come) in change.items():
            touched[table] = self.touched(both, self.keys[table])
            kept = self.read(table, touched[table])
            tables[table] = come if kept is None else come.unionByName(kept.join(out, key, "left_anti").select(*come.columns))
        if any(touched.values()):
            self.write(touched, **tables)
