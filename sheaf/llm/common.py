"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. A local session, which has one machine, may do with a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sheaf-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it back.

    A lost executor then costs a re-read, not the work before it. The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sheaf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def remainder(mod: int):
    """crc32 of doc_id as text, modulo; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod


def texts(df: DataFrame, *keep: str) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, stay out of the operators."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)


def utf8(column: pa.Array) -> list[bytes]:
    """Each text of an Arrow string column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def apart(df: DataFrame, *used: str) -> DataFrame:
    """The columns under names that no result has, but for those that are used; their order stays."""
    return df.toDF(*(c if c in used else f"_own_{n}" for n, c in enumerate(df.columns)))
