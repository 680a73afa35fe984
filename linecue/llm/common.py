"""Pieces that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
#: Text bytes that one step of a Python task handles at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of its own only where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        known = spark.sparkContext.getCheckpointDir()
        where = known or f"file://{tempfile.mkdtemp(prefix='linecue-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder name inside the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def document(key: str = "doc_id", text: str = "text") -> Column:
    """A document's identity: its id with a hash of its text. Structs are equal where both ids are null, and neither an id nor a text alone makes a hot key."""
    return F.struct(F.col(key).alias(key), F.xxhash64(F.col(text).cast("string")).alias("row"))


def joined_apart(rows: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with few, an aggregate with one row a key, which gets an exchange of its own for it: only so can Spark split the rows of a hot key."""
    apart = few.select(F.struct(key).alias("_of"), *(c for c in few.columns if c != key))
    return rows.withColumn("_of", F.struct(key)).join(apart, "_of", how).drop("_of")


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` of one slice holds about `most` bytes (one row at least)."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if not len(values):
            continue
        sizes = np.diff(np.frombuffer(values.buffers()[1], dtype=np.int64 if pa.types.is_large_string(values.type) else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64))
        part, start = np.cumsum(sizes) // most, 0
        for cut in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(values)]:
            if cut > start:
                yield batch.slice(start, cut - start)
            start = cut
