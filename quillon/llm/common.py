"""What the corpus operators share: scratch tables, row keys and Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of inner columns start so; they never meet the columns of a caller.
INNER = "__q_"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, one is made for a session that runs in a single process;
    on a cluster each machine would write to its own disk, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
    root = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{root}")
    return f"file://{root}"


class Scratch:
    """Parquet tables in the shared folder that cut lineage and can be dropped when consumed.

    What a result still reads stays until `sweep`, or until the driver ends.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/quillon-{label}-{uuid.uuid4().hex}"
        self.made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, where: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.base}/{name}")

    @classmethod
    def sweep(cls, *keep: Scratch) -> None:
        """Deletes the tables of all others: for when their results are written."""
        for scratch in [s for s in cls.made if s not in keep]:
            scratch._delete(scratch.base)
            cls.made.remove(scratch)


@atexit.register
def _sweep_at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        Scratch.sweep()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs with a unique non-null long key that follows doc_id's order, and that key's name.

    doc_id itself serves where it is unique and never null. Otherwise rows are
    ordered by (doc_id, text hash), nulls last, numbered in that order, and
    written once, so that each repeated row counts as a document of its own.
    """
    key = f"{INNER}rid"
    bad = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not bad:
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    by = [F.col("doc_id").asc_nulls_last(), F.xxhash64(F.col("text").cast("string"))]
    return scratch.save(docs.orderBy(*by).withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def packed_row(docs: DataFrame, leave: tuple[str, ...] = ("text",)) -> Column:
    """All columns but those left out, as one struct that passes through unchanged."""
    names = [c for c in docs.columns if c not in leave and not c.startswith(INNER)]
    return F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("none"))


def give_back() -> None:
    """Returns freed memory to the system: a worker, or the driver, may wait long for its next use."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker's memory doesn't follow the batch's size."""
    pool = pa.default_memory_pool()
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        if not batch.num_rows:
            yield batch
        del batch
        pool.release_unused()
    give_back()


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and their n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null(b"" if "binary" in str(col.type) else "")
    _, off, data = col.buffers()
    off = np.frombuffer(off, kind, n + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]
