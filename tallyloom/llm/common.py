"""Helpers shared by the corpus operators: the shared folder, written cuts, column isolation."""

from __future__ import annotations

import ctypes
import gc
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import shared_dir

#: Words are runs of anything but ASCII white space (space and 0x09-0x0D).
WORD = r"[^\x20\x09-\x0D]+"


def folder(spark: SparkSession, name: str) -> str:
    """A new place for a table in the shared folder."""
    place = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for block in _open.get():
        block.append(place)
    return place


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there and lost executors cost nothing."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders written inside each open block of scratch; a thread has its own blocks.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are removed at the end, so what is still wanted of them must be written or counted inside.

    Blocks may be nested, and those of other threads are left alone.
    """
    mine: list[str] = []
    token = _open.set((*_open.get(), mine))
    try:
        yield
    finally:
        _open.reset(token)
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in mine:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


#: What a worker process keeps from one task to the next.
_kept: list = []


def once_a_worker(make):
    """make, whose results stay in the worker process for further tasks, until a task of another operator frees them."""
    kept = lru_cache(maxsize=2)(make)
    _kept.append(kept)
    return kept


def free_worker(but=None) -> None:
    """Where a task begins: what earlier tasks left in this worker goes, but what this operator keeps, and freed memory goes back to the machine.

    Spark gives a worker to any later task, so a session of many operators would hold all of their encoders in every worker.
    """
    import pyarrow as pa

    others = [kept for kept in _kept if kept is not but and kept.cache_info().currsize]
    for kept in others:
        kept.cache_clear()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only doc_id and text, so that no other column of the input can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(id_column: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo modulus, equals remainder (false for a null id)."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
