"""Shared scratch tables, and a filter of bounded size for probing a large table with the keys of another.

Lineage is cut with Parquet tables in the folder that the session names in ``spark.checkpoint.dir``; every executor
reads them, so a lost executor costs a re-read and not a recomputation of everything before.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

#: Bits of a key filter per key, and at least and at most (4 KiB and 32 MiB): what is broadcast has this bound. With more keys a filter prunes less; it never loses one.
FILTER_BITS_PER_KEY, FILTER_BITS_LEAST, FILTER_BITS_MOST = 16, 1 << 15, 1 << 28
#: Rows of an Arrow batch of whole texts, where the session keeps Spark's default of 10,000: a batch is held several times over, in both processes.
ARROW_ROWS = 1000
_ARROW_KEY, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
LIGHT_FILES = 4  # of a light table, per core
_BUCKET = 32768  # bits of one bitmap of bitmap_construct_agg

#: Paths written so far, by application and owner.
_written: dict[tuple[str, str], list[str]] = {}
_owner = [""]

shared_dir = shared.folder


@contextlib.contextmanager
def owned(owner: str) -> Iterator[None]:
    """Tables that are kept meanwhile belong to this owner, who alone releases them."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def keep(df: DataFrame, name: str, *, sort: tuple[str, ...] = (), options: dict[str, str] | None = None, by: str | None = None, light: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return the table read back. A light table has no more files than suit the cluster's cores: its writers run through several partitions each, one after the other."""
    spark = df.sparkSession
    if light:
        df = df.coalesce(LIGHT_FILES * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = (df.sortWithinPartitions(*sort) if sort else df).write.options(**(options or {}))
    (writer.partitionBy(by) if by else writer).parquet(path)
    _written.setdefault((spark.sparkContext.applicationId, _owner[-1]), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, owner: str) -> None:
    """Delete an owner's scratch tables, once the results that read them are written. Tables without an owner stay, as results not yet read may need them."""
    for path in _written.pop((spark.sparkContext.applicationId, owner), []):
        delete(spark, path)


class KeyFilter(NamedTuple):
    rows: DataFrame
    bits: int


def key_filter(keys: DataFrame, *columns: str) -> KeyFilter:
    """The hashed places of all the keys, a written table, as rows (bucket, bitmap); as large as the keys need, within bounds."""
    bits = FILTER_BITS_LEAST
    wanted = min(FILTER_BITS_MOST, FILTER_BITS_PER_KEY * keys.count())
    while bits < wanted:
        bits *= 2
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    made = keys.select(place.alias("p")).groupBy((F.col("p") / _BUCKET).cast("int").alias("__bucket")).agg(F.bitmap_construct_agg(F.col("p") % _BUCKET).alias("__bitmap"))
    return KeyFilter(made, bits)


def with_maybe(df: DataFrame, filter_: KeyFilter, flag: str, *columns: str | Column) -> DataFrame:
    """df with a boolean column: false only if the row's key is certainly not among the filter's keys."""
    place = F.pmod(F.xxhash64(*columns), F.lit(filter_.bits))
    bit = (F.col("__place") % _BUCKET).cast("int")
    byte = F.conv(F.hex(F.substring("__bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = df.withColumn("__place", place).withColumn("__bucket", (F.col("__place") / _BUCKET).cast("int"))
    hit = F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))
    return on.join(F.broadcast(filter_.rows), "__bucket", "left").withColumn(flag, hit).drop("__bucket", "__place", "__bitmap")


def names(df: DataFrame) -> list[Column]:
    """Every column of df by position-safe name."""
    return [F.col(f"`{c}`") for c in df.columns]


_STORE = "_quillspan_worker"


def per_worker(name: str, key: object, make: Callable):
    """What make() returns, made once per Python worker for a key: Spark reuses workers, so tasks find what an earlier one has made. Kept until a task of another function begins."""
    store = sys.modules.setdefault(_STORE, types.ModuleType(_STORE)).__dict__
    if name not in store or store[name][0] != key:
        store[name] = (key, make())
    return store[name][1]


def _forget(but: str | None) -> None:
    store = sys.modules.get(_STORE)
    for name in [k for k in (store.__dict__ if store else ()) if not k.startswith("__") and k != but]:
        del store.__dict__[name]


def trim() -> None:
    """Give memory that this Python worker has freed back to the system: workers outlive their tasks and stages."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        release(0)


def few_arenas() -> None:
    """Threads of a library share two of glibc's heaps; else each thread keeps freed memory in its own."""
    if tune := getattr(ctypes.CDLL(None), "mallopt", None):
        tune(-8, 2)  # M_ARENA_MAX


def map_batches(df: DataFrame, function: Callable, schema: str, keeps: str | None = None) -> DataFrame:
    """df.mapInArrow(function, schema) in bounded memory: small batches, and workers that forget what other functions left (all but `keeps`) and are trimmed at the end of each task."""
    conf = df.sparkSession.conf
    if conf.get(_ARROW_KEY) == _ARROW_DEFAULT:
        conf.set(_ARROW_KEY, str(ARROW_ROWS))

    @functools.wraps(function)
    def run(batches: Iterator) -> Iterator:
        few_arenas()
        _forget(keeps)
        yield from function(batches)
        trim()

    return df.mapInArrow(run, schema)
