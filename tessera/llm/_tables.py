"""Shared-storage helpers: intermediate tables and column hygiene.

Intermediate results are written as Parquet below the folder that the session
names in ``spark.checkpoint.dir``: every executor can read them again, whatever
executor wrote them, and they cut lineage.  Tables that are made inside a
:func:`scratch` block go when it ends; what a lazy result still reads stays until the
application does.
"""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_MARKED: set[str] = set()
_SCOPES: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode, a local one if none is set."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="tessera-")
    return f"file://{_FALLBACK['dir']}"


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/tessera-{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if folder not in _MARKED:
        system, place = _file_system(spark, folder)
        system.deleteOnExit(place)
        _MARKED.add(folder)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back."""
    out = _written(df, name)
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of :func:`stored` that nothing reads any more."""
    system, place = _file_system(df.sparkSession, df.stored_at)
    system.delete(place, True)


@contextmanager
def scratch():
    """Delete the tables stored inside the block at its end, whatever happens.  Yields a
    function that stores a result which outlives the block."""
    mine: list[DataFrame] = []
    _SCOPES.append(mine)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = _written(df, name)
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(out)
        return out

    try:
        yield keep
    finally:
        _SCOPES.pop()
        for df in mine:
            dropped(df)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows by ``key`` to as many tasks as there are cores, if the table has fewer
    files than that (one small file is one task); large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def released(rows):
    """Rows of a worker's generator; at its end, freed memory goes back to the system, for
    the worker process lives on between tasks."""
    import ctypes

    import pyarrow as pa

    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:
            pass


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` whose workers give memory back after each task."""
    return df.mapInArrow(lambda batches: released(function(batches)), schema)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker process."""
    module = sys.modules.get("_tessera_worker_cache")
    if module is None:
        module = types.ModuleType("_tessera_worker_cache")
        module.items = {}
        sys.modules["_tessera_worker_cache"] = module
    return module.items


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (no re-evaluation)."""
    return F.transform(F.array(value), body).getItem(0)


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text, as long."""
    return F.size(word_array(text)).cast("long")
