"""Tables that cut lineage: Parquet in the folder that all executors share.

An operator that needs a result twice, or that loops, writes it with ``stage`` and reads it
again, so a lost executor costs the tasks since the last stage and not the whole job.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_live: dict[str, SparkSession] = {}
#: Rows of an Arrow batch: long texts make batches of the usual 10,000 rows large. Set once for a session, never back.
BATCH_ROWS, _ROWS_KEY = 512, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Seconds between two collections of the driver's garbage.
COLLECT_EVERY = 4.0
_collected = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, else the context's checkpoint folder, else the warehouse; a folder of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="stages-")
        atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
    return f"file://{_own[key]}"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most, from now on: a setting that only ever shrinks is safe for queries side by side."""
    if int(spark.conf.get(_ROWS_KEY)) > BATCH_ROWS:
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    _live[path] = spark
    if time.monotonic() - _collected[0] > COLLECT_EVERY:
        release_shuffles(spark)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _live.pop(path, None)


@atexit.register
def _drop_all() -> None:
    """At the driver's end no result is read any more; a session that was stopped before leaves its last tables."""
    for path, spark in list(_live.items()):
        with contextlib.suppress(Exception):
            _delete(spark, path)


def drop(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        path = getattr(df, "_stage_path", None)
        if path:
            _delete(df.sparkSession, path)


def give_back() -> None:
    """Return freed memory to the system: a process that is reused would hold its peak for its neighbours to miss."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files and broadcasts of finished jobs: it acts when the driver's references are gone.
    A collection also shrinks the driver's heap, which plans and task results of a stage have widened."""
    gc.collect()
    spark._jvm.System.gc()
    give_back()
    _collected[0] = time.monotonic()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``: names that a plan adds cannot clash with a table's own."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))


def _hinted(df: DataFrame) -> DataFrame:
    out = F.broadcast(df)
    out._stage_path = getattr(df, "_stage_path", None)
    return out


def small(df: DataFrame, most: int) -> DataFrame:
    """A staged table, with a broadcast hint only if it has at most ``most`` rows; beyond, Spark shuffles and splits skew."""
    return _hinted(df) if df.count() <= most else df


def small_arrays(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """The same, with the bound on elements of the array columns and on rows together."""
    held = df.agg(F.sum(sum((F.size(c) for c in columns), F.lit(1)))).first()[0] or 0
    return _hinted(df) if held <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
