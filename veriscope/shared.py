"""Intermediate tables in shared storage, and size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

# A broadcast table is held by the driver and by every executor.
MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
MAX_DRIVER_BYTES = 16 * 1024 * 1024  # of cuts, of a level's steps or of vocabularies, that the driver may send out


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session (tests, a laptop) may fall back to a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="veriscope-")
    return _own_folders[context.applicationId]


def settle(df: DataFrame, compact: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so that several passes (or a retry after a lost executor)
    do not recompute it, and gives the optimizer the real size of the result.
    ``compact`` evens out the files first: for narrow columns of a large scan, which
    would otherwise leave one tiny file per scan task.
    """
    path = f"{shared_folder(df.sparkSession)}/veriscope-{uuid.uuid4().hex}"
    (df.hint("rebalance") if compact else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over: Spark deletes them when the driver has collected
    their plans, which a driver with room to spare does late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pinned(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """A small result as a broadcast local table; beyond ``max_rows``, ``df`` itself.

    Runs ``df``.  At most ``max_rows + 1`` rows reach the driver.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema))


def _held_bytes(value: Column, kind: DataType) -> Column:
    """About what a value holds in memory, with all that lies inside it."""
    if isinstance(kind, StringType | BinaryType):
        size = F.octet_length(value).cast("long")
    elif isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | ArrayType | MapType | StructType):
            size = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _held_bytes(x, kind.elementType))
        else:
            size = 8 * F.size(value).cast("long")
    elif isinstance(kind, MapType):
        size = _held_bytes(F.map_keys(value), ArrayType(kind.keyType)) + _held_bytes(F.map_values(value), ArrayType(kind.valueType))
    elif isinstance(kind, StructType):
        size = sum((_held_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    else:
        return F.lit(8).cast("long")
    return F.coalesce(size, F.lit(0)) + 8


def fits_broadcast(settled: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a settled (Parquet-backed) table is small enough to broadcast, arrays and binaries included."""
    held = sum((_held_bytes(F.col(f"`{f.name}`"), f.dataType) for f in settled.schema.fields), F.lit(8).cast("long"))
    rows, size = settled.agg(F.count("*"), F.sum(held)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def broadcast_if_small(settled: DataFrame, **limits: int) -> DataFrame:
    """Hint a broadcast only after checking the size (``limits`` of ``fits_broadcast``); else a merge,
    as Catalyst goes by the size of the file, which may be far below what the table holds."""
    return F.broadcast(settled) if fits_broadcast(settled, **limits) else settled.hint("merge")
