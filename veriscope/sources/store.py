"""Results that are computed once and read afterwards."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "CURRENT"


def manifest(spark: SparkSession, inputs: Sequence[str]) -> dict:
    """What tells the state of the input files: their number, and sums over path, length and time of change.

    Files are listed and hashed by Spark, their contents are not read.
    """
    if not inputs:
        return {}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs)).select(
        F.xxhash64("path", "length", F.unix_micros("modificationTime")).alias("h"), "length")
    n, length, mixed, total = files.agg(
        F.count("*"), F.sum("length"), F.bit_xor("h"), F.sum(F.shiftright("h", 24))).first()
    return {"files": n, "bytes": length, "mixed": mixed, "total": total}


def _file_context(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf)


def published(spark: SparkSession, folder: str) -> str | None:
    """The table that the marker in ``folder`` names."""
    where, files, _ = _file_context(spark, f"{folder}/{MARKER}")
    if not files.exists(where):
        return None
    return f"{folder}/{spark.read.text(f'{folder}/{MARKER}').first()[0]}"


def publish(spark: SparkSession, folder: str, name: str) -> str:
    """Make ``name`` the table of ``folder``, unless another writer was first; the path of the one that holds."""
    draft, files, context = _file_context(spark, f"{folder}/_draft-{name}")
    out = files.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        # without the option to overwrite, a rename fails where the marker stands already
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{folder}/{MARKER}"), options)
    except Py4JJavaError as failure:
        if "FileAlreadyExists" not in str(failure.java_exception):
            raise
    return published(spark, folder)


def materialize(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame],
                params: dict | None = None, inputs: Sequence[str] = ()) -> DataFrame:
    """Read the stored table, or build and store it.

    The parameters and the state of the ``inputs`` (paths) are part of the path: other
    parameters or changed files never meet an old result.  A table is written beside the
    marker and named by it when it is whole; of two writers the first one's table holds.
    Rows carry their key, so a stored table is joined by key, never by position.
    """
    key = json.dumps([params or {}, manifest(spark, inputs)], sort_keys=True, default=str)
    path = f"{folder.rstrip('/')}/{name}-{hashlib.md5(key.encode()).hexdigest()[:12]}"
    stored = published(spark, path)
    if stored is None:
        own = f"table-{uuid.uuid4().hex}"
        build().write.parquet(f"{path}/{own}")
        stored = publish(spark, path, own)
    return spark.read.parquet(stored)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
