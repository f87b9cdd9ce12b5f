"""Reading the project's tables and keeping lineage short."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``, with only ``columns`` if any are given."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def utc(frame: DataFrame) -> DataFrame:
    """Timestamps without a zone are read as UTC instants."""
    for field in frame.schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            frame = frame.withColumn(field.name, frame[field.name].cast("timestamp"))
    return frame


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one where that is unset and the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"libranta-{spark.sparkContext.applicationId}")
        if all(path != folder for _, path in _written):
            _written.append((spark, folder))
    return folder


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame`` written once, compressed, as a table in the shared folder, so that later stages survive lost executors.

    Tables are removed when the application ends.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/libranta-{uuid4().hex}"
    frame.write.parquet(path)
    _written.append((spark, path))
    found = spark.read.schema(frame.schema).parquet(path)
    found._libranta_path = path
    return found


def small_hashed(frame: DataFrame) -> DataFrame:
    """``checkpointed``, with joins by hash instead of by sorting where each task's share, as it was written, is under 32 MB; larger ones are sorted as ever."""
    conf, name = frame.sparkSession.conf, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = conf.get(name)
    conf.set(name, "32m")
    try:
        return checkpointed(frame)
    finally:
        conf.set(name, before)


def dropped(*frames: DataFrame) -> None:
    """Removes tables of ``checkpointed`` that nothing reads any more."""
    for frame in frames:
        path = getattr(frame, "_libranta_path", None)
        if path is not None:
            _delete(frame.sparkSession, path)
            _written[:] = [(spark, other) for spark, other in _written if other != path]


def _delete(spark: SparkSession, path: str) -> None:
    if "://" not in path and not path.startswith("file:"):
        shutil.rmtree(path, ignore_errors=True)
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the application may be gone
            return
