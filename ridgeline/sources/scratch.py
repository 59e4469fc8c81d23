"""Places that driver and executors share, and small files there. All goes through Spark's file systems."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a temporary one if driver and executors are one machine (as in tests), else an error, since no local folder would do."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ridgeline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/ridgeline-{uuid.uuid4().hex}"


def _open(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _open(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    place, files = _open(spark, path)
    files.delete(place, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    place, files = _open(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file that is there whole or not at all: written beside its name and renamed."""
    place, files = _open(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(place, True)
    out.write(bytearray(data))
    out.close()
    target, _ = _open(spark, path)
    files.delete(target, False)
    if not files.rename(place, target):
        raise OSError(f"cannot write {path}")


def read_bytes(spark: SparkSession, path: str, limit: int | None = None) -> bytes:
    place, files = _open(spark, path)
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes() if limit is None else stream.readNBytes(limit))
    finally:
        stream.close()
