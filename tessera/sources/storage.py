"""Small text files and paths on whatever file system Spark reads."""

from __future__ import annotations

import importlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SLICE = re.compile(r"^(.*)@\[(\d*):(\d*)\]$")


def without_slice(path: str) -> str:
    return m[1] if (m := _SLICE.match(path)) else path


def slice_of(path: str) -> tuple[str, int | None, int | None]:
    m = _SLICE.match(path)
    return (m[1], int(m[2]) if m[2] else None, int(m[3]) if m[3] else None) if m else (path, None, None)


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file(spark, path)
    return fs.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _file(spark, path)
    fs.delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a temporary one for local masters alone."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or getattr(spark, "_shared_folder", None)
    if not named and (given := context._jsc.sc().getCheckpointDir()).isDefined():
        named = given.get()
    if not named:
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir isn't set, and executors don't share the driver's folders")
        named = spark._shared_folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return named


#: Tables in the shared folder that still stand, in the order that they were made.
_STANDING: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder, for one table."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _STANDING.append(path)
    return path


def standing() -> int:
    return len(_STANDING)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Removes tables of the shared folder once nothing reads them any more."""
    for path in paths:
        delete(spark, path)
        _STANDING.remove(path)


def cleared(spark: SparkSession, since: int = 0, but: tuple = ()) -> None:
    """Removes the tables made since then (see standing()); for callers that have read what they were given."""
    dropped(spark, *[path for path in _STANDING[since:] if path not in but])


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written into the shared folder and read back, so that it is computed once, whatever reads it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_parent(spark: SparkSession, path: str) -> None:
    fs, where = _file(spark, path)
    if where.getParent() is not None:
        fs.mkdirs(where.getParent())


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, where = _file(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Through a file of another name that is renamed, so no reader sees a part."""
    ensure_parent(spark, path)
    fs, where = _file(spark, path)
    _, part = _file(spark, path + ".part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    if fs.exists(where):
        fs.delete(where, False)
    if not fs.rename(part, where):
        raise OSError(f"{path} can't be written")


def moved(spark: SparkSession, path: str, to: str) -> None:
    fs, where = _file(spark, path)
    ensure_parent(spark, to)
    if not fs.rename(where, _file(spark, to)[1]):
        raise OSError(f"{path} can't be moved to {to}")


def by_path(said: str):
    """What ``package.module:name`` names: a provider, an extractor or an upload hook of the user's own."""
    module, sep, name = said.partition(":")
    if not sep:
        raise ValueError(f"{said!r} isn't module:name")
    return getattr(importlib.import_module(module), name)
