"""Restartable work in chunks: finished chunks are kept, a fingerprint guards what they belong to."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources import storage


def fingerprint(spark: SparkSession, path: str, rows: int, chunk_rows: int) -> dict:
    fs, where = storage._file(spark, path)
    status = fs.getContentSummary(where)
    return {"input": path, "rows": rows, "bytes": status.getLength(), "modified": fs.getFileStatus(where).getModificationTime(), "chunk_rows": chunk_rows}


def guarded(spark: SparkSession, out: str, mark: dict) -> None:
    """Writes the fingerprint of a first run; a later run must have the same. Chunks without one may be of anything, and are refused."""
    at = f"{out}.fingerprint.json"
    if storage.exists(spark, at):
        if json.loads(storage.read_text(spark, at)) != mark:
            raise ValueError(f"{out} was begun with another input or chunk size")
    elif storage.exists(spark, out):
        raise ValueError(f"{out} has chunks without a fingerprint")
    else:
        storage.write_text(spark, at, json.dumps(mark))


#: Chunks that are worked on as tasks of one job; more are dealt to these, several to a task.
MOST_TASKS = 20_000
CHUNK = "chunk_id"


def committed(spark: SparkSession, out: str) -> list[int]:
    """Chunks whose file stands. A chunk is one file of one task, which is moved to its place when that task commits."""
    fs, where = storage._file(spark, f"{out}/{CHUNK}=*/*.parquet")
    return sorted({int(file.getPath().getParent().getName().partition("=")[2]) for file in fs.globStatus(where) or []})


def append(made: DataFrame, out: str) -> None:
    """Adds chunks; a task's files get to their place when it commits, not when the job does."""
    made.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(CHUNK).parquet(out)


def run(
    spark: SparkSession,
    rows: DataFrame,
    out: str,
    chunk_rows: int,
    work: Callable[[DataFrame], DataFrame],
    order: str = "row_idx",
    n_rows: int | None = None,
    at_once: int | None = None,
) -> DataFrame:
    """work(rows) by chunks of row numbers (``order``, from 0), as one job; chunks that are committed are left alone.

    The rows are read once, however many chunks there are, and each chunk goes to one task. A task's files are moved to
    their chunks' folders when it ends (not when the job does), so a run that breaks keeps what its tasks have finished. The
    next one takes the rows of open chunks alone, by an anti-join with the chunks that stand, and again in one job. A chunk
    without any output has no file; until the whole run has ended (which is noted beside the table) it counts as open.

    With at_once no more than so many tasks work at a time: the rows are staged by chunks first (they are still read once),
    and each job takes so many of the staged folders. That is for work that waits for others, such as a service's answers.

    work gets the rows with ``chunk_id``, keeps that column, and leaves rows in their partitions. n_rows, if it is known,
    saves a look at the numbers.
    """
    log, staged, chunk = f"{out}.finished.json", f"{out}.staged", F.expr(f"int(`{order}` div {chunk_rows})")
    if not storage.exists(spark, log):
        if n_rows is None:
            last = rows.agg(F.max(order)).first()[0]
            n_rows = 0 if last is None else last + 1
        if not n_rows:
            raise ValueError("nothing to do")
        chunks, done = -(-n_rows // chunk_rows), committed(spark, out)
        numbered, tasks = rows.withColumn(CHUNK, chunk), min(chunks, MOST_TASKS)
        if done:
            numbered = numbered.join(spark.createDataFrame([(c,) for c in done], f"{CHUNK} int"), CHUNK, "left_anti").select(*rows.columns, CHUNK)
        dealt = numbered.repartitionById(tasks, F.expr(f"{CHUNK} % {tasks}"))
        if at_once is None:
            if len(done) < chunks:
                append(work(dealt), out)
        else:
            if not storage.exists(spark, f"{staged}/_SUCCESS"):
                dealt.write.mode("overwrite").partitionBy(CHUNK).parquet(staged)
            from_disk, open_ = spark.read.schema(numbered.schema).parquet(staged), sorted(set(range(chunks)) - set(done))
            for first in range(0, len(open_), at_once):
                own = open_[first : first + at_once]
                place = F.array_position(F.array(*[F.lit(c) for c in own]), F.col(CHUNK)) - 1
                append(work(from_disk.filter(F.col(CHUNK).isin(own)).repartitionById(len(own), place.cast("int"))), out)
        schema = spark.read.parquet(out).schema if committed(spark, out) else work(dealt).schema
        storage.write_text(spark, log, json.dumps({"chunks": chunks, "schema": schema.jsonValue()}))
        storage.delete(spark, staged)
    return spark.read.schema(StructType.fromJson(json.loads(storage.read_text(spark, log))["schema"])).parquet(out)


#: Rows of a row group, so that readers of wide rows can take a few at a time.
GROUP_ROWS = 65_536


def published(spark: SparkSession, made: DataFrame, path: str, by: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Writes a table, in folders by a column if one is named. One without rows is an error, found before anything is replaced.

    made is computed once: its rows are counted where they were staged, beside the path, and then moved there.
    """
    if storage.exists(spark, path):
        raise FileExistsError(f"{path} exists")
    staged = f"{path}.staged"
    writer = made.write.mode("overwrite").option("parquet.block.row.count.limit", group_rows)
    (writer.partitionBy(by) if by else writer).parquet(staged)
    if spark.read.schema(made.schema).parquet(staged).isEmpty():
        storage.delete(spark, staged)
        raise ValueError(f"every row of {path} was dropped")
    storage.moved(spark, staged, path)
    return spark.read.schema(made.schema).parquet(path)


def metrics_of_stream(events: DataFrame, every: str, late: str) -> DataFrame:
    """An extension: counts and sums of an event stream (ts, event_type, value) by time windows, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
