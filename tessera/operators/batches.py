"""Completions from services that take large batches and give results hours later.

What was sent, and what came back, are two tables, so a run can stop and go on at any time. Requests are rows (idx, prompt)
with numbers from 0. Each ``size`` of them are one sub-batch, sent by one task, which notes the service's handle in the table
``sent`` when it commits. ``poll`` fetches what has ended and isn't in the table ``answers`` yet. A request's name is its
number, so results may come in any order and are joined with their requests by it.

A task that is lost between sending and noting would send again. So each sub-batch has a name that follows from the run and
its number, and the service is asked first whether it knows that name.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import corpus
from tessera.streaming import chunks

SIZE, EVERY = 50_000, 30.0
#: Results that a task hands on at once.
ROWS = 5_000


class Service(Protocol):
    def find(self, name: str) -> str | None:
        """The handle of what was sent under a name."""

    def send(self, name: str, requests: list[tuple[str, str]]) -> str:
        """Sends (id, prompt) pairs and gives a handle."""

    def ended(self, handle: str) -> bool: ...

    def fetch(self, handle: str) -> Iterable[tuple[str, str, str | None]]:
        """(id, status, text) in any order; status is "succeeded", "refusal" or one that says what failed."""


def submit(spark: SparkSession, requests: DataFrame, at: str, make: Callable[[], Service], size: int = SIZE) -> DataFrame:
    """The table of what was sent, (name, handle, n, chunk_id), after sending the sub-batches that aren't in it. requests: (idx, prompt)."""
    rows = requests.select(F.col("idx").cast("long"), "prompt")
    n, last, digest = rows.agg(F.count("*"), F.max("idx"), F.sum(F.xxhash64("idx", "prompt") % 1_000_000_007)).first()
    if n != (-1 if last is None else last) + 1:
        raise ValueError("requests must be numbered from 0 on")
    mark = {"rows": n, "size": size, "digest": digest}
    run = hashlib.sha256(json.dumps([at, mark]).encode()).hexdigest()[:16]
    chunks.guarded(spark, f"{at}/sent", mark)

    def send(batches):
        import pyarrow as pa

        held: dict[int, list[tuple[str, str]]] = {}
        for batch in batches:
            for i, prompt, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(chunk, []).append((str(i), prompt or ""))
        service = make() if held else None
        for chunk, own in held.items():
            name = f"{run}-{chunk}"
            handle = service.find(name)
            handle = service.send(name, sorted(own, key=lambda r: int(r[0]))) if handle is None else handle
            yield pa.RecordBatch.from_pydict({"name": [name], "handle": [str(handle)], "n": [len(own)], "chunk_id": pa.array([chunk], pa.int32())})

    return chunks.run(spark, rows, f"{at}/sent", size, lambda df: df.mapInArrow(send, "name string, handle string, n long, chunk_id int"), "idx", n)


def poll(spark: SparkSession, at: str, make: Callable[[], Service]) -> int:
    """Fetches the results of sub-batches that have ended; how many are still open."""
    sent, got = spark.read.parquet(f"{at}/sent"), chunks.committed(spark, f"{at}/answers")
    known = spark.createDataFrame([(c,) for c in got], "chunk_id int")
    waiting = sent.select("chunk_id", "handle").join(known, "chunk_id", "left_anti")
    n = waiting.count()
    if not n:
        return 0

    def fetch(batches):
        import pyarrow as pa

        service = make()
        for batch in batches:
            for chunk, handle in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not service.ended(handle):
                    continue
                held = [(None, "ended", None)]  # so that one without results is known to have ended, too
                for result in service.fetch(handle):
                    held.append((int(result[0]), *result[1:]))
                    if len(held) == ROWS:
                        yield of(chunk, held)
                        held = []
                if held:
                    yield of(chunk, held)

    def of(chunk, held):
        import pyarrow as pa

        columns = [pa.array(x, t) for x, t in zip(zip(*held, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([chunk] * len(held), pa.int32())], ["idx", "status", "text", "chunk_id"])

    dealt = waiting.repartitionById(min(n, chunks.MOST_TASKS), F.expr(f"chunk_id % {min(n, chunks.MOST_TASKS)}"))
    chunks.append(dealt.mapInArrow(fetch, "idx long, status string, text string, chunk_id int"), f"{at}/answers")
    return n - (len(chunks.committed(spark, f"{at}/answers")) - len(got))


def answers(spark: SparkSession, at: str) -> DataFrame:
    """(idx, text) of the requests that succeeded with some text. A sub-batch with failures and no success is an error."""
    found = spark.read.schema("idx long, status string, text string, chunk_id int").parquet(f"{at}/answers").filter("idx IS NOT NULL")
    good = (F.col("status") == "succeeded") & (F.coalesce(T.strip(F.col("text")), F.lit("")) != "")
    counts = found.groupBy("chunk_id").agg(F.count_if(good).alias("good"), F.count_if(~F.col("status").isin("succeeded", "refusal")).alias("failed"))
    if broken := counts.filter("good = 0 AND failed > 0").orderBy("chunk_id").first():
        raise RuntimeError(f"none of the {broken['failed']} requests that sub-batch {broken['chunk_id']} got back succeeded")
    return found.filter(good).select("idx", T.strip(F.col("text")).alias("text"))


def completing(at: str, make: Callable[[], Service], keys: tuple[str, ...], instruction: str = "{text}", text: str = "text", extract: str | None = None, size: int = SIZE, every: float = EVERY) -> Callable[[DataFrame], DataFrame]:
    """A provider for the explanation stage: sends, waits, and adds ``api_explanation``; null without an answer. keys give rows the same order in every run."""
    if "{text}" not in instruction:
        raise ValueError("the instruction has no {text}")

    def provider(rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        numbered = corpus.numbered(rows, *keys, out="_idx")
        submit(spark, numbered.select(F.col("_idx").alias("idx"), T.fill_template(instruction, "{text}", F.coalesce(F.col(text), F.lit(""))).alias("prompt")), at, make, size)
        while poll(spark, at, make):
            time.sleep(every)
        said = T.clean_explanation(F.col("text"), extract) if extract else F.col("text")
        found = answers(spark, at).select(F.col("idx").alias("_idx"), said.alias("api_explanation"))
        return numbered.join(found, "_idx", "left").drop("_idx")

    return provider
