"""Completion providers: prompts in, completions out, in the same order.

A provider has ``complete(prompts)``, which gives a text for each prompt, or None where it gave up on one. How it asks
its service is the caller's function, so nothing here knows a network. Providers run inside tasks, on one Arrow batch at
a time, and are sent there whole; what they hold must be picklable. Services that take whole batches are in ``batches``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: More failures than this share of a batch are the service's fault, not the prompts'; refusals don't count.
MOST_FAILED = 0.2


class Provider(Protocol):
    def complete(self, prompts: list[str]) -> list[str | None]: ...


def checked(provider: Provider, prompts: list[str], until: float | None = None) -> list[str | None]:
    """The provider's answers, if there are as many as prompts and none is empty or anything but text."""
    found = list(provider.complete(prompts) if until is None else provider.complete(prompts, until)) if prompts else []
    if len(found) != len(prompts):
        raise ValueError(f"{len(found)} answers for {len(prompts)} prompts")
    for at, answer in enumerate(found):
        if answer is not None and not (isinstance(answer, str) and answer):
            raise ValueError(f"answer {at} is {answer!r}, neither text nor None")
    return found


@dataclass(frozen=True)
class Bound:
    """At most ``calls`` requests in flight over all of a stage, as ``tasks`` tasks that share them. A speculative copy of a task would add its share."""

    calls: int
    tasks: int

    def __post_init__(self):
        if not 0 < self.tasks <= self.calls:
            raise ValueError("there must be a call for each task")

    @property
    def width(self) -> int:
        return self.calls // self.tasks


class Concurrent:
    """Asks for each prompt by itself, ``width`` at a time.

    ask(prompt) gives (stop, text), stop being "end", "length" or "refusal". A refusal gives None. Errors of the
    ``tolerated`` kinds (the service's, after its own retries) give None, too, but more of them than the share
    ``most_failed`` are an error, as is any other exception, stop or blank text. What has no answer at the time ``until``
    (seconds since the epoch) gets None and isn't waited for.
    """

    def __init__(self, ask: Callable[[str], tuple[str, str]], width: int = 32, tolerated: tuple = (ConnectionError, TimeoutError), most_failed: float = MOST_FAILED):
        self.ask, self.width, self.tolerated, self.most_failed = ask, width, tolerated, most_failed

    def _one(self, prompt: str, until: float | None) -> tuple[bool, str | None]:
        if until is not None and time.time() >= until:
            return False, None
        try:
            stop, text = self.ask(prompt)
        except self.tolerated:
            return True, None
        if stop == "refusal":
            return False, None
        if stop not in ("end", "length") or not text.strip():
            raise ValueError(f"an answer stopped by {stop!r} with {len(text.strip())} characters")
        return False, text.strip()

    def complete(self, prompts: list[str], until: float | None = None) -> list[str | None]:
        pool = ThreadPoolExecutor(self.width)
        try:
            asked = [pool.submit(self._one, p, until) for p in prompts]
            wait(asked, None if until is None else max(0.0, until - time.time()))
            found = [f.result() if f.done() else (False, None) for f in asked]
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        if (failed := sum(f for f, _ in found)) > self.most_failed * len(prompts):
            raise RuntimeError(f"{failed} of {len(prompts)} requests failed")
        return [text for _, text in found]


def asking(
    make: Callable[..., Provider],
    instruction: str = "{text}",
    text: str = "text",
    extract: str | None = None,
    out: str = "api_explanation",
    bound: Bound | None = None,
    until: float | None = None,
) -> Callable[[DataFrame], DataFrame]:
    """A provider for a stage: adds a column of answers (``api_explanation``) to rows.

    make builds the provider inside a task. The instruction holds ``{text}`` once or more; extract is the pattern whose
    first group is cleaned up (None takes answers as they are). Rows without an answer, or without a match, get null.
    With a bound make gets the width of a task's share, and whoever runs the stage must give it no more tasks than the bound
    has (``chunks.run(at_once=...)``, or ``spread``). With until, complete() gets the time after which nothing is asked.
    """
    if "{text}" not in instruction:
        raise ValueError("the instruction has no {text}")

    def provider(rows: DataFrame) -> DataFrame:
        asked = rows.withColumn("_prompt", T.fill_template(instruction, "{text}", F.coalesce(F.col(text), F.lit(""))))
        names = asked.columns

        def run(batches):
            import pyarrow as pa

            with_answers = None
            for batch in batches:
                with_answers = with_answers or (make(bound.width) if bound else make())
                found = checked(with_answers, batch.column(names.index("_prompt")).to_pylist(), until)
                kept = [i for i, n in enumerate(names) if n != "_prompt"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(found, pa.string())], [*(names[i] for i in kept), "_answer"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "_answer string"])
        answered = asked.mapInArrow(run, schema)
        said = T.clean_explanation(F.col("_answer"), extract) if extract else F.col("_answer")
        return answered.withColumn(out, said).drop("_answer")

    provider.bound = bound
    return provider


def spread(rows: DataFrame, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows in as many partitions as a provider's bound has tasks, if it has one."""
    bound = getattr(provider, "bound", None)
    return rows.repartition(bound.tasks) if bound else rows
