"""A judge's run: tasks from explanations and sources, asked in chunks before a deadline, to scores and their summary."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation, providers
from tessera.sources import corpus
from tessera.streaming import chunks

SECONDS, CHUNK_ROWS = 600.0, 2_000


def judge(ask: Callable[[str], tuple[str, str]]) -> Callable[..., providers.Concurrent]:
    """A provider of one-line answers: whatever goes wrong with a task, it alone has none."""
    return lambda width=64: providers.Concurrent(ask, width, (Exception,), 1.0)


def scores(
    spark: SparkSession,
    rows: DataFrame,
    out: str,
    make: Callable[..., providers.Provider],
    k: int = evaluation.OPTIONS,
    seed: int = 0,
    seconds: float = SECONDS,
    chunk_rows: int = CHUNK_ROWS,
    bound: providers.Bound | None = None,
) -> DataFrame:
    """(i, dim, score, hit) of rows (i, explanation, source), for ``evaluation.judge_summary``.

    Answers are written to out by chunks; a run that broke goes on with the open ones, and each run has ``seconds``. What
    isn't answered by then has null scores, as failed tasks do, so a slow service makes a round poorer, not longer.
    """
    until = time.time() + seconds
    jobs = corpus.numbered(evaluation.judge_jobs(rows, k, seed), "i", "dim")
    n, digest = jobs.agg(F.count("*"), F.sum(F.xxhash64("row_idx", "prompt") % 1_000_000_007)).first()
    if not n:
        return evaluation.judge_scores(jobs.withColumn("answer", F.lit(None).cast("string")), k)
    chunks.guarded(spark, out, {"rows": n, "digest": digest, "chunk_rows": chunk_rows})
    ask = providers.asking(make, text="prompt", out="answer", bound=bound, until=until)
    answered = chunks.run(spark, jobs, out, chunk_rows, ask, n_rows=n, at_once=bound.tasks if bound else None)
    return evaluation.judge_scores(answered, k)
