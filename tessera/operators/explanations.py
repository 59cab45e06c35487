"""The explanation stage: cached explanations, misses to a provider, filtering, and training tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.providers import spread
from tessera.sources import storage


def cached(rows: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """rows with ``api_explanation`` from the cache, keyed by the text's sha256; null where it has none.

    cache: (text, api_explanation, file_ord, row_ord). Of repeated texts the last row of the last file wins.
    """
    last = cache.groupBy(F.sha2("text", 256).alias("_key")).agg(F.max_by("api_explanation", F.struct("file_ord", "row_ord")).alias("api_explanation"))
    return rows.withColumn("_key", F.sha2(text, 256)).join(last, "_key", "left").drop("_key")


def misses(rows: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """rows that the cache has no explanation for."""
    return cached(rows, cache, text).filter("api_explanation IS NULL").drop("api_explanation")


def enough_features(explanation: str | Column, least: int = T.MIN_FEATURES) -> Column:
    e = F.col(explanation) if isinstance(explanation, str) else explanation
    return e.isNotNull() & (T.n_features(e) >= least)


def explain(
    rows: DataFrame,
    cache: DataFrame,
    provider: Callable[[DataFrame], DataFrame],
    text: str = "text",
    put: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame] | None = None,
) -> DataFrame:
    """Cached explanations and, for misses, those of the provider (a function that adds ``api_explanation``), cleaned of weak rows.

    The provider's answers are written before anything reads them, so that each miss is asked for once; put(misses, provider)
    does that (``chunks.run`` makes it restartable), by default into the shared folder. The filter applies to hits, too.
    """
    put = put or (lambda asked, answer: storage.kept(answer(spread(asked, answer)), "answers"))
    flagged = cached(rows, cache, text)
    asked = put(flagged.filter("api_explanation IS NULL").drop("api_explanation"), provider)
    return flagged.filter("api_explanation IS NOT NULL").unionByName(asked).filter(enough_features("api_explanation"))


def failure_rates(answers: DataFrame, *by: str, limit: float = 0.2) -> DataFrame:
    """(by, rate, broken): the share of answers that failed after all retries, and whether it is over the limit. Refusals don't count."""
    rate = F.coalesce(F.avg((F.col("status") == "failed").cast("double")), F.lit(0.0))
    return answers.groupBy(*by).agg(rate.alias("rate"), (rate > limit).alias("broken"))


def failure_rate(answers: DataFrame, limit: float = 0.2) -> float:
    """The share of all answers that failed; more than the limit is an error."""
    rate, broken = failure_rates(answers, limit=limit).first()
    if broken:
        raise RuntimeError(f"{rate:.1%} of the answers failed")
    return rate


def messages(content: str) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), F.lit(content).alias("content")))


PROVENANCE = ("n_raw_tokens", "activation_layer", "doc_id")


def build(rows: DataFrame, stage: str, actor: str, critic: str = "", keep_text: bool = False, encode: Callable[[Column], Column] | None = None, suffix: list | None = None) -> DataFrame:
    """Training tables of a stage: av_sft (prompt, response), ar_sft (a filled critic prompt) or rl (a prompt).

    encode gives the ids of a prompt; with it, each critic prompt must end in the ids of ``suffix``, as training reads its
    last place (a tokenizer may join a text's end to the template's).
    """
    debug = ["detokenized_text_truncated"] if keep_text and "detokenized_text_truncated" in rows.columns else []
    kept = ["activation_vector", *PROVENANCE, *debug]
    need = {"av_sft": ["api_explanation"], "ar_sft": ["api_explanation"], "rl": []}[stage]
    if missing := [c for c in (*need, "activation_vector", *PROVENANCE) if c not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    if stage == "av_sft":
        return rows.select(messages(actor).alias("prompt"), T.wrap_explanation(F.col("api_explanation")).alias("response"), *kept)
    if stage == "rl":
        return rows.select(messages(actor).alias("prompt"), *kept)
    if "{explanation}" not in critic:
        raise ValueError("the critic's template has no {explanation}")
    prompt = T.fill_template(critic, "{explanation}", F.col("api_explanation"))
    if encode is not None:
        if not suffix:
            raise ValueError("no suffix to look for")
        prompt = F.when(ends_in(encode(prompt), suffix), prompt).otherwise(F.raise_error(F.lit("a prompt doesn't end in the suffix")))
    return rows.select(prompt.alias("prompt"), *kept)


def ends_in(ids: Column, suffix: list) -> Column:
    """Whether ids end in the suffix."""
    n = len(suffix)
    return F.when(F.size(ids) >= n, F.slice(ids, F.greatest(F.size(ids) - n, F.lit(0)) + 1, F.lit(n)) == F.array(*[F.lit(x) for x in suffix])).otherwise(F.lit(False))


def within_length(rows: DataFrame, ids: str, longest: int, required: bool = False) -> DataFrame:
    """Rows with 1 to ``longest`` ids: to cut a critic prompt on the right would cut its suffix. required: none left is an error."""
    kept = rows.filter(F.size(ids).between(1, longest))
    if required and kept.isEmpty():
        raise ValueError(f"no row has from 1 to {longest} ids")
    return kept


def with_explanation(rows: DataFrame, response: str, out: str = "explanation") -> DataFrame:
    """rows with the explanation of their response; those without one are passed over."""
    return rows.withColumn(out, T.extract_explanation(F.col(response))).filter(F.col(out).isNotNull())
