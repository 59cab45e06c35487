"""Rollout analytics: masks, advantages, divergences of whole logit arrays, step metrics and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import training as R


def marker_well_formed(ids: Column, marker: int, left: int, right: int) -> Column:
    """Exactly one marker in all, with its neighbours."""
    return (F.size(F.filter(ids, lambda t: t == marker)) == 1) & (F.size(valid_markers(ids, marker, left, right)) == 1)


def valid_markers(ids: Column, marker: int, left: int, right: int) -> Column:
    """Positions of markers with their neighbours; other markers don't count."""

    def at(t, i):
        return F.when((t == marker) & (F.get(ids, i - 1) == left) & (F.get(ids, i + 1) == right), i)

    return F.filter(F.transform(ids, at), lambda i: i.isNotNull())


def trimmed_at_stop(ids: Column, stops: list[int]) -> Column:
    """ids up to and with the first stop token."""
    first = F.least(*[F.nullif(F.array_position(ids, s), F.lit(0).cast("long")) for s in stops], F.lit(2**31 - 1).cast("long"))
    return F.slice(ids, F.lit(1), F.least(first, F.size(ids).cast("long")).cast("int"))


def is_truncated(ids: Column, cap: int, stops: list[int]) -> Column:
    return (F.size(ids) >= cap) & ~F.element_at(ids, -1).isin(stops)


def group_advantage(rows: DataFrame, group: str, reward: str, ok: str) -> DataFrame:
    """rows with ``advantage`` (reward - mean) / (sd + 1e-6) over the group's rows that are ok; others get 0, a group of one has sd 1."""
    w = Window.partitionBy(group)
    good = F.when(F.col(ok), F.col(reward))
    deviation = F.coalesce(F.stddev_samp(good).over(w), F.lit(1.0))
    return rows.withColumn("advantage", F.when(F.col(ok), (F.col(reward) - F.avg(good).over(w)) / (deviation + 1e-6)).otherwise(0.0))


def _pairs_of(logits, others):
    """For each row two arrays of doubles; None for a null row, or for rows of other widths."""
    import numpy as np

    def rows(column):
        flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().fill_null(0).to_numpy()
        ends = np.cumsum(sizes)
        return [None if null else flat[end - size : end] for null, end, size in zip(column.is_null().to_pylist(), ends, sizes, strict=True)]

    for a, b in zip(rows(logits), rows(others), strict=True):
        yield (a, b) if a is not None and b is not None and len(a) == len(b) > 0 else None


def _log_probabilities(x):
    """x less its log-sum-exp, shifted by the greatest so that nothing overflows."""
    import numpy as np

    top = x.max()
    return x - (top + np.log(np.exp(x - top).sum()))


def _first_best(x, k: int):
    """Places of the k greatest, of equal ones the first; by selection, without sorting the rest."""
    import numpy as np

    if k >= len(x):
        return np.arange(len(x))
    least = np.partition(x, len(x) - k)[len(x) - k]
    over = np.flatnonzero(x > least)
    return np.concatenate([over, np.flatnonzero(x == least)[: k - len(over)]])


def divergence(logits: Column, others: Column) -> Column:
    """(kl, entropy) of a token's whole array of logits: of the softmax against that of others, and of the first alone, in nats.

    One row at a time in Arrow batches (of bounded bytes); null where an array is null or empty, or their widths differ.
    """

    def run(logits, others):
        import numpy as np
        import pyarrow as pa

        kl, entropy = [], []
        for pair in _pairs_of(logits, others):
            lp, lq = (_log_probabilities(x) for x in pair) if pair else (np.full(1, np.nan),) * 2
            p = np.exp(lp)
            kl.append((p * (lp - lq)).sum() if pair else None)
            entropy.append(-(p * lp).sum() if pair else None)
        return pa.StructArray.from_arrays([pa.array(kl, pa.float64()), pa.array(entropy, pa.float64())], ["kl", "entropy"])

    return F.arrow_udf(run, "kl double, entropy double")(logits, others)


def coarsened_divergence(logits: Column, others: Column, k: int) -> Column:
    """The divergence over the k best entries by logits (of equal ones the first) and one bucket for all others, each tail at least 1e-9."""

    def run(logits, others):
        import numpy as np
        import pyarrow as pa

        out = []
        for pair in _pairs_of(logits, others):
            if not pair:
                out.append(None)
                continue
            best = _first_best(pair[0], k)
            lp, lq = (_log_probabilities(x)[best] for x in pair)
            p, q = np.exp(lp), np.exp(lq)
            rest, other_rest = max(1e-9, 1 - p.sum()), max(1e-9, 1 - q.sum())
            out.append((p * (lp - lq)).sum() + rest * np.log(rest / other_rest))
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(logits, others)


def _or_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(float("nan")))


def step_metrics(rows: DataFrame, step: str = "step") -> DataFrame:
    """One row per step: population deviation for rewards (those that are not null; NaN without any), sample deviation for all advantages.

    Counts of failed injections (cjk), broken markers (marker_ok) and the share of responses over the length threshold come
    with the columns cjk_fail, marker_ok and penalty.
    """
    r = F.col("reward")
    return rows.groupBy(step).agg(
        _or_nan(F.avg(r)).alias("reward_mean"),
        _or_nan(F.stddev_pop(r)).alias("reward_std"),
        _or_nan(F.min(r)).alias("reward_min"),
        _or_nan(F.max(r)).alias("reward_max"),
        F.avg("advantage").alias("advantage_mean"),
        F.stddev_samp("advantage").alias("advantage_std"),
        F.avg(r.isNotNull().cast("double")).alias("extraction_rate"),
        F.avg(F.col("truncated").cast("double")).alias("frac_cut_off"),
        F.count_if(~F.col("ok")).alias("masked_count"),
        F.avg("n_tokens").alias("resp_len"),
        F.avg("penalty").alias("penalty_mean"),
        F.avg((F.col("penalty") > 0).cast("double")).alias("overage_frac"),
        F.count_if("cjk_fail").alias("inject_fail_count"),
        F.count_if(~F.col("marker_ok")).alias("marker_bad_count"),
        F.count_if("truncated").alias("truncated_count"),
    )


def counter_deltas(rows: DataFrame, counter: str, order: str, *by: str) -> DataFrame:
    """rows with ``delta``, what a running counter of each source (``by``) gained since its row before; a reset gives 0, a first row null."""
    if not by:
        raise ValueError("name the columns that tell sources apart")
    gained = F.col(counter) - F.lag(counter).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("delta", F.when(gained.isNotNull(), F.greatest(F.lit(0), gained)))


def with_activations(rows: DataFrame, prompts: DataFrame, key: str, default: dict | None = None) -> DataFrame:
    """rollouts with the columns of their prompt; rollouts of an unknown prompt stay, with the defaults."""
    joined = rows.join(prompts, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(x)) for c, x in (default or {}).items()})


#: A response with a larger share of CJK characters is taken for a failed injection (a fixed value).
MOST_CJK = 0.05


def injection_ok(cjk_fraction: Column, well_formed: Column) -> Column:
    return (cjk_fraction <= MOST_CJK) & well_formed


def token_weighted_loss(rows: DataFrame, loss: str, tokens: str, *by: str, budget: float | None = None) -> DataFrame:
    """(by, loss, ppl, train_ppl[, budget_loss]): the mean loss by tokens; perplexities with the bounds of evaluation and training; with a budget of tokens, the sum over it."""
    mean = F.sum(F.col(loss) * F.col(tokens)) / F.greatest(F.sum(tokens), F.lit(1))
    extra = [(F.sum(loss) / F.lit(float(budget))).alias("budget_loss")] if budget else []
    return rows.groupBy(*by).agg(mean.alias("loss"), R.perplexity(mean).alias("ppl"), R.train_perplexity(mean).alias("train_ppl"), *extra)


def throughput(rows: DataFrame, tokens: Column, rollout_seconds: Column, score_seconds: Column, *by: str) -> DataFrame:
    """(by, tokens_per_s, rollouts_per_s, rollout_share): tokens over the rollout's time, rows over the scoring's, the rollout's share of both."""
    r, s = F.sum(rollout_seconds), F.sum(score_seconds)
    return rows.groupBy(*by).agg((F.sum(tokens) / r).alias("tokens_per_s"), (F.count("*") / s).alias("rollouts_per_s"), (r / (r + s)).alias("rollout_share"))


def phase_seconds(marks: DataFrame, phase: str, at: str, *by: str) -> DataFrame:
    """(by, phase, seconds, share): how long each phase of a step took, from marks that say when one begins (timestamps); the last mark ends the step.

    A phase that is begun several times is summed up; share is of the whole step. Marks of one time keep the order of their names.
    """
    if not by:
        raise ValueError("name the columns that tell steps apart")
    w = Window.partitionBy(*by).orderBy(at, phase)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    spent = (F.lead(micros).over(w) - micros) / F.lit(1e6)
    each = marks.select(*by, F.col(phase).alias("phase"), spent.alias("spent")).filter("spent IS NOT NULL")
    sums = each.groupBy(*by, "phase").agg(F.sum("spent").alias("seconds"))
    whole = F.sum("seconds").over(Window.partitionBy(*by))
    return sums.withColumn("share", F.when(whole > 0, F.col("seconds") / whole))
