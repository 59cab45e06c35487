"""Scalars of training: rewards, penalties, divergences, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FAILED_REWARD = -2.0
#: Default weights of the divergence term by estimator (fixed values).
KL_WEIGHTS = {"k3": 0.01, "dist": 0.2}


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def reward(mse: Column, truncated: Column | None = None) -> Column:
    """-mse; null where it isn't finite or the text was cut off."""
    good = _finite(mse)
    return F.when(good & ~truncated if truncated is not None else good, -mse)


def filled_reward(r: Column, log_mode: bool = False) -> Column:
    if log_mode:
        # greatest() passes over nulls, so they are told apart first
        return F.when(r.isNotNull(), -F.ln(F.least(F.greatest(-r, F.lit(1e-3)), F.lit(2.0)))).otherwise(F.lit(-math.log(2)))
    return F.coalesce(r, F.lit(FAILED_REWARD))


def penalty_threshold(cap: int) -> int:
    return max(1, cap - 64)


def length_penalty(n_tokens: Column, weight: float, threshold: int) -> Column:
    return F.lit(weight) * F.greatest(F.lit(0), n_tokens - threshold)


def k3(new: Column, ref: Column) -> Column:
    delta = F.least(ref - new, F.lit(12.0))
    return F.exp(delta) - delta - 1


def token_loss(advantage: Column, logp: Column, kl: Column, weight: float) -> Column:
    return -(advantage * logp - F.lit(weight) * kl)


def kl_weight(given: float | None, estimator: str) -> float:
    return KL_WEIGHTS[estimator] if given is None else given


def learning_rate(step: Column, base: float, warmup: int, total: int, least: float) -> Column:
    """Linear warm-up, then a cosine down to the given share."""
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(max(1, total - warmup)).cast("double"))
    cosine = F.lit(least) + F.lit(1 - least) * F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * progress))
    return F.when(step < warmup, F.lit(base) * step / F.lit(float(max(1, warmup)))).otherwise(F.lit(base) * cosine)


def holdout_permille(rows: Column, total: Column) -> Column:
    """About rows of total in thousandths, from 1 to 500; halves go to even numbers."""
    share = F.bround(F.lit(1000.0) * rows / F.greatest(F.lit(1), total)).cast("long")
    return F.greatest(F.lit(1), F.least(F.lit(500), share))


def default_layer(layers: Column) -> Column:
    return F.floor(layers * 2 / 3)


def train_perplexity(mean_loss: Column) -> Column:
    """Of a training step, whose exponent is bounded instead."""
    return F.exp(F.least(F.lit(20.0), mean_loss))


def perplexity(mean_loss: Column) -> Column:
    return F.when(mean_loss >= 30, F.lit(float("inf"))).otherwise(F.exp(mean_loss))
