"""Vectors (arrays of floats) as column expressions; elements are doubles before any sum."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.columns import let

TINY = 1e-12


def resolve_scale(scale, d: int) -> float | None:
    """None, "raw" and "none" are no scale; "sqrt_d_model" is the root of the width; else a number."""
    if scale is None or isinstance(scale, str) and scale.lower() in ("raw", "none"):
        return None
    return math.sqrt(d) if scale == "sqrt_d_model" else float(scale)


#: Model types whose embedding layer multiplies by the root of the width (fixed values).
SCALED_EMBEDDINGS = ("gemma", "gemma2", "gemma3", "gemma3_text", "t5")


def embedding_scale(model_type: str, d: int) -> float:
    """What a model's embedding layer multiplies its rows by."""
    return math.sqrt(d) if model_type in SCALED_EMBEDDINGS else 1.0


def scaled_embedding(v: Column, model_type: Column) -> Column:
    """Each row's vector as the embedding layer of its model gives it."""
    factor = F.when(model_type.isin(*SCALED_EMBEDDINGS), F.sqrt(F.size(v))).otherwise(1.0)
    return let(factor, lambda f: F.transform(v, lambda x: x.cast("double") * f))


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize(v: Column, scale: float | None) -> Column:
    """v scaled to the norm; zero stays zero, no scale is no change."""
    if scale is None:
        return doubles(v)
    factor = F.greatest(norm(v), F.lit(TINY)) / F.lit(float(scale))
    return let(factor, lambda f: F.transform(v, lambda x: x.cast("double") / f))


def mse(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def reconstruction_mse(pred: Column, gold: Column, scale: float | None) -> Column:
    return mse(normalize(pred, scale), normalize(gold, scale))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def norm_matched_add(h: Column, v: Column) -> Column:
    """h + |h| * v / (|v| + 1e-9)."""
    factor = norm(h) / (norm(v) + F.lit(1e-9))
    return let(factor, lambda f: F.zip_with(h, v, lambda x, y: x.cast("double") + f * y.cast("double")))


def width_checked(v: Column, d: int) -> Column:
    """v, or an error where its width isn't d; variable lists no longer carry it in their type."""
    return F.when(F.size(v) == d, v).otherwise(F.raise_error(F.lit(f"a vector isn't {d} wide")))
