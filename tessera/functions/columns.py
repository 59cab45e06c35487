"""Ways to compute an expression once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``; a large expression that a lambda names would else be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
