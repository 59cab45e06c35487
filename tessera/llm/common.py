"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import let
from tessera.sources.storage import new_path

__all__ = ["ascii_lower", "fresh", "gram_hashes", "let", "once", "split_words", "table", "word_hashes", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII blanks: the space and the controls from tab to carriage return.
BLANKS = r"[\x09-\x0D\x20]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, however often later columns name it.

    Projections are merged by the optimizer, which copies an expression to every
    use of its fields; it doesn't merge them across a generator.
    """
    return df.select(*[f"`{c}`" for c in df.columns if c != name], F.inline_outer(F.array(F.struct(value.alias(name)))))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; pure ASCII texts take the vectorised path."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separators: str = BLANKS) -> Column:
    """The words between separators; null or blank text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, k: int) -> Column:
    """64-bit hashes of the runs of k neighbours, by start; empty if there are fewer than k."""

    def of(x: Column) -> Column:
        last = F.size(x) - F.lit(k)
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(k), *[F.get(x, i + j) for j in range(k)]))

    return let(hashes, of)


def fresh(name: str, taken: list[str]) -> str:
    """The name, or a longer one, that no column has."""
    while name in taken:
        name += "_"
    return name


def written(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df into the shared folder and reads it back, which cuts its lineage."""
    path = new_path(spark, name)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")  # nothing needs the shuffle files of a table that stands
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path), path
