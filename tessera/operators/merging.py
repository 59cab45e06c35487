"""Shards of one corpus put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.sidecar import DatasetMeta, Slice, base_id, replaced

#: What all shards must have in common.
ORIGIN = ("stage", "base_model", "layer_index", "d_model", "norm", "corpus", "positions_per_doc")
_SHARD = "shard int, dataset_id string, row_count long, start long, length long, " + ", ".join(f"{c} string" for c in ORIGIN)


def gaps(shards: DataFrame) -> DataFrame:
    """shards (shard, start, length) whose successor doesn't begin where they end; a table of shards, so one task will do."""
    following = F.lead("start").over(Window.orderBy("start"))
    return shards.withColumn("expected", F.col("start") + F.col("length")).withColumn("actual", following).filter("actual <> expected")


def described(spark: SparkSession, metas: list[DatasetMeta]) -> DataFrame:
    """A table of shards from their metadata, by their places in the list."""
    rows = [
        (i, m.dataset_id, m.row_count, m.extraction.corpus_slice.start, m.extraction.corpus_slice.length, m.stage, *(str(getattr(m.extraction, c)) for c in ORIGIN[1:]))
        for i, m in enumerate(metas)
    ]
    return spark.createDataFrame(rows, _SHARD)


def whole(shards: DataFrame) -> dict:
    """The slice, the rows and the order of shards that fit together; an error says what doesn't."""
    kinds = [F.sort_array(F.collect_set(c)).alias(c) for c in ORIGIN]
    found = shards.agg(*kinds, F.min("start").alias("start"), F.sum("length").alias("length"), F.sum("row_count").alias("rows"), F.sort_array(F.collect_list(F.struct("start", "shard", "dataset_id"))).alias("order")).first()
    if mixed := {c: found[c] for c in ORIGIN if len(found[c]) != 1}:
        raise ValueError(f"shards differ: {mixed}")
    if found["stage"] != ["base"]:
        raise ValueError(f"shards of {found['stage']}, not base")
    if broken := gaps(shards).select("dataset_id", "expected", "actual").collect():
        raise ValueError(f"gaps or overlaps: {[tuple(b) for b in broken]}")
    return {"slice": Slice(found["start"], found["length"]), "rows": found["rows"], "order": [x["shard"] for x in found["order"]], "parents": [x["dataset_id"] for x in found["order"]]}


def merge(shards: list[tuple[DataFrame, DatasetMeta]]) -> tuple[DataFrame, DatasetMeta]:
    """One table of shards that agree in origin and follow each other without gap or overlap, and its metadata."""
    tables, metas = zip(*shards, strict=True)
    fit = whole(described(tables[0].sparkSession, list(metas)))
    merged = reduce(DataFrame.unionByName, (tables[i] for i in fit["order"]))
    if (rows := merged.count()) != fit["rows"]:
        raise ValueError(f"{rows} rows, but the sidecars say {fit['rows']}")
    origin = replaced(metas[0]).extraction
    origin = type(origin)(**{**vars(origin), "corpus_slice": fit["slice"]})
    return merged, replaced(metas[0], dataset_id=base_id(origin), row_count=rows, extraction=origin, parent_datasets=fit["parents"])
