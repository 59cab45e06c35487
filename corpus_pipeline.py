"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last give the columns of
documents; other columns of the input go, whatever their names. Null, empty and blank texts go in the first stage; short
ones stay. Rows equal in id and text are one document from the second stage on, rows with one id but different texts are
different ones, and null ids are allowed. Of documents that tie, the least id stays, then the least hash of the text. An
empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, ngram_join, packing, pii, quality_rules
from tessera.llm.common import table, written
from tessera.llm.queries import END_ID, tokenizer
from tessera.sources.storage import cleared, dropped, standing

#: Without the rule on few words, which clean documents break, too.
POLICY = "web-3"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    return quality_rules.apply_policy(quality_rules.ledger(docs.select(*COLUMNS)), POLICY).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, that of the least id stays."""
    return ngram_join.deduplicate(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by the name of its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences, with their ids."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), END_ID, with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("packing", pack),
]
#: SQL has no tokenizers, so the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage needed, and its input, is removed once its output stands."""
    docs, before = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES:
        mark = standing()
        docs, path = written(spark, stage(spark, docs, sf_dir), name)
        cleared(spark, mark, but=(path,))
        dropped(spark, *before)
        before = (path,)
    return docs
