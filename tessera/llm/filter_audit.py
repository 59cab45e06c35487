"""Filter interaction audit: what each of five filters removes, in every order of applying them.

Texts are scanned once, in Arrow buffers: classes of bytes and their prefix sums count words, capitals, code points and
symbols of all texts of a slice at once. Distinct words come from sorted hashes of each document's words; neighbours with
the same hash are compared by their bytes, and a document where two different words share one is counted word by word. So
counts are exact. Each document then is a mask of the filters that it fails. Masks are written with a digest of the text
(SHA-256; equal digests are taken for equal texts), and all that follows needs the masks alone: what is identical to a
lesser document's text fails filter E, and the documents of a part shrink to at most 32 masks with their numbers, from
which every order and step is computed within one row.

A null text is empty and has no words; a null lang is the part ''. Each row is a document by itself: rows with the same id
and text are identical to no lesser id by one another, and a null id is neither lesser than another nor has a lesser one.
A document is good (toxic) if any label of its id says so; null ids have no labels. Other columns are ignored. An
empty table has no parts, so no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import text_scan
from tessera.sources.storage import kept

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
BLANKS, SYMBOLS, CAPITALS = "\t\n\x0b\x0c\r ", "#$%&*|", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_BIT = {f: 1 << i for i, f in enumerate(FILTERS)}

_INSIDE = ~text_scan.byte_class(BLANKS)
_IS_SYMBOL = text_scan.byte_class(SYMBOLS)
#: Code points (bytes that begin one) in the lower half of a number, capitals in the upper, so that one prefix sum has both.
_POINTS_AND_CAPITALS = ((np.arange(256) & 0xC0) != 0x80).astype(np.int64) + (text_scan.byte_class(CAPITALS).astype(np.int64) << 32)


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over each text, by differences of prefix sums."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[offsets])


def repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts, its words that stand earlier in it."""
    hashes = text_scan.word_hashes(data, starts, ends)
    key = (rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    order = np.argsort(key)
    at = np.flatnonzero(key[order][1:] == key[order][:-1])
    a, b = order[at], order[at + 1]
    same = text_scan.verified(data, starts[a], ends[a], data, starts[b], ends[b])
    found = np.bincount(rows[b], minlength=n)
    for row in np.unique(rows[b[~same]]):  # two words with one hash
        own = np.flatnonzero(rows == row)
        found[row] = len(own) - len({data[starts[i] : ends[i]].tobytes() for i in own})
    return found


def masks_of(texts) -> tuple[np.ndarray, list[bytes]]:
    """The bits of the filters A to D that each text of an Arrow array fails, and the digests of the texts."""
    bits, digests = np.zeros(len(texts), dtype=np.int32), []
    for first, end, data, offsets in text_scan.slices(texts):
        n, plain = end - first, data[: offsets[-1]]
        starts, ends, rows = text_scan.spans(data, offsets, _INSIDE)
        words = np.bincount(rows, minlength=n)
        distinct = words - repeats(data, starts, ends, rows, n)
        both = _per_text(_POINTS_AND_CAPITALS[plain], offsets)
        points, capitals = both & 0xFFFFFFFF, both >> 32
        symbols = _per_text(_IS_SYMBOL[plain], offsets)
        failed = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, symbols > 0)
        bits[first:end] = sum(x * _BIT[f] for f, x in zip(FILTERS, failed, strict=False))
        digests += [hashlib.sha256(plain[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return bits, digests


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, bits, digest) of documents (doc_id, text, lang), by one scan of the texts."""
    asked = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bits, digests = masks_of(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits), pa.array(digests, pa.binary())], ["doc_id", "part", "bits", "digest"])

    return asked.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, bits int, digest binary")


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part with the same set of failed filters."""
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = kept(masks(docs), "masks").join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    per_id = joined.groupBy("doc_id", "digest", "part", "bits", "good", "toxic").agg(F.count("*").alias("c"))
    # Copies of a text shrink within the tasks that have them, so one with very many is no task's burden.
    unnamed = F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("unnamed")
    alike = per_id.groupBy("digest", "part", "bits", "good", "toxic").agg(F.sum("c").alias("c"), F.min("doc_id").alias("least"), F.min_by("c", "doc_id").alias("first"), unnamed)
    texts = alike.groupBy("digest").agg(F.min("least").alias("of_all"), F.collect_list(F.struct("part", "bits", "good", "toxic", "c", "least", "first", "unnamed")).alias("x"))
    stay = F.col("unnamed") + F.when(F.col("least") == F.col("of_all"), F.col("first")).otherwise(0)
    split = F.inline(F.array(F.struct(F.lit(0).alias("e"), stay.alias("n")), F.struct(F.lit(_BIT["E"]).alias("e"), (F.col("c") - stay).alias("n"))))
    each = texts.select("of_all", F.inline("x")).select("part", "bits", "good", "toxic", split).filter("n > 0")
    of = lambda label: F.sum(F.when(F.col(label), F.col("n")).otherwise(0)).alias(label)
    return each.groupBy("part", (F.col("bits") + F.col("e")).alias("mask")).agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def _sum(rows: Column, of: str, where) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda a, m: a + F.when(where(m["mask"]), m[of]).otherwise(0))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, filter_order and step (see the query's contract); counts are of documents of the part."""
    parts = counted(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    steps = [F.struct(*[F.lit(x).alias(c) for x, c in zip((order, k + 1, _BIT[order[k]], sum(_BIT[f] for f in order[:k])), ("filter_order", "step", "own", "before"), strict=True)]) for order in ORDERS for k in range(len(order))]
    each = parts.select("part", "m", F.inline(F.array(*steps)))
    own, before, m = F.col("own"), F.col("before"), F.col("m")
    removed = lambda x: (x.bitwiseAND(own) != 0) & (x.bitwiseAND(before) == 0)
    # Of the orders, one in as many as a document fails filters has this filter first among them.
    share = F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + F.when(x["mask"].bitwiseAND(own) != 0, x["n"] * (F.lit(len(ORDERS)) / F.bit_count(x["mask"])).cast("long")).otherwise(0))
    return each.select(
        "part",
        "filter_order",
        "step",
        _sum(m, "n", lambda x: x.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        _sum(m, "n", removed).alias("removed"),
        _sum(m, "n", lambda x: (x.bitwiseAND(own) != 0) & (x.bitwiseAND(before) != 0)).alias("redundant"),
        _sum(m, "n", lambda x: x == own).alias("unique_fails"),
        _sum(m, "good", removed).alias("good_lost"),
        _sum(m, "toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )
