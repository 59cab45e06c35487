"""Ranked lexical search by a two-level index with quantised impacts.

Items are asked in blocks whose terms have a bound, so what tasks get of them has one, too. For each block the documents
are scanned once, in Arrow buffers, and a row for each is written: its number of terms and the numbers (``tf``) of those
terms that the block asks for, found by hash and verified by their bytes. Totals over that table give N, L and each term's
df, hence its weight.

The search reads the table. A term's impact in a document is a whole number below 1,000,000. The first level is that
number in steps of 1/255, rounded up to a byte: sums of bytes times weights bound scores from above, and with one less for
each term that a document has, from below. Every document whose upper bound reaches the k-th lower bound that the task has
met so far is scored by the second level, the exact integers. A task's k-th lower bound is at most that of all, so none of
the best is missed. Each task gives its k best for each item; these are merged in two steps.

A null or empty text has no terms, and such a document no score. Items with one id (null, too) are one, with the terms of
all their texts. Each row of the documents is ranked by itself, repeated rows included; a null doc_id comes after any
other of the same score. Other columns are ignored. Without documents, or items, nothing is found.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import text_scan
from tessera.llm.common import ascii_lower, split_words
from tessera.sources.storage import kept

#: What separates terms, as bytes: all ASCII characters but digits and letters.
_TERM = ~text_scan.byte_class("".join(c for c in map(chr, range(128)) if not c.isalnum()))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, LEVELS = 1_000_000, 255
#: Terms of a block's items with repeats (a longer item is a block by itself), and places of a matrix of terms by documents.
BLOCK_TERMS, PLACES = 50_000, 8_000_000
#: Groups of tasks whose best are merged first.
GROUPS = 64


class Vocabulary:
    """Terms that are looked up among the words of texts."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
        self.data = np.concatenate([np.frombuffer(b"".join(raw), dtype=np.uint8), np.zeros(text_scan.PAD, dtype=np.uint8)])
        self.starts, self.ends = ends - [len(t) for t in raw], ends
        hashes = text_scan.word_hashes(self.data, self.starts, self.ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms) of the words that are terms."""
        asked = text_scan.word_hashes(data, starts, ends)
        at = np.searchsorted(self.hashes, asked)
        found, words = [], np.flatnonzero(at < len(self.hashes))
        while len(words):  # again only for terms that share a hash
            words = words[self.hashes[at[words]] == asked[words]]
            term = self.order[at[words]]
            same = text_scan.verified(data, starts[words], ends[words], self.data, self.starts[term], self.ends[term])
            found.append((words[same], term[same]))
            words = words[~same]
            at[words] += 1
            words = words[at[words] < len(self.hashes)]
        return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (words, words)


def _postings_of(texts, vocabulary: Vocabulary):
    """(numbers of terms, lists of term ids, lists of their tf) for an Arrow array of texts."""
    import pyarrow as pa

    counts, sizes, terms, numbers = [], [], [], []
    for first, end, data, offsets in text_scan.slices(texts):
        data, n = _LOWER[data], end - first
        starts, ends, rows = text_scan.spans(data, offsets, _TERM)
        counts.append(np.bincount(rows, minlength=n))
        words, found = vocabulary.find(data, starts, ends)
        keys, tf = np.unique(rows[words].astype(np.int64) * (len(vocabulary.order) + 1) + found, return_counts=True)
        sizes.append(np.bincount(keys // (len(vocabulary.order) + 1), minlength=n))
        terms.append(keys % (len(vocabulary.order) + 1))
        numbers.append(tf)
    ends = pa.array(np.concatenate([[0], *sizes]).cumsum().astype(np.int32))
    flat = lambda x, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([[], *x]).astype(np.int64), kind))
    return pa.array(np.concatenate([[], *counts]).astype(np.int64)), flat(terms, pa.int32()), flat(numbers, pa.int32())


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs): of each document the number of terms, and those of the list that it has, with their numbers."""
    vocabulary = Vocabulary(terms)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_postings_of(batch.column(1), vocabulary)], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Best:
    """The k best documents of one item so far, and what an upper bound must reach."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, k: int):
        self.terms, self.weights, self.k = terms, weights, k
        self.lower = np.zeros(0)
        self.scores, self.ids = np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64)

    def _least(self) -> float:
        """The k-th lower bound, or a better one from the k-th score; in units of SCALE / LEVELS."""
        bounds = [self.lower.min()] if len(self.lower) == self.k else []
        if len(self.scores) == self.k:
            bounds.append(self.scores[-1] * LEVELS // SCALE)
        return max([0, *bounds])

    def take(self, bytes_: np.ndarray, tfs: np.ndarray, m: np.ndarray, ids: np.ndarray) -> None:
        """Documents as columns of the two levels."""
        rough = bytes_[self.terms]
        upper = self.weights @ rough.astype(np.float64)  # whole numbers below 2**53
        lower = upper - self.weights @ (rough > 0).astype(np.float64)
        some = np.flatnonzero((upper > 0) & (lower > (self.lower.min() if len(self.lower) == self.k else -1)))
        if len(some):
            self.lower = np.sort(np.concatenate([self.lower, lower[some]]))[-self.k :]
        reaching = np.flatnonzero((upper > 0) & (upper >= self._least()))
        if not len(reaching):
            return
        tf = tfs[self.terms][:, reaching].astype(np.int64)
        exact = (self.weights.astype(np.int64)[:, None] * ((1000 * SCALE * tf) // (1000 * tf + 8 * m[reaching]))).sum(axis=0)
        good = exact > 0
        scores, ids = np.concatenate([self.scores, exact[good]]), np.concatenate([self.ids, ids[reaching[good]]])
        order = np.lexsort((ids[:, 1], ids[:, 0], -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _ranked(rows: DataFrame, k: int, *by: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)


def _of_block(docs: DataFrame, items: list[tuple[int, list[str]]], k: int) -> DataFrame | None:
    """(item, doc_id, score) of each task's best."""
    terms = sorted({t for _, own in items for t in own})
    if not terms:
        return None
    index = kept(postings(docs, terms), "postings")
    totals = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = totals[0], totals[1] or 0
    if not n_docs:
        return None
    df = np.zeros(len(terms), dtype=np.int64)
    for term, c in index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row for each term of the block at most
        df[term] = c
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.float64)
    place = {t: i for i, t in enumerate(terms)}
    asked = [(item, np.array([i for t in own if df[i := place[t]]], dtype=np.int64)) for item, own in items]

    def run(batches):
        import pyarrow as pa

        best = [(item, Best(own, weights[own], k)) for item, own in asked if len(own)]
        for batch in batches:
            n, ids = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0)
            keys = np.stack([ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()], axis=1)
            m = 10 + (90 * n * n_docs) // n_terms
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            step = max(16, PLACES // len(weights))
            for a in range(0, len(n), step):
                b = min(len(n), a + step)
                own = slice(ends[a], ends[b])
                at, row, tfs = np.repeat(np.arange(b - a), sizes[a:b]), flat[own], tf[own].astype(np.int64)
                exact, rough = np.zeros((len(weights), b - a), dtype=np.int32), np.zeros((len(weights), b - a), dtype=np.uint8)
                exact[row, at] = tfs
                rough[row, at] = -(-((1000 * SCALE * tfs) // (1000 * tfs + 8 * m[a:b][at])) * LEVELS // SCALE)
                for _, found in best:
                    found.take(rough, exact, m[a:b], keys[a:b])
        rows = [(item, found) for item, found in best if len(found.scores)]
        if rows:
            of = lambda name: np.concatenate([getattr(found, name) for _, found in rows])
            ids = of("ids")
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([item for item, _ in rows], [len(f.scores) for _, f in rows])), pa.array(ids[:, 1], mask=ids[:, 0] > 0), pa.array(of("scores"))], ["item", "doc_id", "score"])

    found = index.filter(F.size("terms") > 0).mapInArrow(run, "item long, doc_id long, score long")
    return _ranked(found.withColumn("_group", F.spark_partition_id() % GROUPS), k, "item", "_group").drop("_group", "rank")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    terms = F.array_distinct(F.flatten(F.collect_list(split_words(ascii_lower(F.col("text")), SEPARATORS))))
    each = kept(items.groupBy("item_id").agg(terms.alias("terms")).withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = -(-2 * (each.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for b in range(blocks):
        own = each.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "terms").toLocalIterator()
        made = _of_block(docs, [(r["item"], r["terms"]) for r in own], k)
        found = found if made is None else found.unionByName(made)
    return _ranked(found, k, "item").join(each.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
