"""Deterministic sampling, splits and hold-outs.

Draws follow from a hash of the seed and a key ("hash" mode): they depend neither
on partitions nor on what else is in the table. Exact counts over the whole table
(the split, the permutation) need a rank in hash order; it is found from a
histogram of hash prefixes, so that only the rows of the prefixes at the cuts are
ever ordered, and no single task sees the table.
"""

from __future__ import annotations

import hashlib
import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import let
from tessera.sources import corpus, storage
from tessera.sources.corpus import row_range

FIRST_POSITION = 50
PREFIX = 4  # hex digits: 65,536 prefixes at most


def seeded(seed: int, *keys: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)


def eligible_positions(tokens: Column, special: list[str] | None = None, first: int = FIRST_POSITION) -> Column:
    """Positions (0-based, ascending) from ``first`` on whose token isn't special."""
    at = F.transform(tokens, lambda t, i: F.when((i >= first) & (~t.isin(special) if special else F.lit(True)), i))
    return F.filter(at, lambda i: i.isNotNull())


def sample_positions(positions: Column, k: int, seed: int, key: Column) -> Column:
    """k of the positions (all, if there are fewer), ascending, by hash within the row."""
    ranked = F.sort_array(F.transform(positions, lambda p: F.struct(seeded(seed, key, p).alias("h"), p.alias("p"))))
    return F.sort_array(F.transform(F.slice(ranked, 1, k), lambda x: x["p"]))


def keyed_random(seed: int, key: str) -> random.Random:
    """Python's generator, seeded by the whole digest of seed and key."""
    return random.Random(hashlib.sha256(f"{seed}|{key}".encode()).digest())


def sample_positions_python(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """(doc_id, positions) by Python's own generator, keyed by seed and document, in the order of its draws: what a Python loop gives."""

    @F.pandas_udf("array<int>")
    def draw(ids: pd.Series, positions: pd.Series) -> pd.Series:
        return pd.Series([keyed_random(seed, d).sample(list(p), min(k, len(p))) for d, p in zip(ids, positions, strict=True)], dtype=object)

    return docs.select("doc_id", draw("doc_id", "positions").alias("positions"))


def rank_cuts(keyed: DataFrame, h: str, cuts: list[int]) -> list[str | None]:
    """For each cut c the hash that exactly c rows are less than (null: all are). Hashes are distinct hex strings."""
    prefix = F.substring(h, 1, PREFIX)
    counts = keyed.groupBy(prefix.alias("p")).agg(F.count("*").alias("n"))
    before = dict.fromkeys(cuts)
    seen = 0
    for p, n in sorted(counts.collect()):  # at most 16**PREFIX rows
        for c in cuts:
            if before[c] is None and seen <= c < seen + n:
                before[c] = (p, c - seen)
        seen += n
    wanted = {p for x in before.values() if x for p in (x[0],)}
    if not wanted:
        return [None for _ in cuts]
    ranked = (
        keyed.select(F.col(h).alias("h"), prefix.alias("p"))
        .filter(F.col("p").isin(sorted(wanted)))
        .withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("h")) - 1)
    )
    picks = F.lit(False)
    for x in before.values():
        if x:
            picks = picks | ((F.col("p") == x[0]) & (F.col("r") == x[1]))
    at = {(r["p"], r["r"]): r["h"] for r in ranked.filter(picks).collect()}  # one row for each cut
    return [at[before[c]] if before[c] else None for c in cuts]


def document_split(rows: DataFrame, fractions: dict[str, float], seed: int, key: str = "doc_id") -> DataFrame:
    """rows with ``split``: whole documents go to the named splits in hash order; the last name takes the remainder.

    Counts are int(n * fraction) of the distinct documents, in doubles.
    """
    if any(f < 0 for f in fractions.values()) or abs(sum(fractions.values()) - 1) > 1e-6:
        raise ValueError("fractions must not be negative and must sum to 1")
    docs = rows.select(key).distinct().withColumn("_h", seeded(seed, F.col(key)))
    n, names = docs.count(), list(fractions)
    cuts, at = [], 0
    for name in names[:-1]:
        at += int(n * fractions[name])
        cuts.append(at)
    marks = rank_cuts(docs, "_h", cuts)
    h = seeded(seed, F.col(key))
    split = F.lit(names[-1])
    for name, mark in reversed(list(zip(names[:-1], marks, strict=True))):
        split = F.lit(name) if mark is None else F.when(h < mark, name).otherwise(split)
    return rows.withColumn("split", split)


def shuffled_by_python(spark: SparkSession, n: int, seed) -> DataFrame:
    """(place, source): where Python's ``random.shuffle`` puts the numbers from 0 to n - 1, after ``random.Random(seed)``.

    The generator's draws follow one another, so one task makes them; it holds none of them, and they are written as they
    come: step i (from n - 1 down to 1) swaps place i with a place j. What ends at place i stood at j before that step: what
    the next greater step that drew j brought there, or j itself. So each step has one pointer to a greater one at most, and
    the end of its chain is found by doubling, in as many joins as the logarithm of a chain's length (some tens) has.
    """

    def draw(batches):
        import pyarrow as pa

        rng = random.Random(seed)
        for batch in batches:
            for last in range(n - 1 if len(batch) else 0, 0, -DRAWS):
                steps = list(range(last, max(0, last - DRAWS), -1))
                yield pa.RecordBatch.from_pydict({"i": steps, "j": [rng.randrange(i + 1) for i in steps]})

    draws = storage.kept(spark.range(0, 1, 1, 1).mapInArrow(draw, "i long, j long"), "draws")
    # Place 0 has no step of its own; what is there at the end was brought by the least step that drew it.
    ends = draws.unionByName(spark.range(1 if n else 0).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j")))
    ends = storage.kept(ends.withColumn("from", F.lead("i").over(Window.partitionBy("j").orderBy("i"))), "ends")
    chain = storage.kept(draws.filter("i > j").groupBy(F.col("j").alias("i")).agg(F.min("i").alias("up")), "chain")
    while True:
        further = chain.select(F.col("i").alias("up"), F.col("up").alias("next"))
        jumped = storage.kept(chain.join(further, "up", "left").select("i", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "chain")
        chain = jumped.select("i", "up")
        if jumped.filter("moved").isEmpty():
            break
    top = chain.select(F.col("i").alias("from"), "up")
    return ends.join(top, "from", "left").select(F.col("i").alias("place"), F.coalesce("up", "from", "j").alias("source"))


#: Draws that are handed on at once.
DRAWS = 100_000


def document_split_python(rows: DataFrame, fractions: dict[str, float], seed: int, key: str = "doc_id") -> DataFrame:
    """document_split() in the order that Python's generator shuffles the sorted keys into."""
    ids = corpus.numbered(rows.select(key).distinct(), key, out="source")
    n, names = ids.count(), list(fractions)
    placed = ids.join(shuffled_by_python(rows.sparkSession, n, seed), "source")
    split, end = F.lit(names[-1]), sum(int(n * fractions[name]) for name in names[:-1])
    for name in reversed(names[:-1]):
        split = F.when(F.col("place") < end, name).otherwise(split)
        end -= int(n * fractions[name])
    return rows.join(placed.select(key, split.alias("split")), key)


def permuted_python(rows: DataFrame, seed: int, dataset_id: str, order: str = "row_idx") -> DataFrame:
    """rows (numbered from 0) with ``place``, where Python's generator shuffles them to."""
    digest = hashlib.sha256(f"{seed}|{dataset_id}".encode()).digest()
    places = shuffled_by_python(rows.sparkSession, rows.count(), digest)
    return rows.join(places.withColumnRenamed("source", order), order).orderBy("place")


def without_padding(tokens: Column, pad: Column, end: Column | None = None) -> Column:
    """tokens, or an error where the pad token is among them, as then no position can be trusted; a pad that is also the end token isn't looked for."""
    leak = F.array_contains(tokens, pad)
    if end is not None:
        leak = leak & (pad != end)
    return F.when(leak, F.raise_error(F.lit("a pad token is among the tokens"))).otherwise(tokens)


def coverage(docs: DataFrame, positions: str, k: int) -> DataFrame:
    """One row: documents, those without any position, those with fewer than k, and the rows that sampling gives."""
    n = F.size(positions)
    return docs.agg(
        F.count("*").alias("docs"),
        F.count_if(n == 0).alias("skipped"),
        F.count_if((n > 0) & (n < k)).alias("short_sampled"),
        F.sum(F.least(n, F.lit(k)).cast("long")).alias("rows"),
    )


def observed(docs: DataFrame, positions: str, k: int) -> tuple[DataFrame, Observation]:
    """docs, and the counters of coverage() as an observation: the job that writes docs fills it, so nothing is read twice.

    ``observation.get`` gives them as a dictionary once such a job has run (it waits until then).
    """
    seen, n = Observation(), F.size(positions)
    return docs.observe(
        seen,
        F.count(F.lit(1)).alias("docs"),
        F.count_if(n == 0).alias("skipped"),
        F.count_if((n > 0) & (n < k)).alias("short_sampled"),
        F.coalesce(F.sum(F.least(n, F.lit(k)).cast("long")), F.lit(0)).alias("rows"),
    ), seen


def split_counts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(key).alias("docs"))


def is_held_out(key: Column, permille: int | Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 1000 < permille


def without_seen(rows: DataFrame, first_rows: int, key: str = "doc_id", order: str = "row_idx") -> DataFrame:
    """Rows of documents that the first rows don't touch."""
    seen = rows.filter(F.col(order) < first_rows).select(key).distinct()
    return rows.join(seen, key, "left_anti")


def held_out_first(rows: DataFrame, n: int, permille: int, key: str = "doc_id", order: str = "row_idx") -> DataFrame:
    """The first n rows of held-out documents, in order."""
    return corpus.first_kept(rows, n, is_held_out(F.col(key), permille), order)


def windows_apart(train_rows: int | None, skip: int) -> None:
    """An error where rows for training reach into those for evaluation, which begin behind ``skip``."""
    if train_rows is None or train_rows > skip:
        raise ValueError(f"training takes {train_rows or 'all'} rows, evaluation begins behind {skip}")


def batch_slots(row: Column, batch: int, ranks: int, chunk: int) -> dict[str, Column]:
    """Where a row in training order goes: its step, its slot there, the rank with an equal share of slots, and its chunk of rows."""
    slot = row % batch
    return {"step": F.floor(row / batch), "slot": slot, "rank": F.floor(slot / (batch // ranks)), "chunk": F.floor(row / chunk)}


def permutation_key(seed: int, dataset_id: str, row: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(dataset_id), row.cast("string")), 256)


def permuted(rows: DataFrame, seed: int, dataset_id: str, order: str = "row_idx") -> DataFrame:
    """rows in the order of a keyed permutation; sorted by range, over all tasks."""
    return rows.withColumn("shuffle_key", permutation_key(seed, dataset_id, F.col(order))).orderBy("shuffle_key")


class Shuffled:
    """A keyed bijection of the numbers 0 to n - 1, another one for each epoch, as column expressions.

    Numbers are pairs (left, right) below a * b, which is n or a little more. In each of ``TURNS`` turns a mix of one half
    and a key is added to the other, modulo a or b, which can be undone. A number that leaves the range goes through again
    until it is back; at most a - 1 numbers are outside, and of a large range so few that ``WALKS`` times never end there.
    So neither a table of the permutation nor a replay of draws is needed: the place of a row, or the row at a place, is
    computed from its number, in any task, for any epoch.
    """

    TURNS, WALKS = 4, 48

    def __init__(self, n: int, seed: int, dataset_id: str):
        if not 0 < n < 1 << 60:
            raise ValueError("n must be positive and less than 2**60")
        self.n, self.a = n, math.isqrt(n - 1) + 1
        self.b = -(-n // self.a)
        digest = hashlib.sha256(f"{seed}|{dataset_id}|epochs".encode()).digest()
        #: Numbers below 2**31, two for each turn.
        self.bases = [int.from_bytes(digest[4 * i : 4 * i + 4], "big") >> 1 for i in range(2 * self.TURNS)]

    @staticmethod
    def _mixed(x: Column) -> Column:
        """Below 2**31, from a number below 2**32; products stay below 2**63."""
        x = (x * 1103515245 + 12345) % 2147483647
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * 1597334677) % 2147483629
        return x.bitwiseXOR(F.shiftright(x, 15))

    def _keys(self, epoch: Column) -> list[Column]:
        """(k, l) of each turn."""
        mixed = [self._mixed(F.lit(base).cast("long") + epoch) for base in self.bases]
        return [F.struct(k.alias("k"), l.alias("l")) for k, l in zip(mixed[::2], mixed[1::2], strict=True)]

    def _halves(self, x: Column) -> Column:
        return F.struct(F.call_function("div", x, F.lit(self.b)).alias("left"), (x % self.b).alias("right"))

    def _turned(self, x: Column, k: Column) -> Column:
        def of(left: Column, right: Column) -> Column:
            return let((left + self._mixed(right + k["k"])) % self.a, lambda left: left * self.b + (right + self._mixed(left + k["l"])) % self.b)

        return let(self._halves(x), lambda h: of(h["left"], h["right"]))

    def _turned_back(self, x: Column, k: Column) -> Column:
        def of(left: Column, right: Column) -> Column:
            return let((right + self.b - self._mixed(left + k["l"]) % self.b) % self.b, lambda right: (left + self.a - self._mixed(right + k["k"]) % self.a) % self.a * self.b + right)

        return let(self._halves(x), lambda h: of(h["left"], h["right"]))

    def _through(self, x: Column, keys: list[Column], turn) -> Column:
        again = F.sequence(F.lit(1), F.lit(min(self.WALKS, max(1, self.a * self.b - self.n))))
        return let(F.array(*keys), lambda k: F.aggregate(again, F.aggregate(k, x, turn), lambda y, _: F.when(y >= self.n, F.aggregate(k, y, turn)).otherwise(y)))

    def place(self, row: Column, epoch: Column) -> Column:
        """Where a row is in the order of an epoch."""
        return self._through(row.cast("long"), self._keys(epoch.cast("long")), self._turned)

    def row(self, place: Column, epoch: Column) -> Column:
        """The row at a place."""
        return self._through(place.cast("long"), self._keys(epoch.cast("long"))[::-1], self._turned_back)


def _per_epoch(n: int, batch: int) -> int:
    if not 0 < batch <= n:
        raise ValueError("a batch must have a row, and not more than the table")
    return n // batch


def epoch_batches(rows: DataFrame, n: int, batch: int, steps: int, seed: int, first: int = 0, dataset_id: str = "", order: str = "row_idx") -> DataFrame:
    """rows (numbered from 0 to n - 1) with ``step`` and ``slot`` for the steps from ``first`` on to ``steps`` (exclusive).

    Each epoch goes through the table in an order of its own, in whole batches; what is left at its end is dropped, and the
    next epoch begins. A resumed run needs no replay: a step's rows don't depend on where the run began.
    """
    per_epoch = _per_epoch(n, batch)
    if first >= steps:
        return rows.filter(F.lit(False)).select("*", F.lit(0).cast("long").alias("step"), F.lit(0).cast("long").alias("slot"))
    epochs = F.explode(F.sequence(F.lit(first // per_epoch), F.lit((steps - 1) // per_epoch))).alias("_epoch")
    placed = rows.select("*", epochs).withColumn("_place", Shuffled(n, seed, dataset_id).place(F.col(order), F.col("_epoch")))
    step = F.col("_epoch") * per_epoch + F.floor(F.col("_place") / batch)
    found = placed.filter(F.col("_place") < per_epoch * batch).withColumn("step", step.cast("long")).withColumn("slot", (F.col("_place") % batch).cast("long"))
    return row_range(found, first, steps, "step").drop("_epoch", "_place")


def rows_of_steps(spark: SparkSession, n: int, batch: int, steps: int, seed: int, first: int = 0, dataset_id: str = "") -> DataFrame:
    """(step, slot, row_idx): what epoch_batches() gives, found from the steps, without reading a table; for a few steps of a large one."""
    per_epoch = _per_epoch(n, batch)
    slots = spark.range(first * batch, max(first, steps) * batch).select(F.floor(F.col("id") / batch).alias("step"), (F.col("id") % batch).alias("slot"))
    place = F.col("step") % per_epoch * batch + F.col("slot")
    return slots.withColumn("row_idx", Shuffled(n, seed, dataset_id).row(place, F.floor(F.col("step") / per_epoch)))
