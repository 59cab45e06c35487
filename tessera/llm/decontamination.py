"""Benchmark decontamination by winnowed fingerprints.

Texts are lower-cased (A-Z) and cut into words. The hashes of ``GRAM`` words are
winnowed: of every ``SPAN`` neighbouring hashes the least is kept (with its ties).
GRAM + SPAN - 1 = WINDOW, so any WINDOW words that a document and an item share
hold at least one fingerprint that both kept. Fingerprints are extended on both
sides to all windows that hold them, and those of documents meet those of items
with the same fingerprint, place and words. So hashes only propose: every reported
word was compared.

An item of fewer words than WINDOW (but not none) is one window by itself; its
hash over all its words is looked up at every position of the documents.

Before anything is exploded, a bitmap of the items' fingerprints (of a size that
follows their number, up to 2**MOST_BITS bits; beyond it lets more pass) drops
almost all hashes inside the row. A window that several items have is one row with
the digest of the list of these items, so a prompt that many items share meets a
document once. The lists themselves are looked up once for each document and list, at
the end. Items' windows are broadcast only if they are at most ``BROADCAST_PRINTS`` and
``BROADCAST_BYTES``, both counted beforehand; else both sides are shuffled.

Null or empty texts have no words: such documents have no hit, such items none.
Rows of documents that are equal in id and text are one document; rows with one
id but different texts are judged apart. Items with one id are one item; a null
item_id is named ''. Other columns are ignored by ``report`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, gram_hashes, let, once, split_words, word_hashes, written
from tessera.sources.storage import kept

WINDOW, GRAM, SPAN = 10, 7, 4
REACH = WINDOW - GRAM
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_BITS, MOST_BITS = 16, 27
BROADCAST_PRINTS, BROADCAST_BYTES = 100_000, 32_000_000


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def _kept(hashes: Column, h: Column, i: Column) -> Column:
    """Whether h, at i, is the least of a run of SPAN hashes (cut at the text's ends)."""
    least = [F.least(*[F.coalesce(F.get(hashes, i + j), F.lit(2**63 - 1)) for j in range(a, a + SPAN)]) for a in range(1 - SPAN, 1)]
    found = h == least[0]
    for x in least[1:]:
        found = found | (h == x)
    return found


def _context(words: Column, i: Column, first: int, end: int) -> Column:
    return F.transform(F.sequence(F.lit(first), F.lit(end - 1)), lambda d: F.get(words, i + d))


def _picked(words: Column, hashes: Column, k: int, passes, reach: int = 0) -> Column:
    """(k, i, h, ctx) of the grams of k words that pass and, with a reach, are kept by winnowing; ctx holds ``reach`` words more on each side."""

    def pick(h: Column, i: Column, grams: Column) -> Column:
        good = passes(h)
        if reach:
            good = F.when(good, _kept(grams, h, i)).otherwise(F.lit(False))
        return F.when(good, F.struct(F.lit(k).alias("k"), i.alias("i"), h.alias("h"), _context(words, i, -reach, k + reach).alias("ctx")))

    return let(gram_hashes(hashes, k), lambda g: F.filter(F.transform(g, lambda h, i: pick(h, i, g)), lambda x: x.isNotNull()))


def _windows(k: Column, h: Column, i: Column, ctx: Column) -> Column:
    """array of (k, h, start, window): the windows that hold a fingerprint at i, by how far it is from their beginning; a short one is a window itself."""
    long = [F.struct(F.lit(GRAM + a).alias("k"), h.alias("h"), (i - a).alias("start"), F.slice(ctx, REACH - a + 1, WINDOW).alias("window")) for a in range(REACH + 1)]
    short = F.struct(k.alias("k"), h.alias("h"), i.alias("start"), ctx.alias("window"))
    # Beyond a text's ends words are null.
    return F.when(k < 0, F.array(short)).otherwise(F.filter(F.array(*long), lambda w: F.get(w["window"], F.lit(0)).isNotNull() & F.get(w["window"], F.lit(WINDOW - 1)).isNotNull()))


def item_fingerprints(items: DataFrame) -> DataFrame:
    """(k, h, window, items): the sorted items that have a window with the fingerprint h; k tells how far that is from its beginning, or is a short item's number of words with the sign changed."""
    with_words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w"))
    long = _picked(F.col("w"), word_hashes(F.col("w")), GRAM, lambda h: F.lit(True), REACH)
    short = F.array(F.struct((-F.size("w")).alias("k"), F.lit(0).alias("i"), _whole_hash(F.col("w")).alias("h"), F.col("w").alias("ctx")))
    picked = F.when(F.size("w") >= WINDOW, long).when(F.size("w") > 0, short)
    each = with_words.select("item", F.explode(picked).alias("f")).select("item", F.explode(_windows(F.col("f.k"), F.col("f.h"), F.col("f.i"), F.col("f.ctx"))).alias("x"))
    return each.groupBy("x.k", "x.h", "x.window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _whole_hash(words: Column) -> Column:
    """gram_hashes over all of a short item's words."""
    found = F.lit(None).cast("long")
    for k in range(1, WINDOW):
        found = F.when(F.size(words) == k, F.get(gram_hashes(word_hashes(words), k), F.lit(0))).otherwise(found)
    return found


def _bitmap(fingerprints: DataFrame, size: int) -> DataFrame:
    """One row: 2**size bits, as words of 64."""
    spark = fingerprints.sparkSession
    bit = F.col("h").bitwiseAND(F.lit((1 << size) - 1))
    ones = fingerprints.select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, int(h & 63))").alias("bits"))
    zeros = spark.range(1 << (size - 6)).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bits"))
    dense = ones.unionByName(zeros).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("x")).select(F.transform("x", lambda y: y["bits"]).alias("bitmap"))


def _joined(docs: DataFrame, items: DataFrame, how: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, doc_key, n_words, set, start, end) of extended hits, with how="left" a row of nulls too for each document; and (set, items) of the lists of items."""
    with_items = kept(item_fingerprints(items).withColumn("set", F.sha2(F.to_json("items"), 256)), "fingerprints")
    prints, sets = with_items.drop("items"), with_items.select("set", "items").dropDuplicates(["set"])
    held = F.octet_length(F.array_join("window", " ")) + 16 * F.size("window") + 100  # with what Spark adds to each string and row
    n_prints, shorts, n_bytes = prints.agg(F.count("*"), F.collect_set(F.when(F.col("k") < 0, -F.col("k"))), F.sum(held)).first()
    small = n_prints <= BROADCAST_PRINTS and (n_bytes or 0) <= BROADCAST_BYTES
    lengths = sorted(shorts)  # at most WINDOW - 1 numbers
    size = min(MOST_BITS, max(LEAST_BITS, (64 * n_prints).bit_length()))
    bitmap = _bitmap(prints, size).scalar()

    def picked(words: Column, bits: Column) -> Column:
        def passes(h: Column) -> Column:
            at = F.shiftright(h.bitwiseAND(F.lit((1 << size) - 1)), 6).cast("int")
            return F.getbit(F.get(bits, at), h.bitwiseAND(F.lit(63)).cast("int")) == 1

        def of(hashes: Column) -> Column:
            long = _picked(words, hashes, GRAM, passes, REACH)
            short = [F.transform(_picked(words, hashes, k, passes), lambda x: x.withField("k", -x["k"])) for k in lengths]
            return F.concat(long, *short) if short else long

        return let(word_hashes(words), of)

    cut = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), let(F.col("_bits"), lambda b: picked(w, b)).alias("found")))
    rows = once(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), "text", bitmap.alias("_bits")), "c", cut)
    of_hit = F.flatten(F.transform("c.found", lambda f: _windows(f["k"], f["h"], f["i"], f["ctx"])))
    each = rows.select("doc_id", "doc_key", F.col("c.n").alias("n_words"), F.explode_outer(of_hit).alias("x"))
    found = (each if how == "left" else each.filter(F.col("x").isNotNull())).select(
        "doc_id",
        "doc_key",
        "n_words",
        F.coalesce(F.col("x.k"), F.lit(0)).alias("k"),
        F.coalesce(F.col("x.h"), F.col("doc_key")).alias("h"),  # rows without a hit don't meet in one task
        F.coalesce(F.col("x.window"), F.array().cast("array<string>")).alias("window"),
        F.col("x.start").alias("start"),
    )
    both = found.join(F.broadcast(prints) if small else prints, ["k", "h", "window"], "left" if how == "left" else "inner")
    return both.select("doc_id", "doc_key", "n_words", "set", "start", (F.col("start") + F.size("window")).alias("end")), sets


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, doc_key, n_words, items, start, end): windows that stand in all these items, by word, end exclusive; one may come more than once."""
    found, sets = _joined(docs, items, "inner")
    return found.join(sets, "set").select("doc_id", "doc_key", "n_words", "items", "start", "end")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items, runs) for each document; items are the sorted ids, as strings."""
    covered = F.aggregate(
        F.sort_array("runs"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, r: F.struct(F.greatest(a["end"], r["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], a["end"]))).alias("n")),
        lambda a: a["n"],
    )
    found, sets = _joined(docs, items, "left")
    of_hit = F.when(F.col("set").isNotNull(), F.struct("start", "end"))
    grouped = found.groupBy("doc_id", "doc_key", "n_words").agg(F.collect_set("set").alias("sets"), F.collect_set(of_hit).alias("runs"))
    rows = kept(grouped.select("doc_id", "doc_key", "n_words", covered.alias("n_hit"), F.sort_array("runs").alias("runs"), "sets"), "report")
    columns = ("doc_id", "n_words", "n_hit", "items", "runs")
    free = rows.filter(F.size("sets") == 0).withColumn("items", F.array().cast("array<string>"))
    named = rows.filter(F.size("sets") > 0).select("doc_id", "doc_key", "n_words", "n_hit", "runs", F.explode("sets").alias("set")).join(sets, "set")
    of_doc = named.groupBy("doc_id", "doc_key").agg(F.first("n_words").alias("n_words"), F.first("n_hit").alias("n_hit"), F.first("runs").alias("runs"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return free.select(*columns).unionByName(of_doc.select(*columns))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any hit, as they are; repeated rows stay repeated."""
    # Written first: Spark knows the size of a table that stands, and moves no text if it is small.
    bad, _ = written(docs.sparkSession, _joined(docs, items, "inner")[0].select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["doc_id"], docs["text"]) == bad["_key"]), "left_anti")
