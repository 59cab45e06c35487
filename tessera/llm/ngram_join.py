"""Jaccard join of documents on word shingles, by token combinations of extended prefixes.

A document's set holds the hashes (64 bits) of its distinct runs of ``words``
words; equal sets have one identity (two independent hashes of the whole set, 128
bits) and are linked as they are. Sets x, y link when percent * |x or y| <= 100 *
|x and y|. Such sets of n tokens lack at most e(n) = n - ceil(n * percent / 100)
of their own in the other.

Step 1, prefixes. Tokens are ordered by their hash. Of the first e(n) + 1 + g of a
set, g + 1 or more are shared with a set that it links with, and lie in that one's
prefix, too (g is near a tenth of n). Exact counts over the prefixes of all distinct
sets tell which tokens are shared at all; sets with too few of them can't link and
go. That leaves copies, near copies and texts made of what is common.

Step 2, order. For the sets that stay, all tokens are counted. What only one set
holds can't be shared; K tokens of a set are left, or the set goes if K < s(n) =
n - e(n). They are ordered by the bits of their count, rare ones first, then by
hash, so that every set's first K - s + 1 + g tokens hold the first g + 1 that it
shares. Both are in one number: the hash gives 6 of its 64 bits up for the count's.

Step 3, keys. Tokens in up to 2**RARE - 1 sets are keys by themselves. Frequent tokens
fall into g classes by hash, and every two of a class within a prefix extended by g
are a key: among g + 1 shared tokens two are of one class. If the first shared
token is rare, sets meet at its key, else at that of the first such two. g follows
the size of the smaller set, so that keys stay in proportion to the prefix. A key
also knows how many tokens are left from its place on, which bounds the overlap of
sets that meet there for the first time.

Step 4, verification. Of the sets that share a key, those that the bound allows are
compared with one (the hub, with the most tokens left), not with each other. What
links with the same set is one component already. Then only members of different
components are left, of which those that the bounds allow are compared, too. (A
second bound counts the tokens that only one of two sets can have: those that no
other set holds, and at least as many as the parities of the others by 512 hash
values differ in.) So every pair is linked, known to be in one component, excluded
by a bound, or compared: components are exact, without all pairs of a group.

Nothing about documents reaches the driver, and nothing is broadcast but a Bloom
filter of the texts to be cut again, of at most 2**MOST_BITS bits; beyond that size
more texts are shuffled than needed, at most all of them once. Tables between steps
are in the shared folder, and are removed when they are read for the last time.

Null or empty texts have empty sets and link with nothing. Rows with one id stand
each for itself. Null ids are allowed and are greater than any. Other columns are
ignored. deduplicate() takes rows equal in id and text for one document, and rows
with one id but different texts for different ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, ascii_lower, gram_hashes, let, once, split_words, word_hashes, written
from tessera.llm.components import components_of_stars
from tessera.sources.storage import dropped

WORDS, PERCENT, RARE = 5, 80, 5
HASH_BITS = 58
PARITIES = tuple(f"b{i}" for i in range(8))
LEAST_BITS, MOST_BITS = 16, 27


def shingles(text: Column, words: int = WORDS) -> Column:
    """The sorted set of hashes of a text's shingles; a text of fewer words is one shingle by itself."""

    def of(hashes: Column) -> Column:
        grams = F.when(F.size(hashes) >= words, gram_hashes(hashes, words))
        for k in range(words - 1, 0, -1):
            grams = grams.when(F.size(hashes) == k, gram_hashes(hashes, k))
        return F.sort_array(F.array_distinct(grams.otherwise(F.array().cast("array<bigint>"))))

    return let(word_hashes(split_words(ascii_lower(text), BLANKS)), of)


def _least_partner(n: Column, percent: int) -> Column:
    """The size of the smallest set that one of n may link with; also the least overlap."""
    return F.ceil(n.cast("long") * percent / F.lit(100)).cast("int")


def _spare(n: Column, percent: int) -> Column:
    return F.floor(n.cast("long") * (100 - percent) / F.lit(100)).cast("int")


def _extension(n: Column) -> Column:
    """The power of two at or below a tenth of n, at least 1."""
    return F.pow(F.lit(2), F.length(F.bin(F.greatest(F.floor(n / F.lit(10)), F.lit(1)))) - 1).cast("int")


class _Tables:
    """Tables in the shared folder, which go when they are no longer needed."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        made, self.paths[name] = written(self.spark, df, name)
        return made

    def drop(self, *names: str) -> None:
        dropped(self.spark, *(self.paths.pop(name) for name in names))


def _described(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Each document's set identity, size and prefix."""
    cut = once(docs.select("doc_id", "text"), "tokens", shingles(F.col("text"), words))
    n = F.size("tokens")
    length = F.when(n.cast("long") * (100 - percent) >= percent, F.least(n, _spare(n, percent) + 1 + _extension(n))).otherwise(0)
    return cut.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.xxhash64("tokens").alias("s1"),
        F.xxhash64(F.lit("second"), F.col("tokens")).alias("s2"),
        n.cast("long").alias("n"),
        F.slice("tokens", F.lit(1), length).alias("prefix"),
    )


def _counts(sets: DataFrame, tokens: str) -> DataFrame:
    """(t, c) of the tokens that two sets or more hold."""
    return sets.select(F.explode(tokens).alias("t")).groupBy("t").agg(F.count("*").alias("c")).filter("c >= 2")


def _passing(index: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Ids of the sets with as many shared tokens in their prefix as a link needs."""
    each = index.select("id", F.explode("prefix").alias("t")).join(shared.hint("shuffle_hash"), "t", "left_semi")
    need = 1 + _extension(_least_partner(F.col("n"), percent))
    return each.groupBy("id").agg(F.count("*").alias("known")).join(index.select("id", "n"), "id").filter(F.col("known") >= need).select("id", "n")


def _sets(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(id, n, tokens) of the sets in chosen (id, n, own), made again from the document that stands for each."""
    spark = docs.sparkSession
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * chosen.count()).bit_length()))
    at = lambda h: F.shiftright(h.bitwiseAND(F.lit((1 << bits) - 1)), 6)
    ones = chosen.select(at(F.col("own.text_hash")).alias("at"), F.expr("shiftleft(1L, int(own.text_hash & 63))").alias("bits"))
    zeros = spark.range(1 << (bits - 6)).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bits"))
    dense = ones.unionByName(zeros).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    bloom = dense.agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("x")).select(F.transform("x", lambda y: y["bits"]).alias("b"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    passing = keyed.filter(F.getbit(F.get(bloom.scalar(), at(F.col("text_hash")).cast("int")), F.col("text_hash").bitwiseAND(F.lit(63)).cast("int")) == 1)
    named = chosen.select("id", "n", F.col("own.text_hash").alias("h"), F.col("own.doc_id").alias("d"))
    joined = passing.join(named, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d"))).dropDuplicates(["id"])
    return joined.select("id", "n", shingles(F.col("text"), words).alias("tokens"))


def _ordered(sets: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """(id, n, tokens, often): shared tokens of each set that has enough of them, rare ones first, and how many of these are rare."""
    bits = F.least(F.length(F.bin("c")), F.lit(31)).cast("long")
    token = F.call_function("shiftleft", bits, F.lit(HASH_BITS)).bitwiseOR(F.col("t").bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    each = sets.select("id", F.explode("tokens").alias("t")).join(counts.hint("shuffle_hash"), "t").select("id", token.alias("x"))
    found = each.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("tokens")).join(sets.select("id", "n"), "id")
    rare = F.size(F.filter("tokens", lambda x: x < F.lit((RARE + 1) << HASH_BITS)))
    return found.filter(F.size("tokens") >= _least_partner(F.col("n"), percent)).select("id", "n", "tokens", rare.alias("rare"))


_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x165667B19E3779F9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _levels(n: int, percent: int) -> range:
    """Levels of the smaller sets that a set of n may link with, itself among them."""
    spare = lambda m: m * (100 - percent) // 100
    return range(spare(-(-n * percent // 100)).bit_length(), spare(n).bit_length() + 1)


def _classes(level: int) -> int:
    """An eighth to a quarter of the spare tokens of a set of this level."""
    return 1 << max(0, level - 3)


def _keys(tokens: np.ndarray, n: int, size: int, rare: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set by its first tokens (of ``size`` shared ones), and how many of its tokens may be shared with sets met there."""
    first = size + -n * percent // 100 + 1
    alone = min(rare, first)
    keys, left = [_mixed(tokens[:alone] * _K1)], [size - np.arange(alone)]
    for level in _levels(n, percent):
        classes = _classes(level)
        salt = np.uint64((level + 1) * _K3 & 2**64 - 1)
        often = tokens[rare : first + classes]
        if len(often) < 2:
            continue
        kind = _mixed(often + salt) % np.uint64(classes)
        order = np.argsort(kind, kind="stable")
        often, kind, place = often[order], kind[order], rare + order
        for d in range(1, len(often)):
            same = kind[d:] == kind[:-d]
            if not same.any():
                break
            keys.append(_mixed(often[:-d][same] * _K1 + _mixed(often[d:][same] * _K2) + salt))
            left.append(np.minimum(size, size - place[d:][same] + classes))
    return np.concatenate(keys), np.concatenate(left)


def _signatures(ordered: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, left) of each set."""
    size = F.size("tokens")
    longest = F.least(size, size - _least_partner(F.col("n"), percent) + 2 + F.floor(_spare(F.col("n"), percent) / F.lit(4)).cast("int"))
    heads = ordered.select("id", "n", size.alias("size"), "rare", F.slice("tokens", F.lit(1), longest).alias("head"))

    def run(batches):
        import pyarrow as pa

        types = [pa.int64()] * 4
        for batch in batches:
            ids, ns, sizes, rares = (batch.column(i).to_numpy() for i in range(4))
            lists = batch.column(4)
            flat = lists.flatten().to_numpy().view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            made = [_keys(flat[a:b], int(n), int(size), int(rare), percent) for a, b, n, size, rare in zip(ends[:-1], ends[1:], ns, sizes, rares, strict=True)]
            if made:
                count = [len(k) for k, _ in made]
                columns = np.concatenate([k for k, _ in made]).view(np.int64), np.repeat(ids, count), np.repeat(ns, count), np.concatenate([x for _, x in made])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "id", "n", "left"])

    return heads.mapInArrow(run, "key long, id long, n long, left long").distinct()


def _possible(left: Column, n: Column, other_left: Column, other_n: Column, percent: int) -> Column:
    """Whether sets that meet may link, by what is left of them from there on and by their sizes."""
    sizes = F.least(n, other_n) * 100 >= F.greatest(n, other_n) * percent
    return sizes & (F.least(left, other_left) * (100 + percent) >= (n + other_n) * percent)


def _groups(keys: DataFrame) -> DataFrame:
    """(key, hub, least) of the keys of two sets or more: the set with the most left, and the least size."""
    hub = F.max(F.struct("left", "n", "id"))
    return keys.groupBy("key").agg(F.count("*").alias("c"), hub.alias("hub"), F.min("n").alias("least")).filter("c >= 2").drop("c")


def _members(keys: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Keys with their hub, without sets that can't link with even the smallest of their key."""
    least = F.greatest(F.col("least"), _least_partner(F.col("n"), percent))
    return keys.join(groups, "key").filter(F.col("left") * (100 + percent) >= (F.col("n") + least) * percent).drop("least")


def _linked_pairs(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link, by their tokens."""
    of = lambda x: ordered.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    # The rows are large before hubs meet, so that Spark sees a hot hub's partition and splits it.
    both = pairs.join(of("b"), "b").join(of("a"), "a").withColumn("overlap", F.size(F.array_intersect("ta", "tb")).cast("long"))
    return both.filter(F.col("overlap") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with the id of their component's root so far."""
    known = labels.select(F.col("node.id").alias("id"), F.col("root.id").alias("label"))
    return members.join(known, "id", "left").select("key", "id", "n", "left", F.coalesce("label", "id").alias("label"))


def _mixed_keys(rows: DataFrame) -> DataFrame:
    """(key, most) of the keys whose sets are of several components so far, and the label that most have."""
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    return by_label.groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1").select("key", F.col("most.label").alias("most"))


def _sketched(ids: DataFrame, ordered: DataFrame) -> DataFrame:
    """(id, alone, b0, ...): the number of tokens that no other set holds, and the parities of the others."""

    def word(w: int) -> Column:
        own = lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(len(PARITIES) - 1)) == w
        return F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: F.when(own(t), a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int")))).otherwise(a))

    return ordered.join(ids, "id").select("id", (F.col("n") - F.size("tokens")).alias("alone"), *[word(w).alias(b) for w, b in enumerate(PARITIES)])


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets with a common key, in different components so far, that no bound excludes."""
    x = rows.filter(~F.col("major")).select(*[F.col(c).alias(f"x_{c}") for c in ("key", "id", "n", "left", "label", "alone", *PARITIES)])
    apart = (F.col("x_key") == F.col("key")) & (F.col("x_label") != F.col("label")) & (F.col("major") | (F.col("x_id") < F.col("id")))
    differ = F.col("x_alone") + F.col("alone")
    for b in PARITIES:
        differ = differ + F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(b)))
    few = differ * (100 + percent) <= (F.col("x_n") + F.col("n")) * (100 - percent)
    near = x.join(rows, apart & _possible(F.col("x_left"), F.col("x_n"), F.col("left"), F.col("n"), percent) & few)
    return near.select(F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b")).distinct()


def _linked(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, _Tables]:
    """The documents (doc_id, text_hash, s1, s2, n), their distinct sets (s1, s2, own, stays), and the tables that hold both.

    ``own`` is the least document of a set (none: whether its id is null, doc_id, text_hash), ``stays`` that of its component.
    """
    if not 70 <= percent < 100:
        raise ValueError("percent must be from 70 to 99")
    tables = _Tables(docs.sparkSession)
    described = tables.keep(_described(docs, words, percent), "described")
    rows = tables.keep(described.drop("prefix"), "rows")
    own = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("own")
    of_set = described.filter("n > 0").groupBy("s1", "s2").agg(own, F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    index = tables.keep(of_set.select(F.monotonically_increasing_id().alias("id"), "s1", "s2", "own", "n", "prefix"), "index")
    distinct = tables.keep(index.select("id", "s1", "s2", "own"), "distinct")
    tables.drop("described")
    prefixed = index.filter(F.size("prefix") > 0)
    shared = tables.keep(_counts(prefixed, "prefix").select("t"), "shared")
    passing = tables.keep(_passing(prefixed, shared, percent), "passing")
    tables.drop("index", "shared")
    sets = tables.keep(_sets(docs, passing.join(distinct.select("id", "own"), "id"), words), "sets")
    counts = tables.keep(_counts(sets, "tokens"), "counts")
    ordered = tables.keep(_ordered(sets, counts, percent), "ordered")
    tables.drop("passing", "sets", "counts")

    keys = tables.keep(_signatures(ordered, percent), "keys")
    # Joins by key have tables as they stand on both sides, so that Spark can split a hot key.
    groups = tables.keep(_groups(keys), "groups")
    members = tables.keep(_members(keys, groups, percent), "members")
    tables.drop("keys", "groups")
    nodes = distinct.select("id", F.struct("own", "id").alias("node"))
    stars = members.filter((F.col("id") != F.col("hub.id")) & _possible(F.col("left"), F.col("n"), F.col("hub.left"), F.col("hub.n"), percent))
    near = tables.keep(stars.select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct(), "near")
    links = tables.keep(_named(_linked_pairs(near, ordered, percent), nodes), "links")
    labels = components_of_stars(links, "a", "b")
    labelled = tables.keep(_labelled(members, labels), "labelled")
    mixed = tables.keep(_mixed_keys(labelled), "mixed")
    several = tables.keep(labelled.join(mixed, "key").withColumn("major", F.col("label") == F.col("most")).drop("most"), "several")
    tables.drop("near", "members", "labelled", "mixed")
    sketches = tables.keep(_sketched(several.select("id").distinct(), ordered), "sketches")
    apart = tables.keep(several.join(sketches, "id"), "apart")
    tables.drop("several", "sketches")
    rest = tables.keep(_across(apart, percent), "rest")
    more = tables.keep(_named(_linked_pairs(rest, ordered, percent), nodes), "more")
    tables.drop("ordered", "apart", "rest", "links")
    # What is one component already goes in as one star.
    tree = labels.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    found = labels if more.isEmpty() else components_of_stars(tree.unionByName(more), "a", "b")
    tables.drop("more")
    roots = found.select(F.col("node.id").alias("id"), F.col("root.own").alias("root"))
    # The root is the least of its component, so it says what stays; no join by component is needed.
    return rows, distinct.join(roots, "id", "left").select("s1", "s2", "own", F.coalesce("root", "own").alias("stays")), tables


def _named(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of ids as pairs of nodes, which are ordered by the least document of their sets."""
    return pairs.join(nodes.select(F.col("id").alias("a"), F.col("node").alias("u")), "a").join(nodes.select(F.col("id").alias("b"), F.col("node").alias("v")), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text); percent from 70 to 99."""
    rows, sets, _ = _linked(docs, words, percent)
    # Empty sets have no row there, and keys of their own so that they don't meet in one task.
    full = F.col("n") > 0
    asked = rows.withColumn("s1", F.when(full, F.col("s1")).otherwise(F.xxhash64("doc_id", "text_hash")))
    found = sets.select("s1", "s2", F.lit(True).alias("in_set"), F.col("stays.doc_id").alias("least"))
    component = F.when(full & F.col("in_set"), F.col("least")).otherwise(F.col("doc_id"))
    return asked.join(found, ["s1", "s2"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def deduplicate(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of the least id (null is greater than any), then of the least hash of its text; repeated rows keep one."""
    rows, sets, tables = _linked(docs, words, percent)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    named = F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")
    leaving = rows.filter("n > 0").join(sets.select("s1", "s2", "stays"), ["s1", "s2"]).filter(~key.eqNullSafe(F.col("stays")))
    gone = tables.keep(leaving.select(*named).distinct(), "gone")
    again = tables.keep(rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("c")).filter("c > 1").select(*named), "again")
    tables.drop("rows", "distinct")

    def held(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys, rows["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(rows["text"]) == keys["_hash"]), how)

    single = held(docs, gone.unionByName(again), "left_anti")
    row = F.struct(*[f"`{c}`" for c in docs.columns])
    repeated = held(held(docs, again, "left_semi"), gone, "left_anti").groupBy("doc_id", "text").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return single.unionByName(repeated.select("row.*"))
