"""Quality rules: a ledger of failure bits and measurements, and policies over it.

Every rule is evaluated once per document, in one pass without a shuffle. The
ledger keeps the measurements and one bit per failed rule. A policy is a version
name and a mask of the rules that reject; applying or changing a policy, and
computing ablations, needs the bits alone.

Nulls and empty texts have no words and measure 0. Each input row gets one row
(repeated rows give repeated results). Extra columns are kept by ``ledger``;
those whose names clash with a measurement are replaced by it.

Windows of words are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, gram_hashes, let, once, split_words, word_hashes

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``failed`` is an SQL predicate over the measurements."""

    name: str
    failed: str


#: The order fixes the bits; new rules go to the end, so old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("exclamations", "100 * n_exclamations > 50 * n_words"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("same_lines", "n_lines >= 10 AND 100 * n_dup_lines > 70 * n_lines"),
    Rule("stutter", "100 * n_stutter > 30 * n_words"),
    Rule("no_words", "n_words = 0"),
)
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the names of the rules that reject a document.
POLICIES = {
    "base-1": BASE,
    "web-1": (*BASE, "symbols", "exclamations"),
    "web-2": (*BASE, "symbols", "exclamations", "long_words", "same_lines"),
    # Short texts may be clean, and words that stand twice in a row rarely are.
    "web-3": ("repeated_windows", "symbols", "exclamations", "long_words", "same_lines", "stutter", "no_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclamations", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")


def mask(names) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(RULES)}
    return sum(bits[n] for n in set(names))


def _repeated_words(keys: Column, width: int) -> Column:
    """Words inside windows whose key occurs twice or more; keys are by window start."""

    def covered(pairs: Column) -> Column:
        starts = F.sort_array(
            F.filter(
                F.transform(
                    pairs,
                    lambda x, j: F.when((F.get(pairs, j - 1)["k"] == x["k"]) | (F.get(pairs, j + 1)["k"] == x["k"]), x["i"]),
                ),
                lambda p: p.isNotNull(),
            )
        )
        return let(
            starts,
            lambda s: F.aggregate(
                F.transform(s, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(s, j + 1) - p, F.lit(width)))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(pairs, covered))


def measures(text: Column) -> Column:
    """All measurements of a text in one struct."""
    t = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return let(
            gram_hashes(word_hashes(words), WINDOW),
            lambda keys: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                _repeated_words(keys, WINDOW).cast("long").alias("n_repeat_words"),
                F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("long").alias("n_stutter"),
            ),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    def count(chars: str) -> Column:
        found = t.rlike("[" + chars.replace("|", r"\|") + "]")
        return F.when(found, F.length(t) - F.length(F.translate(t, chars, ""))).otherwise(F.lit(0)).cast("long")

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]"))
    return F.struct(
        let(split_words(t), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        count(SYMBOLS).alias("n_symbols"),
        count("!").alias("n_exclamations"),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and ``fail_bits``; ``text`` stays as it is."""
    names = [c for c in docs.columns if c not in (*MEASURES, "fail_bits")]
    kept, m = [f"`{c}`" for c in names], fresh("_m", names)
    m = once(docs.select(*kept), m, measures(F.col(f"`{text}`"))).select(
        *kept,
        *[F.col(f"{m}.w.{c}").alias(c) for c in ("n_words", "word_chars", "n_repeat_words", "n_stutter")],
        *[F.col(f"{m}.l.{c}").alias(c) for c in ("n_lines", "n_dup_lines")],
        *[F.col(f"{m}.{c}").alias(c) for c in ("n_symbols", "n_exclamations")],
    )
    bits = sum((F.when(F.expr(r.failed), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)), F.lit(0))
    return m.withColumn("fail_bits", bits.cast("int"))


def apply_policy(of_ledger: DataFrame, policy: str, column: str = "kept") -> DataFrame:
    """Adds the verdict of a versioned policy, from the bits alone."""
    return of_ledger.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablation(of_ledger: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that stay without it.

    The ledger shrinks to one row for each set of bits before anything else is computed.
    """
    rules = mask(POLICIES[policy])
    sets = of_ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(rules)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).alias("bit")) for i, r in enumerate(RULES) if rules >> i & 1]))
    return (
        sets.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )
