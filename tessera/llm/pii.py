"""Personal data: patterns propose spans, validators confirm them, context words score them.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of
their patterns that pass their check (parts of at most 255; Luhn; numbers of
digits); they stay whatever their score. Further kinds: ``iban`` (confirmed by
mod 97), ``local_phone`` (digits like 555-123-4567, which need a context word
nearby) and ``secret`` (a long value that is assigned to a name like token). A span's score is its pattern's, plus its validator's, plus
``CONTEXT_SCORE`` if a context word stands near it; further kinds need
``THRESHOLD``.

The patterns are written with possessive quantifiers and boundaries that admit
the same matches without trying again inside a run of characters, so their time
is linear in the text. Offsets count code points, ends are exclusive. Offsets
come from the lengths of the matches and of the pieces between them.

A null text is empty and has no spans. Each input row gets one row. Columns
other than the text are kept by ``redact`` and ``find``; one named ``spans``
is replaced by ``find``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let

CONTEXT_SCORE, THRESHOLD, NEAR = 0.35, 0.7, 48


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a pattern that any text with a match fits, cheap to test
    score: float
    base: bool
    context: str  # words, lower-cased


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, True, "mail|write|contact"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.5, True, r"\bip\b|host|server|address"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9][ -]?[0-9]", 0.3, True, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.6, True, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.3, False, "iban|account|bank"),
    Kind("local_phone", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}", 0.4, False, "phone|tel|call|mobile|fax"),
    Kind("secret", r"(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api[_-]?key) ?[=:] ?[\"']?[A-Za-z0-9/+_.-]{16,}+[\"']?", r"[=:] ?[\"']?[A-Za-z0-9/+_.-]{16}", 0.8, False, "key"),
)
#: What a confirmed value adds to the score; a kind without a validator has none to add.
VALIDATOR_SCORE = {"ip": 0.3, "card": 0.6, "phone": 0.2, "iban": 0.6}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda d: F.when(d > 9, d - 9).otherwise(d)),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has its check digits right."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    each = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(each, F.lit(0), lambda a, d: F.when(d > 9, a * 100 + d).otherwise(a * 10 + d) % 97) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(value, F.lit(" "), F.lit("")))
    return F.lit(True)


def scanned_before(values: Column, start: int, merge, block: int = 128) -> Column:
    """What merge(a, b) makes of ``start`` and all earlier values, for each; by blocks, so that the time stays far from quadratic."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(start), merge)

    def of_blocks(totals: Column) -> Column:
        return let(
            F.transform(totals, lambda x, b: total(F.slice(totals, F.lit(1), b))),
            lambda before: F.flatten(
                F.transform(
                    totals,
                    lambda x, b: let(
                        F.slice(values, b * block + 1, F.lit(block)),
                        lambda own: F.transform(own, lambda y, i: merge(F.get(before, b), total(F.slice(own, F.lit(1), i)))),
                    ),
                )
            ),
        )

    starts = F.sequence(F.lit(0), ((F.greatest(F.size(values), F.lit(1)) - 1) / block).cast("int"))
    return let(F.transform(starts, lambda b: total(F.slice(values, b * block + 1, F.lit(block)))), of_blocks)


def sums_before(values: Column) -> Column:
    return scanned_before(values, 0, lambda a, b: a + b)


def _cutter(text: Column, body, block: int = 2048) -> Column:
    """body(cut), where cut(a, b) is the text from code point a to b; by blocks, as a place in UTF-8 is found by counting from its beginning."""

    def with_blocks(blocks: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            i, j = (a / block).cast("int"), (b / block).cast("int")
            own = F.get(blocks, i)
            across = F.concat(F.substr(own, a % block + 1), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.left(F.get(blocks, j), b % block), F.lit("")))
            return F.when(b <= a, "").when(i == j, F.substr(own, a % block + 1, b - a)).otherwise(across)

        return body(cut)

    return let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block), F.lit(0)), with_blocks)


def _spans(text: Column, kind: Kind) -> Column:
    """array of (kind, start, end, score), in order of start."""

    def of(pieces: Column, values: Column) -> Column:
        def one(value: Column, i: Column, at: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(pieces, i))
            near = F.lower(F.concat(F.right(F.get(pieces, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(pieces, i + 1), F.lit(NEAR))))
            score = F.lit(kind.score + VALIDATOR_SCORE.get(kind.name, 0)) + F.when(near.rlike(kind.context), CONTEXT_SCORE).otherwise(0.0)
            good = _confirmed(kind.name, value)
            if not kind.base:
                good = F.when(good, score >= THRESHOLD).otherwise(F.lit(False))
            return F.when(good, F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), score.cast("double").alias("score")))

        lengths = F.transform(values, lambda v, i: F.length(v) + F.length(F.get(pieces, i)))
        made = let(lengths, lambda x: let(sums_before(x), lambda at: F.transform(values, lambda v, i: one(v, i, at))))
        return F.filter(made, lambda s: s.isNotNull())

    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    found = let(F.struct(F.split(text, kind.pattern).alias("pieces"), values.alias("values")), lambda x: of(x["pieces"], x["values"]))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(text.rlike(kind.hint), found).otherwise(none)


def all_spans(text: Column) -> Column:
    """All spans of a text: by kind in the order of KINDS, then by start."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.concat(*[_spans(t, k) for k in KINDS]))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``spans``, an array of (kind, start, end, score)."""
    return docs.withColumn("spans", all_spans(F.col(f"`{text}`")))


def _rewritten(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the name of its first kind."""

    def of(ordered: Column, reached: Column) -> Column:
        # A span opens a run if it starts where all earlier ones have ended; what they reach is where the text goes on.
        opening = F.transform(ordered, lambda s, i: F.struct(F.get(reached, i).alias("at"), s["start"].alias("start"), s["kind"].alias("kind"), (s["start"] >= F.get(reached, i)).alias("opens")))
        last = F.aggregate(ordered, F.lit(0), lambda a, s: F.greatest(a, -s["back"]))
        piece = lambda cut: lambda r: F.concat(cut(r["at"], r["start"]), F.lit("["), F.upper(r["kind"]), F.lit("]"))
        return let(F.filter(opening, lambda r: r["opens"]), lambda runs: _cutter(text, lambda cut: F.concat(F.array_join(F.transform(runs, piece(cut)), ""), let(last, lambda x: cut(x, F.length(text))))))

    sorted_ = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    reached = lambda o: scanned_before(F.transform(o, lambda s: -s["back"]), 0, lambda a, b: F.greatest(a, b))
    return let(sorted_, lambda o: let(reached(o), lambda m: of(o, m)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; texts without spans, and null ones, stay."""
    column = F.col(f"`{text}`")
    changed = let(all_spans(column), lambda s: F.when(F.size(s) > 0, _rewritten(column, s)).otherwise(column))
    return docs.withColumn(text, changed)
