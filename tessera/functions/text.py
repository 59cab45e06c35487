"""Text functions as column expressions: tags, cleaning, parsing, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.columns import let

OPEN, CLOSE = "<explanation>", "</explanation>"
ANALYSIS_PATTERN = r"<analysis>\s*(.*?)\s*</analysis>"
INJECT = "<INJECT>"
LETTERS = "ABCDEFGH"
MIN_FEATURES = 2
#: Blocks whose characters have "CJK" in their Unicode 15.1 names (fixed values).
CJK_RANGES = (
    "2E80-2E99 2E9B-2EF3 31C0-31E3 3400-4DBF 4E00-9FFF F900-FA6D FA70-FAD9 1F210-1F212 1F214-1F23B 1F240-1F248 "
    "20000-2A6DF 2A700-2B739 2B740-2B81D 2B820-2CEA1 2CEB0-2EBE0 2EBF0-2EE5D 2F800-2FA1D 30000-3134A 31350-323AF"
)


#: Unicode's white space (fixed values).
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Unicode white space off both ends; trim() without a list knows the space alone."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def _tagged(text: Column, pattern: str) -> Column:
    """The first group, or null where the pattern doesn't match (regexp_extract gives '' for both)."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def between(text: Column, opened: str, closed: str) -> Column:
    """What stands between the first opening tag and the next closing one, stripped; null without such a pair. Found by plain search."""

    def of(behind: Column) -> Column:
        end = F.instr(behind, F.lit(closed))
        return F.when(end > 0, strip(F.left(behind, end - 1)))

    at = F.instr(text, F.lit(opened))
    return F.when(at > 0, let(F.substr(text, at + len(opened)), of))


def extract_explanation(text: Column) -> Column:
    """The stripped payload of the first tag pair; null without a pair, '' for an empty one."""
    return between(text, OPEN, CLOSE)


def wrap_explanation(text: Column) -> Column:
    return F.concat(F.lit(OPEN + "\n"), text, F.lit("\n" + CLOSE))


# What a line may begin with, and a bold head, as explanations of this kind are cleaned everywhere.
_MARKER = r"(?Ud)^\s*(?:[-*•+–—]|\d+[.)]|\(\d+\)|[a-zA-Z][.)]|\([a-zA-Z]\)|[ivxIVX]+[.)])\s+"
_BOLD = r"(?Ud)^\*\*(.+?)\*\*\s*"


def clean_explanation(text: Column, pattern: str = ANALYSIS_PATTERN) -> Column:
    """The tagged text as plain paragraphs between empty lines; null without tags."""

    def may_be_marked(x: Column) -> Column:
        """A cheap test that lets every line with a marker pass: what stands first, and second where that is a letter."""
        first, second = F.ascii(x), F.substring(x, 2, 1)
        return first.between(33, 64) | (first > 122) | second.isin(".", ")") | F.left(x, F.lit(1)).isin("i", "v", "x", "I", "V", "X")

    def line(x: Column) -> Column:
        unmarked = F.when(may_be_marked(F.ltrim(x, F.lit(WHITE_SPACE))), F.regexp_replace(x, _MARKER, "")).otherwise(x)
        plain = let(unmarked, lambda y: F.when(F.contains(y, F.lit("**")), F.regexp_replace(y, _BOLD, "$1 ")).otherwise(y))
        return F.btrim(strip(plain), F.lit("*_"))

    said = between(text, "<analysis>", "</analysis>") if pattern == ANALYSIS_PATTERN else _tagged(text, "(?sU)" + pattern)
    lines = F.transform(F.split(said, "\n"), line)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n\n")


def n_features(explanation: Column) -> Column:
    return F.size(F.split(explanation, "\n\n"))


def fill_template(template: str, placeholder: str, value: Column) -> Column:
    """Literal replacement: values may hold braces or anything a pattern would read."""
    return F.replace(F.lit(template), F.lit(placeholder), value)


def inject_marker(messages: Column, marker: str) -> Column:
    return F.transform(messages, lambda m: m.withField("content", F.replace(m["content"], F.lit(INJECT), F.lit(marker))))


def tail_snippet(text: Column, chars: int = 700) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.lit("... "), F.right(text, F.lit(chars)))).otherwise(text)


def head(text: Column, chars: int) -> Column:
    return F.nullif(F.left(text, F.lit(chars)), F.lit(""))


def right_truncated(ids: Column, longest: int) -> Column:
    """The first ids; what is behind them is cut off."""
    return F.slice(ids, F.lit(1), F.lit(longest))


def parse_score(text: Column) -> Column:
    """The first standalone number from 1 to 10, else null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(10|[1-9])\b", 1), F.lit("")).try_cast("int")


def parse_letter(text: Column, k: int) -> Column:
    """The place of the first standalone letter among the first k, else null."""
    found = F.regexp_extract(F.upper(strip(F.coalesce(text, F.lit("")))), rf"\b([{LETTERS[:k]}])\b", 1)
    return F.when(found != "", F.instr(F.lit(LETTERS), found) - 1)


def cjk_class() -> str:
    return "[" + "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in CJK_RANGES.split()) + "]"


def cjk_fraction(text: Column) -> Column:
    size = F.length(text)
    return F.when(size > 0, (size - F.length(F.regexp_replace(text, cjk_class(), ""))) / size).otherwise(F.lit(0.0))


def is_remote(path: Column) -> Column:
    return F.instr(path, "://") > 0


def slice_suffix(path: Column) -> Column:
    """A path's ``@[a:b]`` suffix as (path, start, end); null bounds where it has none."""
    pattern = r"^(.*)@\[([0-9]*):([0-9]*)\]$"
    has = path.rlike(pattern)
    bound = lambda i: F.nullif(F.regexp_extract(path, pattern, i), F.lit("")).try_cast("long")
    return F.struct(
        F.when(has, F.regexp_extract(path, pattern, 1)).otherwise(path).alias("path"),
        F.when(has, bound(2)).alias("start"),
        F.when(has, bound(3)).alias("end"),
    )


def document_key(corpus: str, split: str, row: Column) -> Column:
    return F.concat(F.lit(f"{corpus}:{split}:"), row.cast("string"))


def last_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
