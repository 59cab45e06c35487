"""Checks of templates against a live tokenizer, given as functions; they run on the driver, once for a run."""

from __future__ import annotations

from collections.abc import Callable, Iterable

Encode = Callable[[str], list[int]]
#: Where markers are looked for: enclosed CJK letters and months (fixed values).
FIRST_MARKER, LAST_MARKER = 0x3200, 0x33FF


def marker(encode: Encode, kept: dict[str, str], name: str) -> tuple[str, int]:
    """The first code point that is a single token, kept by the tokenizer's name and verified again."""
    options: Iterable[str] = [kept[name]] if name in kept else map(chr, range(FIRST_MARKER, LAST_MARKER + 1))
    for c in options:
        ids = encode(c)
        if len(ids) == 1:
            kept[name] = c
            return c, ids[0]
    raise ValueError(f"{name} has no marker that is a single token")


def kept_markers(said: str) -> dict[str, str]:
    """The markers found for each tokenizer so far, from YAML text; an empty text has none."""
    import yaml

    found = yaml.safe_load(said) or {}
    if not all(isinstance(c, str) and len(c) == 1 for c in found.values()):
        raise ValueError("a kept marker isn't a single character")
    return found


def suffix_ids(encode: Encode, template: str, placeholder: str = "{explanation}") -> list[int]:
    """Ids of what follows the placeholder, without the first, which may join the text before it; at least two must be there."""
    if template.count(placeholder) != 1:
        raise ValueError("the template must hold its placeholder once")
    ids = encode(template.split(placeholder)[1])[1:]
    if len(ids) < 2:
        raise ValueError("the template's end is too short to be recognised")
    return ids


def neighbours(ids: list[int], mark: int) -> tuple[int, int]:
    """The ids on both sides of the only marker, which must not stand at an end."""
    at = [i for i, t in enumerate(ids) if t == mark]
    if len(at) != 1 or at[0] in (0, len(ids) - 1):
        raise ValueError("the prompt must hold one marker, not at its ends")
    return ids[at[0] - 1], ids[at[0] + 1]
