"""Whole texts to token ids by the tokenizers library, by chunks that are kept.

Both supported kinds of tokenizers cut texts into pre-tokens by a pattern before
any merge, and encode each pre-token by itself. A text can therefore be cut
wherever a pre-token must begin, and equal chunks have equal ids:

* ``byte_level`` (the pattern of byte-level BPE, where a blank belongs to the
  word behind it): before a space that a non-blank follows; and around a line
  feed between two non-blanks.
* ``word`` (blanks are dropped): at spaces and line feeds.

A batch of texts is cut by Arrow, which also finds its distinct chunks; only these are
looked up or encoded, and ids are then gathered for about ``RUN`` chunks at once. Two
generations of chunks of up to ``LONGEST`` characters are kept for each worker, each of
``KEEP`` or the chunks of one slice of ``SLICE`` bytes (those in use move on when the
older one goes). A new chunk that is a Latin word with or without punctuation behind it
is two pre-tokens at most; the library's model gets these directly, spelled as its
pre-tokenizer would spell them. Other chunks go through the whole of the library. Names
of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode

import numpy as np

KEEP, LONGEST, SLICE, RUN = 150_000, 48, 16_000_000, 250_000
#: Blanks other than the space and the line feed, as Unicode has them.
_ODD = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_WORD_START = re.compile(r" (?=\S)")
#: Letters of Latin-1 that keep their length in lower case.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: ASCII punctuation without the apostrophe, which begins contractions.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Texts whose blanks don't all stand alone between two non-blanks, as spaces or line feeds.
_UNUSUAL = r"[ \n][ \n]|\A[ \n]|[ \n]\z|" + _ODD.pattern


def _byte_letters() -> str:
    """How byte-level pre-tokenizers spell each byte: printable ones as themselves, the others from U+0100 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


_SPELLED = _byte_letters()


class ChunkEncoder:
    def __init__(self, path: str, kind: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.ids = [array("I", [i]).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.keep, self.spaced = keep, kind == "byte_level"
        self.line = self._library("\n") if self.spaced else b""
        self.new: dict = {}
        self.old: dict = {}
        self.marks: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, pre_token: str) -> bytes:
        """The ids of one pre-token."""
        spelled = charmap_decode((pre_token if self.spaced else pre_token.lower()).encode(), "strict", _SPELLED)[0]
        tokens = self.tokenize(spelled)
        return self.ids[tokens[0].id] if len(tokens) == 1 else b"".join([self.ids[t.id] for t in tokens])

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= self.keep:
                self.marks.clear()
            self.marks[marks] = self._piece(marks)
        return self.marks[marks]

    def _chunk(self, key) -> bytes:
        """The ids of one chunk: (text,) at a text's start, one that begins with a line feed, any other without its leading space."""
        said, before, space = key, b"", ""
        if self.spaced:
            if isinstance(key, tuple):
                said = key[0]
            elif key[:1] != "\n":
                space = " "
            if not space and said[:1] == "\n" and len(said) > 1 and not said[1].isspace():  # a pre-token of its own before a non-blank
                said, before = said[1:], self.line
        word = said.rstrip(_MARKS)
        if word.isalpha() and len(said) <= LONGEST and (word.isascii() or _LATIN.fullmatch(word)):
            found = before + self._piece(space + word)
            return found if len(word) == len(said) else found + self._marks(said[len(word) :])
        return before + self._library(space + said)

    def _found(self, keys: list) -> list[bytes]:
        """The ids of different chunks."""
        values, old, made = list(map(self.new.get, keys)), self.old, {}
        for i, value in enumerate(values):
            if value is None:
                key = keys[i]
                value = old.get(key)
                if value is None:
                    value = self._chunk(key)
                values[i] = value
                if len(key) <= LONGEST:
                    made[key] = value
        if len(self.new) + len(made) > self.keep:
            self.old, self.new = self.new, made
        else:
            self.new |= made
        return values

    def _whole(self, text: str) -> bytes:
        """The ids of a text with unusual blanks."""
        if not text:
            return b""
        first, *rest = _WORD_START.split(text)
        distinct = list(set(rest))
        of = dict(zip(distinct, self._found(distinct), strict=True))
        return b"".join([self._chunk((first,)), *map(of.__getitem__, rest)])

    def encode(self, texts, end_id: int | None = None):
        """Runs of texts (of an Arrow array of strings; null ones are empty) as (first, last, ids, ends), last exclusive.

        ids are those of all texts of a run, ends where each one's end; with an end id, it stands behind each text.
        """
        import pyarrow.compute as pc

        texts, unusual = pc.fill_null(texts, ""), []
        if self.spaced:
            odd = pc.match_substring_regex(texts, _UNUSUAL)
            unusual = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            lists = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        else:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        starts = flat.take(offsets[:-1]).to_pylist() if self.spaced else []
        found = flat.dictionary_encode()
        del lists, flat
        codes, values = found.indices.to_numpy(), self._found(found.dictionary.to_pylist())
        if starts:  # what begins a text has no space before it
            own = [self._chunk((x,)) for x in starts]
            for i in unusual:
                own[i] = self._whole(texts[int(i)].as_py())
            codes = codes.copy()
            codes[offsets[:-1]] = len(values) + np.arange(len(own))
            values += own
        sizes = np.fromiter(map(len, values), np.int32, len(values)) // 4
        known = np.frombuffer(b"".join(values), "<u4")
        del found, values
        before = np.cumsum(sizes, dtype=np.int64) - sizes
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN, "right")) - 1)
            own = codes[offsets[first] : offsets[last]]
            lengths = sizes[own]
            ends = np.cumsum(lengths, dtype=np.int64)
            at = np.repeat(before[own] - (ends - lengths), lengths)
            at += np.arange(len(at))
            ids, ends = known[at], np.concatenate([np.zeros(1, np.int64), ends])[offsets[first + 1 : last + 1] - offsets[first]]
            if end_id is not None:
                ids, ends = np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)
            yield first, last, ids, ends
            first = last


_ENCODERS: dict[tuple[str, str, int], ChunkEncoder] = {}


def encoder(path: str, kind: str, keep: int = KEEP) -> ChunkEncoder:
    """One for each Python worker, kept from task to task."""
    if (path, kind, keep) not in _ENCODERS:
        _ENCODERS[path, kind, keep] = ChunkEncoder(path, kind, keep)
    return _ENCODERS[path, kind, keep]


def text_slices(batch, limit: int = SLICE):
    """Parts of a record batch (doc_id, text) of about so many bytes of text at most, or of one row."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def slices(batch, limit: int = 4_000_000):
    """Parts of a record batch (doc_id, text) as lists (ids, texts), of about so many characters at most; null texts are empty."""
    ids, texts, total = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        ids.append(doc_id)
        texts.append(text or "")
        total += len(texts[-1])
        if total >= limit:
            yield ids, texts
            ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def give_back() -> None:
    """Returns what a finished task has freed to the system, as workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has its own ways
        return
