"""Words of whole texts found in Arrow buffers by NumPy: classes of bytes, spans, and hashes that can be verified.

UTF-8 lets all this work on bytes: the separators are ASCII, and bytes of longer characters are over 127.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Texts are taken in slices of about so many bytes (one longer text is a slice by itself), which bounds what is held.
SLICE_BYTES = 2_000_000
#: Zero bytes behind a slice, so that eight bytes can be read at any place.
PAD = 8
#: Longer words are hashed by a library, in one call.
LONG_WORD = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def byte_class(chars: str) -> np.ndarray:
    """Which of the 256 bytes are among these ASCII characters."""
    found = np.zeros(256, dtype=bool)
    found[[ord(c) for c in chars]] = True
    return found


def slices(texts, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of an Arrow array of texts; a null is empty, and ``PAD`` zeros follow the bytes."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, at, data = texts.buffers()
    at = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        own = np.concatenate([data[at[first] : at[end]], np.zeros(PAD, dtype=np.uint8)])
        yield first, end, own, at[first : end + 1] - at[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the maximal runs of bytes of a class within each text."""
    n = int(offsets[-1])
    flags = inside[data[:n]]
    opens, closes = flags.copy(), flags.copy()
    opens[1:] &= ~flags[:-1]
    closes[:-1] &= ~flags[1:]
    # A text's first byte opens a run whatever stands before it in the buffer, and its last closes one.
    full = offsets[1:] > offsets[:-1]
    firsts, lasts = offsets[:-1][full], offsets[1:][full] - 1
    opens[firsts], closes[lasts] = flags[firsts], flags[lasts]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(offsets, starts, side="right") - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def _chunk(eights: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    return eights[starts + 8 * k] & _MASKS[np.minimum(lengths - 8 * k, 8)]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word; equal words have equal ones, and verified() tells whether the converse holds."""
    lengths, eights = ends - starts, _eights(data)
    out = _mixed(_chunk(eights, starts, lengths, 0) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD))
    k = 1
    while len(more):
        out[more] = _mixed(out[more] * np.uint64(3) ^ _chunk(eights, starts[more], lengths[more], k))
        k += 1
        more = more[lengths[more] > 8 * k]
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def verified(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, starts2: np.ndarray, ends2: np.ndarray) -> np.ndarray:
    """Whether pairs of words, by place in data and in other, have the same bytes."""
    lengths, eights, eights2 = ends - starts, _eights(data), _eights(other)
    same = lengths == ends2 - starts2
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        if k == LONG_WORD // 8:
            for i in left:
                same[i] = np.array_equal(data[starts[i] : ends[i]], other[starts2[i] : ends2[i]])
            break
        equal = _chunk(eights, starts[left], lengths[left], k) == _chunk(eights2, starts2[left], lengths[left], k)
        same[left[~equal]] = False
        k += 1
        left = left[equal & (lengths[left] > 8 * k)]
    return same
