"""Plain versions of the operators, one row at a time, to hold results against."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def low(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def decontamination(docs, items):
    windows: dict = {}
    for item_id, text in items:
        w = item_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item_id) if item_id is not None else "")
    lengths = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        w, hit, found = item_words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    found |= got
                    hit.update(range(i, i + n))
        out[doc_id] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def pii(text):
    spans = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if good(m[0])] for k, p, good in PII}
    return (*(len(spans[k]) for k, _, _ in PII), sha(",".join(f"{k}:{a}:{b}" for k, _, _ in PII for a, b in spans[k])))


def quality(text):
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), n < 20 or 100 * len(again) > 30 * n)


def rejected(text):
    """By the pipeline's policy."""
    n, chars, symbols, same, again, _ = quality(text)
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    stutter = sum(a == b for a, b in zip(w, w[1:], strict=False))
    return n == 0 or 100 * again > 30 * n or 100 * symbols > 30 * n or 100 * (text or "").count("!") > 50 * n or chars > 40 * n or len(lines) >= 10 and 100 * same > 70 * len(lines) or 100 * stutter > 30 * n


def shingle_set(text, k):
    w = words_of(low(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(docs, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where: dict = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, (_, s) in enumerate(sets):
        shared = Counter(j for x in s for j in where[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (doc_id, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: (len(s), least[find(i)]) for i, (doc_id, s) in enumerate(sets)}


def chat(turns):
    """turns: (role, text) in order."""
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha(said), len(loss), sha(loss)


def ids_of(path, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def check_packing(pieces, ids_by_doc, length=4096):
    """pieces: dicts; every id in one piece, gapless sequences, right checksums. Gives the share of padding."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == ids_by_doc.keys()
    for doc_id, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids_by_doc[doc_id])
            assert p["ids_crc32"] == crc(ids_by_doc[doc_id][at : at + p["length"]])
            at += p["length"]
        assert at == len(ids_by_doc[doc_id])
    pad = used = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length
        used += at
        pad += 0 if at & (at - 1) == 0 else length - at
    return pad / max(1, used)


def viterbi(word, scores, unknown):
    said = "▁" + word
    best = [(0.0, 0)] + [None] * len(said)
    for i in range(1, len(said) + 1):
        options = []
        for j in range(i):
            if said[j:i] in scores:
                options.append((best[j][0] + scores[said[j:i]], best[j][1] - 1))
        if said[i - 1] not in scores:
            size = len(said[i - 1].encode())
            options.append((best[i - 1][0] + size * unknown, best[i - 1][1] - size))
        best[i] = max(options)
    return -best[-1][1]
