"""Scans of Arrow buffers, the filter audit, lexical search and near duplicates of vectors against plain versions."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import filter_audit, lexical_search, nn_descent, text_scan

from . import brute

TEXT = st.text(st.sampled_from("ab Zé\t\n\x0b\x00\x1c漢𝄞#$.9") | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=12), st.integers(1, 40), st.integers(0, 3))
def test_words_of_slices(texts, most, skip):
    """Words of whole texts, whatever the slices and the array's own offset; equal hashes for equal words, and verified pairs."""
    array = pa.array(["first"] * skip + texts, pa.string())[skip:]
    got, words = {}, []
    for first, end, data, offsets in text_scan.slices(array, most):
        assert end > first and not data[offsets[-1] :].any()
        starts, ends, rows = text_scan.spans(data, offsets, filter_audit._INSIDE)
        for a, b, row, h in zip(starts, ends, rows, text_scan.word_hashes(data, starts, ends), strict=True):
            got.setdefault(first + row, []).append(data[a:b].tobytes().decode())
            words.append((data[a:b].tobytes(), int(h)))
        if len(starts):
            i, j = np.triu_indices(len(starts))
            same = text_scan.verified(data, starts[i], ends[i], data.copy(), starts[j], ends[j])
            assert same.tolist() == [data[starts[x] : ends[x]].tobytes() == data[starts[y] : ends[y]].tobytes() for x, y in zip(i, j, strict=True)]
    assert got == {i: w for i, t in enumerate(texts) if (w := brute.words_of(t))}
    assert len(set(words)) == len({w for w, _ in words})


def test_long_words():
    long = ["x" * n for n in (7, 8, 9, 255, 256, 257, 300_000)] + ["x" * 299_999 + "y", "x" * 256 + "y", "y" + "x" * 256]
    (_, _, data, offsets), *rest = text_scan.slices(pa.array([" ".join(long + long)]))
    assert not rest
    starts, ends, _ = text_scan.spans(data, offsets, filter_audit._INSIDE)
    assert len(set(text_scan.word_hashes(data, starts, ends).tolist())) == len(long) == len(starts) // 2
    n = len(long)
    assert text_scan.verified(data, starts[:n], ends[:n], data, starts[n:], ends[n:]).all()
    assert not text_scan.verified(data, starts[-3:], ends[-3:], data, np.roll(starts[-3:], 1), np.roll(ends[-3:], 1)).any()


def plain_mask(text):
    t = text or ""
    w = brute.words_of(t)
    failed = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)))
    return sum(1 << i for i, x in enumerate(failed) if x)


def plain_audit(docs, labels):
    """One document and one order at a time."""
    out, rows = {}, []
    for doc_id, text, lang in docs:
        copy = any(doc_id is not None and i is not None and i < doc_id and (t or "") == (text or "") for i, t, _ in docs)
        own = [x for x in labels if x[0] == doc_id and doc_id is not None]
        rows.append((lang or "", plain_mask(text) | 16 * copy, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    for part in {r[0] for r in rows}:
        removed = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            every = list(left)
            for step, f in enumerate(order, 1):
                fails = lambda r, bit=1 << "ABCDE".index(f): r[1] & bit
                gone = [r for r in left if fails(r)]
                redundant = sum(1 for r in every if fails(r)) - len(gone)
                left = [r for r in left if not fails(r)]
                removed[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(r[1] == 1 << "ABCDE".index(f) for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(removed[order[step - 1]])
    return {k: tuple(x) for k, x in out.items()}


def audit_docs():
    rng = random.Random(5)
    texts = [None, "", " ", "one", "A" * 30, "x#y", " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i % 90}" for i in range(250)), "Ab " * 400, "é" * 200_000 + " z" * 300]
    while len(texts) < 60:
        words = [rng.choice(["one", "Two", "naïve", "𝄞", "A%"]) + str(rng.randrange(rng.choice([5, 400]))) for _ in range(rng.randrange(1, 300))]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    docs = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    docs += [(100 + i, t, "en") for i, t in enumerate(texts[::3])] + [(3, "one", "de"), (3, "one", "en"), (None, "one", "en"), (None, texts[6], None), (None, texts[6], None), (-4, texts[20], "de")]
    return docs


def test_filter_audit(spark):
    docs = audit_docs()
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 70, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (8, None, None)]
    made = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id long, text string, lang string, part string, bits string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in filter_audit.audit(made, known).collect()}
    assert got == plain_audit(docs, labels)
    assert filter_audit.audit(made.limit(0), known).count() == 0
    assert filter_audit.audit(made, known.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_masks_where_words_share_a_hash(monkeypatch):
    texts = [t for _, t, _ in audit_docs()]
    want = [plain_mask(t) for t in texts]
    bits, digests = filter_audit.masks_of(pa.array(texts))
    assert bits.tolist() == want and digests[0] == digests[1] != digests[2]
    monkeypatch.setattr(text_scan, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3) << np.uint64(40))
    assert filter_audit.masks_of(pa.array(texts))[0].tolist() == want


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.low(text or ""))


def plain_search(docs, items, k):
    """Every document against every item, in whole numbers."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, n_docs = sum(n for _, _, n in held), len(held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def search_rows():
    rng = random.Random(9)
    words = [f"t{i}" for i in range(60)] + ["Élan", "straße", "x" * 9, "x" * 300, "y9", "漢字", "a-b_c"]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([3, 30, 300])))) for i in range(150)]
    docs += [(200 + i, docs[i % 4][1]) for i in range(60)]  # ties
    docs += [(7, docs[7][1]), (None, docs[1][1]), (None, docs[1][1].upper()), (300, None), (301, ""), (302, "... \t"), (303, "T1 " * 100_000), (-5, docs[2][1])]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(20)] + [(3, "t59 more"), (None, "t1 t2"), (50, None), (51, ""), (52, "unknown words alone"), (53, docs[0][1]), (54, "t1")]
    return docs, items


@pytest.mark.parametrize(("k", "block"), [(10, 50_000), (3, 30), (1000, 50_000)])
def test_lexical_search(spark, monkeypatch, k, block):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    docs, items = search_rows()
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, score string").repartition(6)
    q = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, rank string")
    want = plain_search(docs, items, k)
    assert sorted(map(tuple, lexical_search.search(d, q, k).collect()), key=repr) == want
    assert {r[0] for r in want} >= {None, 3, 53} and not {50, 51, 52} & {r[0] for r in want}


def test_lexical_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("false"), items.filter("false")), (docs.withColumn("text", F.lit("?!")), items), (docs, items.withColumn("text", F.lit("?!")))):
        assert lexical_search.search(d, q).collect() == []


def test_bounds_hold_and_rescoring_is_exact():
    """Small batches in turn, with as many ties as there may be, give what all scores at once give."""
    rng = np.random.default_rng(2)
    for trial in range(20):
        n, terms, k = 300, 12, int(rng.integers(1, 12))
        tf = rng.integers(0, 4, size=(terms, n)) * rng.integers(0, 2, size=(terms, n))
        weights, m = rng.integers(0, 13_000, size=terms).astype(float), 10 + rng.integers(0, [2, 10**9][trial % 2], size=n)
        impact = (10**9 * tf) // np.maximum(1, 1000 * tf + 8 * m)
        rough = -(-impact * lexical_search.LEVELS // lexical_search.SCALE)
        assert (rough <= 255).all() and (rough * lexical_search.SCALE >= impact * lexical_search.LEVELS).all()
        own, best, keys = np.arange(0, terms, 2), None, np.stack([np.zeros(n, dtype=np.int64), rng.permutation(n)], axis=1)
        best = lexical_search.Best(own, weights[own], k)
        for a in range(0, n, 37):
            best.take(rough[:, a : a + 37].astype(np.uint8), tf[:, a : a + 37].astype(np.int32), m[a : a + 37], keys[a : a + 37])
        exact = (weights[own].astype(np.int64)[:, None] * impact[own]).sum(axis=0)
        want = sorted((-int(s), int(i)) for s, i in zip(exact, keys[:, 1], strict=True) if s > 0)[:k]
        assert [(-int(s), int(i)) for s, i in zip(best.scores, best.ids[:, 1], strict=True)] == want


def test_terms_that_share_a_hash(monkeypatch):
    docs, items = search_rows()
    terms = sorted({t for _, text in items for t in terms_of(text)})
    texts = pa.array([t for _, t in docs])
    n, ids, tfs = lexical_search._postings_of(texts, lexical_search.Vocabulary(terms))
    assert n.to_pylist() == [len(terms_of(t)) for _, t in docs]
    asked = set(terms)
    want = [{t: c for t, c in Counter(terms_of(t)).items() if t in asked} for _, t in docs]
    assert [{terms[i]: c for i, c in zip(a, b, strict=True)} for a, b in zip(ids.to_pylist(), tfs.to_pylist(), strict=True)] == want
    monkeypatch.setattr(text_scan, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(2))
    _, ids, tfs = lexical_search._postings_of(texts, lexical_search.Vocabulary(terms))
    assert [{terms[i]: c for i, c in zip(a, b, strict=True)} for a, b in zip(ids.to_pylist(), tfs.to_pylist(), strict=True)] == want


VECTORS = "vec_id long, embedding array<float>, label int, id long, v string"


def plain_links(rows, least=0.9):
    """(n_links, component) by row, of all pairs."""
    good = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for d in {len(r[1]) for r in rows if good(r[1])}:
        at = [i for i, r in enumerate(rows) if good(r[1]) and len(r[1]) == d]
        x = np.array([rows[i][1] for i in at], dtype=np.float32).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            links[at[i]] += 1
            links[at[j]] += 1
            root[find(at[i])] = find(at[j])
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, r in enumerate(rows):
        first[find(i)] = min(first.get(find(i), r[0]), r[0], key=order) if find(i) in first else r[0]
    return [(r[0], links[i], first[find(i)], first[find(i)] == r[0]) for i, r in enumerate(rows)]


def vectors(seed=1, d=24):
    """Copies, tight and wide groups, a chain, pairs on either side of the threshold, and rows without a direction."""
    rng = np.random.default_rng(seed)
    out = list(rng.standard_normal((300, d)))
    for g in range(30):
        centre = rng.standard_normal(d)
        out += [centre + rng.standard_normal(d) * rng.uniform(0.05, 0.4) for _ in range(g % 7 + 2)]
    centre = rng.standard_normal(d)
    out += [centre * s for s in (1, 2, 3e-20, 1e20)] + [centre] * 40 + [centre + rng.standard_normal(d) * 0.1 for _ in range(150)]
    wide = rng.standard_normal(d)
    out += [wide + rng.standard_normal(d) * 0.3 for _ in range(80)]
    a, b = np.linalg.qr(rng.standard_normal((d, 2)))[0].T
    out += [np.cos(t) * a + np.sin(t) * b for t in np.arange(40) * 0.12]
    rows = [x.astype(np.float32).tolist() for x in out] + [None, [], [0.0] * d, [-0.0] * d, [1.0, None] * (d // 2), [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [1.0, 2.0], [2.0, 4.0], [1.0], [5.0], [-5.0]]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    rows = [(int(i), v) for i, v in zip(ids, rows, strict=True)]
    return rows + [rows[310], rows[310], (None, rows[320][1]), (None, rows[0][1]), (None, None)]


def as_vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], VECTORS).repartition(4)


def test_near_duplicates_of_vectors(spark):
    rows = vectors()
    df = as_vectors(spark, rows)
    got = sorted(map(tuple, nn_descent.near_duplicates(df).collect()), key=repr)
    want = sorted(plain_links(rows), key=repr)
    assert got == want and sum(w[1] for w in want) > 30_000
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0
    nothing = df.filter("embedding IS NULL OR size(embedding) = 0")
    assert {tuple(r)[1:] for r in nn_descent.near_duplicates(nothing.filter("vec_id IS NOT NULL")).collect()} == {(0, r[0], True) for r in rows if r[0] is not None and not r[1]}


def test_lists_grow_and_the_audit_finds_what_rounds_missed(spark, monkeypatch):
    """Without balls and with a poor start, saturated lists are doubled and the audit goes on until recall is good."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    x = np.concatenate([centre + rng.standard_normal((120, 16)) * 0.15, rng.standard_normal((200, 16))])
    leaders = spark.createDataFrame([(i, v.tolist(), 0.9) for i, v in enumerate(x)], "id long, v array<double>, need double").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {(int(i), int(j)) for i, j in zip(*np.nonzero(u @ u.T >= 0.9), strict=True) if i != j}

    def found(**patch):
        for name, value in patch.items():
            monkeypatch.setattr(nn_descent, name, value)
        graph, recall = nn_descent.descend(leaders)
        lists = {r["id"]: (r["k"], r["list"]) for r in graph.collect()}
        pairs = {(i, e["other"]) for i, (_, own) in lists.items() for e in own if e["cos"] >= 0.9}
        assert pairs <= true and all(len(own) <= k for k, own in lists.values())
        return pairs | {(j, i) for i, j in pairs}, recall, max(k for k, _ in lists.values())

    pairs, recall, longest = found()
    assert pairs == true and recall >= nn_descent.RECALL and longest >= 64
    pairs, recall, longest = found(STARTS=1, ROUNDS=0, AUDITS=1)
    assert recall < nn_descent.RECALL and len(pairs) < len(true) / 2 and longest <= 16
    more, _, _ = found(ROUNDS=4, AUDITS=3)
    assert more == true
