"""Each operator against its plain version, on small tables of awkward rows."""

import random
import struct
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat_format, chunk_encoder, decontamination, ngram_join, packing, pii, quality_rules, queries, token_binary, token_counts, url_filter, warc_revisits
from tessera.llm.chunk_encoder import ChunkEncoder
from tessera.llm.components import components, components_of_stars
from tessera.llm.queries import tokenizer

from ..conftest import same_rows
from . import brute

WORD = "the of Dé año straße und que naïve A-b it's 12 x"
DOCS = "doc_id long, text string, extra string, n_words string, spans string, kept string, h string, start string"


def some_docs(seed=0, n=60):
    """Nulls, empty, blank and long texts, copies and near copies, and columns with clashing names."""
    rng, words = random.Random(seed), WORD.split()
    long = " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(3000))
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = [None, "", " \n\t ", "one", "two words", "one", long, "x y z " * 40, "\n".join(["same line here"] * 9 + ["other"])]
    texts += [" ".join(base), " ".join(base), "  ".join(base[:60]) + "\n" + " ".join(base[60:])]
    for i in range(24):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    while len(texts) < n:
        texts.append(" ".join(rng.choice(words) + rng.choice(["", ".", ",", "\n", " "]) for _ in range(rng.randrange(1, 200))))
    return [(i, t, "e", "c", "c", "c", "c", "c") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


TEXTS = [(r[0], r[1]) for r in some_docs()]


def test_quality(docs, none):
    made = {r["doc_id"]: r for r in quality_rules.apply_policy(quality_rules.ledger(docs), "web-2").collect()}
    for i, t in TEXTS:
        r = made[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["fail_bits"] & 3 != 0) == brute.quality(t)
        assert r["kept"] == (r["fail_bits"] & quality_rules.mask(quality_rules.POLICIES["web-2"]) == 0) and r["extra"] == "e"
    assert quality_rules.ledger(none).count() == 0
    for r in quality_rules.apply_policy(quality_rules.ledger(docs), "web-3").collect():
        assert r["kept"] == (not brute.rejected(dict(TEXTS)[r["doc_id"]]))
    clash = docs.select("doc_id", "text", F.lit("kept").alias("_m"), F.lit("kept").alias("_m_"), F.lit(0).alias("fail_bits"))
    for r in quality_rules.ledger(clash).collect():
        assert (r["_m"], r["_m_"]) == ("kept", "kept") and r["n_words"] == brute.quality(dict(TEXTS)[r["doc_id"]])[0]
    twice = docs.unionByName(docs)
    assert quality_rules.ledger(twice).count() == 2 * len(TEXTS)


def test_ablation(spark):
    ledger = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "fail_bits int")
    got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in quality_rules.ablation(ledger, "base-1").collect()}
    assert got == {"few_words": (3, 2, 4), "repeated_windows": (1, 0, 2)}


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(TEXTS[9][1].split()[20:45])), (2, "two words"), (3, None), (4, ""), (5, "ONE"), (10, TEXTS[9][1][:400]), (10, "x y z x y z x y z x y z"), (None, "naïve naïve")]
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, n_words string")
    want = brute.decontamination(TEXTS, items)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"])), r["n_hit"] > 0) for r in decontamination.report(docs, bench).collect()}
    assert got == want
    assert {r["doc_id"] for r in decontamination.clean(docs, bench).collect()} == {i for i, w in want.items() if not w[4]}
    assert decontamination.report(none, bench).count() == 0
    assert decontamination.report(docs, bench.limit(0)).filter("n_hit > 0 OR size(items) > 0").count() == 0
    twice = docs.filter("doc_id = 9").unionByName(docs.filter("doc_id = 9"))
    assert decontamination.report(twice, bench).count() == 1


def test_decontamination_without_broadcast(docs, spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    items = [(1, " ".join(TEXTS[9][1].split()[20:45]))]
    got = {r["doc_id"]: r["n_hit"] for r in decontamination.report(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: w[1] for i, w in brute.decontamination(TEXTS, items).items()}


def test_decontamination_of_items_of_every_short_length(spark):
    items = [(n, " ".join(f"k{n}w{j}" for j in range(n))) for n in range(1, 11)]
    rows = []
    for _, text in items:
        for before, after in ((0, 0), (0, 9), (1, 1), (4, 12), (25, 3), (9, 0)):
            rows.append((len(rows), " ".join([*(f"b{i}" for i in range(before)), text, *(f"a{i}" for i in range(after))])))
        rows.append((len(rows), f"{text} x {text} {text}"))
        rows.append((len(rows), " ".join(text.split()[:-1] + ["x"])))
    want = brute.decontamination(rows, items)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"])), r["n_hit"] > 0) for r in decontamination.report(docs, bench).collect()}
    assert got == want
    assert {r["doc_id"] for r in decontamination.clean(docs, bench).collect()} == {i for i, w in want.items() if not w[4]}


def test_decontamination_of_items_with_a_common_prompt(spark):
    prompt = " ".join(f"p{i}" for i in range(30))
    items = [(n, f"{prompt} own{n} " + " ".join(f"i{n}x{j}" for j in range(9 + n % 5))) for n in range(300)]
    rows = [(d, f"d{d} {prompt} e{d}") for d in range(50)] + [(60, items[7][1] + " " + items[8][1]), (61, " ".join(f"p{i}" for i in range(9)))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontamination(rows, items)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"])), r["n_hit"] > 0) for r in decontamination.report(docs, bench).collect()}
    assert got == want and want[0][2] == 300
    # The windows of the prompt are rows, whatever the number of items: each of 21 holds 4 fingerprints at most.
    assert decontamination.hits(docs, bench).count() < 4 * (21 * 52 + 2 * 45)
    assert {r["doc_id"] for r in decontamination.clean(docs.unionByName(docs), bench).collect()} == {61}


def test_decontamination_of_very_many_items_with_a_common_prompt(spark):
    prompt, n = " ".join(f"p{i}" for i in range(12)), 100_000
    bench = spark.range(n).select(F.col("id").alias("item_id"), F.concat(F.lit(prompt + " own"), F.col("id").cast("string")).alias("text"))
    docs = spark.createDataFrame([(d, f"d{d} {prompt} own{d % 7} x") for d in range(40)] + [(50, "a clean text")], "doc_id long, text string")
    got = decontamination.report(docs, bench).select("doc_id", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("h")).collect()
    every = brute.sha(",".join(sorted(str(i) for i in range(n))))
    assert {r["doc_id"]: (r["n_hit"], r["n"], r["h"]) for r in got} == {**{d: (13, n, every) for d in range(40)}, 50: (0, 0, brute.sha(""))}


PII_TEXTS = [
    "a@b.c%d@e.f and x.y+z@mail-1.example.org.", "no@dot, @x.y a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (743) 555-3824, +12 345", "+" + "(" * 500, "1 2 3 4 " * 300, "é" * 30 + "a@b.co +49 30 1234567", "call phone 555-123-4567", "555-123-4567", "IBAN DE89 3704 0044 0532 0130 00.",
    "IBAN DE89 3704 0044 0532 0130 01.", "x" * 3000 + "@", None, "", "a." * 2000 + "@" + "b." * 2000 + "c", "+12 345 1.2.3.4",
]


def test_pii(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(PII_TEXTS)], "doc_id long, text string, spans string")
    for r in pii.find(df).collect():
        base = [s for s in r["spans"] if s["kind"] in ("email", "ip", "card", "phone")]
        said = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base)
        assert brute.sha(said) == brute.pii(r["text"])[4], (r["text"] or "")[:60]
    more = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find(df).collect()}
    assert more[8] == ["local_phone"] and more[9] == [] and "iban" in more[10] and "iban" not in more[11]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[7] == "é" * 30 + "[EMAIL] [PHONE]" and clean[13] is None and clean[9] == PII_TEXTS[9]
    assert clean[16] == "[PHONE]" and clean[0] == "[EMAIL][EMAIL] and [EMAIL]."
    assert pii.find(df.limit(0)).count() == pii.redact(df.limit(0)).count() == 0
    assert pii.find(df.unionByName(df)).count() == 2 * len(PII_TEXTS)
    said = spark.createDataFrame([(1, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y'), (2, "password=61cfd3300259e4653f"), (3, "token of love"), (4, "the token: short"), (5, "api_key: AAAABBBBCCCCDDDD1")], "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find(said).collect()}
    assert found == {1: [("secret", 2, 52)], 2: [("secret", 0, 27)], 3: [], 4: [], 5: [("secret", 0, 26)]}


def redacted(text, spans):
    """Plain: runs of overlapping spans give way to the name of their first kind."""
    out, at = [], 0
    for start, back, kind in sorted((s["start"], -s["end"], s["kind"]) for s in spans):
        if start >= at:
            out.append(text[at:start] + f"[{kind.upper()}]")
        at = max(at, -back)
    return "".join(out) + text[at:]


def test_redaction_by_blocks(spark):
    """Spans at and across the ends of blocks, in texts of characters of one to four bytes."""
    rng, texts = random.Random(3), [*PII_TEXTS]
    for n in (2040, 2048, 4095, 6000, 9000):
        texts.append("".join(rng.choice(["é", "a ", "𝄞", "x@y.zz ", "+1 555 123 4567 ", "10.0.0.1\n", "4111 1111 1111 1111 "]) for _ in range(n // 4)))
        texts += ["é" * (n - 3) + " a@b.co", "𝄞" * n + " a@b.co" + "z" * 5000, "a@b.co " + " " * n]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    for r in pii.redact(df).collect():
        want = texts[r["doc_id"]]
        assert r["text"] == (want and redacted(want, spans[r["doc_id"]]))


def test_redaction_of_very_many_spans_is_linear(spark):
    def seconds(n, of):
        df = spark.createDataFrame([(1, " é ".join(f"user{i}@mail{i % 7}.example.com" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        found = of(df).select(F.length("text").alias("n"), F.xxhash64("*")).first()
        return time.time() - began, found["n"]

    seconds(100, pii.redact)
    took, length = seconds(30_000, pii.redact)
    assert length == 30_000 * 7 + 29_999 * 3
    assert took < 5 + 4 * seconds(30_000, pii.find)[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700))
def test_blocks_round_trip(ids):
    data = token_binary.pack(np.array(ids, dtype="<u4"))
    assert token_binary.unpack(data).tolist() == ids
    assert token_binary.unpack(data, 1, 3).tolist() == ids[128:384]


@pytest.fixture(scope="function")
def short_runs():
    before, chunk_encoder.RUN = chunk_encoder.RUN, 7
    yield
    chunk_encoder.RUN = before


@pytest.mark.usefixtures("short_runs")
@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.sampled_from(list("aB é'sdt漢1.,!\n\t \u00a0\u2003\x1c\x85<|>0\u0301Σ")), max_size=40))
def test_chunks_encode_as_whole_texts_do(text):
    for name, kind in (("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "word")):
        codec = CODECS.setdefault(name, ChunkEncoder(tokenizer(name), kind) if name not in CODECS else None)
        texts = [text, None, text + "a", "", text]
        whole = [codec.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        made = [ids[a:b].tolist() for _, _, ids, ends in codec.encode(pa.array(texts)) for a, b in zip([0, *ends], ends, strict=False)]
        assert made == whole
        runs = [(a, b) for a, b, _, _ in codec.encode(pa.array(texts), 2)]
        assert [x for run in runs for x in range(*run)] == list(range(len(texts)))


CODECS: dict = {}


def test_token_files(spark, docs, none, tmp_path, monkeypatch):
    monkeypatch.setattr(token_binary, "SEGMENT", 1000)
    path = f"file://{tmp_path}/tokens"
    token_binary.write(docs, path, tokenizer("byte_bpe_50k.json"), 2)
    ids = brute.ids_of(tokenizer("byte_bpe_50k.json"), [t for _, t in TEXTS], 2)
    at = 0
    for r, own in zip(token_binary.read_documents(spark, path, with_ids=True).orderBy("doc_id").collect(), ids, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), brute.crc(own))
        assert list(struct.unpack(f"<{len(own)}I", r["ids"])) == own
        at += len(own)
    token_binary.write(none, path + "0", tokenizer("byte_bpe_50k.json"), 2)
    assert token_binary.read_documents(spark, path + "0").count() == 0
    again = [(7, "b b"), (7, "a"), (7, "a"), (None, "n"), (3, None)]
    token_binary.write(spark.createDataFrame(again, "doc_id long, text string").repartition(2), path + "1", tokenizer("byte_bpe_50k.json"), 2)
    back = token_binary.read_documents(spark, path + "1").orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None, 3, 7, 7, 7] and [r["start"] for r in back] == [0, 2, 3, *(r["start"] for r in back[3:])]
    said = sorted(brute.crc(x) for x in brute.ids_of(tokenizer("byte_bpe_50k.json"), [t for _, t in again], 2))
    assert sorted(r["ids_crc32"] for r in back) == said


def test_chat(spark):
    rows = [(1, 0, "user", "a <b> \\e \\l"), (1, 1, "assistant", "</turn><turn>x"), (1, 2, None, None), (2, 0, "assistant", ""), (2, 1, "assistant", "é<"), (3, None, "user", "n"), (None, 1, "system", "s\n"), (4, 0, "us<text>er", "q"), (1, 1, "assistant", "</turn><turn>x")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, reply string")
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r, x))
    made = chat_format.examples(df)
    for r in chat_format.read_back(made).collect():
        turns = [(t["role"], t["text"]) for t in r["turns"]]
        assert turns == [(a or "", b or "") for a, b in by[r["conv_id"]]]
        assert r["replies"] == [b or "" for a, b in by[r["conv_id"]] if a == "assistant"] or [x for x in r["replies"] if x] == [b for a, b in by[r["conv_id"]] if a == "assistant" and b]
        assert "".join(r["replies"]) == "".join(b or "" for a, b in by[r["conv_id"]] if a == "assistant")
    assert chat_format.read_back(chat_format.examples(df.limit(0))).count() == 0
    for r in made.filter("conv_id = 2").collect():
        assert r["text"][r["loss_start"] : r["loss_end"]] in ("", "é\\l")


@pytest.mark.parametrize("slack,length,most", [(0, 16, 2), (3, 16, 3), (32, 4096, 4)])
def test_packer(slack, length, most):
    rng, made = random.Random(length), []
    p = packing.Packer(made.append, length, most, slack)
    docs = [[rng.randrange(9) for _ in range(rng.choice([1, 2, 5, 15, 16, 17, 40, 100]))] for _ in range(200)]
    for i, d in enumerate(docs):
        p.add(i, 0, struct.pack(f"<{len(d)}I", *d), len(d))
        assert len(p.windows) <= most
    p.finish()
    pieces = [dict(doc_id=i, start=s, length=len(x) // 4, ids_crc32=brute.zlib.crc32(x), doc_tokens=n, sequence_id=q, offset=sum(len(y[2]) // 4 for y in seq[:k])) for q, seq in enumerate(made) for k, (i, s, x, n) in enumerate(seq)]
    assert brute.check_packing(pieces, dict(enumerate(docs)), length) <= slack / length + 1e-9


def test_packing(docs, none):
    pieces = [r.asDict() for r in packing.pack(docs, tokenizer("word_bpe_49k.json"), 2).collect()]
    ids = brute.ids_of(tokenizer("word_bpe_49k.json"), [t for _, t in TEXTS], 2)
    assert brute.check_packing(pieces, {i: x for (i, _), x in zip(TEXTS, ids, strict=True)}) < 0.02
    assert packing.pack(none, tokenizer("word_bpe_49k.json"), 2).count() == 0
    twice = [r.asDict() for r in packing.pack(docs.unionByName(docs), tokenizer("word_bpe_49k.json"), 2, with_ids=True).collect()]
    assert sum(p["length"] for p in twice) == 2 * sum(map(len, ids)) and all(len(p["ids"]) == 4 * p["length"] for p in twice)


def test_urls(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("net", "/de/", "block")], "host string, path string, action string")
    listed = spark.createDataFrame([("bad.org", "/"), ("bad.com", "/en/")], "host string, path string")
    rows = {
        1: ("http://a.EXAMPLE.com/en/77?x", "a.example.com", "/en/77", "example.com/en/7", "allow"), 2: ("http://example.com/en/6", "example.com", "/en/6", "com/en/", "block"),
        3: ("xcom/en/", "", "", None, "allow"), 4: (None, "", "", None, "allow"), 5: ("https://notexample.com", "notexample.com", "", None, "allow"), 6: ("s://x.bad.org/#/de/", "x.bad.org", "/", None, "block"),
        7: ("s://a.net/de/?http://b.com/en/", "a.net", "/de/", "net/de/", "block"), 8: ("s://bad.com/en/", "bad.com", "/en/", "com/en/", "block"), 9: ("://com/en/", "com", "/en/", "com/en/", "block"), 10: ("", "", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, r[0], "c", "c") for i, r in rows.items()], "page_id long, url string, host string, key string")
    got = {r["page_id"]: tuple(r[c] for c in ("url", "host", "path", "rule", "verdict")) for r in url_filter.judge(pages, rules, listed).collect()}
    assert got == rows
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    again = pages.unionByName(pages).unionByName(pages.filter("page_id IN (2, 4)")).unionByName(pages.select(F.lit(None).cast("long").alias("page_id"), "url", "host", "key"))
    copies = {(r["page_id"], r["url"]): r["count"] for r in url_filter.judge(again, rules, listed).groupBy("page_id", "url").count().collect()}
    assert copies == {**{(i, r[0]): 3 if i in (2, 4) else 2 for i, r in rows.items()}, **{(None, r[0]): 1 for r in rows.values()}}
    both = rules.unionByName(spark.createDataFrame([("example.com/", "en/7", "block"), ("com", "/en/", "allow")], rules.schema))
    assert url_filter.judge(pages, both, listed).count() == len(rows)


def test_urls_in_other_forms_of_a_listed_one(spark):
    listed = spark.createDataFrame([("Ads.example.com", "/"), ("u@old.org:80", "/a"), ("x.y.z.net.", "")], "host string, path string")
    rules = spark.createDataFrame([("ads.example.com", "/ok", "allow"), ("com:80", "/r", "block")], "host string, path string, action string")
    forms = [f"http://{h}{p}" for h in ("ads.example.com:80", "u@ads.example.com", "u:p@w@ads.example.com.", "www.ads.example.com.:8080", "ADS.example.com") for p in ("", "/", "/x?u@y", "#f")]
    others = ["http://example.com/", "http://ads.example.com.evil.org/", "http://ads.example.com@b.org/", "http://bads.example.com/", "ads.example.com/", "http://", "http://.:", "http://old.org/b"]
    blocked = [*forms, "s://old.org/a", "s://b.old.org./abc", "s://x.y.z.net", "s://x.y.z.net:/q", "s://b.com:80/r"]
    allowed = [*others, "s://ads.example.com/ok/1", "s://b.com/r"]
    pages = spark.createDataFrame(list(enumerate(blocked + allowed)), "page_id long, url string")
    got = {r["url"]: (r["verdict"], r["rule"]) for r in url_filter.judge(pages, rules, listed).collect()}
    assert [u for u in blocked if got[u][0] != "block"] == [] and [u for u in allowed if got[u][0] != "allow"] == []
    assert got["s://b.com:80/r"][1] == "com:80/r" and got["s://old.org/a"][1] is None and got["s://ads.example.com/ok/1"][1] == "ads.example.com/ok"


def test_urls_with_line_ends_in_their_hosts(spark, tmp_path):
    """The query's verdicts are its SQL's on these, too."""
    ends = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x85", "\u2028", "\u2029"]
    hosts = [h for e in ends for h in (f"{e}@ads-track.example.com", f"u{e}v:p@adult-x.example.org:80", f"u@w{e}@ads-track.example.net.", f"ads-track.example.com:80{e}", f"ads-track.example.com{e}:80", f"{e}@a.com", f"a.com:80{e}", f"x{e}.com")]
    spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in ("", "/en/"))], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    made = queries.op7_url_filter(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(made, con.sql(queries.ORACLE_SQL["op7_url_filter"]))
    # A user goes in front of all of them but the line feed (alone or in a pair), which ends the search.
    assert made.filter("verdict = 'block' AND rule IS NULL").count() == 6 * 5


def test_hosts_of_very_many_labels(spark):
    rules = spark.createDataFrame([("com", "/" * n, "block") for n in range(1, 12)] + [("a.com", "/x", "allow")], "host string, path string, action string")
    long = "a." * 100_000
    pages = spark.createDataFrame([(1, f"http://{long}com/x"), (2, f"http://{long}com//x"), (3, f"http://{long}"), (4, f"http://{'.' * 100_000}x/"), (5, f"http://{':1' * 100_000}x/")], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in url_filter.judge(pages, rules, rules.filter("path = '/x'").select(F.lit("org").alias("host"), "path")).collect()}
    assert got == {1: ("allow", "a.com/x"), 2: ("block", "com//"), 3: ("allow", None), 4: ("allow", None), 5: ("allow", None)}


def test_bloom_holds_every_key_and_few_others(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    bloom = url_filter.bloom(keys, 64)
    asked = spark.range(6000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id")
    held = asked.select("id", F.col("key"), bloom.scalar().alias("b")).select("id", url_filter.may_hold(F.col("b"), F.col("key"), 64).alias("h"))
    assert held.filter("id < 2000 AND NOT h").count() == 0
    assert held.filter("id >= 2000 AND h").count() < 400


def test_revisits(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for i in range(300):
        kind = rng.choice(["response", "revisit", "revisit"])
        url = rng.choice(["http://www.a.org/x/", "https://A.org:443/x?utm_source=q", "http://a.org/y?b=1&a=2", "http://a.org/y?a=2&b=1#z", None, "http://hot.net/"])
        status = 200 if kind == "response" else 304
        rows.append((i, url, rng.choice([None, *range(12)]), kind, status, rng.choice([None, "e1", "W/e1", "e2"]), rng.choice([None, "d1", "d2"]), rng.choice([None, "p1", "p2"]), [("date", str(i)), ("content-length", str(i % 7))] if i % 3 else [("x", "1"), ("date", "0")], "c"))
    schema = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers array<struct<name:string,value:string>>, full string"
    df = spark.createDataFrame(rows, schema)
    names = {"http://www.a.org/x/": "a.org/x", "https://A.org:443/x?utm_source=q": "a.org/x", "http://a.org/y?b=1&a=2": "a.org/y?a=2&b=1", "http://a.org/y?a=2&b=1#z": "a.org/y?a=2&b=1", None: "", "http://hot.net/": "hot.net"}
    at = lambda r: (-1 if r[2] is None else r[2], r[0])
    want = {}
    for r in rows:
        full = [x for x in rows if x[3] == "response" and x[1] and names[x[1]] == names[r[1]] and at(x) < at(r)]
        if r[3] == "response":
            want[r[0]] = (r[0], "response", r[7])
            continue
        if not full:
            want[r[0]] = (None, "no_base", r[7])
            continue
        b = max(full, key=at)
        tag = lambda e: e.removeprefix("W/")
        same = tag(r[5]) == tag(b[5]) if r[5] and b[5] else r[6] == b[6] if r[6] and b[6] else r[7] == b[7] if r[7] and b[7] else None
        verdict = {True: "resolved", False: "mismatch", None: "unverified"}[same]
        want[r[0]] = (None if verdict == "mismatch" else b[0], verdict, b[7] if verdict == "resolved" else r[7])
    for slices in (64, 3):
        monkeypatch.setattr(warc_revisits, "SLICES", slices)
        made = warc_revisits.resolve(df).collect()
        assert {r["record_id"]: (r["base_id"], r["verdict"], r["digest"]) for r in made} == want
        for r in made:
            if r["verdict"] == "resolved":
                own, base = dict(rows[r["record_id"]][8]), dict(rows[r["base_id"]][8])
                assert {h["name"]: h["value"] for h in r["headers"]} == {**base, "date": own["date"]}
    assert warc_revisits.resolve(df.limit(0)).count() == 0


REVISITS = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers array<struct<name:string,value:string>>"


def test_revisits_of_urls_without_slashes(spark):
    rows = [(i, u, i, "response", 200, f"e{i}", None, None, []) for i, u in enumerate(["dns:a.org", "a.org/x", "a?x=1", "b?x=1", "", None])]
    asked = ["dns:a.org#f", "a.org/x", "a?x=1", "b?x=1#f", "", None, "dns:b.org"]
    rows += [(10 + i, u, 10 + i, "revisit", 304, f"e{i}", None, None, []) for i, u in enumerate(asked)]
    got = {r["record_id"]: (r["canonical_url"], r["base_id"], r["verdict"]) for r in warc_revisits.resolve(spark.createDataFrame(rows, REVISITS)).filter("kind = 'revisit'").collect()}
    assert got == {
        10: ("dns:a.org", 0, "resolved"), 11: ("a.org/x", 1, "resolved"), 12: ("a?x=1", 2, "resolved"), 13: ("b?x=1", 3, "resolved"),
        14: ("", 4, "resolved"), 15: ("", None, "no_base"), 16: ("dns:b.org", None, "no_base"),
    }


def test_revisits_pass_over_partial_and_failed_responses(spark, monkeypatch):
    states = [200, 206, 404, 503, None]
    rows = [(i, "http://a.org/", i, "response", s, "e", None, f"p{i}", []) for i, s in enumerate(states)]
    rows += [(5, "http://a.org/", 5, "revisit", 304, "e", None, None, []), (6, "http://b.org/", 6, "response", 206, "e", None, "p", []), (7, "http://b.org/", 7, "revisit", 304, "e", None, None, [])]
    for slices in (64, 1):
        monkeypatch.setattr(warc_revisits, "SLICES", slices)
        got = {r["record_id"]: (r["base_id"], r["verdict"], r["digest"]) for r in warc_revisits.resolve(spark.createDataFrame(rows, REVISITS)).collect()}
        assert got[5] == (0, "resolved", "p0") and got[7] == (None, "no_base", None)
        assert all(got[i] == (i, "response", f"p{i}") for i in range(5))


def test_revisit_headers_in_any_case(spark):
    url = "http://a.org/"
    rows = [
        (1, url, 1, "response", 200, "e", None, "p", [("ETag", "old"), ("Content-Type", "t"), ("X", "1")]), (2, url, 2, "revisit", 304, "e", None, None, [("etag", "new"), ("x", "2")]),
        (3, url, 3, "revisit", 304, "e", None, None, None), (4, url, None, "revisit", 304, "e", None, None, []), (5, None, 9, "revisit", 304, "e", None, None, [("A", None)]), (5, None, 9, "revisit", 304, "e", None, None, [("A", None)]),
    ]
    got = {r["record_id"]: (r["verdict"], r["headers"] and [tuple(h) for h in r["headers"]]) for r in warc_revisits.resolve(spark.createDataFrame(rows, REVISITS)).collect()}
    assert got[2] == ("resolved", [("content-type", "t"), ("etag", "new"), ("x", "1")])
    assert got[3][0] == "resolved" and got[4] == ("no_base", []) and got[5] == ("no_base", [("a", None)])
    assert warc_revisits.resolve(spark.createDataFrame(rows, REVISITS)).count() == 6
    edges = sorted(random.Random(1).sample(range(10_000), 700))
    asked = spark.createDataFrame([(t,) for t in [-1, 0, 9_999, None, *edges, *(e + 1 for e in edges)]], "t long")
    for r in asked.select("t", warc_revisits._slice_of(F.col("t"), edges).alias("s")).collect():
        assert r["s"] == sum(r["t"] is not None and e < r["t"] for e in edges)


def long_text(words: int = 25_000) -> str:
    rng = random.Random(11)
    return " ".join(f"w{rng.randrange(5_000)}" + rng.choice(["", "", ",", ".\n"]) for _ in range(words))


def test_very_long_texts(spark):
    text = long_text()
    rows = [(1, text), (2, text + " end"), (3, "short one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    item = [(9, " ".join(text.split()[24_000:24_030]))]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontamination.report(docs, spark.createDataFrame(item, "item_id long, text string")).collect()}
    assert got == {i: w[:2] for i, w in brute.decontamination(rows, item).items()} and got[1][1] == 30
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()} == {1: 1, 2: 1, 3: 3}
    for r in quality_rules.ledger(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.quality(dict(rows)[r["doc_id"]])[:5]
    for r in pii.find(docs.withColumn("text", F.concat("text", F.lit(" a@b.co")))).collect():
        assert [(s["start"], s["end"]) for s in r["spans"]] == [(len(dict(rows)[r["doc_id"]]) + 1, len(dict(rows)[r["doc_id"]]) + 7)]
    ids = brute.ids_of(tokenizer("word_bpe_49k.json"), [t for _, t in rows], 2)
    pieces = [r.asDict() for r in packing.pack(docs, tokenizer("word_bpe_49k.json"), 2).collect()]
    brute.check_packing(pieces, {i: x for (i, _), x in zip(rows, ids, strict=True)})
    chat = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.examples(chat)).first()["replies"] == [text]
    page = spark.createDataFrame([(1, "http://a.com/" + "x" * 200_000)], "page_id long, url string")
    assert url_filter.judge(page, spark.createDataFrame([("a.com", "/xx", "block")], "host string, path string, action string")).first()["verdict"] == "block"


def test_very_many_equal_lines_and_very_long_urls(spark):
    rows = [(1, "same line of words\n" * 100_000), (2, "\n".join(f"line {i}" for i in range(100_000))), (3, "\n" * 200_000), (4, "a " * 200_000)]
    made = {r["doc_id"]: r for r in quality_rules.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert tuple(made[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute.quality(text)[:5]
    url = "http://www.a.org/" + "x/" * 100_000 + "?" + "&".join(f"k{i}={i}" for i in range(20_000))
    again = url.replace("?", "?utm_source=x&").replace("//www.", "//") + "#f"
    captures = [(1, url, 1, "response", 200, "e", None, "p", [("etag", "e")]), (2, again, 2, "revisit", 304, "e", None, None, [("etag", "e")]), (3, url + "&z", 3, "revisit", 304, "e", None, None, [])]
    got = {r["record_id"]: (r["base_id"], r["verdict"]) for r in warc_revisits.resolve(spark.createDataFrame(captures, REVISITS)).collect()}
    assert got[2] == (1, "resolved") and got[3][1] == "no_base"


def test_ngram_join_rows_of_one_id(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (None, "a b c d e f"), (None, ""), (2, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (2, 0, 2)], key=repr)


@pytest.mark.parametrize("words,percent", [(3, 90), (1, 70)])
def test_ngram_join(spark, docs, none, words, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs, words, percent).collect()}
    assert got == brute.components(TEXTS, words, percent)
    if percent == 90:
        assert ngram_join.join(none, words, percent).count() == 0


def test_ngram_join_of_chains_and_families(spark):
    rng, rows = random.Random(3), []
    for family in range(6):
        w = [f"f{family}_{i}" for i in range(rng.choice([9, 12, 40, 200]))]
        for _ in range(40):
            if rng.random() < 0.5:
                w = list(w)
                w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, 1, 90).collect()}
    assert got == brute.components(rows, 1, 90)
    kept = {r["doc_id"] for r in ngram_join.deduplicate(df, 2, 80).collect()}
    assert kept == {c for _, c in brute.components(rows, 2, 80).values()}


def test_deduplicate_repeated_and_null_ids(spark):
    rng = random.Random(7)
    a, b, c, d, e, f = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "abcdef")
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [
        (1, a, "u"), (2, b, "u"), (2, b, "v"), (2, b, "v"),  # a row repeated, with different other columns
        (5, near(a), "u"), (5, c, "u"),  # one id, two texts: one of them a near copy of 1
        (None, d, "u"), (None, d, "u"), (None, near(d), "u"), (None, a, "u"), (None, e, "u"),
        (7, e, "u"), (9, f, "u"), (9, near(f), "u"), (4, near(b), "u"), (4, near(b), "u"),
        (8, None, "u"), (8, None, "u"), (8, "", "u"), (6, "", "u"), (None, " ", "u"), (None, " ", "u"),
    ]
    for turn in range(2):
        df = spark.createDataFrame(rows[:: 1 - 2 * turn], "doc_id long, text string, extra string").repartition(3)
        made = ngram_join.deduplicate(df)
        assert made.columns == df.columns
        got = sorted(((r["doc_id"], r["text"]) for r in made.collect()), key=repr)
        of_d, of_f = [x for x in got if x[1] in (d, near(d))], [x for x in got if x[1] in (f, near(f))]
        assert len(of_d) == len(of_f) == 1 and of_d[0][0] is None and of_f[0][0] == 9
        rest = [(1, a), (2, b), (5, c), (7, e), (8, None), (8, ""), (6, ""), (None, " ")]
        assert got == sorted([*rest, *of_d, *of_f], key=repr)
    assert ngram_join.deduplicate(df.limit(0)).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    rng = random.Random(4)
    stars = [(h, rng.randrange(300)) for h in rng.sample(range(300), 40) for _ in range(rng.randrange(1, 12))] + [(500, m) for m in range(400, 480)] + [(600, 479), (5, 5), (700, 700)]
    root = {x: x for pair in stars for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in stars:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    made = [(r["node"], r["root"]) for r in components_of_stars(spark.createDataFrame(stars, "a long, b long"), "a", "b").collect()]
    assert sorted(made) == sorted((x, find(x)) for x in root)
    assert components_of_stars(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_token_counts(spark, docs, none):
    unigram = token_counts.Unigram.of_model(tokenizer("piece_bpe_32k.model"))
    for r in token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model")).collect():
        words = (dict(TEXTS)[r["doc_id"]] or "").split()
        assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(brute.viterbi(w, unigram.scores, unigram.unknown) for w in words))
    assert token_counts.count_tokens(none, tokenizer("piece_bpe_32k.model")).count() == 0
    assert token_counts.count_tokens(docs.unionByName(docs), tokenizer("piece_bpe_32k.model")).count() == 2 * len(TEXTS)
    odd = spark.createDataFrame([(1, "x" * 5_000 + " x"), (1, "x" * 5_000)], "doc_id long, text string")
    long = brute.viterbi("x" * 300, unigram.scores, unigram.unknown)
    assert unigram.counts(["x" * 300, "x"]) == {"x" * 300: long, "x": brute.viterbi("x", unigram.scores, unigram.unknown)}
    made = sorted(r["n_tokens"] for r in token_counts.count_tokens(odd, tokenizer("piece_bpe_32k.model")).collect())
    assert made[1] - made[0] == brute.viterbi("x", unigram.scores, unigram.unknown)
