"""The pipeline's stages against plain versions, and the queries against their SQL."""

import pytest

import corpus_pipeline
from tessera.llm import pii, queries, token_counts
from tessera.sources.storage import standing

from ..conftest import DATA, same_rows
from . import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLE_SQL[name]))


def test_token_files_query(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    ids, at = brute.ids_of(queries.tokenizer("byte_bpe_50k.json"), [r["text"] for r in rows], 2), 0
    made = queries.QUERIES["op2_token_binary"](spark, DATA).orderBy("doc_id").collect()
    for r, doc, own in zip(made, rows, ids, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc["doc_id"], at, len(own), brute.crc(own))
        at += len(own)


def test_packing_query(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    ids = brute.ids_of(queries.tokenizer("word_bpe_49k.json"), [r["text"] for r in rows], 2)
    pieces = [r.asDict() for r in queries.QUERIES["op4_packing"](spark, DATA).collect()]
    assert brute.check_packing(pieces, {r["doc_id"]: x for r, x in zip(rows, ids, strict=True)}) < 0.02


def test_pii_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    made = queries.QUERIES["op5_pii"](spark, DATA).collect()
    assert len(made) == len(texts)
    for r in made:
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == brute.pii(texts[r["doc_id"]])
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        base = ",".join(":".join(x) for x in spans if x[0] in ("email", "ip", "card", "phone"))
        assert brute.sha(base) == r["base_sha256"] and all(0 <= int(a) < int(b) <= len(texts[r["doc_id"]]) for _, a, b in spans)
        order = [k.name for k in pii.KINDS]
        assert [(order.index(k), int(a)) for k, a, _ in spans] == sorted((order.index(k), int(a)) for k, a, _ in spans)


def test_token_counts_query(spark):
    unigram = token_counts.Unigram.of_model(queries.tokenizer("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    known = {w: brute.viterbi(w, unigram.scores, unigram.unknown) for w in set(" ".join(texts.values()).split())}
    made = queries.QUERIES["op9_token_counts"](spark, DATA).collect()
    assert {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in made} == {i: (len(t.split()), sum(known[w] for w in t.split())) for i, t in texts.items()}


def test_stages_on_awkward_rows(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join(words), "x"), (1, None, "x"), (2, "", "x"), (2, " ", "x"), (3, " ".join(words), "x"), (3, " ".join(words), "y"), (3, "one mail to a@b.co", "x"), (4, "short but clean", "x"), (None, "no id here", "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), e, "clash", "clash") for i, t, e in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string, n_words string, spans string")
    for empty in (False, True):
        made = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, made, DATA)
            if name != "packing":
                assert made.columns == list(corpus_pipeline.COLUMNS)
        got = made.collect()
        texts = [] if empty else [(3, " ".join(words)), (3, "one mail to [EMAIL]"), (4, "short but clean"), (None, "no id here")]
        want = sorted(((i, len(x)) for (i, _), x in zip(texts, brute.ids_of(queries.tokenizer("word_bpe_49k.json"), [t for _, t in texts], 2), strict=True)), key=repr)
        assert sorted({(r["doc_id"], r["doc_tokens"]) for r in got}, key=repr) == want and sum(r["length"] for r in got) == sum(n for _, n in want)


def test_stages(spark, duck):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, DATA)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        if name == "quality_rules":
            assert set(after) == {i for i, r in before.items() if not brute.rejected(r["text"])}
        elif name == "near_duplicates":
            assert set(after) == {c for _, c in brute.components([(i, r["text"]) for i, r in before.items()], 5, 80).values()}
        elif name == "decontamination":
            assert set(after) == {i for i, w in brute.decontamination([(i, r["text"]) for i, r in before.items()], items).items() if not w[4]}
        else:
            assert set(after) == set(before)
            assert all(sum(brute.pii(r["text"])[:4]) == 0 for r in after.values())
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    pieces = [r.asDict() for r in stages["packing"](spark, docs, DATA).collect()]
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    ids = brute.ids_of(queries.tokenizer("word_bpe_49k.json"), [t for _, t in texts], 2)
    assert brute.check_packing(pieces, {i: x for (i, _), x in zip(texts, ids, strict=True)}) < 0.05
    mark = standing()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()} == {i for i, _ in texts}
    assert standing() == mark + 1  # the result alone
