"""Properties of sampling, splits, explanations, merging, sidecars, chunks and settings."""

import dataclasses
import hashlib
import json
import os
import random
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import tokens
from tessera.operators import batches, evaluation, explanations, judging, merging, providers, rollouts, sampling
from tessera.plans import config, pipeline
from tessera.sources import corpus, sidecar, storage
from tessera.streaming import chunks


GOLDEN_POSITIONS, GOLDEN_PAIR = [51, 56, 52, 60, 74], [51, 52]
GOLDEN_SPLIT = {"a": ["d01", "d03", "d08"], "b": ["d04", "d07"], "c": ["d00", "d02", "d05", "d06", "d09"]}
GOLDEN_PERMUTATION = [7, 4, 5, 3, 2, 0, 9, 8, 6, 1]
GOLDEN_MATCH = (["s5", "s1", "s0", "s1x"], 2)


def test_split_keeps_documents_whole_and_counts_exact(spark):
    rows = spark.range(200).select((F.col("id") % 50).cast("string").alias("doc_id"), F.col("id").alias("x"))
    got = sampling.document_split(rows, {"a": 0.3, "b": 0.29, "c": 0.41}, 7)
    by = {r["split"]: (r["d"], r["n"]) for r in got.groupBy("split").agg(F.count_distinct("doc_id").alias("d"), F.count("*").alias("n")).collect()}
    assert by == {"a": (15, 60), "b": (14, 56), "c": (21, 84)}
    assert got.select("doc_id", "split").distinct().count() == 50
    again = sampling.document_split(rows.repartition(7), {"a": 0.3, "b": 0.29, "c": 0.41}, 7)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in again.collect()}
    with pytest.raises(ValueError):
        sampling.document_split(rows, {"a": 0.5, "b": 0.6}, 7)


def test_split_of_no_or_few_documents(spark):
    none = spark.createDataFrame([], "doc_id string")
    assert sampling.document_split(none, {"a": 0.5, "b": 0.5}, 1).count() == 0
    one = spark.createDataFrame([("x",)], "doc_id string")
    assert [r["split"] for r in sampling.document_split(one, {"a": 0.5, "b": 0.5}, 1).collect()] == ["b"]


def test_positions(spark):
    docs = spark.createDataFrame([("a", list(range(60, 90))), ("b", [51, 52]), ("c", [])], "doc_id string, positions array<int>")
    got = {r["doc_id"]: r["p"] for r in docs.select("doc_id", sampling.sample_positions(F.col("positions"), 5, 3, F.col("doc_id")).alias("p")).collect()}
    assert len(set(got["a"])) == 5 and got["a"] == sorted(got["a"]) and got["b"] == [51, 52] and got["c"] == []


def test_draws_of_pythons_generator(spark):
    """Fixed values, found once with Python's own random module by hand."""
    docs = spark.createDataFrame([("c:train:0", list(range(50, 80))), ("c:train:1", [51, 52]), ("c:train:2", [])], "doc_id string, positions array<int>")
    drawn = {r["doc_id"]: r["positions"] for r in sampling.sample_positions_python(docs, 5, 42).collect()}
    assert drawn == {"c:train:0": GOLDEN_POSITIONS, "c:train:1": GOLDEN_PAIR, "c:train:2": []}
    rows = spark.range(20).select(F.concat(F.lit("d"), F.format_string("%02d", F.col("id") % 10)).alias("doc_id"), F.col("id").alias("row_idx"))
    split = {r["doc_id"]: r["split"] for r in sampling.document_split_python(rows, {"a": 0.3, "b": 0.29, "c": 0.41}, 7).collect()}
    assert {x: sorted(d for d in split if split[d] == x) for x in "abc"} == GOLDEN_SPLIT
    assert [r["row_idx"] for r in sampling.permuted_python(spark.range(10).withColumnRenamed("id", "row_idx"), 0, "d1").collect()] == GOLDEN_PERMUTATION
    assert evaluation.match_options_python(["s0", "s1", "s1x", "", "s4", "s5"], 0, 3) == GOLDEN_MATCH
    assert evaluation.match_options_python(["s0", "s0x", "s4", "s5"], 0, 3) is None and evaluation.match_options_python(["", "a", "b", "c"], 0, 3) is None


def test_permutation_and_batches(spark):
    rows = spark.range(1000).withColumnRenamed("id", "row_idx")
    order = [r["row_idx"] for r in sampling.permuted(rows, 0, "d1").collect()]
    assert sorted(order) == list(range(1000)) and order != sorted(order)
    assert order != [r["row_idx"] for r in sampling.permuted(rows, 0, "d2").collect()]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 3000])
def test_pythons_shuffle_by_chains_of_swaps(spark, monkeypatch, n):
    want = list(range(n))
    random.Random(11).shuffle(want)
    got = sampling.shuffled_by_python(spark, n, 11).orderBy("place").collect()
    assert [tuple(r) for r in got] == list(enumerate(want))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 4096])
def test_shuffled_is_a_bijection_for_each_epoch(spark, n):
    s = sampling.Shuffled(n, 3, "d")
    rows = spark.range(n).select("id", F.explode(F.array(*[F.lit(e) for e in (0, 1, 7)])).alias("e"))
    got = rows.withColumn("p", s.place(F.col("id"), F.col("e"))).withColumn("back", s.row(F.col("p"), F.col("e"))).collect()
    places = {e: [r["p"] for r in sorted(got, key=lambda r: r["id"]) if r["e"] == e] for e in (0, 1, 7)}
    assert all(sorted(p) == list(range(n)) for p in places.values()) and all(r["back"] == r["id"] for r in got)
    if n > 90:
        assert len({tuple(p) for p in places.values()}) == 3
        # Neighbours don't stay together: their distances are as wide as those of a random order.
        assert all(np.mean(np.abs(np.diff(p))) > n / 4 for p in places.values())


def test_shuffled_of_very_many(spark):
    for n in (10**9 + 7, 2**59):
        s = sampling.Shuffled(n, 3, "d")
        rows = spark.range(0, n, n // 1000).withColumn("p", s.place(F.col("id"), F.lit(5))).withColumn("back", s.row(F.col("p"), F.lit(5))).collect()
        assert all(r["back"] == r["id"] and 0 <= r["p"] < n for r in rows) and len({r["p"] for r in rows}) == len(rows)


def test_epoch_batches(spark):
    n, batch, steps = 103, 10, 25
    rows = spark.range(n).withColumnRenamed("id", "row_idx")
    made = sampling.epoch_batches(rows, n, batch, steps, 1)
    got = sorted((r["step"], r["slot"], r["row_idx"]) for r in made.collect())
    assert [x[:2] for x in got] == [(s, b) for s in range(steps) for b in range(batch)]
    for epoch in (0, 1):
        assert len({row for step, _, row in got if step // 10 == epoch}) == 100
    assert [x[2] for x in got[:100]] != [x[2] for x in got[100:200]]
    for first in (0, 7, 13, 24, 25, 30):  # resumed, nothing is replayed
        assert sorted((r["step"], r["slot"], r["row_idx"]) for r in sampling.epoch_batches(rows, n, batch, steps, 1, first).collect()) == [x for x in got if x[0] >= first]
        assert sorted(map(tuple, sampling.rows_of_steps(spark, n, batch, steps, 1, first).collect())) == [x for x in got if x[0] >= first]
    for bad in (0, n + 1):
        with pytest.raises(ValueError):
            sampling.epoch_batches(rows, n, bad, 1, 1)


def test_counters_come_with_the_job_that_writes(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    docs = spark.createDataFrame([(i, list(range(i % 5))) for i in range(20)], "doc_id long, p array<int>").mapInArrow(counting, "doc_id long, p array<int>")
    seen, counters = sampling.observed(docs, "p", 3)
    seen.write.parquet(f"{tmp_path}/seen")
    assert counters.get == {"docs": 20, "skipped": 4, "short_sampled": 8, "rows": 4 * (1 + 2 + 3 + 3)} and read.value == 20
    assert counters.get == sampling.coverage(spark.read.parquet(f"{tmp_path}/seen"), "p", 3).first().asDict()


def test_phase_seconds(spark):
    marks = spark.sql("SELECT * FROM VALUES (1, 'gen', timestamp'2024-01-01 00:00:00'), (1, 'score', timestamp'2024-01-01 00:00:06'), (1, 'gen', timestamp'2024-01-01 00:00:08'), (1, 'end', timestamp'2024-01-01 00:00:10.5'), (2, 'end', timestamp'2024-01-01 00:00:00') AS t(step, phase, at)")
    got = {(r["step"], r["phase"]): (r["seconds"], round(r["share"], 4)) for r in rollouts.phase_seconds(marks, "phase", "at", "step").collect()}
    assert got == {(1, "gen"): (8.5, 0.8095), (1, "score"): (2.0, 0.1905)}
    with pytest.raises(ValueError):
        rollouts.phase_seconds(marks, "phase", "at")


def test_numbering_has_no_gaps(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k")).repartition(6)
    got = corpus.numbered(rows, "k").collect()
    assert all(r["k"] == r["row_idx"] for r in got) and len(got) == 500


def test_numbering_of_a_wide_table_loses_nothing(spark, tmp_path):
    n = 200_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"), F.lit(None).alias("none"))
    corpus.numbered(rows, "k").drop("none").write.parquet(f"{tmp_path}/numbered")
    back = spark.read.parquet(f"{tmp_path}/numbered")
    assert back.count() == n and back.filter("k <> row_idx OR length(wide) <> 256").count() == 0
    with pytest.raises(ValueError):
        corpus.numbered(rows.withColumn("_id", F.lit(1)), "k")
    mark = storage.standing()
    assert corpus.numbered(rows.limit(0), "k").count() == 0
    assert storage.standing() == mark + 1
    storage.cleared(spark, mark)
    assert storage.standing() == mark


def test_windows_and_zips(spark):
    rows = spark.range(20).select(F.col("id").alias("row_idx"), (F.col("id") * 2).alias("x"))
    assert [r["x"] for r in corpus.window(rows, 15, 3, ["x"], ["missing"]).collect()] == [30, 32, 34]
    assert corpus.zipped(rows, rows.withColumnRenamed("x", "y")).filter("x <> y").count() == 0
    with pytest.raises(ValueError):
        corpus.zipped(rows, rows.limit(19))
    sampling.windows_apart(10, 10)
    for bad in (None, 11):
        with pytest.raises(ValueError):
            sampling.windows_apart(bad, 10)
    with pytest.raises(Exception, match="pad token"):
        spark.range(1).select(sampling.without_padding(F.array(F.lit(1), F.lit(0)), F.lit(0))).collect()
    assert spark.range(1).select(sampling.without_padding(F.array(F.lit(1), F.lit(0)), F.lit(0), F.lit(0))).first()[0] == [1, 0]


def test_corpora_are_staged_beforehand(spark, tmp_path):
    rows = spark.range(5).withColumnRenamed("id", "row_idx")
    rows.write.parquet(f"{tmp_path}/a.parquet")
    rows.write.parquet(f"{tmp_path}/staged/org/name/default/train")
    assert corpus.located(spark, f"file://{tmp_path}/a.parquet@[1:2]", "x").endswith("a.parquet@[1:2]")
    assert corpus.scan(spark, corpus.located(spark, "org/name", f"file://{tmp_path}/staged")).count() == 5
    assert [r["row_idx"] for r in corpus.scan(spark, f"{tmp_path}/a.parquet@[3:]", ["row_idx"]).collect()] == [3, 4]
    with pytest.raises(FileNotFoundError):
        corpus.located(spark, "org/other", f"file://{tmp_path}/staged")
    with pytest.raises(ValueError):
        corpus.scan(spark, f"{tmp_path}/a.parquet", ["none"])


def test_kept_texts(spark):
    rows = spark.createDataFrame([("e", "t", [1.0], 1, 1, "d")], "api_explanation string, detokenized_text_truncated string, activation_vector array<double>, n_raw_tokens int, activation_layer int, doc_id string")
    assert "detokenized_text_truncated" in explanations.build(rows, "rl", "a", keep_text=True).columns
    assert "detokenized_text_truncated" not in explanations.build(rows, "rl", "a").columns
    assert rollouts.MOST_CJK == 0.05
    assert spark.createDataFrame([(0.05, True), (0.06, True), (0.0, False)], "c double, m boolean").filter(rollouts.injection_ok(F.col("c"), F.col("m"))).count() == 1


def test_counters_have_sources(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 2), ("b", 1, 7)], "s string, t int, c int")
    assert {(r["s"], r["t"]): r["delta"] for r in rollouts.counter_deltas(rows, "c", "t", "s").collect()} == {("a", 1): None, ("a", 2): 4, ("a", 3): 0, ("b", 1): None}
    with pytest.raises(ValueError):
        rollouts.counter_deltas(rows, "c", "t")


def test_metrics_of_a_step_without_rewards(spark):
    rows = spark.createDataFrame([(1, None, 0.0, True, False, False, True, 3, 0.0)], "step int, reward double, advantage double, ok boolean, truncated boolean, cjk_fail boolean, marker_ok boolean, n_tokens int, penalty double")
    made = rollouts.step_metrics(rows).first()
    assert all(np.isnan(made[c]) for c in ("reward_mean", "reward_std", "reward_min", "reward_max")) and made["extraction_rate"] == 0


def test_distractors_never_share_a_document(spark):
    texts = ["a" * n for n in range(1, 30)] + [f"b{i}" for i in range(3)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = evaluation.distractors(rows, 4, 1).collect()
    by = {i: [r["j"] for r in got if r["i"] == i] for i in {r["i"] for r in got}}
    assert set(by) == set(range(32)) and all(len(set(j)) == 3 for j in by.values())
    assert all(sorted(by[i]) == [29, 30, 31] for i in range(29))
    assert evaluation.distractors(rows.filter("i < 29"), 4, 1).count() == 0
    assert evaluation.distractors(rows.limit(0), 4, 1).count() == 0


def plain_distractors(rows, k, seed):
    """The same draws, one source at a time."""
    fit = [(i, t) for i, t in rows if t]
    sha = lambda *parts: hashlib.sha256("|".join(map(str, (seed, *parts))).encode()).hexdigest()
    ring, out = sorted(fit, key=lambda r: (sha("ring", r[0]), r[0])), {}
    for i, t in fit:
        start = int(sha("start", i)[:8], 16) % len(fit)
        good = [j for j, o in ring[start:] + ring[:start] if j != i and not o.startswith(t) and not t.startswith(o)]
        if len(good) >= k - 1:
            out[i] = good[: k - 1]
    return out


@pytest.mark.parametrize("few", [0, 2, 3, 9])
def test_distractors_where_most_texts_agree(spark, few):
    """Rows that meet grow with the sources, not with their square, and the draws stay what they are."""
    texts = ["same text"] * 900 + [f"other {i}" for i in range(few)] + ["same text and more", "same"][: few]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "i long, text string").repartition(3)
    got = {}
    for r in evaluation.distractors(df, 4, 1).orderBy("i", "r").collect():
        got.setdefault(r["i"], []).append(r["j"])
    assert got == plain_distractors(rows, 4, 1)


def test_sources_of_one_text_meet_few_others(spark, monkeypatch):
    met, keep = [], storage.kept

    def counting(df, name):
        made = keep(df, name)
        if name == "rings":
            met.append(made.count())
        return made

    monkeypatch.setattr(storage, "kept", counting)
    for n in (400, 1600):
        df = spark.createDataFrame([(i, "same" if i >= 40 else f"o{i}") for i in range(n)], "i long, text string")
        assert evaluation.distractors(df, 4, 1).count() == 3 * n
    assert met == [400 + 40, 1600 + 40]


def test_distractors_of_texts_that_begin_alike(spark):
    """Sketches leave open whether these are apart; the texts tell."""
    draw = random.Random(3)
    bases = ["".join(draw.choice("aé€😀") for _ in range(70)) for _ in range(3)]
    texts = [draw.choice(bases)[: draw.choice((1, 2, 3, 15, 16, 17, 40, 63, 64, 65, 70))] + draw.choice(("", "", "x", "y")) for _ in range(300)] + ["", None]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "i long, text string")
    want = plain_distractors(rows, 4, 1)
    for sources, asked in ((df, set(want)), (df.withColumn("asked", F.when(F.col("i") > 9, F.col("i") % 3 == 1)), {i for i in want if i > 9 and i % 3 == 1})):
        got = {}
        for r in evaluation.distractors(sources, 4, 1).orderBy("i", "r").collect():
            got.setdefault(r["i"], []).append(r["j"])
        assert got == {i: want[i] for i in asked}


def moved_bytes(spark, since):
    """Bytes shuffled, spilled and written by stages from that id on, and the next id."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    each = [stages.apply(i) for i in range(stages.size())]
    return sum(x.shuffleWriteBytes() + x.diskBytesSpilled() + x.outputBytes() for x in each if x.stageId() >= since), max([-1, *[x.stageId() for x in each]]) + 1


def test_judge_jobs_leave_sources_where_they_are(spark, tmp_path):
    """What moves is what prompts show, not whole texts."""
    long = F.concat(*[F.sha2(F.concat("id", F.lit(f"|{n}")), 256) for n in range(300)])
    spark.range(400).select(F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, "said").alias("explanation"), long.alias("source")).write.parquet(f"{tmp_path}/rows")
    _, since = moved_bytes(spark, 0)
    jobs = evaluation.judge_jobs(spark.read.parquet(f"{tmp_path}/rows"), 4, 1)
    assert jobs.agg(F.count("*"), F.sum(F.length("prompt"))).first()[0] == 200 * 6
    assert 0 < moved_bytes(spark, since)[0] < 400 * 300 * 64 // 2


def test_match_options_hold_the_true_one(spark):
    texts = ["a" * n for n in range(1, 30)] + [f"b{i}" for i in range(3)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in evaluation.match_options(rows, 4, 1).collect():
        assert r["options"][r["true_pos"]] == texts[r["i"]] and len(set(r["options"])) == 4


def test_judging(spark):
    rows = spark.createDataFrame([(0, " one ", "x" * 800), (1, None, "b"), (2, "", "c"), (3, "say {options} {text}", "d"), (4, "far", "e"), (5, "off", None)], "i long, explanation string, source string")
    jobs = evaluation.judge_jobs(rows, 4, 1).collect()
    assert len(jobs) == 4 * 5 + 3 and {j["i"] for j in jobs if j["dim"] == "source_match"} == {0, 3, 4}
    assert all("say {options} {text}" in j["prompt"] for j in jobs if j["i"] == 3)
    none = evaluation.judge_summary(spark.createDataFrame([], "i long, dim string, score int, hit int")).first()
    assert none["n_judged"] == 0 and all(np.isnan(none[c]) for c in none.asDict() if c != "n_judged")
    scores = [(i, d, None if d == "coherence" else 5, None) for i in range(6) for d in evaluation.RUBRIC] + [(i, "source_match", None, None) for i in range(6)]
    got = evaluation.judge_summary(spark.createDataFrame(scores, "i long, dim string, score int, hit int")).first()
    assert got["judge_fail_rate"] == pytest.approx(12 / 36) and np.isnan(got["coherence_mean"]) and np.isnan(got["source_match_acc"]) and got["match_answer_rate"] == 0 and got["specificity_mean"] == 5


def test_cache_takes_the_last_row_and_is_filtered_too(spark):
    cache = spark.createDataFrame([("text A", "old\n\nx", 0, 0), ("text A", "new\n\ny", 1, 0), ("text B", "weak", 0, 1)], "text string, api_explanation string, file_ord int, row_ord int")
    rows = spark.createDataFrame([(1, "text A"), (2, "text B"), (3, "text a"), (4, "text A ")], "id int, text string")
    assert {r["id"]: r["api_explanation"] for r in explanations.cached(rows, cache).collect()} == {1: "new\n\ny", 2: "weak", 3: None, 4: None}
    assert sorted(r["id"] for r in explanations.misses(rows, cache).collect()) == [3, 4]
    asked = explanations.explain(rows, cache, lambda m: m.withColumn("api_explanation", F.when(F.col("id") == 3, "p\n\nq")))
    assert {r["id"]: r["api_explanation"] for r in asked.collect()} == {1: "new\n\ny", 3: "p\n\nq"}


class Counting:
    """Answers by a rule, and writes down each prompt."""

    def __init__(self, log):
        self.log = log

    def complete(self, prompts):
        with open(self.log, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        return [None if "t3" in p else f"<analysis>\n- {p}\n- second\n</analysis>" for p in prompts]


def test_the_provider_is_asked_once_for_each_miss(spark, tmp_path):
    log, out = f"{tmp_path}/asked", f"file://{tmp_path}/chunks"
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "row_idx long, text string")
    cache = spark.createDataFrame([("t1", "a\n\nb", 0, 0), ("t2", None, 0, 1)], "text string, api_explanation string, file_ord int, row_ord int")
    provider = providers.asking(lambda: Counting(log), "Explain {text}", extract=r"<analysis>\s*(.*?)\s*</analysis>")
    made = explanations.explain(rows, cache, provider)
    for _ in range(2):
        assert {r["row_idx"] for r in made.collect()} == {0, 1, 2, 4, 5, 6, 7, 8}
    assert sorted(open(log).read().split("\n")[:-1]) == [f"Explain t{i}" for i in (0, 2, 3, 4, 5, 6, 7, 8)]

    def restartable(asked, answer):
        return chunks.run(spark, asked, out, 4, answer).drop("chunk_id")

    open(log, "w").close()
    assert explanations.explain(rows, cache, provider, put=restartable).count() == 8
    storage.delete(spark, f"{out}/chunk_id=1")
    storage.delete(spark, f"{out}.finished.json")
    assert explanations.explain(rows, cache, provider, put=restartable).count() == 8
    said = open(log).read().split("\n")[:-1]
    assert {s: said.count(s) for s in said} == {f"Explain t{i}": 2 if 4 <= i < 8 else 1 for i in (0, 2, 3, 4, 5, 6, 7, 8)}
    with pytest.raises(ValueError):
        providers.asking(lambda: None, "no place")


def test_providers():
    def ask(prompt):
        if "down" in prompt:
            raise ConnectionError
        return {"no": ("refusal", ""), "blank": ("end", " "), "odd": ("paused", "x")}.get(prompt, ("end", f" {prompt}! "))

    assert providers.checked(providers.Concurrent(ask, 3), ["a", "no", "c", "d", "e", "down"]) == ["a!", None, "c!", "d!", "e!", None]
    for bad in (["down", "down", "c"], ["blank"], ["odd"]):
        with pytest.raises((RuntimeError, ValueError)):
            providers.Concurrent(ask).complete(bad)
    for bad in ([], ["a", "b"], [""], [3]):
        with pytest.raises(ValueError):
            providers.checked(type("P", (), {"complete": lambda self, p, bad=bad: bad})(), ["x"])
    assert providers.checked(providers.Concurrent(ask), []) == [] and storage.by_path("math:sqrt")(4) == 2


def test_what_is_late_has_no_answer(spark):
    def ask(prompt):
        time.sleep(float(prompt))
        return "end", prompt

    began = time.time()
    assert providers.Concurrent(ask, 2).complete(["0", "30", "0.1", "0.2"], time.time() + 1.5) == ["0", None, "0.1", "0.2"]
    assert providers.Concurrent(ask, 1).complete(["30", "0"], time.time() + 0.5) == [None, None]
    assert providers.Concurrent(ask).complete(["0"], time.time() - 1) == [None] and time.time() - began < 10


class InFlight:
    """Notes how many calls are open at once, over all tasks."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, prompt):
        own = f"{self.folder}/open/{uuid.uuid4().hex}"
        open(own, "w").close()
        with open(f"{self.folder}/seen", "a") as f:
            f.write(f"{len(os.listdir(f'{self.folder}/open'))}\n")
        time.sleep(0.05)
        os.remove(own)
        return "end", prompt.upper()


@pytest.mark.parametrize("chunked", [False, True])
def test_calls_in_flight_have_a_bound(spark, tmp_path, chunked):
    os.mkdir(f"{tmp_path}/open")
    ask, bound = InFlight(str(tmp_path)), providers.Bound(6, 3)
    assert bound.width == 2
    rows = spark.range(80).select(F.col("id").alias("row_idx"), F.concat(F.lit("t"), "id").alias("text")).repartition(16)
    provider = providers.asking(lambda width: providers.Concurrent(ask, width), bound=bound)
    if chunked:
        made = chunks.run(spark, rows, f"file://{tmp_path}/out", 10, provider, at_once=bound.tasks)
        assert chunks.committed(spark, f"file://{tmp_path}/out") == list(range(8)) and not storage.exists(spark, f"file://{tmp_path}/out.staged")
    else:
        made = storage.kept(provider(providers.spread(rows, provider)), "bounded")
    assert {r["row_idx"]: r["api_explanation"] for r in made.collect()} == {i: f"T{i}" for i in range(80)}
    seen = [int(x) for x in open(f"{tmp_path}/seen")]
    assert len(seen) == 80 and 2 < max(seen) <= 6
    with pytest.raises(ValueError):
        providers.Bound(2, 3)


class Later:
    """A service that keeps what it gets in a folder and is done when a file says so."""

    def __init__(self, folder):
        self.folder = folder

    def find(self, name):
        return f"h-{name}" if os.path.exists(f"{self.folder}/h-{name}") else None

    def send(self, name, requests):
        with open(f"{self.folder}/h-{name}", "w") as f:
            json.dump(requests, f)
        with open(f"{self.folder}/log", "a") as f:
            f.write(f"{name} {len(requests)}\n")
        if os.path.exists(f"{self.folder}/lose"):
            os.remove(f"{self.folder}/lose")
            raise RuntimeError("lost after sending")
        return f"h-{name}"

    def ended(self, handle):
        return os.path.exists(f"{self.folder}/all") or handle.endswith("-1")

    def fetch(self, handle):
        with open(f"{self.folder}/h-{handle[2:]}") as f:
            for name, prompt in reversed(json.load(f)):
                if "lost" not in prompt:
                    yield name, "expired" if "down" in prompt else "refusal" if "no" in prompt else "succeeded", None if "no" in prompt else f" {prompt}! "


def test_batches_are_sent_once_and_fetched_as_they_end(spark, tmp_path):
    at, folder = f"file://{tmp_path}/state", str(tmp_path)
    make = lambda: Later(folder)
    prompts = [f"q{i}" for i in range(23)]
    prompts[3], prompts[4], prompts[5], prompts[12] = "no", "down", "lost", None
    requests = spark.createDataFrame(list(enumerate(prompts)), "idx long, prompt string").repartition(5)
    open(f"{folder}/lose", "w").close()
    with pytest.raises(Exception, match="lost after sending"):
        batches.submit(spark, requests, at, make, 10)
    for _ in range(2):  # neither what was noted nor what was only sent is sent again
        sent = batches.submit(spark, requests, at, make, 10)
    assert sorted((r["chunk_id"], r["n"]) for r in sent.collect()) == [(0, 10), (1, 10), (2, 3)]
    log = [x.split() for x in open(f"{folder}/log")]
    assert len({name for name, _ in log}) == 3 == len(log)
    assert batches.poll(spark, at, make) == 2 and batches.poll(spark, at, make) == 2
    assert {r["idx"] for r in batches.answers(spark, at).collect()} == set(range(10, 20))
    open(f"{folder}/all", "w").close()
    assert batches.poll(spark, at, make) == 0 == batches.poll(spark, at, make)
    got = {r["idx"]: r["text"] for r in batches.answers(spark, at).collect()}
    assert got == {i: f"{p or ''}!" for i, p in enumerate(prompts) if i not in (3, 4, 5)}
    with pytest.raises(ValueError, match="another input"):
        batches.submit(spark, requests.withColumn("prompt", F.upper("prompt")), at, make, 10)
    with pytest.raises(ValueError, match="numbered"):
        batches.submit(spark, requests.filter("idx > 0"), f"{at}2", make, 10)
    bad = spark.createDataFrame([(0, "down"), (1, "down"), (2, "ok")], "idx long, prompt string")
    batches.submit(spark, bad, f"{at}3", make, 2)
    assert batches.poll(spark, f"{at}3", make) == 0
    with pytest.raises(RuntimeError, match="sub-batch 0"):
        batches.answers(spark, f"{at}3")


def test_batches_as_a_provider_of_explanations(spark, tmp_path):
    open(f"{tmp_path}/all", "w").close()
    rows = spark.createDataFrame([(f"d{i}", i, f"<a>t{i}\n- second</a>") for i in range(7)], "doc_id string, n_raw_tokens int, text string")
    cache = spark.createDataFrame([("<a>t1\n- second</a>", "a\n\nb", 0, 0)], "text string, api_explanation string, file_ord int, row_ord int")
    folder = str(tmp_path)
    provider = batches.completing(f"file://{tmp_path}/state", lambda: Later(folder), ("doc_id", "n_raw_tokens"), "Say {text}", extract=r"<a>\s*(.*?)\s*</a>", size=3, every=0.1)
    got = {r["doc_id"]: r["api_explanation"] for r in explanations.explain(rows, cache, provider).collect()}
    assert got["d1"] == "a\n\nb" and got["d0"].startswith("t0") and set(got) == {f"d{i}" for i in range(7)}
    assert sorted(int(x.split()[1]) for x in open(f"{tmp_path}/log")) == [3, 3]


class Judge:
    def __init__(self, folder):
        self.folder = folder

    def __call__(self, prompt):
        with open(f"{self.folder}/asked", "a") as f:
            f.write(hashlib.sha256(prompt.encode()).hexdigest() + "\n")
        if "slow" in prompt:
            time.sleep(60)
        if "broken" in prompt:
            raise KeyError("whatever")
        if "stop" in prompt and os.path.exists(f"{self.folder}/stop"):
            time.sleep(4)
            os._exit(1)
        return "end", "B" if "SOURCE" in prompt else "7" if "coherence" not in prompt and "fit together" not in prompt else "none"


def test_a_judge_from_tasks_to_its_summary(spark, tmp_path):
    folder = str(tmp_path)
    said = [(i, f"explanation {i}", f"{i} source") for i in range(30)]
    rows = spark.createDataFrame([*said, (30, None, "x source"), (31, "broken", "y source")], "i long, explanation string, source string")
    make = judging.judge(Judge(folder))
    made = judging.scores(spark, rows, f"file://{tmp_path}/a", make, seed=1, chunk_rows=40)
    got = evaluation.judge_summary(made).first()
    jobs = {(r["i"], r["dim"]): r["true_pos"] for r in evaluation.judge_jobs(rows, seed=1).collect()}
    right = [p == 1 for (i, d), p in jobs.items() if d == evaluation.MATCH and i < 30]
    assert len(jobs) == 31 * 6 and got["specificity_mean"] == 7 and np.isnan(got["coherence_mean"]) and got["n_judged"] == 31
    assert got["source_match_acc"] == pytest.approx(np.mean(right)) and got["judge_fail_rate"] == pytest.approx((6 + 30) / 186)
    asked = open(f"{folder}/asked").read().split()
    assert len(asked) == 186 == len(set(asked))
    # Again: nothing is asked. A run that broke asks for its open chunks.
    assert str(evaluation.judge_summary(judging.scores(spark, rows, f"file://{tmp_path}/a", make, seed=1, chunk_rows=40)).first()) == str(got) and len(open(f"{folder}/asked").read().split()) == 186
    stopping = rows.withColumn("explanation", F.when(F.col("i") == 29, "stop here").otherwise(F.col("explanation")))
    open(f"{folder}/stop", "w").close()
    with pytest.raises(Exception):  # the worker dies
        judging.scores(spark, stopping, f"file://{tmp_path}/b", make, seed=1, chunk_rows=40)
    done = chunks.committed(spark, f"file://{tmp_path}/b")
    assert 0 < len(done) < 5
    os.remove(f"{folder}/stop")
    os.remove(f"{folder}/asked")
    assert judging.scores(spark, stopping, f"file://{tmp_path}/b", make, seed=1, chunk_rows=40).filter("score = 7").count() == 30 * 4
    assert len(open(f"{folder}/asked").read().split()) <= 186 - 26 * len(done)


def test_a_judge_keeps_its_deadline(spark, tmp_path):
    rows = spark.createDataFrame([(i, "slow" if i == 1 else "fast", f"{i} source") for i in range(5)], "i long, explanation string, source string")
    began = time.time()
    made = judging.scores(spark, rows, f"file://{tmp_path}/a", judging.judge(Judge(str(tmp_path))), seed=1, seconds=15)
    got = {(r["i"], r["dim"]): r["score"] for r in made.collect()}
    assert time.time() - began < 45 and got[1, "specificity"] is None and got[0, "specificity"] == 7
    none = judging.scores(spark, rows.limit(0), f"file://{tmp_path}/b", judging.judge(Judge(str(tmp_path))))
    assert evaluation.judge_summary(none).first()["n_judged"] == 0


def test_failure_rate(spark):
    answers = lambda n: spark.createDataFrame([(i, "failed" if i < n else "ok") for i in range(10)], "i int, status string")
    assert explanations.failure_rate(answers(1)) == pytest.approx(0.1)
    with pytest.raises(RuntimeError):
        explanations.failure_rate(answers(3))


def _meta(start, length, rows, **more):
    e = {"base_model": "org/m", "d_model": 4, "layer_index": 2, "norm": "none", "corpus": "c", "corpus_slice": sidecar.Slice(start, length), "positions_per_doc": 1}
    return sidecar.DatasetMeta(f"d{start}", "base", rows, sidecar.Extraction(**{**e, **more}))


def test_merge(spark):
    a, b = spark.range(3), spark.range(2)
    merged, meta = merging.merge([(b, _meta(10, 5, 2)), (a, _meta(0, 10, 3))])
    assert merged.count() == meta.row_count == 5 and meta.parent_datasets == ["d0", "d10"]
    assert meta.extraction.corpus_slice == sidecar.Slice(0, 15) and meta.dataset_id.startswith("base_m_L2_")
    for bad in (_meta(11, 5, 2), _meta(9, 5, 2), _meta(10, 5, 3), _meta(10, 5, 2, d_model=5)):
        with pytest.raises(ValueError):
            merging.merge([(a, _meta(0, 10, 3)), (b, bad)])


def test_sidecar_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/t.parquet"
    sidecar.write(spark, path, _meta(0, 10, 3))
    back = sidecar.read(spark, path + "@[0:5]")
    assert back.extraction == _meta(0, 10, 3).extraction and back.created_at
    with pytest.raises(ValueError):
        sidecar.dumps(sidecar.replaced(back, stage="rl"))
    with pytest.raises(ValueError):
        sidecar.loads("kind: other\nschema_version: 1")
    with pytest.raises(ValueError):
        sidecar.loads(f"kind: {sidecar.KIND}\nschema_version: 1\ndataset_id: d")
    assert sidecar.derived_id("base_m", "build", "rl") == "rl_m"
    full = sidecar.replaced(back, stage="ar_sft", tokens=sidecar.Tokens("x", 7, 1, 2, [3, 4]), prompt_templates={"actor": "a <INJECT> b", "critic": "c"})
    again = sidecar.loads(sidecar.dumps(full) + "later: 1\n")
    assert again.tokens == full.tokens and again.extraction == full.extraction and "api_summaries" not in sidecar.dumps(full)
    ids = lambda s: [{"x": 7, "a": 1, "b": 2}[c] for c in s if c != " "]
    assert sidecar.verify(again, ids, ids, {"mse_scale": 3.0})["neighbours"] == (1, 2) and sidecar.verify(again, ids)["mse_scale"] == 2.0
    for bad in (sidecar.Tokens("x", 8), sidecar.Tokens("x", 7, 2, 1)):
        with pytest.raises(ValueError):
            sidecar.verify(sidecar.replaced(full, tokens=bad), ids, ids)
    assert storage.slice_of("a@[3:]") == ("a", 3, None)


def test_chunks_resume(spark, tmp_path):
    rows, done = spark.range(10).withColumnRenamed("id", "row_idx"), []

    def work(df):
        done.append(1)
        return df

    out = f"file://{tmp_path}/out"
    chunks.guarded(spark, out, {"rows": 10})
    assert chunks.run(spark, rows, out, 4, work).count() == 10 and chunks.committed(spark, out) == [0, 1, 2]
    storage.delete(spark, f"{out}/chunk_id=1")
    storage.delete(spark, f"{out}.finished.json")
    assert chunks.run(spark, rows, out, 4, work).count() == 10 and chunks.committed(spark, out) == [0, 1, 2]
    assert chunks.run(spark, rows, out, 4, lambda df: df.filter("chunk_id < 0").drop("chunk_id").withColumn("chunk_id", F.lit(0))).count() == 10
    with pytest.raises(ValueError, match="nothing"):
        chunks.run(spark, rows.limit(0), f"{out}0", 4, work)
    assert chunks.run(spark, rows, f"{out}_none", 4, lambda df: df.filter("row_idx < 0")).count() == 0
    chunks.guarded(spark, out, {"rows": 10})
    with pytest.raises(ValueError):
        chunks.guarded(spark, out, {"rows": 11})
    storage.delete(spark, f"{out}.fingerprint.json")
    with pytest.raises(ValueError, match="without a fingerprint"):
        chunks.guarded(spark, out, {"rows": 10})
    with pytest.raises(ValueError):
        chunks.published(spark, rows.filter("row_idx < 0"), f"{out}2")
    assert not storage.exists(spark, f"{out}2") and not storage.exists(spark, f"{out}2.staged")
    chunks.published(spark, spark.range(0, 100, 1, 1), f"{out}3", group_rows=10)
    import glob

    import pyarrow.parquet as pq

    groups = [pq.ParquetFile(f).num_row_groups for f in glob.glob(f"{tmp_path}/out3/*.parquet")]
    assert groups == [10]
    with pytest.raises(FileExistsError):
        chunks.published(spark, rows, f"{out}3")


def test_chunks_read_their_input_once_and_keep_what_a_broken_run_has_finished(spark, tmp_path, monkeypatch):
    n, size = 40, 4
    spark.range(n).withColumnRenamed("id", "row_idx").withColumn("x", F.col("row_idx") * 2).write.parquet(f"{tmp_path}/in")
    read, worked, fails = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), f"{tmp_path}/fails"

    def counting(counter, slow=False):
        def run(batches):
            for batch in batches:
                counter.add(len(batch))
                if slow and 33 in batch.column(0).to_pylist() and os.path.exists(fails):
                    time.sleep(6)  # the tasks of the other chunks end meanwhile
                    raise ValueError("broken")
                yield batch

        return run

    def once(out):
        rows = spark.read.parquet(f"{tmp_path}/in").mapInArrow(counting(read), "row_idx long, x long")
        return chunks.run(spark, rows, out, size, lambda df: df.mapInArrow(counting(worked, True), "row_idx long, x long, chunk_id int"), n_rows=n)

    out = f"file://{tmp_path}/a"
    assert sorted(r["x"] for r in once(out).collect()) == [2 * i for i in range(n)] and (read.value, worked.value) == (n, n)
    assert once(out).count() == n and read.value == n  # a finished run reads nothing
    for tasks in (20_000, 5):  # with several chunks in a task, those of the broken one are open
        monkeypatch.setattr(chunks, "MOST_TASKS", tasks)
        out, read.value, worked.value = f"file://{tmp_path}/b{tasks}", 0, 0
        open(fails, "w").close()
        with pytest.raises(Exception, match="broken"):
            once(out)
        done = chunks.committed(spark, out)
        assert 8 not in done and len(done) >= 7 - (tasks == 5)
        os.remove(fails)
        read.value = worked.value = 0
        assert sorted(r["row_idx"] for r in once(out).collect()) == list(range(n))
        assert (read.value, worked.value) == (n, n - size * len(done)) and chunks.committed(spark, out) == list(range(10))


def files_read(df):
    """How many files the scans of a table's plan have read."""
    df._jdf.collectToPython()
    found, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan = plan.executedPlan()
        if plan.metrics().contains("numFiles"):
            found += plan.metrics().apply("numFiles").value()
        plans += [plan.children().apply(i) for i in range(plan.children().size())] + ([plan.plan()] if "QueryStageExec" in plan.getClass().getSimpleName() else [])
    return found


def test_rows_in_file_order(spark, tmp_path):
    """Several files, empty ones among them, names with blanks, in an order that no column has."""
    order, at = [7, 3, 9, 1, 8, 2, 6, 0, 5, 4, 11, 10], f"{tmp_path}/a table"
    for k, part in enumerate((order[:5], [], order[5:6], order[6:])):
        spark.createDataFrame([(x, f"t{x}") for x in part], "x long, text string").coalesce(1).write.mode("append").parquet(f"{at}/k={k}")
    want = list(zip(order, range(12), strict=True))
    for a, b in ((0, None), (0, 5), (3, 7), (5, 6), (6, 12), (11, 99), (12, None), (4, 4)):
        got = sorted(((r["x"], r["row_idx"]) for r in corpus.in_file_order(spark, at, a, b, ["x"]).collect()), key=lambda r: r[1])
        assert got == want[a:b], (a, b)
    few = corpus.in_file_order(spark, at, 5, 6)
    assert files_read(few) == 1 and files_read(corpus.in_file_order(spark, at, 3, 5)) == 1 and files_read(corpus.in_file_order(spark, at, 3, 7)) == 4 and few.columns == ["x", "text", "k", "row_idx"] and few.first()["k"] == 2
    assert "Exchange rangepartitioning" not in few._jdf.queryExecution().toString()
    assert corpus.row_count(spark, at) == 12 and [n for _, n in corpus.file_rows(spark.read.parquet(at))] == [5, 1, 6]
    assert sorted(r["x"] for r in corpus.scan(spark, f"{at}@[2:6]", ["x"], None).collect()) == sorted(order[2:6])
    with pytest.raises(ValueError, match="in the way"):
        corpus.in_file_order(spark, at, out="x")


def test_caps_and_windows_are_filters(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BUCKETS", 5)
    numbers = [x * x * 7 - 900 for x in range(60)]
    rows = spark.createDataFrame([(x, x % 3) for x in numbers], "row_idx long, k long").repartition(7)
    assert corpus.nth_numbers(rows, [0, 1, 31, 59, 60]) == [numbers[0], numbers[1], numbers[31], numbers[59], None]
    assert corpus.nth_numbers(rows.limit(0), [0, 3]) == [None, None]
    odd = [x for x in numbers if x % 3 == 1]
    for n in (0, 1, 7, len(odd), 99):
        got = corpus.first_kept(rows, n, F.col("k") == 1)
        assert sorted(r["row_idx"] for r in got.collect()) == odd[:n]
    assert corpus.first_kept(rows, 40).rdd.getNumPartitions() == 7 and corpus.first_kept(rows, 40).count() == 40
    assert sorted(r["row_idx"] for r in corpus.window(rows, 13, 22, ["row_idx"]).collect()) == numbers[13:35]
    assert corpus.window(rows, 60, 5, ["row_idx"]).count() == 0 and corpus.window(rows, 58, 5, ["row_idx"]).count() == 2


def test_stream_windows(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:01' + make_interval(0, 0, 0, 0, 0, id) AS ts, 'a' AS event_type, 1.0D AS value FROM range(90)")
    df.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/events")
    q = chunks.metrics_of_stream(stream, "1 hour", "1 minute").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == 90


def test_settings():
    assert config.with_overrides({"a": {"b": 1}}, ["a.b=2", "c=[1]"]) == {"a": {"b": 2}, "c": [1]}
    assert config.expanded({"preset": "p", "x": 1}, {"p": {"x": 0, "y": 2}}) == {"x": 1, "y": 2}
    assert config.resolved({"lr": 0.1, "n": 3}, {"lr": "1e-4"}, {"n": 7}) == {"lr": 1e-4, "n": 7}
    with pytest.raises(ValueError):
        config.resolved({"lr": 0.1}, {"other": 1}, {})
    assert config.resolved({"lr": 0.1, "n": 3, "b": False, "s": "x"}, {"b": "true"}, {"n": "7", "lr": 1}) == {"lr": 1.0, "n": 7, "b": True, "s": "x"}
    with pytest.raises(ValueError):
        config.resolved({"lr": 0.1}, {}, {"other": 1})
    assert config.snapshot({"b": 1, "a": 2, "config": "x"}) == "a: 2\nb: 1\n"


def test_guards(spark):
    with pytest.raises(ValueError):
        corpus.not_empty(spark.range(0), "t")
    with pytest.raises(ValueError):
        corpus.require(spark.range(1), ["x"])
    with pytest.raises(ValueError):
        explanations.build(spark.range(1), "rl", "a")
    rows = spark.createDataFrame([("e", [1.0], 1, 1, "d")], "api_explanation string, activation_vector array<double>, n_raw_tokens int, activation_layer int, doc_id string")
    words = lambda p: F.split(p, " ")
    assert explanations.build(rows, "ar_sft", "a", "t {explanation} end of it", encode=words, suffix=["of", "it"]).count() == 1
    with pytest.raises(Exception, match="end in the suffix"):
        explanations.build(rows, "ar_sft", "a", "t {explanation} end of it", encode=words, suffix=["of", "that"]).collect()
    ids = spark.createDataFrame([([],), ([1],), ([1, 2, 3],)], "ids array<int>")
    assert explanations.within_length(ids, "ids", 2).count() == 1
    with pytest.raises(ValueError):
        explanations.within_length(ids.filter("size(ids) > 2"), "ids", 2, required=True)
    good = pipeline.Settings("in", "out")
    pipeline.preconditions(good)
    for change in ({"actor": "none"}, {"critic": "{explanation}{explanation}"}, {"fractions": {"av_sft": 1.0}}, {"length": 0}, {"no_text": True}):
        with pytest.raises(ValueError):
            pipeline.preconditions(dataclasses.replace(good, **change))


def test_shared_folder(spark, monkeypatch):
    assert storage.shared_folder(spark)
    monkeypatch.setattr(spark, "_shared_folder", None, raising=False)

    class Elsewhere:
        def __init__(self, context):
            self.context, self.master = context, "spark://host:7077"

        def __getattr__(self, name):
            return getattr(self.context, name)

    class Session:
        sparkContext = Elsewhere(spark.sparkContext)

    if not spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        with pytest.raises(ValueError):
            storage.shared_folder(Session())


def test_markers_are_kept_as_yaml():
    assert tokens.kept_markers("") == {} and tokens.kept_markers("m: ㊗") == {"m": "㊗"}
    with pytest.raises(ValueError):
        tokens.kept_markers("m: two")
