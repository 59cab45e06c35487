"""All stages on the smallest corpus, and the checks around a run."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from tessera.functions import tokens
from tessera.plans import pipeline
from tessera.sources import sidecar, storage

from .conftest import DATA


def test_stages(spark, tmp_path):
    sent = []
    s = pipeline.Settings(f"{DATA}/documents.parquet", f"file://{tmp_path}/run", start=10, length=60, positions_per_doc=3)
    at = pipeline.run(spark, s, uploaded=sent.append)
    base = spark.read.parquet(at["base", "base"])
    assert base.groupBy("doc_id").count().filter("count > 3").count() == 0
    assert base.filter("n_raw_tokens <= 50 OR size(activation_vector) <> 8").count() == 0
    raw = [spark.read.parquet(at["split", x]) for x in pipeline.TRAIN_STAGES]
    assert sum(r.count() for r in raw) == base.count()
    seen = [{x[0] for x in r.select("doc_id").distinct().collect()} for r in raw]
    assert not (seen[0] & seen[1] or seen[0] & seen[2] or seen[1] & seen[2])
    for stage in pipeline.TRAIN_STAGES:
        a, b = spark.read.parquet(at["built", stage]), spark.read.parquet(at["shuffled", stage])
        assert a.exceptAll(b).count() == 0 and a.count() == b.count() > 0
        assert sidecar.read(spark, at["shuffled", stage]).dataset_id.endswith("__shuf42")
    assert spark.read.parquet(at["built", "ar_sft"]).filter(~F.col("prompt").endswith("</text> <summary>")).count() == 0
    assert len(sent) == 10
    counted = {r["metric"]: r["value"] for r in spark.read.parquet(f"{s.output}/counters").collect()}
    assert counted["docs"] == 60 and counted["rows"] == base.count()
    assert {r["metric"] for r in spark.read.parquet(f"{s.output}/phases").collect()} == {"split", *(f"{step}/{name}" for step, name in at if step != "split")}
    asked = []

    def refused(rows):
        asked.append(1)
        return pipeline.stand_in_provider(rows)

    # A second run finds everything; one that lost the end of a step goes on there.
    assert pipeline.run(spark, s, provider=refused) == at and not asked
    kept = sidecar.read(spark, at["built", "rl"])
    for step, name in (("explained", "av_sft"), ("built", "av_sft"), ("shuffled", "av_sft")):
        storage.delete(spark, sidecar.sidecar_path(at[step, name]))
    pipeline.run(spark, s, provider=refused)
    assert not asked and sidecar.read(spark, at["built", "rl"]) == kept
    lengths = lambda p: F.transform(F.split(p, " "), lambda w: F.length(w))
    ends = sidecar.Tokens("㊗", 0, critic_suffix_ids=[9])
    for step in ("built", "shuffled"):
        storage.delete(spark, sidecar.sidecar_path(at[step, "ar_sft"]))
    pipeline.run(spark, dataclasses.replace(s, encode=lengths, tokens=ends))
    storage.delete(spark, sidecar.sidecar_path(at["built", "ar_sft"]))
    with pytest.raises(Exception, match="end in the suffix"):
        pipeline.run(spark, dataclasses.replace(s, encode=lengths, tokens=dataclasses.replace(ends, critic_suffix_ids=[8])))
    with pytest.raises(ValueError, match="another input"):
        storage.delete(spark, sidecar.sidecar_path(at["base", "base"]))
        pipeline.run(spark, dataclasses.replace(s, chunk_rows=7))


def test_what_may_be_built():
    e = sidecar.Extraction("m", 1, 1, "none", "c", sidecar.Slice(0, 1), 1)
    meta = sidecar.DatasetMeta("d", "base", 1, e)
    assert sidecar.unbuilt(meta) == meta
    for bad in (sidecar.replaced(meta, stage="rl"), sidecar.replaced(meta, extraction=dataclasses.replace(e, norm="sqrt_d_model"))):
        with pytest.raises(ValueError):
            sidecar.unbuilt(bad)


def test_commit_of_a_checkout(tmp_path):
    git = tmp_path / ".git"
    assert sidecar.commit(tmp_path) == ""
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    assert sidecar.commit(tmp_path) == ""
    (git / "packed-refs").write_text("# pack-refs\nabc refs/heads/main\n^def\n")
    assert sidecar.commit(tmp_path) == "abc"
    (git / "refs/heads/main").write_text("123\n")
    assert sidecar.commit(tmp_path) == "123"
    (git / "HEAD").write_text("456\n")
    assert sidecar.commit(tmp_path) == "456"


class Letters:
    def extract(self, texts, layer):
        return [(list(t[:60]), [[float(ord(c)), float(layer)] for c in t[:60]]) for t in texts]


def test_extractor_inside_tasks(spark):
    docs = spark.createDataFrame([("a", "x" * 55), ("b", "")], "doc_id string, text string")
    s = pipeline.Settings("", "", positions_per_doc=20, layer=3)
    made, seen = pipeline._positions(pipeline.extracting(Letters, 3)(docs), s)
    got = made.collect()
    assert seen.get == {"docs": 2, "skipped": 1, "short_sampled": 1, "rows": 5}
    assert sorted(r["n_raw_tokens"] for r in got) == [51, 52, 53, 54, 55] and all(r["activation_vector"] == [120.0, 3.0] for r in got)
    assert got[0]["detokenized_text_truncated"].split(" ") == ["x"] * got[0]["n_raw_tokens"]
    import dataclasses as d

    assert {r["detokenized_text_truncated"] for r in pipeline._positions(pipeline.extracting(Letters, 3)(docs), d.replace(s, no_text=True))[0].collect()} == {""}


def test_a_run_is_not_overwritten(spark, tmp_path):
    e = sidecar.Extraction("m", 1, 1, "none", "c", sidecar.Slice(0, 1), 1)
    meta = sidecar.DatasetMeta("d", "base", 1, e)
    out = f"file://{tmp_path}/out"
    pipeline.begun(spark, out, meta, False)
    with pytest.raises(ValueError):
        pipeline.begun(spark, out, meta, False)
    pipeline.begun(spark, out, meta, True)
    with pytest.raises(ValueError):
        pipeline.begun(spark, out, sidecar.replaced(meta, extraction=dataclasses.replace(e, d_model=2)), True)
    pipeline.append_metrics(spark, f"{out}/metrics", 1, {"a": 1, "b": 2})
    for _ in range(2):  # a resumed step stands once
        pipeline.append_metrics(spark, f"{out}/metrics", 2, {"a": 3})
    assert spark.read.parquet(f"{out}/metrics").groupBy().sum("value").first()[0] == 6
    assert pipeline.console_line(3, {"loss": 0.5}) == "step 3 | loss 0.5"


def test_tokens():
    encode = lambda s: [ord(c) for c in s] if s >= "㈀" and len(s) == 1 and s != "㈀" else [1, 2, *map(ord, s)]
    kept = {}
    assert tokens.marker(encode, kept, "t") == ("㈁", 0x3201) and tokens.marker(encode, kept, "t")[0] == "㈁"
    assert tokens.suffix_ids(lambda s: list(range(len(s))), "a{explanation}bcd") == [1, 2]
    assert tokens.neighbours([5, 9, 6], 9) == (5, 6)
    for bad in ([9, 1], [1, 9, 9, 2], [1, 2]):
        with pytest.raises(ValueError):
            tokens.neighbours(bad, 9)
