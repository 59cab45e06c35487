"""The five stages from a corpus to shuffled training tables, each a table with a sidecar.

Models plug in as functions of DataFrames: an extractor adds the tokens and the vectors of each document, a provider adds
explanations. The stand-ins here are rules, not models, and say so in what they write.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, explanations, sampling
from tessera.sources import corpus, sidecar, storage
from tessera.streaming import chunks

TRAIN_STAGES = ("av_sft", "ar_sft", "rl")
EXPLAINED = ("av_sft", "ar_sft")


def stand_in_extractor(width: int, layer: int) -> Callable[[DataFrame], DataFrame]:
    """Words as tokens and hashes as vectors: deterministic, and no model's."""

    def extract(docs: DataFrame) -> DataFrame:
        words = F.split("text", " ")
        unit = lambda w, i: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: (F.pmod(F.xxhash64(w, i, d, F.lit(layer)), F.lit(2001)) / 1000.0 - 1.0).cast("float"))
        return docs.withColumn("tokens", words).withColumn("vectors", F.transform("tokens", unit))

    return extract


def stand_in_provider(rows: DataFrame) -> DataFrame:
    """A rule in place of a completion service: a digest and the first line; no model is asked."""
    first = F.get(F.split("text", "\n"), F.lit(0))
    return rows.withColumn("api_explanation", F.concat(F.left(F.sha2("text", 256), F.lit(8)), F.lit("\n\n"), first))


def extracting(make: Callable, layer: int, text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """An extractor that runs inside tasks, on one Arrow batch at a time.

    make builds it, once for a task; extract(texts, layer) gives (tokens as strings, vectors) for each text.
    """

    def extract(docs: DataFrame) -> DataFrame:
        names = docs.columns

        def run(batches):
            import pyarrow as pa

            model = None
            for batch in batches:
                model = model or make()
                texts = batch.column(names.index(text)).to_pylist()
                found = list(model.extract(texts, layer))
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} results for {len(texts)} texts")
                tokens = pa.array([list(t) for t, _ in found], pa.list_(pa.string()))
                vectors = pa.array([[list(map(float, v)) for v in vs] for _, vs in found], pa.list_(pa.list_(pa.float32())))
                yield pa.RecordBatch.from_arrays([*batch.columns, tokens, vectors], [*names, "tokens", "vectors"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "tokens array<string>", "vectors array<array<float>>"])
        return docs.mapInArrow(run, schema)

    return extract


@dataclass
class Settings:
    corpus_path: str
    output: str
    base_model: str = "stand-in"
    corpus: str = "documents"
    corpus_split: str = "train"
    start: int = 0
    length: int = 1000
    d_model: int = 8
    layer: int = 1
    positions_per_doc: int = 10
    seed: int = 42
    fractions: dict[str, float] = field(default_factory=lambda: {"av_sft": 0.4, "ar_sft": 0.4, "rl": 0.2})
    actor: str = "Explain <INJECT>."
    critic: str = "<text>{explanation}</text> <summary>"
    tokens: sidecar.Tokens = sidecar.Tokens("㊗", 0, critic_suffix_ids=[0, 1])
    chunk_rows: int = 65536
    keep_text: bool = False


    no_text: bool = False
    pad: str | None = None
    #: The ids of a prompt, as a column; with it, critic prompts must end in the ids of the suffix.
    encode: Callable[[Column], Column] | None = None


#: The steps of a run, each a folder, and the tables that they make.
STEPS = {
    "base": ("base",),
    "split": TRAIN_STAGES,
    "explained": EXPLAINED,
    "built": TRAIN_STAGES,
    "shuffled": TRAIN_STAGES,
}


def place(out: str, step: str, name: str) -> str:
    """Where a step's table is; splits are the folders of one partitioned table."""
    if name not in STEPS[step]:
        raise ValueError(f"{step} makes no {name}")
    folder = {"base": step, "split": f"{step}/split={name}"}.get(step, f"{step}/{name}")
    return f"{out}/{folder}"


def preconditions(s: Settings) -> None:
    """What must hold before a run begins."""
    lacking = [mark for mark, template in (("{explanation}", s.critic), ("<INJECT>", s.actor)) if template.count(mark) != 1]
    if lacking:
        raise ValueError(f"templates must hold {lacking} once")
    if set(s.fractions) != set(TRAIN_STAGES) or min(s.fractions.values()) < 0 or abs(sum(s.fractions.values()) - 1) > 1e-6:
        raise ValueError(f"fractions must name {TRAIN_STAGES}, not be negative, and sum to 1")
    if s.length < 1 or s.positions_per_doc < 1 or s.chunk_rows < 1:
        raise ValueError("length, positions_per_doc and chunk_rows must be positive")
    if s.no_text and s.fractions["rl"] < 1:
        raise ValueError("without texts nothing can be explained")


def run(
    spark: SparkSession,
    settings: Settings,
    extractor: Callable[[DataFrame], DataFrame] | None = None,
    provider: Callable[[DataFrame], DataFrame] = stand_in_provider,
    cache: DataFrame | None = None,
    uploaded: Callable[[str], None] | None = None,
) -> dict[tuple[str, str], str]:
    """Runs all steps and gives the paths of the tables by step and name. uploaded gets each shuffled and explained table, and its sidecar.

    Extraction and answers are written by chunks, each finished once; after a break, a run with the same settings works on
    the chunks that are still open, and tables that stand are read. What extraction counted and the seconds of each table that
    was made are added to the tables ``counters`` and ``phases``, by the time at which they were noted.
    """
    s, mark = settings, storage.standing()
    preconditions(s)
    at = {(step, name): place(s.output, step, name) for step, names in STEPS.items() for name in names}
    extractor = extractor or stand_in_extractor(s.d_model, s.layer)
    cache = cache if cache is not None else spark.createDataFrame([], "text string, api_explanation string, file_ord int, row_ord int")
    rows_of = sidecar.Slice(s.start, s.length)
    origin = sidecar.Extraction(s.base_model, s.d_model, s.layer, "none", s.corpus, rows_of, s.positions_per_doc)

    seconds: dict[str, float] = {}

    @contextmanager
    def phase(name: str):
        began = time.time()
        yield
        seconds[name] = time.time() - began

    def stand(path: str) -> bool:
        return storage.exists(spark, sidecar.sidecar_path(path))

    def put(df: Callable[[], DataFrame], step: str, name: str, meta: sidecar.DatasetMeta) -> tuple[DataFrame, sidecar.DatasetMeta]:
        path = at[step, name]
        if not stand(path):
            if storage.exists(spark, path):  # its sidecar is missing, so nothing was told of it
                storage.delete(spark, path)
            with phase(f"{step}/{name}"):
                made = chunks.published(spark, df(), path)
                sidecar.write(spark, path, sidecar.replaced(meta, row_count=made.count()))
        return spark.read.parquet(path), sidecar.read(spark, path)

    def extracted() -> DataFrame:
        docs = corpus.in_file_order(spark, s.corpus_path, s.start, s.start + s.length, ["text"])
        named = docs.select((F.col("row_idx") - s.start).alias("place"), T.document_key(s.corpus, s.corpus_split, F.col("row_idx")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        parts, n = f"{s.output}/parts/base", max(0, min(s.length, corpus.row_count(spark, s.corpus_path) - s.start))
        chunks.guarded(spark, parts, chunks.fingerprint(spark, s.corpus_path, s.length, s.chunk_rows))
        counters = []

        def work(rows: DataFrame) -> DataFrame:
            made, seen = _positions(extractor(rows), s, "chunk_id")
            counters.append(seen)
            return made

        made = chunks.run(spark, named, parts, s.chunk_rows, work, "place", n).drop("chunk_id")
        if counters:  # of the documents of this run; one that goes on adds its own
            append_metrics(spark, f"{s.output}/counters", int(time.time()), counters[0].get)
        return made

    base, base_meta = put(extracted, "base", "base", sidecar.DatasetMeta(sidecar.base_id(origin), "base", 0, origin, created_by=__name__))

    if not all(stand(at["split", name]) for name in TRAIN_STAGES):
        whole = f"{s.output}/split"
        if storage.exists(spark, whole):
            storage.delete(spark, whole)
        with phase("split"):
            split = chunks.published(spark, sampling.document_split(base, s.fractions, s.seed), whole, by="split")
        counts = {r["split"]: r["rows"] for r in sampling.split_counts(split).collect()}
        if empty := set(TRAIN_STAGES) - set(counts):
            raise ValueError(f"no documents for {sorted(empty)}")
        for name in TRAIN_STAGES:
            meta = sidecar.replaced(base_meta, dataset_id=sidecar.derived_id(base_meta.dataset_id, "split", name), parent_datasets=[base_meta.dataset_id], row_count=counts[name])
            sidecar.write(spark, at["split", name], meta)

    def explained(rows: DataFrame, name: str) -> DataFrame:
        def answered(asked: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
            parts, numbered = f"{s.output}/parts/explained/{name}", corpus.numbered(asked, "doc_id", "n_raw_tokens")
            n, bound = numbered.count(), getattr(answer, "bound", None)
            chunks.guarded(spark, parts, chunks.fingerprint(spark, at["split", name], n, s.chunk_rows))
            if not n:
                return answer(asked)
            return chunks.run(spark, numbered, parts, s.chunk_rows, lambda rows: answer(rows.drop("row_idx")), n_rows=n, at_once=bound.tasks if bound else None).drop("chunk_id")

        text = rows.withColumn("text", F.col("detokenized_text_truncated"))
        return explanations.explain(text, cache, provider, put=answered).drop("text")

    for stage in TRAIN_STAGES:
        rows, meta = spark.read.parquet(at["split", stage]), sidecar.read(spark, at["split", stage])
        if stage in EXPLAINED:
            known = sidecar.replaced(meta, dataset_id=sidecar.derived_id(meta.dataset_id, "explain"), parent_datasets=[meta.dataset_id], api_summaries={"provider": getattr(provider, "__name__", "provider")})
            rows, meta = put(lambda rows=rows, stage=stage: explained(rows, stage), "explained", stage, known)
        templates = {"actor": s.actor, "critic": s.critic}
        built = sidecar.replaced(sidecar.unbuilt(meta), stage=stage, dataset_id=sidecar.derived_id(meta.dataset_id, "build", stage), parent_datasets=[meta.dataset_id], tokens=s.tokens, prompt_templates=templates)
        done, meta = put(lambda rows=rows, stage=stage: explanations.build(rows, stage, s.actor, s.critic, s.keep_text, s.encode, s.tokens.critic_suffix_ids), "built", stage, built)
        key = sampling.permutation_key(s.seed, meta.dataset_id, F.xxhash64("doc_id", "n_raw_tokens"))
        last = sidecar.replaced(meta, dataset_id=sidecar.derived_id(meta.dataset_id, "shuffle", seed=s.seed), parent_datasets=[meta.dataset_id])
        put(lambda done=done, key=key: done.withColumn("_k", key).orderBy("_k").drop("_k"), "shuffled", stage, last)
    if uploaded:
        for step in ("shuffled", "explained"):
            for name in STEPS[step]:
                uploaded(at[step, name])
                uploaded(sidecar.sidecar_path(at[step, name]))
    if seconds:
        append_metrics(spark, f"{s.output}/phases", int(time.time()), seconds)
    storage.cleared(spark, mark)
    return at


def _positions(extracted: DataFrame, s: Settings, *more: str) -> tuple[DataFrame, Observation]:
    """The base table (and more columns), one row for each sampled position, each with its own text and vector alone; and counters of its documents, which the job that writes it fills."""
    tokens = F.col("tokens") if s.pad is None else sampling.without_padding(F.col("tokens"), F.lit(s.pad))
    eligible, seen = sampling.observed(extracted.withColumn("_eligible", sampling.eligible_positions(tokens)), "_eligible", s.positions_per_doc)
    positions = sampling.sample_positions(F.col("_eligible"), s.positions_per_doc, s.seed, F.col("doc_id"))
    prefix = lambda p: F.lit("") if s.no_text else F.array_join(F.slice("tokens", F.lit(1), p + 1), " ")
    each = F.transform(positions, lambda p: F.struct((p + 1).cast("long").alias("n_raw_tokens"), prefix(p).alias("detokenized_text_truncated"), F.get("vectors", p).alias("activation_vector")))
    rows = eligible.select(F.explode(each).alias("x"), "doc_id", *more)
    return rows.select("x.*", F.lit(s.layer).cast("long").alias("activation_layer"), "doc_id", *more), seen


def begun(spark: SparkSession, out: str, meta: sidecar.DatasetMeta, resume: bool) -> None:
    """Refuses to start over a run that has checkpoints; a resumed run must have the same tokens and origin."""
    snapshot = f"{out}/dataset.meta.yaml"
    if storage.exists(spark, snapshot):
        old = sidecar.loads(storage.read_text(spark, snapshot))
        if not resume:
            raise ValueError(f"{out} holds a run")
        if (old.tokens, old.extraction) != (meta.tokens, meta.extraction):
            raise ValueError("the run was begun with other data")
    else:
        storage.write_text(spark, snapshot, sidecar.dumps(meta))


def console_line(step: int, metrics: dict[str, float]) -> str:
    return f"step {step} | " + " | ".join(f"{k} {v:.4g}" for k, v in metrics.items())


def _put_step(rows: DataFrame, path: str) -> None:
    """rows in place of what the table has of their step; a resumed step doesn't stand twice."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def append_metrics(spark: SparkSession, path: str, step: int, metrics: dict[str, float]) -> None:
    """Puts (step, metric, value) rows into a table."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(float(v)).alias("value")) for k, v in metrics.items()])
    _put_step(spark.range(1).select(F.inline(each), F.lit(step).cast("long").alias("step")), path)


def append_samples(path: str, records: DataFrame, step: int) -> None:
    """Puts an evaluation's records into the table of samples, which grows over a run."""
    _put_step(evaluation.sample_table(records, step), path)
