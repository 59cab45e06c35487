"""Evaluation: variance explained, reconstruction, judge tasks and their summary."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.functions.columns import let
from tessera.sources import corpus, storage


def baselines(rows: DataFrame, vector: str, scale: float) -> DataFrame:
    """Errors of predicting the mean (``raw_baseline``) and the mean at full norm (``meannorm_baseline``); null without rows.

    Whole vectors are summed up (by MLlib's summarizer), so each task gives two vectors to one row's merge, whatever its rows.
    """
    summed = Summarizer.metrics("mean", "normL2", "count").summary(array_to_vector(V.normalize(F.col(vector), scale)))
    found = rows.filter(F.col(vector).isNotNull()).groupBy(F.lit(1).alias("all")).agg(summed.alias("s"))
    squares = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x * x)
    sums = found.select(F.size(vector_to_array("s.mean")).alias("d"), (squares("s.normL2") / F.col("s.count")).alias("sq"), squares("s.mean").alias("mm"))
    sums = sums.agg(*[F.max(c).alias(c) for c in ("d", "sq", "mm")])
    length = F.greatest(F.sqrt("mm"), F.lit(V.TINY))
    return sums.select(
        ((F.col("sq") - F.col("mm")) / F.col("d")).alias("raw_baseline"),
        ((F.col("sq") - 2 * F.lit(scale) * F.col("mm") / length + F.col("mm") * F.pow(F.lit(scale) / length, F.lit(2))) / F.col("d")).alias("meannorm_baseline"),
    )


def variance_explained(mse: Column, baseline: Column) -> Column:
    return 1 - mse / baseline


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """rows: reward (filled). A row is valid if its reward is over -2; the mean takes all rows."""
    valid = F.col("reward") > -2.0
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(valid).alias("n_valid"),
        F.avg("reward").alias("reward_mean"),
        F.avg(F.when(valid, -F.col("reward"))).alias("mse_valid"),
    )


def variance_explained_by(rows: DataFrame, mse: str, baseline: float, *by: str) -> DataFrame:
    """(by, n_scored, mse_mean, fve_pct) of the rows with an error; the others didn't give one and don't count."""
    mean = F.avg(mse)
    return rows.groupBy(*by).agg(F.count(mse).alias("n_scored"), mean.alias("mse_mean"), (100 * variance_explained(mean, F.lit(baseline))).alias("fve_pct"))


def baselines_of_first(rows: DataFrame, vector: str, scale: float, n: int, order: str = "row_idx") -> DataFrame:
    """baselines() of the first n rows, as trainers take them."""
    return baselines(corpus.first_kept(rows, n, order=order).select(vector), vector, scale)


#: Dimensions that a judge rates from 1 to 10 (fixed names), each with what it asks for.
RUBRIC = {
    "unique_info": "how much distinct, specific information it gives; repeated or general statements add nothing",
    "coherence": "how well its parts read and fit together, whether or not they are true",
    "writing_quality": "how clean and fluent the writing is, whatever it says",
    "specificity": "how few texts it could be about, judged by itself",
    "repetitiveness": "how much it repeats words, phrases or points (10: all the time)",
}
MATCH, OPTIONS, SNIPPET, JUDGED = "source_match", 4, 700, 6000
_RATE = "Rate this explanation of what a language model held in mind while it read a text, from 1 to 10, for {what}.\nAnswer with the number alone.\n\nEXPLANATION:\n{text}"
_CHOOSE = "This explanation was made while a language model read the end of one of {k} texts. Which one?\nAnswer with its letter alone.\n\nEXPLANATION:\n{text}\n\n{options}"


def _drawn(seed: int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def _apart(a: Column, b: Column) -> Column:
    """Neither text begins with the other: prefixes of one document are the same answer twice."""
    return ~(a.startswith(b) | b.startswith(a))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _sketch(text: Column) -> Column:
    """(n, digest, heads): the length, and hashes of the whole text and of its beginnings of 1, 2, 4, ... characters."""
    lengths = F.array(*[F.lit(1 << p) for p in range(31)])
    heads = let(F.length(text), lambda n: F.transform(F.filter(lengths, lambda m: m <= n), lambda m: F.hash(F.left(text, m))))
    return F.struct(F.length(text).alias("n"), _digest(text).alias("digest"), heads.alias("heads"))


def _apart_by_sketch(a: Column, b: Column) -> Column:
    """What two sketches say about ``_apart``: true, false, or null where the texts themselves must tell."""
    both = F.least(F.size(a["heads"]), F.size(b["heads"]))
    differ = F.slice(a["heads"], F.lit(1), both) != F.slice(b["heads"], F.lit(1), both)
    return F.when(a["n"] == b["n"], a["digest"] != b["digest"]).when(differ, True)


#: A text that this share of the sources, or more, have is common; there are at most so many times fewer of them.
COMMON = 8


def distractors(sources: DataFrame, k: int = OPTIONS, seed: int = 0) -> DataFrame:
    """(i, j, r): for each source (i, text) its k - 1 distractors, r = 1, 2, ..., if the set has as many.

    With a column ``asked``, only sources where it is true get distractors; the others are still distractors themselves.

    Sources stand on a ring in hash order. Each starts at a place drawn by hash and takes the next ones that don't begin with
    its text, nor it with theirs. It looks through a stretch of the ring that should hold twice as many as it needs; those
    that found too few look through one four times as long.

    No text goes round: sources meet by sketches, which tell most of them apart. Of the others the longer text is looked up
    where it stands, and its beginning must have another SHA-256 than the shorter one.

    Where most sources have one text, each of these would go far round the ring for the few others. So a text that an
    eighth of the sources or more have (there are eight at most) gets a ring of its own, of what fits it alone, and
    stretches by the number of those; with fewer than k - 1 of them it has no distractors. i must be unique.
    """
    spark = sources.sparkSession
    fit = sources.filter("text <> ''")
    wanted = F.coalesce("asked", F.lit(False)) if "asked" in sources.columns else F.lit(True)
    sketched = fit.select("i", wanted.alias("asked"), _sketch(F.col("text")).alias("sketch"), _drawn(seed, F.lit("ring"), F.col("i")).alias("h"))
    ring = storage.kept(corpus.numbered(sketched, "h", "i", out="place").drop("h"), "ring")
    n = ring.count()
    if not n:
        return spark.createDataFrame([], sources.select("i").schema.add("j", sources.schema["i"].dataType).add("r", "integer"))
    start = F.conv(F.left(_drawn(seed, F.lit("start"), F.col("i")), F.lit(8)), 16, 10).cast("long") % n
    by_text = ring.groupBy(F.col("sketch.digest").alias("digest")).agg(F.count("*").alias("c"), F.min("place").alias("own")).filter(F.col("c") * COMMON >= n)
    common = storage.kept(by_text.select("digest", (F.col("own") + 1).alias("ring")), "common")
    other = ring.select(F.col("i").alias("j"), "place", F.col("sketch").alias("other"), F.lit(0).cast("long").alias("ring"))
    if not common.isEmpty():
        # Eight texts at most, as one value, which is held against each text where that stands.
        firsts = ring.join(F.broadcast(common), F.col("place") + 1 == F.col("ring")).select("i", "ring")
        texts = fit.join(F.broadcast(firsts), "i").select("ring", "text")
        held = fit.select(F.col("i").alias("j"), "text", texts.agg(F.collect_list(F.struct("ring", "text"))).scalar().alias("common"))
        rings = F.transform(F.filter("common", lambda c: _apart(c["text"], F.col("text"))), lambda c: c["ring"])
        own = other.drop("ring", "other").join(held.select("j", F.explode(rings).alias("ring")), "j")
        other = other.unionByName(own, allowMissingColumns=True)
    other = storage.kept(other, "rings")
    sizes = {r["ring"]: r["count"] for r in other.groupBy("ring").count().collect()}  # nine rows at most
    asked = ring.filter("asked").withColumn("digest", F.col("sketch.digest")).join(F.broadcast(common), "digest", "left").select("i", F.coalesce("ring", F.lit(0)).alias("ring"), "sketch", start.alias("start"))
    asked = asked.filter(F.col("ring").isin([r for r, c in sizes.items() if r == 0 or c >= k - 1]))
    found, factor = None, 2
    while True:
        width = {r: min(n, max(1, -(-factor * k * n // c))) for r, c in sizes.items()}
        of_ring = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in width.items() for x in pair]), F.col("ring"))
        stretch = F.floor(F.col("place") / of_ring)
        last = F.floor(F.lit(n - 1) / of_ring)
        # The stretch where a source starts, and the next two (the last may be short), cover its own length from there on.
        nexts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda d: (F.floor(F.col("start") / of_ring) + d) % (last + 1)))
        met = asked.withColumn("stretch", F.explode(nexts)).join(other.withColumn("stretch", stretch), ["ring", "stretch"])
        distance = F.pmod(F.col("place") - F.col("start"), F.lit(n))
        near = met.filter((F.col("i") != F.col("j")) & (distance < of_ring)).withColumn("d", distance)
        picked = _pairs_apart(near, fit).groupBy("i").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "j"))), 1, k - 1).alias("x")).filter(F.size("x") == k - 1)
        picked = storage.kept(picked, "distractors")
        found = picked if found is None else found.unionByName(picked)
        asked, factor = storage.kept(asked.join(picked.select("i"), "i", "left_anti"), "asked"), 4 * factor
        if min(width.values()) == n or asked.isEmpty():
            return found.select("i", F.posexplode("x").alias("r", "x")).select("i", F.col("x.j").alias("j"), (F.col("r") + 1).alias("r"))


def _pairs_apart(near: DataFrame, texts: DataFrame) -> DataFrame:
    """(i, j, d) of the pairs whose texts are apart. near: (i, sketch, j, other, ring, d); on rings of their own (not 0) all are."""
    apart = F.when(F.col("ring") != 0, True).otherwise(_apart_by_sketch(F.col("sketch"), F.col("other")))
    of_j = F.col("sketch.n") < F.col("other.n")
    less = F.when(of_j, F.col("sketch")).otherwise(F.col("other"))
    doubt = F.struct(F.when(of_j, F.col("j")).otherwise(F.col("i")).alias("longer"), less["n"].alias("n"), less["digest"].alias("digest"))
    told = near.select("i", "j", "d", apart.alias("apart"), doubt.alias("doubt")).filter("apart IS DISTINCT FROM false")
    told = storage.kept(told.select("i", "j", "d", F.when(F.col("apart").isNull(), F.col("doubt")).alias("doubt")), "near")
    sure, doubts = told.filter("doubt IS NULL").drop("doubt"), told.filter("doubt IS NOT NULL").select("i", "j", "d", "doubt.*")
    if doubts.isEmpty():
        return sure
    # A table of its own, so that Spark sees how small it is; where it is, it is sent to the texts and these stay.
    looked = storage.kept(doubts, "doubts").join(texts.select(F.col("i").alias("longer"), "text"), "longer")
    return sure.unionByName(looked.filter(_digest(F.left("text", F.col("n"))) != F.col("digest")).select("i", "j", "d"))


def match_options(sources: DataFrame, k: int = OPTIONS, seed: int = 0, snippet: int = SNIPPET) -> DataFrame:
    """(i, true_pos, options): the ends of a source and of its distractors, in an order drawn by hash, and the true one's place. Sources as for distractors()."""
    ends = sources.filter("text <> ''").select(F.col("i").alias("j"), T.tail_snippet(F.col("text"), snippet).alias("t"))
    wrong = distractors(sources, k, seed)
    pairs = wrong.select("i", "j").unionByName(wrong.filter("r = 1").select("i", F.col("i").alias("j")))
    shown = pairs.join(ends, "j")
    slots = F.sort_array(F.collect_list(F.struct(_drawn(seed, F.lit("slot"), F.col("i"), F.col("j")).alias("h"), "j", "t")))
    made = shown.groupBy("i").agg(slots.alias("slots"))
    return made.select("i", (F.array_position(F.transform("slots", lambda s: s["j"]), F.col("i")) - 1).cast("int").alias("true_pos"), F.transform("slots", lambda s: s["t"]).alias("options"))


def match_options_python(sources: list[str], i: int, seed: int, k: int = OPTIONS, snippet: int = SNIPPET) -> tuple[list[str], int] | None:
    """The task of one row by NumPy's generator, keyed by seed and row, for evaluation sets that fit on the driver; None without enough distractors."""
    import numpy as np

    own = sources[i]
    fit = [j for j, s in enumerate(sources) if own and s and j != i and not s.startswith(own) and not own.startswith(s)]
    if len(fit) < k - 1:
        return None
    rng = np.random.default_rng((seed, i))
    members = [i, *rng.choice(fit, size=k - 1, replace=False).tolist()]
    slot_of = rng.permutation(k).tolist()
    shown = {slot: sources[j] for slot, j in zip(slot_of, members, strict=True)}
    return [s if len(s) <= snippet else f"... {s[-snippet:]}" for _, s in sorted(shown.items())], slot_of[0]


def _explained(limit: int) -> Column:
    return F.left(T.strip(F.col("explanation")), F.lit(limit))


def judge_jobs(rows: DataFrame, k: int = OPTIONS, seed: int = 0, limit: int = JUDGED) -> DataFrame:
    """(i, dim, true_pos, prompt): the rubric's tasks of each row (i, explanation, source) with an explanation, and its match, if it has enough distractors."""
    kept = rows.withColumn("explanation", F.nullif(_explained(limit), F.lit(""))).filter(F.col("explanation").isNotNull())
    asks = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(_RATE.replace("{what}", what)).alias("template")) for d, what in RUBRIC.items()]))
    rated = kept.select("i", asks.alias("a"), "explanation").select("i", F.col("a.dim").alias("dim"), F.lit(None).cast("int").alias("true_pos"), F.replace("a.template", F.lit("{text}"), F.col("explanation")).alias("prompt"))
    # Rows without an explanation have no task, but their sources are distractors.
    told = F.coalesce(F.length(_explained(limit)) > 0, F.lit(False))
    tasks = match_options(rows.select("i", F.coalesce("source", F.lit("")).alias("text"), told.alias("asked")), k, seed)
    lines = F.array_join(F.transform("options", lambda o, p: F.concat(F.lit("SOURCE "), F.substring(F.lit(T.LETTERS), p + 1, F.lit(1)), F.lit(":\n"), o)), "\n\n")
    # The options go in first, so that an explanation that says {options} stays what it is.
    filled = F.concat(F.lit(_CHOOSE.replace("{k}", str(k)).split("{text}")[0]), F.col("explanation"), F.lit("\n\n"), lines)
    return rated.unionByName(kept.join(tasks, "i").select("i", F.lit(MATCH).alias("dim"), "true_pos", filled.alias("prompt")))


def judge_scores(answers: DataFrame, k: int = OPTIONS) -> DataFrame:
    """(i, dim, score, hit) of answered tasks (i, dim, true_pos, answer); what can't be read, or has no answer, is null."""
    match, letter = F.col("dim") == MATCH, T.parse_letter(F.col("answer"), k)
    return answers.select("i", "dim", F.when(~match, T.parse_score(F.col("answer"))).alias("score"), F.when(match, (letter == F.col("true_pos")).cast("int")).alias("hit"))


def shown(records: DataFrame, at: tuple[int, ...] = (0, 7, 14), order: str = "idx") -> DataFrame:
    """The records at fixed places, to see how outputs change between evaluations."""
    return records.filter(F.col(order).isin(*at))


def sample_table(records: DataFrame, step: int, chars: int = 500) -> DataFrame:
    """Rows (step, idx, reward, fve, extracted, explanation) for the table of samples that a run keeps."""
    return records.select(F.lit(step).cast("long").alias("step"), "idx", "reward", "fve", "extracted", F.left("explanation", F.lit(chars)).alias("explanation"))


def by_request(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """requests with the text of their answer by (batch, idx); null where it is missing or failed."""
    good = answers.select("batch", "idx", F.when(F.col("status") == "succeeded", F.col("text")).alias("text"))
    return requests.join(good, ["batch", "idx"], "left")


def judge_summary(scores: DataFrame) -> DataFrame:
    """scores: (i, dim, score, hit): one row per task; a null score or hit failed. Means of nothing are NaN."""
    match = F.col("dim") == MATCH
    mean = lambda x: F.coalesce(F.avg(x), F.lit(float("nan")))
    return scores.agg(
        *[mean(F.when(F.col("dim") == d, F.col("score"))).alias(f"{d}_mean") for d in RUBRIC],
        mean(F.when(match, F.col("hit"))).alias("source_match_acc"),
        mean(F.when(match, F.col("hit").isNotNull().cast("double"))).alias("match_answer_rate"),
        mean(F.when(match, F.col("hit").isNull()).otherwise(F.col("score").isNull()).cast("double")).alias("judge_fail_rate"),
        F.count_distinct("i").alias("n_judged"),
    )
