"""Fixed cases of scalar functions, and properties of the vector ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import training as R
from tessera.functions import vectors as V
from tessera.operators import evaluation, rollouts


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_extract_explanation(spark):
    said = ["x <explanation>hello</explanation> y", "<explanation>\n hi\n </explanation>", "<explanation>a</explanation><explanation>b</explanation>", "<explanation></explanation>", "<explanation>open", "none", None]
    assert values(spark, said, T.extract_explanation) == ["hello", "hi", "a", "", None, None, None]


def test_clean_explanation(spark):
    said = [
        "<analysis>\n- **Head:** text*\n\n2) more\n  iv. last _x_\n</analysis>",
        "<analysis>one</analysis>",
        "<analysis></analysis>",
        "<analysis>cut",
    ]
    assert values(spark, said, T.clean_explanation) == ["Head: text\n\nmore\n\nlast _x", "one", "", None]
    assert values(spark, ["a\n\nb", "a"], T.n_features) == [2, 1]


def test_parsing(spark):
    assert values(spark, ["7", " 10 ", "Score: 3.", "ten", "", None], T.parse_score) == [7, 10, 3, None, None, None]
    assert values(spark, ["B", " c ", "Answer: D", "E", "", None], lambda x: T.parse_letter(x, 4)) == [1, 2, 3, None, None, None]


def test_text_shapes(spark):
    assert values(spark, ["hello world", "漢字", "", "㊗、あ"], T.cjk_fraction) == [0, 1, 0, 0]
    assert values(spark, ["a" * 701, "b" * 700], T.tail_snippet) == ["... " + "a" * 700, "b" * 700]
    assert values(spark, ["x"], T.wrap_explanation) == ["<explanation>\nx\n</explanation>"]
    assert values(spark, ["a{b}"], lambda x: T.fill_template("<{explanation}>", "{explanation}", x)) == ["<a{b}>"]
    got = values(spark, ["p@[1:5]", "p@[:7]", "p", "a@b"], T.slice_suffix)
    assert [tuple(x) for x in got] == [("p", 1, 5), ("p", None, 7), ("p", None, None), ("a@b", None, None)]


def test_scales():
    assert V.resolve_scale(None, 4096) is None and V.resolve_scale("raw", 4096) is None
    assert V.resolve_scale("sqrt_d_model", 4096) == 64 and V.resolve_scale("3.5", 4) == 3.5


def test_normalize(spark):
    got = values(spark, [[3.0, 4.0], [0.0, 0.0]], lambda x: V.normalize(x, 10.0), "array<float>")
    assert got == [[6.0, 8.0], [0.0, 0.0]]
    assert values(spark, [[3.0, 4.0]], lambda x: V.normalize(x, None), "array<float>") == [[3.0, 4.0]]


def test_baselines_agree_with_numpy_and_with_the_identities(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 32)) * 3 + 1
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    s = math.sqrt(32)
    raw, mean_norm = evaluation.baselines(df, "v", s).first()
    n = x / np.linalg.norm(x, axis=1, keepdims=True) * s
    mu = n.mean(axis=0)
    assert raw == pytest.approx(((n - mu) ** 2).mean())
    assert mean_norm == pytest.approx(((n - mu / np.linalg.norm(mu) * s) ** 2).mean())
    r = np.linalg.norm(mu) / s
    assert raw == pytest.approx(1 - r * r) and mean_norm == pytest.approx(2 * (1 - r))


def test_rewards(spark):
    df = spark.createDataFrame([(0.5, False), (float("nan"), False), (0.1, True), (float("inf"), False)], "m double, t boolean")
    got = [tuple(r) for r in df.select(R.reward(F.col("m"), F.col("t")), R.filled_reward(R.reward(F.col("m"), F.col("t"))), R.filled_reward(R.reward(F.col("m"), F.col("t")), True)).collect()]
    assert [x[:2] for x in got] == [(-0.5, -0.5), (None, -2.0), (None, -2.0), (None, -2.0)]
    assert got[0][2] == pytest.approx(math.log(2)) and got[1][2] == pytest.approx(-math.log(2))
    assert R.penalty_threshold(50) == 1 and R.penalty_threshold(200) == 136
    assert R.kl_weight(None, "dist") == 0.2 and R.kl_weight(0.5, "k3") == 0.5


def test_k3_and_permille(spark):
    assert values(spark, [-1.0], lambda x: R.k3(x, x), "double") == [0.0]
    df = spark.createDataFrame([(1, 2000), (3, 2000), (5, 2000), (0, 10), (9, 10)], "v long, n long")
    assert [r[0] for r in df.select(R.holdout_permille(F.col("v"), F.col("n"))).collect()] == [1, 2, 2, 1, 500]


def test_markers(spark):
    rows = [[1, 2, 41, 42, 43, 5], [42, 41, 43, 5, 6, 7], [1, 2, 9, 42, 43, 5], [41, 42, 43, 41, 42, 43], [41, 42, 43, 42, 1]]
    assert values(spark, rows, lambda x: rollouts.marker_well_formed(x, 42, 41, 43), "array<int>") == [True, False, False, False, False]
    assert values(spark, rows, lambda x: rollouts.valid_markers(x, 42, 41, 43), "array<int>") == [[3], [], [], [1, 4], [1]]
    assert values(spark, [[1, 9, 2, 8], [1, 2]], lambda x: rollouts.trimmed_at_stop(x, [8, 9]), "array<int>") == [[1, 9], [1, 2]]


def test_advantage_of_one_row_and_of_masked_rows(spark):
    df = spark.createDataFrame([(1, 3.0, True), (2, 1.0, True), (2, 3.0, True), (2, 9.0, False)], "g int, r double, ok boolean")
    got = sorted((r["g"], r["r"], round(r["advantage"], 4)) for r in rollouts.group_advantage(df, "g", "r", "ok").collect())
    assert got == [(1, 3.0, 0.0), (2, 1.0, -0.7071), (2, 3.0, 0.7071), (2, 9.0, 0.0)]


def test_lines_are_cleaned_as_the_patterns_alone_would(spark):
    """The cheap tests before the patterns change nothing, and trimming by a list is what the pattern for white space does."""
    rng = np.random.default_rng(8)
    parts = ["-", "*", "•", "–", "1.", "12)", "(3)", "a.", "B)", "(c)", "iv.", "XI)", "x", "i", "**", "**bold**", "word", "_", " ", "\t", "\u00a0", "\u2003", "\u3000", "\u0661.", "é.", "z)", "~", "{", "\u180e", "\u200b"]
    lines = ["".join(rng.choice(parts, size=rng.integers(0, 7))) for _ in range(4000)]
    marked = F.regexp_replace(F.regexp_replace("x", T._MARKER, ""), T._BOLD, "$1 ")
    plain = F.regexp_replace(F.regexp_replace(marked, r"(?U)^\s+|\s+\z", ""), r"^[*_]+|[*_]+\z", "")
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    made = df.select("x", plain.alias("want"), T.clean_explanation(F.concat(F.lit("<analysis>|\n"), "x", F.lit("\n|</analysis>"))).alias("got"), F.regexp_replace("x", r"(?U)^\s+|\s+\z", "").alias("bare"), T.strip(F.col("x")).alias("stripped"))
    for r in made.collect():
        assert r["got"] == "\n\n".join(["|", *([r["want"]] if r["want"] else []), "|"]) and r["bare"] == r["stripped"], r


def test_divergences_of_whole_arrays(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(6, 40)) * 2, rng.normal(size=(6, 40)) * 2
    a[5] = np.round(a[5])  # ties, of which the first count
    a[4], b[4] = a[4] + 900, b[4] - 900  # nothing overflows
    rows = [(t, a[t].tolist(), b[t].tolist()) for t in range(6)] + [(6, None, [1.0]), (7, [], []), (8, [1.0], [1.0, 2.0]), (9, [3.0], [-7.0]), (10, [1.0, 2.0], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "token int, x array<double>, y array<double>").repartition(3)
    x, y = F.col("x"), F.col("y")
    made = df.select("token", rollouts.divergence(x, y).alias("full"), *[rollouts.coarsened_divergence(x, y, k).alias(f"k{k}") for k in (1, 8, 40, 99)])
    got = {r["token"]: r for r in made.collect()}
    for t in range(6):
        p, q = (np.exp(v - v.max()) / np.exp(v - v.max()).sum() for v in (a[t], b[t]))
        full = (p * np.log(p / q)).sum()
        assert got[t]["full"]["kl"] == pytest.approx(full, rel=1e-9) and got[t]["full"]["entropy"] == pytest.approx(-(p * np.log(p)).sum(), rel=1e-9)
        for k in (1, 8, 40, 99):
            best = sorted(range(40), key=lambda i: (-a[t][i], i))[:k]
            tp, tq = (max(1e-9, 1 - v[best].sum()) for v in (p, q))
            assert got[t][f"k{k}"] == pytest.approx((p[best] * np.log(p[best] / q[best])).sum() + tp * np.log(tp / tq), abs=1e-6)
            assert -1e-6 <= got[t][f"k{k}"] <= full + 1e-6
    assert all(got[t]["k8"] is None and got[t]["full"]["kl"] is None for t in (6, 7, 8))
    assert got[9]["full"] == (0, 0) and got[10]["k1"] == pytest.approx(0)
    assert "Generate" not in made._jdf.queryExecution().toString() and "Window" not in made._jdf.queryExecution().toString()


def test_baselines_of_wide_vectors(spark):
    from tessera.operators import evaluation

    x = np.random.default_rng(4).normal(size=(200, 32)) * 3 + 1
    rows = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>").repartition(5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True) * 4
    mean = unit.mean(axis=0)
    got = evaluation.baselines(rows, "v", 4.0).first()
    assert got["raw_baseline"] == pytest.approx(((unit - mean) ** 2).mean()) and got["meannorm_baseline"] == pytest.approx(((unit - mean * 4 / np.linalg.norm(mean)) ** 2).mean())
    assert list(evaluation.baselines(rows.limit(0), "v", 4.0).first()) == [None, None]


def test_schedule(spark):
    got = values(spark, [0, 5, 10, 50, 90, 200], lambda x: R.learning_rate(x, 1.0, 10, 90, 0.1), "int")
    assert got == pytest.approx([0, 0.5, 1.0, 0.55, 0.1, 0.1])
