"""Joins, aggregates, metrics, replays, models and reports."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vakya.functions.lexicons import LABELS
from vakya.operators import dedupe, gatelog, metrics, models, mt_metrics, reports, winners
from vakya.plans.pipeline import analyze


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_first_of_and_fan_out(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), (None, 3, "z"), (None, 4, "w"), ("b", 5, None)], "k string, o int, v string")
    assert rows(dedupe.first_of(df, ["k"], ["o"])) == rows(spark.createDataFrame([("a", 1, "x"), (None, 3, "z"), ("b", 5, None)], df.schema))
    got = dedupe.fan_out(df, ["k"], "o", lambda d: d.withColumn("done", F.concat(F.lit("!"), F.coalesce("v", F.lit("")))))
    assert {r["o"]: (r["done"], r["is_duplicate"]) for r in got.collect()} == {1: ("!x", False), 2: ("!x", True), 3: ("!z", False), 4: ("!z", True), 5: ("!", False)}
    assert dedupe.first_of(df.limit(0), ["k"], ["o"]).count() == 0


def test_marks_and_batches(spark):
    df = spark.createDataFrame([(1, "t", ["s"]), (2, "t", ["s"]), (3, None, []), (4, None, [])], "i int, t string, signals array<string>")
    assert {r["i"]: r["signals"] for r in dedupe.mark_duplicates(df, ["t"], "i").collect()} == {1: ["s"], 2: ["s", "duplicate_post"], 3: [], 4: ["duplicate_post"]}
    b = dedupe.batches(spark.range(20).withColumn("g", F.col("id") % 2), "id", 4, ["g"])
    assert max(Counter((r["g"], r["batch"]) for r in b.collect()).values()) == 4


def test_duplicate_times(spark):
    f = spark.createDataFrame([(1, "a", 10.0), (2, "a", 4.0)], "i int, k string, translation_time_ms double")
    s = spark.createDataFrame([("a", 10.0, 110.5, 2.0, "ok")], "k string, base_ms double, resolved_ms double, sentiment_ms double, result string")
    assert [(r["i"], r["spread_ms"], r["total_ms"]) for r in dedupe.spread_failures(f, s, ["k"]).orderBy("i").collect()] == [(1, 110.5, 112.5), (2, 104.5, 106.5)]


def _labelled(spark, n=400, seed=2):
    r = random.Random(seed)
    data = [(r.choice(LABELS), r.choice(LABELS), [round(r.random(), 1) for _ in range(3)], r.choice(["en", "te"])) for _ in range(n)] + [(None, "Neutral", [0.1, 0.2, 0.3], "en"), ("Odd", "Neutral", [0.1, 0.2, 0.3], "en")]
    return [d for d in data if d[0] in LABELS], spark.createDataFrame(data, "truth string, pred string, probs array<double>, language string")


def test_metrics_match_plain_python(spark):
    data, df = _labelled(spark)
    cells = {(a, b): n for a, b, n in rows(metrics.confusion(df, "truth", "pred"))}
    assert cells == {(a, b): sum(t == a and p == b for t, p, *_ in data) for a in LABELS for b in LABELS}
    f1 = []
    for x in LABELS:
        tp, fp, fn = (sum(c) for c in ((t == p == x for t, p, *_ in data), (p == x != t for t, p, *_ in data), (t == x != p for t, p, *_ in data)))
        f1.append(2 * tp / (2 * tp + fp + fn))
    a = metrics.averages(metrics.per_class(metrics.confusion(df, "truth", "pred"))).first()
    assert math.isclose(a["f1_macro"], sum(f1) / 3) and math.isclose(a["accuracy"], sum(t == p for t, p, *_ in data) / len(data))

    def auc(pos, neg):
        return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)

    want = sum(auc([s[k] for t, _, s, _ in data if t == x], [s[k] for t, _, s, _ in data if t != x]) for k, x in enumerate(LABELS)) / 3
    assert math.isclose(metrics.roc_auc(df, "truth", "probs").first()[0], want)
    flat = [(s[k], t == x) for t, _, s, _ in data for k, x in enumerate(LABELS)]
    assert math.isclose(metrics.micro_auc(df, "truth", "probs").first()[0], auc([s for s, h in flat if h], [s for s, h in flat if not h]))
    curve = rows(metrics.roc_curve(df, "truth", "probs"))
    assert len(curve) == len({s for s, _ in flat})
    for s, fpr, tpr in curve:
        assert math.isclose(tpr, sum(h and v >= s for v, h in flat) / sum(h for _, h in flat)) and math.isclose(fpr, sum(not h and v >= s for v, h in flat) / sum(not h for _, h in flat))


def test_metrics_of_few_classes(spark):
    df = spark.createDataFrame([("Negative", "Negative", [0.9, 0.05, 0.05]), ("Positive", "Neutral", [0.2, 0.2, 0.6])], "truth string, pred string, probs array<double>")
    assert metrics.roc_auc(df, "truth", "probs").first()[0] == 1.0
    assert rows(metrics.roc_auc(df.limit(1), "truth", "probs")) == [(None,)]
    a = metrics.averages(metrics.per_class(metrics.confusion(df, "truth", "pred"))).first()
    assert math.isclose(a["f1_macro"], 1 / 3)
    assert sum(r["n"] for r in metrics.confusion(df.limit(0), "truth", "pred").collect()) == 0


def test_nearest_ranks(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"), F.col("id").cast("double").alias("v"))
    got = {r["g"]: (r["n"], r["p50"], r["p95"]) for r in metrics.nearest_rank(df, "v", ["o"], ["g"]).collect()}
    last = sorted(range(198, 98, -2))
    assert got[0] == (50, last[25], last[46])


def test_bleu_and_chrf(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("a b c d", "a b x d"), (None, "z")], "h string, r string")
    assert math.isclose(mt_metrics.bleu(df.limit(1), "h", "r").first()[0], 100) and math.isclose(mt_metrics.chrf(df.limit(1), "h", "r").first()[0], 100)
    # By hand: the first row matches all of its 6, 5, 4, 3 n-grams, the second 3 of 4, 1 of 3, 0 of 2, 0 of 1.
    got = mt_metrics.bleu(df.limit(2), "h", "r").first()[0]
    assert math.isclose(got, 100 * math.exp(sum(map(math.log, (9 / 10, 6 / 8, 4 / 6, 3 / 4))) / 4))
    assert mt_metrics.bleu(df.where("h is null"), "h", "r").first()[0] == 0.0
    t = spark.createDataFrame([("Hello, world! It's 3.5 or 4-5.",)], "x string").select(mt_metrics.tokens_13a("x")).first()[0]
    assert t == "Hello , world ! It's 3.5 or 4 - 5 ."


def test_winners(spark):
    df = spark.createDataFrame([("A one", 0.80004, 0.7, 9.0, None), ("B two", 0.80001, 0.7, 5.0, 1.0)], "model string, f1_macro double, accuracy double, avg_time_ms double, comet double")
    assert winners.winner(df, "model").first()["model"] == "B two"
    a, b = df.orderBy("model").collect()
    assert winners.trail(a, b, "model")[-1] == "Inference time: A one 9.0 vs B two 5.0 -> B two wins" and winners.trail(a, b, "model", winners.TRANSLATION[:1])[0].startswith("COMET: unavailable")
    same = df.withColumn("avg_time_ms", F.lit(1.0))
    assert winners.winner(same, "model").first()["model"] == "A one"


def test_gate_replay():
    bad = [(float(i), i + 0.5, True) for i in range(8)]
    d, s = gatelog._replay([*bad, (9.0, 9.1, False), (38.0, 38.4, True), (38.1, 38.2, False), (39.0, 39.1, False), (40.0, 40.1, False)], 2, 8, 30.0)
    assert d == ["admitted"] * 8 + ["open", "probe", "open", "probe", "admitted"]
    d, _ = gatelog._replay([(0.0, 5.0, False), (1.0, 5.0, False), (2.0, 3.0, False), (5.0, 6.0, False)], 2, 8, 30.0)
    assert d == ["admitted", "admitted", "full", "admitted"]


def test_gate_operators(spark):
    data = [(k, i, float(i), i + 1.5, i % 10 != 9) for k in (1, 2) for i in range(40)]
    df = spark.createDataFrame(data, "k int, i int, a double, b double, bad boolean")
    runs = {(r["k"], r["i"]): r["run"] for r in gatelog.failure_runs(df, ["k"], ["a"], "bad").collect()}
    assert runs[1, 8] == 9 and runs[1, 9] == 0 and runs[2, 10] == 1
    got = gatelog.replay(df, "k", "a", "b", "bad").where("k = 1").orderBy("i").collect()
    assert [r["decision"] for r in got] == gatelog._replay([d[2:] for d in data if d[0] == 1], 2, 8, 30.0)[0]
    load = {(r["k"], r["i"]): r["open_calls"] for r in gatelog.overlap_bound(df, ["k"], "a", "b").collect()}
    assert load[1, 0] == 0 and load[1, 5] == 1


def fails(texts, lang):
    if any("boom" in t for t in texts):
        raise ValueError("boom")
    return [f"{lang} text of {len(t)}" for t in texts]


def fatal(texts, lang):
    raise TypeError("a bug")


def second(texts, lang):
    return ["a second translation" for _ in texts]


def test_failures_are_isolated_and_bugs_are_not():
    assert models.isolated(fails, ["a", "boom", "c"], "te") == [("te text of 1", None), (None, "ValueError"), ("te text of 1", None)]
    with pytest.raises(TypeError):
        models.isolated(fatal, ["a"], "te")


def test_translation_cascade(spark):
    df = spark.createDataFrame([(1, "hello", "en"), (2, "నమస్తే", "te"), (3, "boom", "te"), (4, "నమస్తే", "te"), (5, "bonjour", "fr"), (6, None, "te"), (7, "కాష్", "te")], "i int, x string, lang string")
    cache = spark.createDataFrame([("te", "కాష్", "cached words")], "lang string, text string, english_text string")
    got = {r["i"]: (r["translation_backend"], r["english_text"], r["failure"]) for r in models.translated(df, "x", "lang", lambda: fails, lambda: second, cache).collect()}
    assert got == {1: ("bypass", "hello", None), 2: ("primary", "te text of 6", None), 3: ("secondary", "a second translation", None), 4: ("primary", "te text of 6", None), 5: ("passthrough", "bonjour", None), 6: (None, None, None), 7: ("cache", "cached words", None)}
    alone = {r["i"]: r["failure"] for r in models.translated(df, "x", "lang", lambda: fails).collect()}
    assert alone[3] == "ValueError" and alone[2] is None


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("A one", "te", 0.5), ("B two", "te", 0.4), ("A one", "hi", 0.1)], "model string, language string, f1 double")
    p = reports.pivoted(df, "language", "model", "f1", ["A one", "B two"], 0.0)
    assert rows(p) == [("hi", 0.1, 0.0), ("te", 0.5, 0.4)]
    assert rows(reports.better_rows(df, "language", "model", "f1", "A one", "B two")) == [("te",)]
    assert reports.side_by_side(df, "language", "model", ["A one", "B two"], {"f1": "score"}).columns == ["language", "A_score", "B_score"]
    assert reports.summary_markdown("T", {"x": df.orderBy("model", "language")}).startswith("# T\n\n## x\n\n| model | language | f1 |\n| --- | --- | --- |")
    reports.write_csv_with_bom(df, str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfmodel,")
    reports.write_csv(df, str(tmp_path / "out"), by=["model"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    assert reports.json_rows(df.limit(1)).first()[0] == '{"model":"A one","language":"te","f1":0.5}'


def test_whole_analysis_leaves_the_jvm_for_cleaning_and_scripts_only(spark):
    df = spark.createDataFrame([(1, "this is good work"), (2, "not good at all"), (3, None), (4, "🙏"), (5, "నమస్తే అందరికీ")], "id int, post_text string")
    a = analyze(df)
    got = {r["id"]: (r["language"], r["sentiment"], r["contentless"]) for r in a.collect()}
    assert got == {1: ("en", "Positive", None), 2: ("en", "Negative", None), 4: ("unknown", "Neutral", "no text"), 5: ("te", "Neutral", None)}
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 6 and "MapInPandas" not in plan
