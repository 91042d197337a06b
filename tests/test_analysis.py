"""The whole analysis with models: each runs once a text, romanised posts are refined and spelled, failures are resolved or told."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vakya.functions import annotate, intel, policy, requests
from vakya.operators import dedupe, gatelog, models
from vakya.plans import pipeline
from vakya.sources import io


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def counting(path, results):
    """A model that notes each text it's given."""

    def make():
        def call(texts, lang):
            with open(path, "a") as f:
                f.writelines(json.dumps(t) + "\n" for t in texts)
            return [results(t, lang) for t in texts]

        return call

    return make


def noted(path):
    return [json.loads(x) for x in open(path)]


def test_each_model_sees_a_text_once(spark, tmp_path):
    posts = spark.createDataFrame([(i, f"రోడ్డు {i % 100}") for i in range(200)], "id bigint, x string").withColumn("lang", F.lit("te"))
    first, second = tmp_path / "first", tmp_path / "second"
    out = models.translated(posts, "x", "lang", counting(first, lambda t, _: "" if t.endswith("7") else "the road " + t.split()[1]), counting(second, lambda t, _: " a second text "))
    got = by_id(out)
    assert len(noted(first)) == len({*noted(first)}) == 100 and len(noted(second)) == 10
    assert got[107]["english_text"] == "a second text" and got[107]["translation_backend"] == "secondary" and got[8]["english_text"] == "the road 8"
    assert all(r["translation_time_ms"] >= 0 for r in got.values())


def test_romanised_posts_are_refined_and_spelled(spark):
    posts = spark.createDataFrame([(1, "nenu chala road meeda unna!"), (2, "the road is bad"), (3, "ಈ ರಸ್ತೆ ಸರಿ ಇಲ್ಲ"), (4, "nenu boom chala")], "id bigint, post_text string")
    seen = []

    def make():
        def call(texts, lang):
            if any("b o m" in t for t in texts):
                raise ValueError("no spelling")
            assert all(t.startswith("__te__ ") for t in texts), texts
            return [f"< {t.split()[-1]} >" for t in texts]

        return call

    got = by_id(pipeline.analyze(posts, speller=make))
    assert [got[i]["language"] for i in (1, 2, 3, 4)] == ["te", "en", "kn", "te"] and not seen
    assert got[1]["was_transliterated"] and got[1]["transliterated_text"] == "నేను చాలా <d> <a> <a>!"
    assert not got[2]["was_transliterated"] and got[2]["transliterated_text"] == ""
    assert not got[4]["was_transliterated"] and got[4]["english_text"] == "nenu boom chala"  # a failed word leaves the text as it was
    plain = by_id(pipeline.analyze(posts))
    assert plain[1]["transliterated_text"].startswith("నేను చాలా road")


def test_failed_posts_are_resolved_or_say_why(spark, tmp_path):
    posts = spark.createDataFrame([(1, "రోడ్డు బాగా లేదు"), (2, "రోడ్డు బాగా లేదు"), (3, "నీళ్లు రావు"), (4, "good work")], "id bigint, post_text string")
    asked = tmp_path / "asked"

    def fail():
        def call(texts, lang):
            raise RuntimeError("no model")

        return call

    reply = lambda t, _: json.dumps({"english_text": "The road is damaged", "sentiment": "Negative", "confidence": 0.87654}) if "రోడ్డు" in t else "no"
    got = by_id(pipeline.analyze(posts, primary=fail, fallback=counting(asked, reply)))
    assert len(noted(asked)) == 2  # equal posts are asked about once
    for i in (1, 2):
        r = got[i]
        assert (r["english_text"], r["sentiment"], r["confidence"], r["translation_backend"], r["fallback_reason"], r["was_translated"]) == ("The road is damaged", "Negative", 0.8765, "ollama_fallback", "RuntimeError", True)
        assert r["review_recommended"] and "ollama_pipeline_fallback" in r["signals"] and r["total_time_ms"] == r["translation_time_ms"] and r["failure"] is None
    assert got[3]["failure"] == "no object" and got[3]["sentiment"] is None and got[4]["sentiment"] == "Positive"
    with pytest.raises(Exception, match="the pipeline failed for a post"):
        annotate.strict(pipeline.analyze(posts, primary=fail), "failure").collect()
    assert annotate.strict(pipeline.analyze(posts), "failure").count() == 4


def test_judgements(spark, tmp_path):
    asked = tmp_path / "asked"
    data = [(k, "a post about roads", "a post about roads", "Neutral", "en") for k in (1, 2)] + [(3, "  ", "", "Neutral", "en"), (4, "boom", "boom", "Neutral", "en"), (5, "odd", "odd", "Neutral", "en")]
    df = spark.createDataFrame(data, "result_id bigint, post_text string, english_text string, sentiment string, language string")
    df = df.withColumns({"confidence": F.lit(0.9), "was_translated": F.lit(False), "was_transliterated": F.lit(False), "fallback_used": F.lit(False), "translation_truncated": F.lit(False), "sentiment_truncated": F.lit(False), "translation_backend": F.lit("bypass"), "fallback_reason": F.lit(""), "transliterated_text": F.lit("")})

    def answer(payload, prompt):
        assert "category: one of these" in prompt and json.loads(payload)["translation_backend"] == "bypass"
        if "boom" in payload:
            raise TimeoutError("late")
        return "odd words" if "odd" in payload else json.dumps({"category": "protest", "intent": "opinion", "risk_score": 12.5, "reasoning": "r", "summary": "s", "recommended_action": "Monitor", "evidence_confidence": "high"})

    got = {r["result_id"]: r["record"] for r in pipeline.judged(df, counting(asked, answer), model="m").collect()}
    assert len(noted(asked)) == 3
    assert (got[1]["category"], got[1]["risk_score"], got[1]["source"], got[1]["model"]) == ("Protest", 12, "provider", "m") and "duplicate_post" not in got[1]["signals"]
    assert got[2]["signals"] == [*got[1]["signals"], "duplicate_post"] and got[2]["category"] == "Protest"
    assert (got[3]["source"], got[3]["recommended_action"]) == ("triage", "Ignore") and "TimeoutError" in got[4]["reasoning"] and got[5]["source"] == "error"
    counts = intel.outcome_counts(spark.createDataFrame([(r["source"], r["signals"]) for r in got.values()], "source string, signals array<string>")).first()
    assert tuple(counts) == (5, 4, 1, 1, 2)


def test_contexts_of_failed_posts(spark):
    posts = spark.createDataFrame([(1, "nenu chala"), (2, None), (3, "🙏")], "id bigint, post_text string")
    got = by_id(pipeline.with_language(posts))
    assert [(got[i]["language"], got[i]["was_transliterated"]) for i in (1, 2, 3)] == [("te", True), ("unknown", False), ("unknown", False)]


def test_no_group_is_ordered_whole(spark):
    r = random.Random(3)
    data = [(r.choice(["hot"] * 3 + ["a", None]), k if k else 10**15, r.random() < 0.7, float(k), float(k) + r.random() * 50) for k in range(2000)]
    df = spark.createDataFrame(data, "k string, t bigint, failed boolean, a double, b double").repartition(8)
    groups = {}
    for row in sorted(data, key=lambda x: x[1]):
        groups.setdefault(row[0], []).append(row)
    runs, places = {}, {}
    for k, rows in groups.items():
        n = 0
        for i, row in enumerate(rows):
            n = n + 1 if row[2] else 0
            runs[row[1]], places[row[1]] = n, i
    assert {x["t"]: x["run"] for x in gatelog.failure_runs(df, ["k"], ["t"], "failed").collect()} == runs
    assert {x["t"]: x["rank"] for x in dedupe.ranked(df, "t", ["k"]).collect()} == places
    open_ = {row[1]: sum(o[3] < row[3] < o[4] for o in groups[row[0]]) for row in data}
    assert {x["t"]: x["open_calls"] for x in gatelog.overlap_bound(df, ["k"], "a", "b").collect()} == open_


def test_samples_of_any_size(spark):
    df = spark.range(10_000).withColumn("key", F.col("id")).withColumn("_x", F.lit(1))
    some = {n: {r["id"] for r in io.seeded_sample(df, n, "id").collect()} for n in (0, 1, 500, 9_999, 20_000)}
    assert {n: len(v) for n, v in some.items()} == {0: 0, 1: 1, 500: 500, 9_999: 9_999, 20_000: 10_000}
    assert some[1] < some[500] < some[9_999] and some[500] == {r["id"] for r in io.seeded_sample(df.repartition(3), 500, "id").collect()}


def test_limits_in_order(spark):
    data = [("many", k, "x") for k in range(5)] + [("long", 0, "ok"), ("long", 1, "x" * 11), ("long", 2, "y" * 12), ("much", 0, "x" * 9), ("much", 1, "x" * 9), ("much", 2, None), ("fine", 0, "x")]
    df = spark.createDataFrame(data, "r string, pos int, x string")
    got = {x["r"]: x["error"] for x in requests.size_errors(df, "r", "pos", "x", 4, 10, 15).collect()}
    assert got["fine"] is None and {e["code"] for k, e in got.items() if k != "fine"} == {413}
    assert got["many"]["detail"].startswith("Too many texts: 5") and got["long"]["detail"] == "texts[1] is 11 characters (limit 10)." and got["much"]["detail"].startswith("Request totals 18")


def test_words_of_a_pack(spark):
    assert policy.pack_table(spark, policy.DEFAULT).where("severity = ''").count() == 13
