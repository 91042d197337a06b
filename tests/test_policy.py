"""Policy packs, replies that translate and judge at once, and report tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vakya.functions import intel, policy
from vakya.operators import mt_metrics, reports
from vakya.plans.queries import QUERIES


def test_packs(spark):
    p = policy.parse_pack({"name": "n", "categories": [{"id": " A ", "definition": "d" * 600, "keywords": [" k ", ""]}, {"id": "B", "severity": "high"}]})
    assert [c.id for c in p.categories] == ["A", "B", "Unknown"] and len(p.categories[0].definition) == 500 and p.categories[0].keywords == ("k",)
    assert policy.parse_pack(None) is policy.DEFAULT is policy.parse_pack({}) and len(policy.DEFAULT.allowed()) == 13
    assert len(policy.parse_pack({"categories": [{"id": "a"}, {"id": "A"}]}).categories) == 3  # ids are compared as they are
    assert policy.parse_pack({"categories": [{"id": "a", "definition": " d "}]}).categories[0].definition == " d " and policy.parse_pack({"categories": [{"id": "a"}]}).name == "caller"
    for bad in ({"categories": []}, {"categories": [{"id": ""}]}, {"categories": ["a"]}, {"categories": [{"id": "a", "keywords": "k"}]}, {"categories": [{"id": "a"}, {"id": "a"}]}, {"categories": [{"id": "a"}], "unknown_label": "b"}, {"categories": [{"id": str(i)} for i in range(129)]}, {"categories": [{"id": "x" * 97}]}):
        with pytest.raises(ValueError):
            policy.parse_pack(bad)
    s = policy.reply_schema(p, "free", True)
    assert s["properties"]["category"]["enum"] == ["A", "B", "Unknown"] and "intent_label" in s["required"] and s["required"][-1] == "keyword_context"
    plain = policy.reply_schema(p)
    assert "keyword_context" in plain["properties"] and "keyword_context" not in plain["required"] and "additionalProperties" not in plain
    assert policy.system_prompt(p, "free", True).count("keyword_context") == 2 and "intent_label" not in policy.system_prompt(p)


def test_fingerprints_worked_out_by_hand():
    assert policy.DEFAULT.fingerprint() == "sha256:88b29680510e42c9bacb6d6c9c6799c7be0f693bfe2716461227476faaf6fd4b"
    text = '{"categories":[{"definition":"","id":"B","keywords":["సడక్"],"severity":"high"},{"definition":"d","id":"A","keywords":[],"severity":""},{"definition":"","id":"Unknown","keywords":[],"severity":""}],"intent_mode":"free","unknown_label":"Unknown"}'
    p = policy.parse_pack({"categories": [{"id": "B", "severity": "high", "keywords": ["సడక్"]}, {"id": "A", "definition": "d"}]})
    assert p.fingerprint("free") == "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_fingerprint_is_the_same_in_spark_and_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/policy_category.parquet").collect()
    pack = policy.Pack("t", tuple(policy.Category(r["category_id"], r["definition"] or "", r["severity"] or "", tuple(r["keywords"])) for r in rows))
    assert QUERIES["policy_fingerprint"](spark, "/root/testdata/sf0.001").first()[0] == pack.fingerprint()
    assert policy.pack_table(spark, pack).count() == 13


@pytest.mark.parametrize(
    "reply, failure",
    [
        ('{"english_text": "The road is bad", "sentiment": "Negative", "confidence": 0.9}', None),
        ('{"english_text": "The road is bad", "sentiment": "Negative", "confidence": true}', "confidence"),
        ('{"english_text": "The road is bad", "sentiment": "Negative", "confidence": 1.5}', "confidence"),
        ('{"english_text": "The road is bad", "sentiment": "Negative", "confidence": "0.9"}', "confidence"),
        ('{"english_text": "The road is bad", "sentiment": "Mixed", "confidence": 0.9}', "sentiment"),
        ('{"english_text": 5, "sentiment": "Negative", "confidence": 0.9}', "no text"),
        ('{"english_text": " ", "sentiment": "Negative", "confidence": 0.9}', "no text"),
        ('{"english_text": "The road is bad", "sentiment": "Negative"}', "keys"),
        ('{"english_text": "x y", "sentiment": "Negative", "confidence": 0.9, "more": 1}', "keys"),
        ('["a"]', "no object"),
        ("text", "no object"),
        ('{"english_text": "రోడ్డు బాగా లేదు", "sentiment": "Negative", "confidence": 0.9}', "unchanged"),
    ],
)
def test_fallback_replies(spark, reply, failure):
    df = spark.createDataFrame([(reply, "రోడ్డు బాగా లేదు", "te")], "r string, s string, lang string")
    got = df.select(intel.fallback_result("r", "s", "lang").alias("v")).first()["v"]
    assert got["failure"] == failure and (got["english_text"] is None) == (failure is not None)


def test_the_best_models_in_a_document(spark):
    t = spark.createDataFrame([("a", 30.0, 50.0, None, 9.0), ("b", 31.0, 50.0, None, 8.0)], "model string, bleu double, chrf double, comet double, avg_time_ms double")
    m = spark.createDataFrame([("x", 0.8, 0.7, 0.75, 5.0), ("y", 0.9, 0.7, 0.75, 5.0)], "model string, accuracy double, f1_macro double, f1_weighted double, avg_time_ms double")
    by = spark.createDataFrame([("te", "x", 0.4), ("te", "y", 0.5), ("hi", "x", 0.6), ("hi", "y", 0.5), ("kn", "y", 0.9)], "language string, model string, f1_macro double")
    doc = reports.best_document(t, m, by)
    assert doc.startswith("# Best models: b, then y\n") and "- COMET: n/a" in doc and "1. COMET: unavailable" in doc and "1. chrF: tie at 50.0" in doc
    assert "Better than x by macro F1 for: te" in doc and "## Sentiment: y" in doc
    wide = reports.formatted_table(t.withColumns({"n_translated": F.lit(3), "total_time_s": F.lit(1.25), "model_size_mb": F.lit(10.0), "gpu_peak_mb": F.lit(None).cast("double")}), "model", reports.TRANSLATION_ROWS, ["a", "b"]).orderBy("place")
    assert [tuple(r)[1:] for r in wide.collect()][:5] == [("BLEU", "30.00", "31.00"), ("chrF", "50.00", "50.00"), ("COMET", "n/a", "n/a"), ("Posts translated", "3", "3"), ("Avg latency (ms/post)", "9.0", "8.0")]
    with pytest.raises(ValueError):
        reports.markdown(spark.range(5), most=4)
    assert reports.markdown(spark.range(5)).count("\n") == 6
    masks = spark.createDataFrame([(True, None), (None, None), (False, True)], "a boolean, b boolean")
    assert [r[0] for r in masks.select(mt_metrics.either("a", "b")).collect()] == [True, False, True]


def test_tables(spark):
    df = spark.createDataFrame([(1, "a", "hello", 2.0, "p"), (1, "b", "hi", 3.0, "p"), (2, "a", "x", 1.0, "q")], "id int, model string, english_text string, translation_time_ms double, post_text string")
    t = reports.translations_table(df, "id", "model", ["a", "b"], base=["post_text"], selected="a")
    assert t.columns == ["id", "post_text", "a_translation", "a_time_ms", "b_translation", "b_time_ms", "selected_pipeline"] and t.count() == 2
    p = spark.createDataFrame([(["x", "y"], 1)], "signals array<string>, n int")
    assert tuple(reports.predictions_table(p, ["n", "signals"]).first()) == (1, "x|y")
    e = spark.createDataFrame([("Positive", "Positive", 2.0), ("Negative", "Positive", 4.0)], "t string, p string, total_time_ms double")
    assert reports.accuracy_line(e, "t", "p").startswith("accuracy 0.5000, macro F1 0.2222, 3.0 ms")
    assert e.select(F.lit(1)).count() == 2
