"""The whole analysis of posts, one transform of a table (batch or stream): clean, language, spelling, translation, sentiment, flags, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vakya.functions.annotate import quality_flags, sentiment_truncated, top_confidence, top_label
from vakya.functions.intel import assessment, contentless, payload, resolved_failures, signals
from vakya.functions.lexicons import LABELS
from vakya.functions.policy import DEFAULT, Pack
from vakya.functions.quality import generation_budget, route
from vakya.functions.roman import needs_transliteration, refine_language, transliterate_rules
from vakya.functions.text import clean_text, words
from vakya.operators.dedupe import first_of
from vakya.operators.models import class_scores, lexicon_probs, mapped, roman_cues, script_language, spelled, translated, verified_english


def with_language(df: DataFrame, text: str = "post_text", detect=script_language, roman=roman_cues) -> DataFrame:
    """Adds cleaned_text, language (detected, then put right by scripts and the romanised words) and was_transliterated. These are what
    a record of a post that fails later on says of it; a language that can't be told is 'unknown'."""
    t = df.withColumn("cleaned_text", clean_text(text))
    t = t.withColumn("language", F.coalesce(detect("cleaned_text"), F.lit("unknown"))).withColumn("language", refine_language("cleaned_text", "language", roman))
    return t.withColumn("was_transliterated", F.coalesce(needs_transliteration("cleaned_text", "language"), F.lit(False)))


def analyze(df: DataFrame, text: str = "post_text", detect=script_language, probs=lexicon_probs, primary=None, secondary=None, roman=roman_cues, speller=None, fallback=None, tokens=None, classifier=None, classes: dict[int, str] | None = None) -> DataFrame:
    """Adds the columns of a result. Without models all rows are taken as they are, which keeps the plan free of Python but for
    cleaning, and fit for streams. Null texts are cleaned to '' and dropped.

    primary, secondary, speller and fallback make models (see operators/models.py): of translation, of native spellings, and one that
    translates and judges at once what the others failed on, replying in JSON. Rows that fail for good have `failure` set and no
    sentiment. classifier makes a model that scores the `classes` of a text, in place of the column function `probs`. tokens: a column function that counts tokens; else words and two signs for the ends are counted."""
    size = tokens or (lambda x: F.size(words(x)) + 2)
    t = df.withColumnRenamed(text, "post_text") if text != "post_text" else df
    t = with_language(t, "post_text", detect, roman).where(F.length("cleaned_text") > 0)
    if speller is None:
        native = F.when(F.col("was_transliterated"), transliterate_rules("cleaned_text", "language"))
    else:
        t = spelled(t.withColumn("_to_spell", F.when(F.col("was_transliterated"), F.col("cleaned_text"))), "_to_spell", "language", speller, "_native").drop("_to_spell")
        native = F.col("_native")
    t = t.withColumn("_native", native).withColumn("was_transliterated", F.col("_native").isNotNull())
    t = t.withColumn("transliterated_text", F.coalesce("_native", F.lit(""))).withColumn("_working", F.coalesce("_native", "cleaned_text")).drop("_native")
    if primary is None:
        backend = F.when(route("language") == "bypass", "bypass").otherwise("passthrough")
        t = t.withColumns({"english_text": F.col("_working"), "translation_backend": backend, "translation_time_ms": F.lit(0.0), "failure": F.lit(None).cast("string")})
    else:
        t = translated(t, "_working", "language", primary, secondary)
    done = F.col("translation_backend").isin("primary", "secondary", "cache") & F.col("failure").isNull()
    t = t.withColumn("was_translated", F.coalesce(done, F.lit(False)))
    cut = F.col("was_translated") & (size("english_text") >= generation_budget(size("_working")))
    t = t.withColumns({"fallback_used": F.lit(False), "fallback_reason": F.lit(""), "translation_truncated": F.coalesce(cut, F.lit(False)), "sentiment_truncated": sentiment_truncated(size("english_text"))})
    good = F.col("failure").isNull()
    if classifier is None:
        t = t.withColumn("probs", F.when(good, probs("english_text"))).withColumn("sentiment_time_ms", F.lit(0.0))
    else:
        t = class_scores(t, "english_text", classifier, classes or dict(enumerate(LABELS))).withColumn("sentiment_time_ms", F.coalesce("sentiment_time_ms", F.lit(0.0)))
        t = t.withColumn("failure", F.coalesce("failure", F.when(F.col("probs").isNull(), F.lit("sentiment"))))
    t = t.withColumns({"sentiment": top_label("probs"), "confidence": top_confidence("probs"), "total_time_ms": F.round(F.col("translation_time_ms") + F.col("sentiment_time_ms"), 3)})
    t = t.withColumns(quality_flags()).drop("_working")
    if fallback is not None:
        t = with_fallback(t, fallback)
    return t.withColumn("signals", signals()).withColumn("contentless", contentless())


def with_fallback(t: DataFrame, fallback) -> DataFrame:
    """Rows that failed, once for equal posts, through a model that translates and judges; what its reply can't be used for stays failed."""
    keys = ["post_text", "language", "was_transliterated"]
    failed = t.where("failure is not null")
    one = failed.groupBy(*keys).agg(F.min("failure").alias("reason"), F.min("translation_time_ms").alias("translation_time_ms"))
    asked = mapped(one, "post_text", "language", fallback, "reply", 1).withColumn("fallback_ms", F.col("time_ms")).withColumnRenamed("failure", "_kind").drop("time_ms")
    new = resolved_failures(asked, english=verified_english).withColumn("failure", F.coalesce("_kind", "failure")).drop("_kind", "reason")
    same = [c for c in t.columns if c not in new.columns or c in keys]
    got = failed.select(*same).join(new, keys)
    return t.where("failure is null").unionByName(got, allowMissingColumns=True)


def judged(results: DataFrame, make, pack: Pack = DEFAULT, intent_mode: str = "enum", keywords: str | None = None, model: str = "") -> DataFrame:
    """Adds `record`, the assessment of each result: posts without content by triage, the rest by a model that is told of a post as JSON
    and replies in JSON. Equal posts (text, English text, sentiment) are judged once and the later ones, by result_id, marked so.

    make builds a function from (payloads, prompt) to replies; it fails post by post, and what fails gets a record that says so."""
    from vakya.functions.policy import system_prompt

    keys = ["post_text", "english_text", "sentiment"]
    t = results if "signals" in results.columns else results.withColumn("signals", signals())
    names = [*keys, "result_id", "signals", *[c for c in ("language", "confidence", "was_translated", "was_transliterated", "translation_backend", "fallback_used", "fallback_reason", "transliterated_text") if c in t.columns], *([keywords] if keywords else [])]
    one = first_of(t.select(*names), keys, ["result_id"])
    told = one.withColumn("_why", contentless()).withColumn("_payload", payload(keywords)).withColumn("_prompt", F.lit(system_prompt(pack, intent_mode, keywords is not None)))
    ask = told.where("_why is null").select(*keys, "result_id", "_payload", "_prompt")
    replies = mapped(ask, "_payload", "_prompt", make, "reply", 1).select("result_id", "reply", "failure", "time_ms")
    first = told.join(replies, "result_id", "left").withColumn("record", assessment("reply", "failure", "time_ms", F.lit(model), pack=pack, intent_mode=intent_mode))
    right = first.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("result_id").alias("_first"), F.col("record").alias("_record"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    again = F.col("_record").withField("signals", F.array_append("_record.signals", F.lit("duplicate_post")))
    return t.join(right, on).withColumn("record", F.when(F.col("result_id") == F.col("_first"), F.col("_record")).otherwise(again)).select(*t.columns, "record")
