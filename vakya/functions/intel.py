"""Signals of a post, model replies brought onto a contract, policy packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakya.functions.annotate import quality_flags
from vakya.functions.lexicons import ACTIONS, CODE_MIX, EVIDENCE, INTENTS, LABELS, LOW_CONFIDENCE, MAX_CHARS, NO_ASSESSMENT, NO_REASONING, NO_SUMMARY, PROVIDER_FAILED, SHORT_WORDS, TRIAGE
from vakya.functions.policy import DEFAULT, Pack
from vakya.functions.rx import LINK, W_IN, forward, media, spam
from vakya.functions.script import script_mix
from vakya.functions.text import clip, col, first_words, let, lookup, n_links, squeezed_ends, words


def signals() -> Column:
    """The flags of a result row in fixed order; nulls count as '' , 0 or false."""
    text, english, lang = (F.coalesce(c, F.lit("")) for c in ("post_text", "english_text", "language"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    w = words(english)
    n = F.size(w)
    flags = {
        "very_short": n <= SHORT_WORDS,
        "truncated": F.length(text) > MAX_CHARS,
        "low_sentiment_confidence": F.coalesce("confidence", F.lit(0.0)) < LOW_CONFIDENCE,
        "code_mixed": script_mix(text) >= CODE_MIX,
        "romanized_indic_transliterated": yes("was_transliterated"),
        "ollama_pipeline_fallback": yes("fallback_used"),
        "translation_truncated": yes("translation_truncated"),
        "sentiment_truncated": yes("sentiment_truncated"),
        "translation_unavailable": ~lang.isin("en", "") & ~yes("was_translated"),
        "language_undetermined": lang == "unknown",
        "quoted_or_forwarded": text.rlike(forward),
        "possible_spam": text.rlike(spam) | (F.regexp_count(text, F.lit(f"#[{W_IN}]+")) >= 8),
        "link_heavy": n_links(text) >= 3,
        "possible_ocr_noise": (n >= 6) & (F.size(F.filter(w, lambda x: F.length(x) == 1)) / F.greatest(n, F.lit(1)) > 0.4),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())))


def contentless() -> Column:
    """Why a post has nothing to analyse, else null."""
    text, english = (F.coalesce(c, F.lit("")) for c in ("post_text", "english_text"))
    return (
        F.when(squeezed_ends(text) == "", "blank")
        .when(squeezed_ends(text).rlike(media), "media")
        .when(~F.regexp_replace(text, LINK, " ").rlike(r"[\p{L}\p{N}]"), "no text")
        .when(squeezed_ends(english) == "", "no translation")
    )


KEYWORDS = "array<struct<keyword string, matched boolean, contextually_relevant boolean, usage string, reason string>>"


def record(pack: Pack = DEFAULT, intent_mode: str = "enum", **parts: Column) -> Column:
    """An assessment as a struct of all its fields; what isn't given is as for a post that can't be assessed."""
    fixed = {
        "category": F.lit(pack.unknown_label), "intent": F.lit(pack.unknown_label if intent_mode == "free" else "Unknown"), "risk_score": F.lit(0), "reasoning": F.lit(""), "summary": F.lit(NO_ASSESSMENT),
        "recommended_action": F.lit("Human Review"), "evidence_confidence": F.lit("low"), "signals": F.array().cast("array<string>"), "source": F.lit("provider"), "model": F.lit(""), "latency_ms": F.lit(0.0),
        "intent_label": F.lit("Unknown"), "policy_pack_fingerprint": F.lit(pack.fingerprint(intent_mode)), "schema_enforced": F.lit(True), "keyword_context": F.array().cast(KEYWORDS),
    }
    if odd := parts.keys() - fixed.keys():
        raise ValueError(f"no fields of an assessment: {sorted(odd)}")
    return F.struct(*((parts.get(k, v)).alias(k) for k, v in fixed.items()))


def triage(signals_: Column | str = "signals", pack: Pack = DEFAULT, intent_mode: str = "enum") -> Column:
    """The assessment of a post with nothing to assess, made without a model; null for others."""
    why = contentless()
    say = lambda i: lookup({k: v[i] for k, v in TRIAGE.items()}, why)
    return F.when(why.isNotNull(), record(pack, intent_mode, reasoning=say(0), recommended_action=say(1), signals=col(signals_), source=F.lit("triage")))


def assessment(reply: Column | str, failure: Column | str, latency_ms: Column | str = "latency_ms", model: Column | None = None, signals_: Column | str = "signals", pack: Pack = DEFAULT, intent_mode: str = "enum", enforced: Column | None = None) -> Column:
    """The assessment of a post: by triage, else from a model's reply (JSON text), else, where the model failed (`failure`, the kind of
    its error) or replied with no JSON object, one that says so. Latency, model and whether a schema was enforced are stamped on the latter two."""
    why = F.coalesce(col(failure), F.when(json_object(reply).isNull(), F.lit("ValueError")))
    stamps = {"signals": col(signals_), "latency_ms": F.coalesce(F.round(col(latency_ms).cast("double"), 1), F.lit(0.0)), "model": F.lit("") if model is None else model, "schema_enforced": F.lit(True) if enforced is None else enforced}
    head, _, tail = PROVIDER_FAILED.partition("{}")
    failed = record(pack, intent_mode, reasoning=F.concat(F.lit(head), why, F.lit(tail)), source=F.lit("error"), **stamps)
    names = ("category", "intent", "intent_label", "risk_score", "reasoning", "summary", "recommended_action", "evidence_confidence", "keyword_context")
    good = let(validated(reply, intent_mode == "free", pack.allowed(), pack.unknown_label), lambda v: record(pack, intent_mode, **{n: v[n] for n in names}, **stamps))
    return F.coalesce(triage(signals_, pack, intent_mode), F.when(why.isNotNull(), failed).otherwise(good))


def payload(keywords: Column | str | None = None) -> Column:
    """What a model is told of a result row, as JSON; keywords (an array of structs) are told of where there are some."""
    text = lambda c: clip(F.coalesce(c, F.lit(""))).alias(c)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    told = [] if keywords is None else [F.when(F.size(col(keywords)) > 0, col(keywords)).alias("matched_keywords")]
    return F.to_json(
        F.struct(
            clip(F.coalesce("post_text", F.lit(""))).alias("original_text"), "language", text("english_text"), "sentiment", "confidence", yes("was_translated"), yes("was_transliterated"),
            F.coalesce(F.nullif(F.col("translation_backend"), F.lit("")), F.lit("unknown")).alias("translation_backend"), yes("fallback_used"), F.coalesce("fallback_reason", F.lit("")).alias("fallback_reason"), text("transliterated_text"), "signals", *told,
        )
    )


def json_object(reply: Column | str) -> Column:
    """The JSON object of a reply, which may stand in a code fence or in prose; null if there is none."""
    t = squeezed_ends(reply)
    t = F.when(t.startswith("```"), squeezed_ends(F.regexp_replace(t, r"(?i)^```(?:json)?\s*|\s*```$", ""))).otherwise(t)
    whole, inner = F.try_parse_json(t), F.try_parse_json(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit("")))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_object(whole), F.to_json(whole)).when(whole.isNull() & is_object(inner), F.to_json(inner))


def pick(value: Column | str, allowed, default: str) -> Column:
    """A value of a fixed set, whatever its case; else the default."""
    return F.coalesce(lookup({x.lower(): x for x in allowed}, F.lower(squeezed_ends(value))), F.lit(default))


def risk(value: Column | str) -> Column:
    """A number, rounded half to even, in 0 to 100; 0 for what is none."""
    x = F.expr(f"try_cast({value} as double)") if isinstance(value, str) else value.try_cast("double")
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.rint(F.greatest(F.lit(-1.0), F.least(F.lit(101.0), x))).cast("int")))


REPLY = "category string, intent string, intent_label string, risk_score string, reasoning string, summary string, recommended_action string, evidence_confidence string"


def validated(reply: Column | str, free: bool = False, categories=DEFAULT.allowed(), unknown: str = "Unknown") -> Column:
    """A struct on the contract from the JSON text of a reply."""
    t = json_object(reply)
    r = F.from_json(t, REPLY)
    text = lambda c: F.coalesce(squeezed_ends(r[c]), F.lit(""))
    intent = F.coalesce(F.nullif(first_words(text("intent")), F.lit("")), F.lit(unknown)) if free else pick(r["intent"], INTENTS, "Unknown")
    remarks = F.get_json_object(t, "$.keyword_context")
    return F.struct(
        pick(r["category"], categories, unknown).alias("category"),
        intent.alias("intent"),
        (pick(r["intent_label"], INTENTS, "Unknown") if free else intent).alias("intent_label"),
        risk(r["risk_score"]).alias("risk_score"),
        F.when(text("reasoning") == "", NO_REASONING).otherwise(text("reasoning")).alias("reasoning"),
        F.when(text("summary") == "", NO_SUMMARY).otherwise(text("summary")).alias("summary"),
        F.when(text("reasoning") == "", "Human Review").otherwise(pick(r["recommended_action"], ACTIONS, "Human Review")).alias("recommended_action"),
        pick(r["evidence_confidence"], EVIDENCE, "low").alias("evidence_confidence"),
        F.coalesce(F.when(remarks.startswith("["), F.from_json(remarks, KEYWORDS)), F.array().cast(KEYWORDS)).alias("keyword_context"),
    )


def keywords_by_place(posts: DataFrame, lists: DataFrame, request: str, pos: str = "pos", keywords: str = "keywords") -> DataFrame:
    """Posts of requests with the keywords given for their place; posts beyond the lists have none, lists beyond the posts are dropped."""
    right = lists.select(F.col(request).alias("_request"), F.col(pos).alias("_pos"), F.col(keywords).alias("matched_keywords"))
    return posts.join(right, (posts[request] == right["_request"]) & (posts[pos] == right["_pos"]), "left").drop("_request", "_pos")


def json_string(x: Column | str) -> Column:
    """A JSON string literal, null for null; other than ASCII stays as it is."""
    t = col(x)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.coalesce(F.concat(F.lit('"'), t, F.lit('"')), F.lit("null"))


FALLBACK = "english_text string, sentiment string, confidence string"


def fallback_result(reply: Column | str, source: Column | str, lang: Column | str, english=None) -> Column:
    """A struct (english_text, sentiment, confidence, failure) from the JSON text of a reply that translates and judges at once.

    It must have those three keys and no others, English text that can be a translation, a known label and a number in [0, 1].
    `english`, a function from a text column to a condition, verifies that the text is English."""
    from vakya.functions.quality import unusable_reason

    v = F.try_parse_json(col(reply))
    t = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v))
    r = F.from_json(t, FALLBACK)
    keys = F.array_sort(F.json_object_keys(t))
    of = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    kind = of("confidence")
    number = kind.startswith("BIGINT") | kind.startswith("DOUBLE") | kind.startswith("DECIMAL")
    confidence = r["confidence"].try_cast("double")
    why = (
        F.when(t.isNull(), "no object")
        .when(~keys.eqNullSafe(F.array(F.lit("confidence"), F.lit("english_text"), F.lit("sentiment"))), "keys")
        .when(~F.coalesce(of("english_text") == "STRING", F.lit(False)) | (F.coalesce(squeezed_ends(r["english_text"]), F.lit("")) == ""), "no text")
        .when(~F.coalesce(r["sentiment"].isin(*LABELS), F.lit(False)), "sentiment")
        .when(~F.coalesce(number, F.lit(False)) | ~F.coalesce(confidence.between(0, 1), F.lit(False)), "confidence")
        .when(col(lang) != "en", unusable_reason(col(source), r["english_text"]))
    )
    if english is not None:
        why = F.coalesce(why, F.when((col(lang) != "en") & ~F.coalesce(english(r["english_text"]), F.lit(False)), "not english"))
    good = why.isNull()
    return F.struct(F.when(good, squeezed_ends(r["english_text"])).alias("english_text"), F.when(good, r["sentiment"]).alias("sentiment"), F.when(good, confidence).alias("confidence"), why.alias("failure"))


def resolved_failures(failures: DataFrame, reply: str = "reply", fallback_ms: str = "fallback_ms", english=None) -> DataFrame:
    """Failed posts (post_text, language, was_transliterated, reason, translation_time_ms, ...) with a model's reply as rows of results,
    flags included; `failure` says why a reply couldn't be taken, and such a row has no text, sentiment or confidence."""
    v = failures.withColumn("_v", fallback_result(reply, "post_text", "language", english))
    ms = F.round(F.col("translation_time_ms") + F.col(fallback_ms), 3)
    changed = F.lower(squeezed_ends("_v.english_text")) != F.lower(squeezed_ends("post_text"))
    r = v.withColumns(
        {
            "english_text": F.col("_v.english_text"), "sentiment": F.col("_v.sentiment"), "confidence": F.round("_v.confidence", 4), "was_translated": F.coalesce((F.col("language") != "en") & changed, F.lit(False)),
            "sentiment_time_ms": F.lit(0.0), "total_time_ms": ms, "translation_backend": F.lit("ollama_fallback"), "fallback_used": F.lit(True), "fallback_reason": F.col("reason"),
            "translation_truncated": F.lit(False), "sentiment_truncated": F.lit(False), "failure": F.col("_v.failure"),
        }
    )
    return r.withColumn("translation_time_ms", ms).withColumns(quality_flags()).drop("_v", reply, fallback_ms)


def outcome_counts(records: DataFrame) -> DataFrame:
    """(n_posts, n_analyzed, n_reused, n_triage, n_errors) of assessments (source, signals): how each came about."""
    again = F.array_contains("signals", "duplicate_post")
    return records.agg(F.count("*").alias("n_posts"), F.count_if(~again).alias("n_analyzed"), F.count_if(again).alias("n_reused"), F.count_if(F.col("source") == "triage").alias("n_triage"), F.count_if(F.col("source") == "error").alias("n_errors"))
