"""Scalar functions against expected values and against plain Python over random Unicode."""

import html
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vakya.functions import annotate, intel, quality, roman, script, text
from vakya.functions.lexicons import BLOCKS


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i bigint, {schema}")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def one(spark, column, *texts):
    return values(spark, [(t,) for t in texts], "x string", column)


def random_texts(n=300, seed=4):
    r = random.Random(seed)
    pools = ["abcXYZéßñ", "చలాకనమి్ఁ", "कखगािी्।", "ಕಖಗಿ", "കഖഗി", "தமிழ்", "বাংলা", "ગુજ", "ਪੰਜ", "اردو،؟", " \t\n  ", "@#_.!?:;'\"&<>/-", "0123٣५", "🙏🔥👍", "éä", "http://a.b www.c.d "]
    return ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 40))) for _ in range(n)]


def clean(t):
    t = html.unescape(t)
    for p, to in ((r"<[^>]+>", " "), (r"(?i)(?:https?://|www\.)\S+", " "), (r"@\w+", " "), (r"#(\w+)", r"\1")):
        t = re.sub(p, to, t)
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", t)).strip()


def bucket(c):
    for name, (a, b) in BLOCKS.items():
        if int(a, 16) <= ord(c) <= int(b, 16):
            return name
    return "latin" if 0x41 <= ord(c) <= 0x24F and c.isalpha() else None


def test_cleaning_and_scripts_match_plain_python(spark):
    ts = random_texts() + ["&lt;b&gt; &copy; &#2325; a&amp;lt;", "see https://x.y/z and @user_1 #Tag2", "@मोदी जी"]
    assert one(spark, text.clean_text("x"), *ts) == [clean(t) for t in ts]
    counts = [Counter(b for c in t if (b := bucket(c))) for t in ts]
    assert one(spark, script.detect_script("x"), *ts) == [c.most_common(1)[0][0] if c else "unknown" for c in counts]
    ratio = [c["latin"] / sum(c.values()) if c else 0.0 for c in counts]
    assert one(spark, script.latin_ratio("x"), *ts) == pytest.approx(ratio)
    kept = [" ".join("".join(c for c in t if bucket(c) == "latin" or c.isspace() or (c.isascii() and not c.isalpha())).split()) for t in ts]
    assert one(spark, script.extract_latin("x"), *ts) == kept


def test_cleaning_expected_values(spark):
    assert one(spark, text.clean_text("x"), "Great 🙏🔥", "Hi @bob see https://t.co/x #GoodWork  now", None, "") == ["Great 🙏🔥", "Hi see GoodWork now", "", ""]
    assert one(spark, text.normalize_label("x"), " NEG", "neutral ", "Pos", "what", None) == ["Negative", "Neutral", "Positive", None, None]
    with pytest.raises(Exception, match="no sentiment label"):
        one(spark, text.normalize_label("x", strict=True), "what")
    assert one(spark, F.array_join(text.sentences("x"), "|"), "One. Two! Three?", "single", "", None) == ["One.|Two!|Three?", "single", "", ""]
    assert one(spark, text.first_words("x", 3), "a b  c d e", "a b") == ["a b c", "a b"]
    assert one(spark, text.clip("x", 10), "a" * 10, "abcdefghijklmno") == ["a" * 10, "abcdefg\n...[truncated]...\nmno"]
    assert values(spark, [(5.25,), (75.0,), (None,)], "s double", text.seconds_text("s"))[1] == "1m 15.0s"
    assert values(spark, [(0.12345,), (float("nan"),), (None,)], "s double", text.metric_text("s")) [1:] == ["n/a", "n/a"]


def test_unique_language(spark):
    got = one(spark, script.unique_language("x"), "ಕನ್ನಡ", "മലയാളം", "ಕನ್ನಡ english words", "हिन्दी", "English only", "a lot of english words with one క", None)
    assert got == ["kn", "ml", "kn", None, None, None, None]
    assert one(spark, script.script_mix("x"), "abc कखग", "abc", "", "కా a") == [0.5, 0.0, 0.0, 0.5]
    assert one(spark, script.arabic_ratio("x"), "اردو ab", "12") == [pytest.approx(4 / 6), 0.0]


def test_romanised_cues(spark):
    ts = ["chaala bagundi", "service is good", "movie bilkul bakwas", "inka chala bilkul", "", None, "LEDU nenu,undi!"]
    assert one(spark, roman.cue_count("x"), *ts) == [2, 0, 2, 3, 0, None, 2]  # capitals may be an acronym
    assert one(spark, roman.cue_language("x"), *ts)[:5] == ["te", None, "hi", None, None]
    assert one(spark, roman.residual("x"), "The service chala bagundi PIN a") == ["chala bagundi"]
    assert one(spark, F.array_join(roman.polarity_tokens("x"), "|"), "Not good, baddd. worst no") == ["bad|good|no|not|worst"]


def test_transliteration(spark):
    data = [("Teen Din meh 6th Sat hai,", "ur"), ("service chaala bagundi!", "te"), ("6chala", "te"), ("text", "en"), (" ", "te"), (None, "te")]
    got = values(spark, data, "x string, lang string", roman.transliterate_rules("x", "lang"))
    assert got == ["تین دن میں 6th Sat hai,", "service చాలా బాగుంది!", "6chala", None, None, None]
    assert values(spark, data[:2], "x string, lang string", roman.model_words("x", "lang")) == [["hai"], []]
    assert values(spark, [("Namaz", "ur")], "x string, lang string", roman.model_input("x", "lang")) == ["__ur__ n a m a z"]


SCORE = "array<struct<label string, score double>>"


@pytest.mark.parametrize(
    "x, ranked, bert, rest, want",
    [
        ("chala bagundi service", [("eng_Latn", 0.7), ("tel_Latn", 0.2)], None, [], "te"),
        ("this is a genuine english sentence with many ordinary words", [("eng_Latn", 0.9), ("tel_Latn", 0.2)], None, [], "en"),
        ("the scheme implementation is good kaani no response", [("eng_Latn", 0.95)], "eng_Latn", [("tel_Latn", 0.33)], "te"),
        ("short english here", [("eng_Latn", 0.5)], "tel_Latn", [], "en"),
        ("nice weather", [("hin_Latn", 0.9)], None, [], "en"),
        ("chala manchidi undi ra", [("kan_Latn", 0.8)], None, [], "te"),
        ("teen din namaz kal raat ghar mein", [("eng_Latn", 0.95)], "urd_Latn", [], "ur"),
        (" ", [], None, [], None),
        ("unheard words of nothing whatever known", [("other", 0.9)], None, [], None),
    ],
)
def test_roman_language(spark, x, ranked, bert, rest, want):
    assert values(spark, [(x, ranked, bert, rest)], f"x string, a {SCORE}, b string, c {SCORE}", roman.roman_language("x", "a", "b", "c")) == [want]


def test_refine_language(spark):
    data = [("ಕನ್ನಡ text", "en"), ("నమస్తే", "te"), ("plain words", "en"), ("plain words", "hi"), ("हिन्दी है", "hi"), ("", "unknown")]
    for new, want in (("te", ["kn", "te", "te", "te", "hi", "unknown"]), ("en", ["kn", "te", "en", "hi", "hi", "unknown"]), (None, ["kn", "te", "en", "hi", "hi", "unknown"])):
        assert values(spark, data, "x string, lang string", roman.refine_language("x", "lang", lambda p: F.lit(new).cast("string"))) == want


@pytest.mark.parametrize(
    "source, target, reason",
    [
        ("నమస్తే", "Hello there", None),
        ("నమస్తే", "  ", "empty"),
        ("hello", "HELLO", "unchanged"),
        ("నమస్తే", "123 !!", "no letters"),
        ("నమస్తే", "నమస్తే అందరికీ hi", "not latin"),
        ("یہ اردو متن ہے", "this is یہ متن ok words here", "arabic left"),
        ("చిన్న", "word " * 80, "too long"),
        ("నమస్తే అందరికీ ఎలా ఉన్నారు", "go go go go go now then stop", "repeats"),
        ("chala good undi", "It is bad", "polarity"),
        ("chala good undi", "It is nice", None),
        ("not good undi", "It is terrible", None),
        ("asalu not", "It came", "polarity"),
        ("asalu not", "It didn't come", None),
        ("good undi", "There is a road", "polarity"),
    ],
)
def test_translation_gate(spark, source, target, reason):
    assert values(spark, [(source, target)], "s string, t string", quality.unusable_reason("s", "t")) == [reason]


def test_prompts_and_budgets(spark):
    assert values(spark, [("x", "hi")], "x string, lang string", quality.model_prompt("x", "lang", "indictrans2")) == ["hin_Deva eng_Latn x"]
    assert values(spark, [("x", "hi")], "x string, lang string", quality.model_prompt("x", "lang", "madlad")) == ["<2en> x"]
    assert values(spark, [("x", "hi")], "x string, lang string", quality.model_prompt("x", "lang", "nllb")) == ["x"]
    assert values(spark, [("x", "ur")], "x string, lang string", quality.model_prompt("x", "lang", "indictrans2")) == [None]  # plain tags lead astray
    with pytest.raises(ValueError):
        quality.model_prompt("x", "lang", "tagged")
    assert values(spark, [(0,), (10,), (1000,)], "n int", quality.generation_budget("n")) == [32, 57, 256]
    assert one(spark, quality.route("x"), "en", "te", "fr", None) == ["bypass", "translate", "passthrough", "passthrough"]


RESULT = "post_text string, english_text string, language string, sentiment string, confidence double, was_translated boolean, was_transliterated boolean, translation_time_ms double, sentiment_time_ms double, total_time_ms double, fallback_used boolean, translation_truncated boolean, sentiment_truncated boolean"
BASE = {"post_text": "a post with some words", "english_text": "a post with some words", "language": "en", "sentiment": "Neutral", "confidence": 0.9, "was_translated": False, "was_transliterated": False, "translation_time_ms": 1.0, "sentiment_time_ms": 2.0, "total_time_ms": 3.0, "fallback_used": False, "translation_truncated": False, "sentiment_truncated": False}


def result(spark, column, **change):
    return values(spark, [tuple((BASE | change).values())], RESULT, column)[0]


@pytest.mark.parametrize(
    "change, signal",
    [
        ({}, None), ({"english_text": "two words"}, "very_short"), ({"post_text": "x" * 4001}, "truncated"), ({"confidence": 0.5}, "low_sentiment_confidence"), ({"post_text": "abc कखग"}, "code_mixed"),
        ({"was_transliterated": True}, "romanized_indic_transliterated"), ({"fallback_used": True}, "ollama_pipeline_fallback"), ({"translation_truncated": True}, "translation_truncated"), ({"sentiment_truncated": True}, "sentiment_truncated"),
        ({"language": "te"}, "translation_unavailable"), ({"post_text": "RT @bob hello"}, "quoted_or_forwarded"), ({"post_text": "Click  here now"}, "possible_spam"), ({"post_text": "#a #b #c #d #e #f #g #h"}, "possible_spam"),
        ({"post_text": "http://a http://b www.c"}, "link_heavy"), ({"english_text": "a b c word word word"}, "possible_ocr_noise"),
    ],
)
def test_signals(spark, change, signal):
    assert result(spark, intel.signals(), **change) == ([signal] if signal else [])


@pytest.mark.parametrize("change, why", [({}, None), ({"post_text": " "}, "blank"), ({"post_text": "[image omitted]"}, "media"), ({"post_text": "🙏 http://a.b/c"}, "no text"), ({"english_text": None}, "no translation")])
def test_contentless(spark, change, why):
    assert result(spark, intel.contentless(), **change) == why


@pytest.mark.parametrize("change, ok", [({}, True), ({"sentiment": "Mixed"}, False), ({"confidence": float("nan")}, False), ({"confidence": None}, False), ({"total_time_ms": 9.0}, False), ({"english_text": " "}, False), ({"translation_time_ms": -1.0}, False)])
def test_validity(spark, change, ok):
    assert result(spark, F.coalesce(annotate.is_valid_result(), F.lit(False)), **change) is ok


def test_flags(spark):
    assert result(spark, annotate.quality_flags()["review_recommended"]) is False
    for change in ({"confidence": 0.59}, {"language": "unknown"}, {"language": None}, {"language": "te"}, {"fallback_used": True}, {"sentiment_truncated": True}):
        assert result(spark, annotate.quality_flags()["review_recommended"], **change) is True


def test_replies(spark):
    replies = [
        '```json\n{"category": "cyber crime", "intent": "rumor", "risk_score": 72.5, "reasoning": "r", "summary": "s", "recommended_action": "monitor", "evidence_confidence": "HIGH"}\n```',
        'Sure: {"category": "Aliens", "risk_score": "abc"} done', '[1, 2]', "no json", '{"risk_score": -3, "reasoning": "x"}', '{"risk_score": 250}', '{"risk_score": "Infinity"}', None,
    ]
    got = one(spark, intel.validated("x"), *replies)
    assert tuple(got[0]) == ("Cyber Crime", "Rumor", "Rumor", 72, "r", "s", "Monitor", "high", [])
    assert (got[1]["category"], got[1]["risk_score"], got[1]["recommended_action"]) == ("Unknown", 0, "Human Review")
    assert [g["risk_score"] for g in got[4:7]] == [0, 100, 0]
    assert one(spark, intel.json_object("x"), *replies)[2:4] == [None, None]
    free = one(spark, intel.validated("x", free=True), '{"intent": "one two three four five six seven eight nine"}')[0]
    assert free["intent"] == "one two three four five six seven eight" and free["intent_label"] == "Unknown"


def test_scores(spark):
    assert annotate.label_mapping({0: "LABEL_0", 1: "LABEL_1", 2: "LABEL_2"}) == {0: 0, 1: 1, 2: 2} and annotate.label_mapping({0: "positive", 1: "negative"}) == {0: 2, 1: 0}
    with pytest.raises(ValueError):
        annotate.label_mapping({0: "joy"})
    got = values(spark, [([0.2, 0.8],)], "p array<double>", annotate.canonical_probs("p", {0: 0, 1: 2}))[0]
    assert got == pytest.approx([0.2 / 1.4, 0.4 / 1.4, 0.8 / 1.4])
    assert values(spark, [([0.4, 0.4, 0.2],)], "p array<double>", annotate.top_label("p")) == ["Negative"]
