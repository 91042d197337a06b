"""Problems 1, 4, 6, 8 and 10: rules on single texts, brute force, and edge cases."""

import time

import duckdb
import pytest

pytest.importorskip("vakya.llm")
from vakya.llm import abuse, langid, leaks, pii, quality  # noqa: E402
from vakya.llm.base import words_of  # noqa: E402

DIR = "/root/testdata/sf0.001"
GIVEN, SURNAMES = {"asha", "kiran", "mohan"}, {"yelpuri", "rathodvar"}


def rows(df):
    return sorted(map(tuple, df.collect()))


def found(text):
    return [(text[a:b], k) for a, b, k in pii.find(text, GIVEN, SURNAMES)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mail asha.y7@mail.example now", [("asha.y7@mail.example", "EMAIL")]),
        ("mujhe asha_7 [at] mail[dot]example par", [("asha_7 [at] mail[dot]example", "EMAIL")]),
        ("Write to me at asha-7 at inbox dot test please", [("asha-7 at inbox dot test", "EMAIL")]),
        ("anjali_37 .example", []),
        ("Follow @asha_7 for notices", []),
        ("Call +1 (202) 555-0139 today", [("+1 (202) 555-0139", "PHONE")]),
        ("नंबर ९९९९९०१२३४ है", [("९९९९९०१२३४", "PHONE")]),
        ("Ph ９​９９９９０１２３４!", [("９​９９９９０१२३४".replace("१२३४", "１２３４"), "PHONE")]),
        ("dial nine nine nine nine nine zero one two three four ok", [("nine nine nine nine nine zero one two three four ", "PHONE")]),
        ("Receipt 40000-105237, Transaction 89148914383414, Helpline 1912, Rs 9,999,999", []),
        ("complaint 4097-42872 and 153,172 and 27441/1427", []),
        ("Aadhaar 7656 4203 6586; PAN ZMYXD1787D; XZV/6893670; X 7795801", [("7656 4203 6586", "ID_NUMBER"), ("ZMYXD1787D", "ID_NUMBER"), ("XZV/6893670", "ID_NUMBER"), ("X 7795801", "ID_NUMBER")]),
        ("I live at Flat 105B, Amber Apartments, Clock Tower Lane, Yutidosiwadi.", [("Flat 105B, Amber Apartments, Clock Tower Lane, Yutidosiwadi", "ADDRESS")]),
        ("at door no 21/71 station back road behind the mill, Town today", [("door no 21/71 station back road behind the mill, Town", "ADDRESS")]),
        ("The old bridge in Komiyijupalle is on Clock Tower Lane", []),
        ("My name is Asha K Yelpuri. The Kiran Medicals signboard fell", [("Asha K Yelpuri", "NAME")]),
        ("हमारे पड़ोसी दिनेश अहिरखेड़े भी परेशान हैं", [("दिनेश अहिरखेड़े", "NAME")]),
        ("9999901234; Chitrani Edavalath; asha@a.test", [("9999901234", "PHONE"), ("Chitrani Edavalath", "NAME"), ("asha@a.test", "EMAIL")]),
        ("", []),
    ],
)
def test_personal_data(text, want):
    got = found(text)
    assert [k for _, k in got] == [k for _, k in want]
    assert [t.strip() for t, _ in got] == [t.strip() for t, _ in want]


def test_redaction_keeps_the_rest():
    t = "Ｎｏｔｅ: é​ x; call ९९९९९०१२३४, ok 🙏"
    assert pii.redact(t, pii.find(t)) == "Ｎｏｔｅ: é​ x; call [PHONE], ok 🙏"


def test_personal_data_edge_cases(spark):
    data = [("s", 1, "call 9999901234"), ("s", 1, "call 9999901234"), ("s", 2, None), ("s", 3, ""), (None, None, " "), ("s", 4, "word " * 60_000)]
    df = spark.createDataFrame(data, "src string, key bigint, text string").selectExpr("*", "1 as types", "2 as row_id")
    names = spark.createDataFrame([("Asha", "given"), (None, None), ("Asha", "given")], "name string, kind string")
    began = time.time()
    got = pii.redacted(df, names).where("n_found > 0").distinct()
    assert rows(got.select("src", "row_id", "clean_text")) == [("s", 1, "call [PHONE]")]
    assert time.time() - began < 60
    assert pii.redacted(df.limit(0), names.limit(0)).count() == 0


def test_leaks_match_brute_force(spark):
    items = duckdb.sql(f"select item_id, text from '{DIR}/eval_items.parquet'").fetchall()
    docs = duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet' where text is not null").fetchall()
    grams = {}
    for i, t in items:
        w = words_of(t or "")
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = {(d, i) for d, t in docs for w in [words_of(t)] for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    assert rows(leaks.QUERIES["p8_found"](spark, DIR)) == sorted(want) and want


def test_leaks_edge_cases(spark):
    w = [f"w{k}" for k in range(30)]
    items = spark.createDataFrame([(1, " ".join(w[:20])), (1, " ".join(w[:20])), (2, " ".join(w[:12])), (3, None), (None, "x"), (4, "a " * 15), (5, " ".join(w[5:25]))], "item_id bigint, text string")
    docs = [(10, "pre " + ", ".join(w[3:16]).upper() + "!"), (11, " ".join(w[:12])), (12, " ".join(w[2:9]) + " gap " + " ".join(w[9:16])), (13, None), (14, ""), (15, "a " * 50_000), (16, " ".join(w[0:7])), (17, " ".join(w[7:14])), (10, "pre " + ", ".join(w[3:16]).upper() + "!")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as terms")
    for shard in (5, 400_000):
        assert rows(leaks.leaks(df, items, shard=shard).select("doc_id", "item_id")) == [(10, 1), (15, 4)]
    assert rows(leaks.leaks(df, items.limit(0))) == [] and rows(leaks.leaks(df.limit(0), items)) == []


@pytest.mark.parametrize(
    "text, kind",
    [
        ("The old bridge was closed in March. Nobody told the residents, who waited for hours.\n\nIt opened again on Friday.", "prose"),
        ("- one thing\n- other thing\n- third thing, ward 7\n- fourth", "list"),
        ("Pending works\nold bridge\nPuvisadipur, ward 3\nroads - 203\nlibrary", "list"),
        ("Villages, Alpha, Beta, ward 7, Gamma, old bridge, Delta, unit 9, Epsilon, power - 41", "list"),
        ("Place,Topic,Count\nAlpha,Roads,12\nBeta,Water,7\nGamma,Power,9", "table"),
        ("| a | b | c |\n|---|---|---|\n| x | 1 | 2 |\n| y | 3 | 4 |", "table"),
        ("Place    Topic    Count\nAlpha    Roads    12\nBeta    Water    7", "table"),
        ("#a1 #b2 #c3 #d4 #e5 #f6", "junk"),
        ("Home | About | Help\nHelp | Home | Login | About\nLogin | Help | Home", "junk"),
        ("really truly " * 40, "junk"),
        ("à¤\x95à¤² à¤¸à¥\x87 à¤ªà¤¾à¤¨à¥\x80 à¤\x86à¤¯à¤¾", "junk"),
        ("59/wfth5lPLPKPjp/rMfJWj4xUPnS1YfEuP91sw09f\n+5tqdYMQLcQb516006ntTXd+l2CYdna8gQM+9ML3l", "junk"),
        ("kvvhrwnmflg.\nzdkzrdghktkqcx.\nstbmzmpnz:\ncjhbhhvgvg", "junk"),
        ("[13/09/2026, 2:02] asha: ok\n[13/09/2026, 2:03] mohan: thanks, see you at the meeting", "prose"),
        ("user1 wrote:\nThe bus is late again today, as it was all week.\n\nuser2 wrote:\nIt came at nine.", "prose"),
        ("so the bus came late again and nobody knew why it had been that way since the old\nbridge was closed in march and we all had to walk to the market every single day", "prose"),
        ("", "empty"),
        ("   \n ", "empty"),
    ],
)
def test_kinds_of_text(text, kind):
    assert quality.statistics(text)[-1] == kind


def test_quality_edge_cases(spark):
    data = [(1, "One line here. Two.\nOne line here. Two."), (1, "One line here. Two.\nOne line here. Two."), (2, None), (3, ""), (None, "x"), (4, "a b c d e f. " * 30_000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 as kind", "2 as n_words")
    got = {r["doc_id"]: r for r in quality.document_statistics(df).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1]["n_words"] == 8 and got[1]["duplicate_line_share"] == 0.5 and got[1]["end_punctuation_share"] == 1.0
    assert got[2]["kind"] is None and got[2]["n_words"] is None and got[3]["kind"] == "empty"
    assert quality.document_statistics(df.limit(0)).count() == 0


EN = ["the bridge was closed all week and nobody told us", "where is the water that they promised to the village", "this road is better than it was last year"]
HI = ["yeh sadak bahut kharab hai aur koi nahi dekhta", "paani kab aayega hum kab tak intezaar karenge", "bijli phir se chali gayi hai aaj raat ko"]
MR = ["रस्ता खूप खराब आहे आणि कोणी बघत नाही", "पाणी कधी येणार आहे ते सांगा", "वीज पुन्हा गेली आहे आज रात्री"]
HD = ["यह सड़क बहुत खराब है और कोई नहीं देखता", "पानी कब आएगा हम कब तक इंतजार करेंगे", "बिजली फिर से चली गई है आज रात को"]


@pytest.fixture(scope="module")
def model():
    rows = [("en", x) for x in EN * 9] + [("hi", x) for x in (HI + HD) * 9] + [("mr", x) for x in MR * 9] + [("te", "ఈ రోడ్డు బాగా లేదు")] * 9 + [("hi", EN[0]), ("en", HI[1]), ("hi", MR[2])] * 2
    return langid.fit(rows, langid.read_vocabulary(f"/opt/tokenizers/{langid.VOCABULARY}"))


def test_forward_sums_all_segmentations():
    p = {b" a": (0.5, 0.1), b"b": (0.25, 0.1), b" ab": (0.125, 0.3), b" ": (0.1, 0.0), b"a": (0.2, 0.2)}
    import math

    x, y = langid.forward("ab", p, 2)
    assert math.isclose(math.exp(x), 0.125 + 0.5 * 0.25 + 0.1 * 0.2 * 0.25) and math.isclose(math.exp(y), 0.3 + 0.1 * 0.1)
    assert all(math.isfinite(v) for v in langid.forward("ab" * 5_000, p | {b"b": (1e-5, 1e-5)}, 2))


def test_languages(model):
    of = lambda t: [x for x, _ in langid.spoken(langid.segments(t, model))]
    assert model.langs["latn"] == ["en", "hi"] and model.langs["deva"] == ["hi", "mr"] and model.langs["telu"] == ["te"]
    assert of("where is the bridge that they promised") == ["en"] and of("sadak bahut kharab hai aaj raat") == ["hi"]
    assert of("पाणी पुन्हा खराब आहे आणि कोणी सांगा") == ["mr"] and of("ఈ రోడ్డు") == ["te"]
    assert of(f"{EN[0]}. {MR[0]} | {HI[0]}") == ["en", "hi", "mr"]
    assert of("🙏 123 https://a.test @x") == [] and of("") == []


def test_language_edge_cases(spark, model):
    data = [(1, EN[1], "hin"), (1, EN[1], "hin"), (2, None, "en"), (3, "", None), (None, EN[0], None), (4, "word and " * 20_000, "en"), (5, MR[1], "mr-IN"), (6, HD[1], "und")]
    df = spark.createDataFrame(data, "key bigint, text string, label string").selectExpr("*", "1 as languages")
    got = {(r["key"], r["label"]): [x["language"] for x in r["languages"]] for r in langid.languages(df, model).collect()}
    assert got[1, "hi"] == ["en"] and got[2, "en"] == [] and got[3, None] == [] and got[5, "mr"] == ["mr"] and got[6, None] == ["hi"]
    assert langid.fit_on(df.limit(0)).langs == {}


def test_language_accuracy_on_held_out_rows(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/pipeline_result.parquet").selectExpr("result_id as key", "post_text as text", "language as label").where("key % 2 = 0")
    test = spark.read.parquet("/root/testdata/sf0.01/pipeline_result.parquet").selectExpr("result_id as key", "post_text as text", "language as label").where("key % 2 = 1")
    got = langid.languages(test, langid.fit_on(t)).where("label is not null and size(languages) = 1")
    right = got.where("label = languages[0].language").count()
    assert right > 0.9 * got.count()  # some labels are wrong by design


def test_spellings_of_terms():
    same = {abuse._hash("idiot")}
    for t in ("1d10t", "i.d.i.o.t", "i d i o t", "ＩＤＩＯＴ", "іdiоt", "idiooooot"):
        assert any(same <= {*w} for w in abuse.stretches(t)), t
    assert abuse.terms_of("s***d") == ["<masked>", "<masked>sd"] and abuse.terms_of("12345") == [] and abuse.stretches("") == []


def test_machine_learns_interactions():
    good = ["you are so kind to us", "pigs roam near the clinic", "the clinic is open today", "we saw pigs today"] * 40
    bad = ["you filthy pigs go away", "you are filthy pigs"] * 30
    noisy = [(t, i % 21 == 0) for i, t in enumerate(good)] + [(t, i // 2 % 2 == 0) for i, t in enumerate(bad)]
    # `least` counts different texts, so each gets a word of its own.
    m = abuse.fit([(f"{t} n{i}x", y) for i, (t, y) in enumerate(noisy)])
    assert min(map(m.text, bad)) > m.threshold > max(map(m.text, good))
    assert m.text("") == 0.0


def test_abuse_edge_cases(spark):
    posts = spark.createDataFrame([(1, "some text"), (1, "some text"), (2, None), (3, " "), (None, "x"), (4, "word " * 50_000)], "id bigint, text string").selectExpr("*", "1 as score")
    judged = spark.createDataFrame([(1, None), (2, "Other"), (None, "Hate Speech"), (1, "Other")], "id bigint, category string")
    m = abuse.fit_on(posts, judged)
    assert rows(abuse.scored(posts, m).selectExpr("id", "score < 0.01")) == [(1, True), (2, None), (3, None), (4, True)]
    assert abuse.scored(posts.limit(0), abuse.fit_on(posts.limit(0), judged.limit(0))).count() == 0
