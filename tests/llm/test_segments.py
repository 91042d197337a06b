"""Segments of texts put together from sentences in known languages, confidence in scripts of one language, words of any length."""

import math
import random

import pytest

pytest.importorskip("vakya.llm")
from vakya.llm import langid  # noqa: E402
from tests.llm.test_texts import EN, HI, MR, model  # noqa: E402, F401

TE = ["ఈ రోడ్డు చాలా బాగా లేదు", "నీళ్లు రోజూ రావడం లేదు ఇక్కడ", "మా వీధిలో దీపాలు వెలగడం లేదు"]


def test_segments_of_planted_texts(model):  # noqa: F811
    r = random.Random(4)
    right = total = 0
    for _ in range(60):
        parts = [(lang, r.choice(of)) for lang, of in r.sample([("en", EN), ("hi", HI), ("mr", MR), ("te", TE)], 2)]
        text = langid.lines_form("\n".join(x for _, x in parts))
        got = langid.segments(text, model)
        at = 0
        for lang, x in parts:
            x = langid.lines_form(x)
            a, b = at, at + len(x)
            at = b + 1
            total += b - a
            right += sum(max(0, min(b, s[1]) - max(a, s[0])) for s in got if s[2] == lang)
            assert all(0 <= s[3] <= 1 for s in got)
    assert right >= 0.9 * total, (right, total)


def test_confidence_in_a_script_of_one_language_is_the_models():
    text = [("te", x) for x in TE * 20]
    m = langid.fit(text, langid.read_vocabulary(f"/opt/tokenizers/{langid.VOCABULARY}"))
    assert m.langs["telu"] == ["te"]
    (good,), (odd,) = langid.segments(TE[0], m), langid.segments("ఝౠఞఙ ఱఴఝఔ ఌఞ", m)
    assert good[2] == odd[2] == "te" and good[3] > 0.99 and odd[3] < 0.1
    assert langid.segments("", m) == [] and langid.spoken(langid.segments("42 !!", m)) == []


def test_words_of_any_length():
    word = "రోడ్డు" * 400
    p = {bytes([k]): 1 / 300 for k in range(256)} | {"రో".encode(): 0.01}
    e: dict = {}
    singles = {x: (v,) for x, v in p.items()}
    langid._expected(word, 2.0, p, e, 6, singles)
    assert math.isclose(sum(len(x) * n for x, n in e.items()), 2 * len((" " + word).encode()), rel_tol=1e-6)
    short: dict = {}
    langid._expected("రోడ్డు", 1.0, p, short, 6, singles)
    assert math.isclose(e["రో".encode()], 800 * short["రో".encode()], rel_tol=0.02)
    (whole,) = langid.forward(word, singles, 1, 6)
    assert math.isfinite(whole) and whole < -3000
    # the end of a long word counts: nothing is cut off
    (other,) = langid.forward("రోడ్డు" * 399 + "xxxxxxxx", singles, 1, 6)
    assert other != whole
