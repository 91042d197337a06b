"""Personal data on texts of other frames than the test tables': recall and precision by type."""

import random

import pytest

pytest.importorskip("vakya.llm")
from vakya.llm import pii  # noqa: E402

GIVEN = "Asha Ramesh Farida Joseph Kavya Manoj Nirmala Salim Teresa Vikram".split()
SURNAMES = "Ahirkhede Marrepalli Odugunta Penmettur Quadrishi Talvanekar".split()
UNKNOWN = "Rajesh Kumar|Sunil Verma|Hari Prasad|Kamala Devi|Arun Shankar|Bhavana Reddy|Lakshmi Narayan|Peter Dsouza|Zoya Khan|Imtiaz Ali".split("|")
FRAMES = [
    "Please contact {} at the office.", "I met {} yesterday and nothing moved.", "Mr. {} never came back.", "Our neighbour {} has been waiting.", "{} said that the tap is dry.",
    "We asked {} about the pump.", "Dr {} was on leave.", "Yours sincerely, {}", "My brother {} lost his pass.", "Thanks to {} for the repair.", "{} complained twice.", "Smt {} lives beside the tank.", "name: {}", "My name is {}.",
]
OTHERS = ["The Gandhi Market road is closed.", "Apollo Medicals was shut.", "We met the Water Board yesterday.", "Near Lake View Crossing the light is out.", "The bus to Green Park was late.", "I told the clerk about the Old Bridge.", "Good Friday was a holiday.", "Call the Helpline at noon."]


def test_names_in_other_frames():
    r = random.Random(8)
    found = missed = wrong = 0
    for frame in FRAMES:
        for _ in range(20):
            name = r.choice(UNKNOWN) if r.random() < 0.6 else f"{r.choice(GIVEN)} {r.choice(SURNAMES)}"
            text = f"{r.choice(OTHERS)} {frame.format(name)} {r.choice(OTHERS)}"
            at = text.index(name)
            got = [(a, b) for a, b, k in pii.find(text, {x.lower() for x in GIVEN}, {x.lower() for x in SURNAMES}) if k == "NAME"]
            hit = any(a <= at and b >= at + len(name) and b - a <= len(name) + 4 for a, b in got)
            found, missed, wrong = found + hit, missed + (not hit), wrong + len(got) - hit
    assert found / (found + missed) >= 0.9 and found / (found + wrong) >= 0.9, (found, missed, wrong)


def test_contexts_are_learned_and_serve_names_in_any_script_and_case():
    known, r = [f"{a} {b}" for a in GIVEN for b in SURNAMES], random.Random(1)
    texts = [f"A queue again. The pump man {r.choice(known)} was paid twice. All is dry" for _ in range(30)] + [f"The pump house was old. We saw {k} lorries" for k in range(30)]
    given, surnames = {x.lower() for x in GIVEN}, {x.lower() for x in SURNAMES}
    cues = pii.Cues(texts, given, surnames)
    of = lambda t: [t[a:b] for a, b, k in pii.find(t, given, surnames, cues) if k == "NAME"]
    assert of("Today the pump man Zubin Mistry was paid twice.") == ["Zubin Mistry"] == of("the pump man Zubin Mistry was paid twice")
    assert of("the pump man zubin mistry was paid twice.") == ["zubin mistry"] and of("the pump man రమేష్ ఓడుగుంట was paid twice") == ["రమేష్ ఓడుగుంట"]
    assert of("The pump house was old and was paid twice") == [] and not pii.Cues([], given, surnames).at


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("write to ravi{at}mail{dot}com please", "EMAIL", "ravi{at}mail{dot}com"),
        ("write to ravi <at> mail <dot> co <dot> in please", "EMAIL", "ravi <at> mail <dot> co <dot> in"),
        ("write to ravi (@) mail.com please", "EMAIL", "ravi (@) mail.com"),
        ("ravi at mail dot com", "EMAIL", "ravi at mail dot com"),
        ("రవి: తొమ్మిది ఎనిమిది ఏడు ఆరు ఐదు నాలుగు మూడు రెండు ఒకటి సున్నా", "PHONE", "తొమ్మిది ఎనిమిది ఏడు ఆరు ఐదు నాలుగు మూడు రెండు ఒకటి సున్నా"),
        ("my pan is ABCDE1234F.", "ID_NUMBER", "ABCDE1234F"),
        ("card ７４００ ７５０３ ５９８５ here", "ID_NUMBER", "７４００ ７５０３ ５９８５"),
        ("at Flat 405B, Amber Apartments, Clock Tower Lane, Gunivilopur.", "ADDRESS", "Flat 405B, Amber Apartments, Clock Tower Lane, Gunivilopur"),
    ],
)
def test_other_types(text, kind, want):
    assert [text[a:b] for a, b, k in pii.find(text) if k == kind] == [want]
    assert f"[{kind}]" in pii.redact(text, pii.find(text))
