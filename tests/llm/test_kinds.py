"""Kinds of text on planted documents: recall and precision of each kind, and repetition of every unit."""

import random

import pytest

pytest.importorskip("vakya.llm")
from vakya.llm import quality  # noqa: E402

WORDS = "the a river road school water people town said that it was very late and nobody came to see why of in for with their new old bridge market light rain".split()


def sentence(r):
    return " ".join(r.choices(WORDS, k=r.randint(7, 16))).capitalize() + "."


def prose(r):
    return "\n\n".join(" ".join(sentence(r) for _ in range(r.randint(2, 5))) for _ in range(r.randint(2, 5)))


def listing(r):
    return "\n".join(f"{r.choice(['-', '*', '•'])} " + " ".join(r.choices(WORDS, k=r.randint(1, 5))) for _ in range(r.randint(6, 20)))


def table_(r):
    d = r.choice(["|", "\t", ","])
    k = r.randint(3, 5)
    return "\n".join(d.join(str(r.randint(1, 999)) if c else r.choice(WORDS) for c in range(k)) for _ in range(r.randint(6, 20)))


def junk(r):
    return r.choice(
        [
            lambda: " ".join("".join(r.choices("qwrtpsdfghjklzxcvbnm#$%&", k=r.randint(3, 9))) for _ in range(40)),
            lambda: "\n\n".join([sentence(r)] * 9),
            lambda: " ".join(["read more"] * 30),
            lambda: " ".join("#" + w for w in r.choices(WORDS, k=25)),
            lambda: "\n".join(["Home | News | Contact | Login"] * 8),
            lambda: " ".join(r.choice("abcdefghij") for _ in range(80)),
        ]
    )()


def test_kinds_of_planted_documents():
    r = random.Random(6)
    right, told, of = {}, {}, {}
    for kind, make in (("prose", prose), ("list", listing), ("table", table_), ("junk", junk)):
        for _ in range(60):
            got = quality.statistics(make(r))[-1]
            of[kind], told[got], right[kind] = of.get(kind, 0) + 1, told.get(got, 0) + 1, right.get(kind, 0) + (got == kind)
    for kind in of:
        assert right[kind] >= 0.95 * of[kind] and right[kind] >= 0.95 * told[kind], (kind, right, of, told)


def test_repetition_of_any_unit_is_junk_and_refrains_are_not():
    r = random.Random(2)
    assert quality.statistics("\n\n".join([f"{sentence(r)} {sentence(r)}"] * 6))[-1] == "junk"
    assert quality.statistics("buy now " * 40 + sentence(r))[-1] == "junk"
    song = "\n\n".join(x for _ in range(3) for x in (f"{sentence(r)} {sentence(r)} {sentence(r)}", "And the river runs to the town, and the rain."))
    assert quality.statistics(song)[-1] == "prose"
    assert quality.statistics(prose(r) + "\n\n- one\n- two\n- three")[-1] == "prose"
