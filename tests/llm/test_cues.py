"""Contexts of names learned from a table: from all of its texts, as `Cues` learns them in memory."""

import random

import pytest

pytest.importorskip("vakya.llm")
from pyspark.sql import functions as F  # noqa: E402

from vakya.llm import pii  # noqa: E402

GIVEN, SURNAMES = {"asha", "ramesh", "farida", "joseph"}, {"ahirkhede", "odugunta", "penmettur"}


def pairs(cues):
    return {(a, b) for a, bs in cues.at.items() for b in bs}


def test_a_rare_context_in_a_large_table_is_learned(spark):
    """Three texts of 120,000 hold it, so part of them would miss it, as would a judgement of the share from part of them."""
    rare = F.element_at(F.array(*(F.lit(f"Then the pump man {n} was paid twice.") for n in ("Asha Odugunta", "Ramesh Penmettur", "Farida Ahirkhede"))), (F.col("id") / 40_000 + 1).cast("int"))
    text = F.when(F.col("id") % 40_000 == 7, rare).otherwise(F.concat(F.lit("The tap of lane "), F.col("id"), F.lit(" is dry.")))
    cues = pii.learn_cues(spark.range(120_000).select(F.lit("dataset").alias("src"), F.col("id").alias("key"), text.alias("text")), GIVEN, SURNAMES)
    assert (("pump", "man"), ("was", "paid", "twice")) in pairs(cues)
    found = "Today the pump man zubin mistry was paid twice."
    assert pii.redact(found, pii.find(found, GIVEN, SURNAMES, cues)) == "Today the pump man [NAME] was paid twice."


def test_a_table_teaches_what_its_texts_do(spark):
    r = random.Random(4)
    names = [f"{a} {b}".title() for a in GIVEN for b in SURNAMES] + ["Asha K. Odugunta", "Ａｓｈａ Penmettur"]
    others = ["the old pump", "Zubin Mistry", "रमेश कुमार", "ramesh the clerk", "nobody at all"]
    frames = ["The pump man {} was paid twice.", "We gave {} a form", "{} never came; write to asha [at] odugunta [dot] in", "Dr. {} left @ noon", "A note for d'mello's {} came late", "Ask {} \tat mail\tdot com"]
    texts = [r.choice(frames).format(r.choice(names if r.random() < 0.6 else others)) for _ in range(400)]
    rows = [("dataset", k, t) for k, t in enumerate(texts + texts[:200] + [None, "", " "])]
    table = spark.createDataFrame(rows, "src string, key bigint, text string").repartition(3)
    want = pairs(pii.Cues([*map(pii.without_addresses, sorted({*texts}))], GIVEN, SURNAMES))
    assert len(want) > 10
    for block in (100_000, 7):
        assert pairs(pii.learn_cues(table, GIVEN, SURNAMES, block=block)) == want
    assert not pii.learn_cues(table, GIVEN, set()).at and not pii.learn_cues(table.limit(0), GIVEN, SURNAMES).at


def test_addresses_are_cut_out_of_any_text():
    whole = lambda t: (s := pii.Spans(t), s.rewrite(pii.DISGUISED, pii._address), pii.EMAIL.sub("|", s.text))[2]
    for t in ("a@b.in c", "ravi at mail dot com", "ravi\tat\tmail\tdot\tcom", "RAVI (AT) MAIL.COM x", "ravi{@}mail{dot}com", "r @ mail.com", "the water at noon", "ｒａｖｉ＠ｍａｉｌ．ｃｏｍ", "रवि @ घर", "plain"):
        assert pii.without_addresses(t) == whole(t)


def test_words_of_units_with_and_without_places():
    for t in ("Dr. Asha K. Odugunta left.", "at 5.30 a.m. we met MRS. d'mr. x", "S.K. Rao; a_b @ 12-3\nरवि। है. ok...", "İ. Ali", "the end. A new one", "", "."):
        assert pii.unit_words(t) == [w for w, *_ in pii.units(t)]
