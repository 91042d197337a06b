"""Scores of planted cases under a noisy judgement: recall, precision, and the noise as estimated."""

import random

import numpy as np
import pytest

pytest.importorskip("vakya.llm")
from vakya.llm import abuse  # noqa: E402

NEUTRAL = "the road bus water school bridge light market office clerk pension tank queue morning evening street rain river park bill".split()
INSULTS, GROUPS = "filth vermin scum rats dogs".split(), "northerners hillfolk weavers drovers".split()


def post(r, kind):
    base = r.choices(NEUTRAL, k=r.randint(6, 14))
    if kind == "abusive":
        at = r.randint(0, len(base))
        base[at:at] = [r.choice(GROUPS), "are", r.choice(INSULTS)]
    elif kind == "animals":
        base[2:2] = ["the", r.choice(INSULTS), "ate", "grain"]
    elif kind == "group":
        base[3:3] = ["the", r.choice(GROUPS), "held", "a", "fair"]
    return " ".join(base)


@pytest.mark.parametrize("n, recall, precision", [(1500, 0.8, 0.8), (6000, 0.9, 0.9)])
def test_recall_and_precision_under_a_noisy_judgement(n, recall, precision):
    r = random.Random(n)
    kinds = r.choices(["abusive", "animals", "group", "plain"], [0.06, 0.06, 0.06, 0.82], k=n)
    told = [(post(r, k), r.random() < (0.6 if k == "abusive" else 0.02)) for k in kinds]
    m = abuse.fit(told)
    fresh = r.choices(["abusive", "animals", "group", "plain"], [0.1, 0.1, 0.1, 0.7], k=1500)
    got = [(m.text(post(r, k)) >= m.threshold, k == "abusive") for k in fresh]
    both, found, true = sum(a and b for a, b in got), sum(a for a, _ in got), sum(b for _, b in got)
    assert both >= recall * true and both >= precision * found, (both, found, true, m.threshold)
    assert abs(m.recall - 0.6) < 0.2 and m.alarm < 0.05


def test_the_cut_follows_the_noise():
    score = np.concatenate([np.linspace(0.0, 0.3, 900), np.linspace(0.7, 1.0, 100)])
    r = np.random.default_rng(1)
    judged = np.where(score > 0.5, r.random(1000) < 0.6, r.random(1000) < 0.02)
    recall, alarm = abuse.noise(score, judged)
    assert 0.45 < recall < 0.75 and alarm < 0.05 and 0.28 < abuse.cut(score, judged, recall, alarm) < 0.75
    assert abuse._falling(np.array([0.0, 1.0, 0.0, 0.0])).tolist() == [0.5, 0.5, 0.0, 0.0]
