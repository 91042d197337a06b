"""Problem 4: abusive, hateful or sexual content.

A factorization machine over hashed terms scores stretches of a text (sentences, long ones in overlapping windows); a text's score is
its highest. Pairwise interactions tell an insult aimed at somebody from a word that merely occurs. Spellings are undone first:
plain forms (looks.py), letters spelled apart, digits and signs for letters, masked words (which become a term of their own).

It's fitted to a sample of bounded size of texts with a noisy judgement: equal stretches are weighed by how often they were
judged abusive and not, then, as a judgement is about a whole text and often wrong, refitted to what judgement and machine together
say of each text's worst stretch. Words in fewer than `least` different texts (names, numbers) are no terms. Texts without a judgement aren't fitted to.

Null and blank texts score null and are no cases; a repeated id counts once. Without any abusive judgement all scores are 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vakya.llm.base import check_broadcast, deep_size, not_blank, on_executors, table
from vakya.llm.looks import transducer

LABEL = "hate speech"
WINDOW, STEP, SPACE = 16, 8, 1 << 22
LEET = str.maketrans("0134578$@!", "oieastbsai")
APART = re.compile(r"(?<![^\W_])[a-z0-9$@](?:[ .*_-][a-z0-9$@!]){2,}(?![^\W_])")
DROP = re.compile(r"https?://\S+|[@#]\w+|</?\w+>|&\w+;")
CUT = re.compile(r"[.!?।۔|\n;…]+(?=\s|$)|\n")
LONG = re.compile(r"([^\W\d_])\1{2,}")
TERM = re.compile(r"[^\s.,:;?\"“”()\[\]{}|/<>…।۔–—~^=+-]+")


def _joined(m: re.Match) -> str:
    s = re.sub(r"[ .*_-]", "", m[0])
    return s if sum(map(str.isalpha, s)) >= 2 else m[0]


def terms_of(token: str) -> list[str]:
    t = token.strip("!*'`’‘_&%")
    if "*" in token and any(map(str.isalpha, token)) and (t != token.strip("!") or "*" in t) and len(token) > 2 and "*" in token.strip("*"):
        return ["<masked>", f"<masked>{t[0]}{t[-1]}"]
    if not t:
        return []
    if LONG.search(t):  # drawn out: with the letter once and twice
        return [*{LONG.sub(r"\1", t), LONG.sub(r"\1\1", t)}]
    if t.isalpha() or not t.isascii():
        return [t]
    letters = sum(map(str.isalpha, t))
    if not letters:
        return []
    plain = t.translate(LEET)
    return [plain, plain.replace("i", "l", 1)] if "1" in t else [plain]


def sentences(text: str) -> list[list[int]]:
    """The hashed terms of each sentence, in order."""
    text = DROP.sub(" ", transducer().form(text).lower() if "\n" not in text else "\n".join(map(transducer().form, text.lower().split("\n"))))
    text = APART.sub(_joined, text)
    out = []
    for s in CUT.split(text):
        terms = [x for t in TERM.findall(s) for x in terms_of(t)]
        if terms:
            out.append([_hash(x) for x in terms])
    return out


def windows(hashes: list[int]) -> list[tuple[int, ...]]:
    """The distinct terms of each window of a sentence, in order of hash."""
    return [tuple(sorted({*hashes[k : k + WINDOW]})) for k in (range(0, max(1, len(hashes) - STEP), STEP) if len(hashes) > WINDOW else (0,))]


def stretches(text: str) -> list[tuple[int, ...]]:
    return [w for s in sentences(text) for w in windows(s)]


_known: dict[str, int] = {}


def _hash(term: str) -> int:
    h = _known.get(term)
    if h is None:
        if len(_known) > 200_000:
            _known.clear()
        h = _known[term] = xxhash.xxh3_64_intdigest(term) & (SPACE - 1)
    return h


class Machine:
    """w0 + sum of w + sum over pairs of <v, v>, as a probability."""

    def __init__(self, w0: float, at: dict[int, int], w: np.ndarray, v: np.ndarray) -> None:
        self.w0, self.at, self.w, self.v, self.known = w0, at, w, v, {}
        self.threshold, self.recall, self.alarm = 0.5, RECALL, ALARM

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def stretch(self, hashes: tuple[int, ...]) -> float:
        rows = tuple([r for h in hashes if (r := self.at.get(h)) is not None])
        p = self.known.get(rows)
        if p is None:
            if len(self.known) > 200_000:
                self.known.clear()
            v = self.v[list(rows)]
            s = v.sum(axis=0)
            x = self.w0 + self.w[list(rows)].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
            p = self.known[rows] = 1 / (1 + math.exp(-max(-50.0, min(50.0, float(x)))))
        return p

    def all(self, rows: list[tuple[int, ...]]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        idx = np.concatenate([np.array(r, np.int64) for r in rows])
        x = np.full(len(rows), self.w0)
        some = np.flatnonzero(sizes)
        cut = (np.cumsum(sizes) - sizes)[some]
        s, q = np.add.reduceat(self.v[idx], cut), np.add.reduceat((self.v[idx] ** 2).sum(axis=1), cut)
        x[some] += np.add.reduceat(self.w[idx], cut) + 0.5 * ((s * s).sum(axis=1) - q)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def text(self, text: str) -> float:
        best = 0.0
        for s in sentences(text):
            best = max(best, *map(self.stretch, windows(s)))
            if len(s) > WINDOW and self.at:
                best = max(best, self.apart([*dict.fromkeys(s)]))
        return best

    def apart(self, hashes: list[int]) -> float:
        """The highest score of any two blocks of STEP distinct terms, so that any two terms of a sentence meet, among as many others as in a window."""
        rows = np.array([self.at.get(h, -1) for h in hashes])
        cut = np.arange(0, len(rows), STEP)
        v, w = np.where((rows >= 0)[:, None], self.v[rows], 0.0), np.where(rows >= 0, self.w[rows], 0.0)
        s = np.add.reduceat(v, cut)
        own = np.add.reduceat(w, cut) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), cut))
        top = own[0]
        for k in range(len(cut) - 1):
            top = max(top, float((own[k] + own[k + 1 :] + s[k + 1 :] @ s[k]).max()))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.w0 + float(top)))))


#: Where the estimate of the judgement's noise starts: of abusive texts, how many it calls so, and of others.
RECALL, ALARM = 0.55, 0.02
PARTS = 4


def noise(score: np.ndarray, judged: np.ndarray) -> tuple[float, float]:
    """How often the judgement calls abusive texts so, and others, by scores that it had no part in. The lower half of the texts is hardly
    ever abusive, what a machine is sure of nearly always is; a few texts at the rates assumed at first keep small samples sane."""
    clean, sure = score <= np.median(score), score >= 0.9
    alarm = float((judged[clean].sum() + 50 * ALARM) / (clean.sum() + 50))
    return max(2 * alarm, float((judged[sure].sum() + 20 * RECALL) / (sure.sum() + 20))), alarm


def cut(score: np.ndarray, judged: np.ndarray, recall: float, alarm: float) -> float:
    """The score from which on the best balance of misses and false alarms is expected. How many of a score are abusive is the share
    judged so, made to fall with the score, less what the judgement's errors make of it."""
    order = np.argsort(-score, kind="stable")
    share = np.clip((_falling(judged[order].astype(float)) - alarm) / (recall - alarm), 0, 1)
    balance = 2 * np.cumsum(share) / (np.arange(1, len(share) + 1) + share.sum() + 1e-9)
    k = int(balance.argmax())
    below = score[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((score[order[k]] + below) / 2)


def fit(texts: list[tuple[str, bool]], least: int = 4, seed: int = 1, each_of=map, **how) -> Machine:
    """(text, judged abusive) rows to a machine; `each_of` maps a function over the parts, if need be elsewhere.

    Each of four parts of the texts is scored by a machine fitted to the others: these scores tell how often the judgement is wrong and from which
    score on a text counts as abusive. Then a machine is fitted to all, with the judgement's errors known."""
    own = [(stretches(t), y) for t, y in texts]
    often = Counter(h for ws in {tuple(sorted({*ws})) for ws, _ in own} for h in {h for w in ws for h in w})
    at = {h: k for k, h in enumerate(h for h, n in often.items() if n >= least)}
    number: dict[tuple[int, ...], int] = {}
    own = [([*{number.setdefault(tuple([at[h] for h in w if h in at]), len(number)) for w in ws}], y) for ws, y in own if ws]
    rows, judged = [*number], np.array([y for _, y in own], bool)
    none = Machine(-50.0, at, np.zeros(len(at)), np.zeros((len(at), 1)))
    if not at or not judged.any():
        return none
    score = np.zeros(len(own))
    parts = [np.arange(len(own)) % PARTS == k for k in range(PARTS)]
    jobs = [([x for x, out in zip(own, part) if not out], rows, at, RECALL, ALARM) for part in parts]
    for part, m in zip(parts, each_of(partial(_tried, seed=seed, **how), jobs)):
        score[part] = _worst((m or none).all(rows), [x for x, out in zip(own, part) if out])[1]
    recall, alarm = noise(score, judged)
    m = _fitted(own, rows, at, recall, alarm, seed=seed, **how)
    m.recall, m.alarm, m.threshold = recall, alarm, cut(score, judged, recall, alarm)
    return m


def _tried(job: tuple, **how) -> Machine | None:
    return _fitted(*job, **how) if any(y for _, y in job[0]) else None


def _worst(p: np.ndarray, own: list[tuple[list[int], bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its worst stretch, and that one's score."""
    worst = np.array([ws[int(p[ws].argmax())] for ws, _ in own], np.int64)
    return worst, p[worst]


def _fitted(own: list[tuple[list[int], bool]], rows: list[tuple[int, ...]], at: dict[int, int], recall: float, alarm: float, factors: int = 4, epochs: int = 30, rate: float = 0.3, rounds: int = 3, seed: int = 1) -> Machine:
    """First to the judgements, then to each text's own state as its judgement and its worst stretch tell it together."""
    rng = np.random.default_rng(seed)
    m = Machine(-3.0, at, np.zeros(len(at)), rng.normal(0, 0.02, (len(at), factors)))
    judged = np.array([y for _, y in own], bool)
    for r in range(rounds):
        yes, no = np.zeros(len(rows)), np.zeros(len(rows))
        if r == 0:  # as judged: of a text's stretches, those that are seldom in other texts stand out
            for ws, y in own:
                (yes if y else no)[ws] += 1
        else:
            p = m.all(rows)
            p = np.clip((p - alarm) / (recall - alarm), 1e-6, 1 - 1e-6) if r == 1 else np.clip(p, 1e-6, 1 - 1e-6)
            worst, q = _worst(p, own)
            q = q * np.where(judged, recall, 1 - recall) / (q * np.where(judged, recall, 1 - recall) + (1 - q) * np.where(judged, alarm, 1 - alarm))
            for (ws, _), k, x in zip(own, worst, q):
                yes[k] += x
                no[ws] += 1
                no[k] -= x
        pick = [k for k, w in enumerate(rows) if w and yes[k] + no[k] > 0]
        m = _descend(m, [rows[k] for k in pick], yes[pick], no[pick], epochs, rate, rng)
    return m


def _falling(y: np.ndarray) -> np.ndarray:
    """The closest values to y that never rise: neighbours that do are pooled."""
    value, size = [], []
    for x in y.tolist():
        value.append(x)
        size.append(1)
        while len(value) > 1 and value[-1] >= value[-2]:
            v, n = value.pop(), size.pop()
            value[-1] = (value[-1] * size[-1] + v * n) / (size[-1] + n)
            size[-1] += n
    return np.repeat(value, size)


def _descend(m: Machine, rows: list[tuple[int, ...]], yes: np.ndarray, no: np.ndarray, epochs: int, rate: float, rng, prior: tuple[float, float] = (1.0, 8.0)) -> Machine:
    """Adagrad on the weighted likelihood, with normal priors of these precisions on w and v."""
    w0, w, v = m.w0, m.w.copy(), m.v.copy()
    total = float((yes + no).sum())
    g0, gw, gv = 1e-8, np.full(len(w), 1e-8), np.full(v.shape, 1e-8)
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate([np.array(r) for r in rows])
    begin = np.cumsum(sizes) - sizes
    batch = max(512, min(4096, len(rows) // 4 + 1))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            part = len(pick) / len(rows)
            n = sizes[pick]
            cut = np.cumsum(n) - n
            idx = flat[np.repeat(begin[pick] - cut, n) + np.arange(n.sum())]
            row = np.repeat(np.arange(len(pick)), n)
            vi = v[idx]
            s = np.add.reduceat(vi, cut)
            x = w0 + np.add.reduceat(w[idx], cut) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vi * vi).sum(axis=1), cut))
            p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            e = ((yes + no)[pick] * p - yes[pick]) / total
            g = float(e.sum())
            g0 += g * g
            w0 -= rate * g / math.sqrt(g0)
            near, inverse = np.unique(idx, return_inverse=True)
            d = np.bincount(inverse, e[row], len(near)) + prior[0] / total * part * w[near]
            gw[near] += d * d
            w[near] -= rate * d / np.sqrt(gw[near])
            each = e[row][:, None] * (s[row] - vi)
            for f in range(v.shape[1]):
                d = np.bincount(inverse, each[:, f], len(near)) + prior[1] / total * part * v[near, f]
                gv[near, f] += d * d
                v[near, f] -= rate * 0.2 * d / np.sqrt(gv[near, f])
    return Machine(w0, m.at, w, v)


def fit_on(posts: DataFrame, judgements: DataFrame, sample: int = 40_000) -> Machine:
    """A machine from posts (id, text) and judgements (id, category), of which about `sample` ids, chosen by hash, are used."""
    j = judgements.where("id is not null and category is not null").groupBy("id").agg(F.max((F.lower(F.trim("category")) == LABEL).cast("int")).alias("y"))
    n = j.count()
    part = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n)))
    texts = posts.where(part & not_blank("text")).groupBy("id").agg(F.min("text").alias("text"))
    rows = texts.join(j.where(part), "id").select("id", "text", "y").limit(2 * sample).collect()
    m = fit([(r["text"], bool(r["y"])) for r in sorted(rows)], each_of=on_executors(posts.sparkSession))
    check_broadcast(deep_size(m.at) + m.v.nbytes)
    return m


def _run(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for b in batches:
        scores = [machine.text(t) if t and not t.isspace() else None for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["id", "score"])


def scored(posts: DataFrame, machine: Machine) -> DataFrame:
    """(id, text) to (id, score), one row per id."""
    rows = posts.where("id is not null").select("id", "text").mapInArrow(partial(_run, machine=machine), "id bigint, score double")
    return rows.groupBy("id").agg(F.max("score").alias("score"))


def _in(s, d: str) -> tuple[DataFrame, DataFrame]:
    return table(s, d, "dataset").select("id", F.col("post_text").alias("text")), table(s, d, "intelligence_result").select(F.col("post_id").alias("id"), "category")


def p4_found(s, d: str) -> DataFrame:
    posts, judged = _in(s, d)
    m = fit_on(posts, judged)
    return scored(posts, m).where(F.col("score") >= m.threshold).select("id")


def p4_scores(s, d: str) -> DataFrame:
    """Every post's score, and whether it counts as abusive."""
    posts, judged = _in(s, d)
    m = fit_on(posts, judged)
    return scored(posts, m).withColumn("abusive", F.col("score") >= m.threshold)


def p4_rates(s, d: str) -> DataFrame:
    """For each platform: its posts with text, and how many and what share of them are abusive."""
    platforms = table(s, d, "dataset").where("id is not null").groupBy("id").agg(F.min(F.lower(F.trim("platform"))).alias("platform"))
    r = p4_scores(s, d).where("score is not null").join(platforms, "id").groupBy("platform")
    r = r.agg(F.count("*").alias("n_posts"), F.count_if("abusive").alias("n_abusive"))
    return r.withColumn("share", F.round(F.col("n_abusive") / F.col("n_posts"), 6))


QUERIES = {"p4_found": p4_found, "p4_scores": p4_scores, "p4_rates": p4_rates}
