"""Problem 6: the language of each text and of each stretch of it.

A word's probability in a language sums over all its segmentations into pieces of a fixed public vocabulary (a forward algorithm
over its bytes), with each language's own piece probabilities. These are fitted by expectation maximisation to a sample of
labelled rows of bounded size; the labels being partly wrong, rows are labelled anew by the model and fitted again. Which
languages a script may hold comes from the sample too. Where it's but one, what its text is weighed against is a language without
habits, in which all letters of the script are as likely, so the confidence says how much a stretch reads like the language. Within a run of
a script with several, the languages of the words are found together (Viterbi, with a cost for switching).

Addresses, links, handles, hashtags and words with digits don't count, nor do Latin words capitalised within a sentence (names).
A language counts as spoken in a text where a whole sentence is in it, however short, or a stretch of `least` words in a row; else the
one with most evidence is. Sentences end at sentence signs and line ends; a short one must be told by its script or by a clear margin.
Null or blank texts and those without words have no language and no segment; repeated rows count once.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vakya.llm.base import check_broadcast, deep_size, not_blank, on_executors, table, tokenizers, word_pattern
from vakya.llm.looks import transducer
from vakya.llm.pii import ADDRESS, DISGUISED, HAS_STREET, SIGN

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Codes of languages, two and three letters.
CODES = {"eng": "en", "hin": "hi", "tel": "te", "tam": "ta", "kan": "kn", "mal": "ml", "mar": "mr", "ben": "bn", "guj": "gu", "pan": "pa", "urd": "ur"}
LANGUAGES = tuple(CODES.values())
# First and last code points of scripts.
SCRIPTS = {"deva": (0x900, 0x97F), "beng": (0x980, 0x9FF), "guru": (0xA00, 0xA7F), "gujr": (0xA80, 0xAFF), "taml": (0xB80, 0xBFF), "telu": (0xC00, 0xC7F), "knda": (0xC80, 0xCFF), "mlym": (0xD00, 0xD7F), "arab": (0x600, 0x6FF)}
SKIP = re.compile(r"https?://\S+|www\.\S+|[#@]\w+|\S*@\S*|</?\w+>|&\w+;", re.I)
#: Ends of sentences; a full stop only before a blank or closing sign.
ENDS = re.compile(r"[\n!?।॥۔؟]|\.(?=[\s\"'”’)\]]|$)")
SHORTENED = frozenset("rs no dr mr mrs ms st smt shri sri prof vs etc".split())
FLOOR, SWITCH, SENTENCE_SWITCH = 1e-7, 9.0, 3.0


def script_of(word: str) -> str:
    p = ord(word[0])
    if p < 0x250:
        return "latn"
    for name, (a, b) in SCRIPTS.items():
        if a <= p <= b:
            return name
    return "other"


def words_in(text: str) -> list[tuple[str, int, int, bool]]:
    """(word in lower case, start, end, is a name) of the plain form, in order; what doesn't count is left out."""
    if SIGN.search(text) or " dot " in text or "[" in text or "(" in text:
        text = DISGUISED.sub(lambda m: " " * len(m[0]), text)
    if HAS_STREET.search(text.lower()):
        text = ADDRESS.sub(lambda m: " " * len(m[0]), text)
    text = SKIP.sub(lambda m: " " * len(m[0]), text)
    out, last = [], 0
    for m in word_pattern().of(text).finditer(text):
        w = m[0]
        if any(map(str.isdecimal, w)):
            last = m.end()
            continue
        begins = not out or any(c in ".!?|\n:;\"" for c in text[last : m.start()])
        name = not begins and w[0].isupper() and w[1:].islower() and w[0] < "ɐ"
        out.append((w.lower(), m.start(), m.end(), name))
        last = m.end()
    return out


def sentences(text: str, words: list[tuple[str, int, int, bool]]) -> list[int]:
    """The number of the sentence that each word is in."""
    out, n = [], 0
    for i, w in enumerate(words):
        if i:
            last, a, b, _ = words[i - 1]
            if (m := ENDS.search(text, b, w[1])) and not (m[0] == "." and m.start() == b and (b - a == 1 or last in SHORTENED)):
                n += 1
        out.append(n)
    return out


def lines_form(text: str) -> str:
    """The plain form with line ends kept, which stand where it has blanks."""
    form = transducer().form
    return "\n".join(x for line in text.splitlines() if (x := form(line))) if "\n" in text or "\r" in text else form(text)


class Model:
    """Piece probabilities by script: pieces[script] maps a piece to a tuple over langs[script]."""

    def __init__(self, langs: dict[str, list[str]], pieces: dict[str, dict[bytes, tuple[float, ...]]]) -> None:
        self.langs, self.pieces, self.known = langs, pieces, {}
        self.longest = {s: max(map(len, of), default=1) for s, of in pieces.items()}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def score(self, word: str, script: str) -> list[float]:
        """The word's log probability in each language of the script, all segmentations summed; in a script of one, in that and without habits."""
        key = word
        if (s := self.known.get(key)) is not None:
            return s
        if len(self.known) > 300_000:
            self.known.clear()
        s = self.known[key] = forward(word, self.pieces[script], max(2, len(self.langs[script])), self.longest[script])
        return s


def forward(word: str, pieces: dict[bytes, tuple[float, ...]], k: int, longest: int = 0) -> list[float]:
    text = (" " + word).encode()
    n = len(text)
    longest = longest or max(map(len, pieces))
    if k == 2 and n <= 96:  # most words; plain sums are quicker
        one, two, get = [1.0] + [0.0] * n, [1.0] + [0.0] * n, pieces.get
        for i in range(n):
            if (x := one[i]) or two[i]:
                y = two[i]
                for j in range(i + 1, min(n, i + longest) + 1):
                    if p := get(text[i:j]):
                        one[j] += x * p[0]
                        two[j] += y * p[1]
        return [math.log(x) if x > 0 else -700.0 for x in (one[n], two[n])]
    at = [None] * (n + 1)
    at[0] = (1.0,) * k
    shift = 0.0
    get = pieces.get
    for i in range(n):
        a = at[i]
        if a is None:
            continue
        if i and i % 48 == 0 and (top := max(a)) > 0:  # keeps long words from underflow
            shift += math.log(top)
            for j in range(i, min(n, i + longest) + 1):
                if at[j] is not None:
                    at[j] = tuple(x / top for x in at[j])
            a = at[i]
        for j in range(i + 1, min(n, i + longest) + 1):
            p = get(text[i:j])
            if p is not None:
                b = at[j]
                at[j] = tuple([x * y for x, y in zip(a, p)]) if b is None else tuple([z + x * y for x, y, z in zip(a, p, b)])
    return [math.log(x) + shift if x > 0 else -700.0 for x in at[n]] if at[n] else [-700.0] * k


def _expected(word: str, count: float, probability: dict[bytes, float], into: dict[bytes, float], longest: int, singles: dict[bytes, tuple[float]]) -> None:
    """Add the expected number of each piece over the word's segmentations. Probabilities are scaled by byte, by as much as the whole word
    is likely, so words of any length stay within the range of numbers."""
    text = (" " + word).encode()
    n = len(text)
    scale = [1.0] * (longest + 1)
    if n > 96:
        (whole,) = forward(word, singles, 1, longest)
        scale = [math.exp(min(700.0, -whole * k / n)) for k in range(longest + 1)]
    a, arcs = [0.0] * (n + 1), []
    a[0] = 1.0
    for i in range(n):
        if a[i]:
            for j in range(i + 1, min(n, i + longest) + 1):
                if p := probability.get(text[i:j]):
                    p *= scale[j - i]
                    a[j] += a[i] * p
                    arcs.append((i, j, p))
    if not a[n]:
        return
    b = [0.0] * (n + 1)
    b[n] = 1.0
    for i, j, p in reversed(arcs):
        b[i] += p * b[j]
    for i, j, p in arcs:
        x = text[i:j]
        into[x] = into.get(x, 0.0) + count * a[i] * p * b[j] / a[n]


def read_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def fit(rows: list[tuple[str, str]], vocabulary: list[bytes], rounds: int = 3, own_share: float = 0.2, each_of=map) -> Model:
    """(label, text) rows to a model; `each_of` maps a function over the scripts, if need be elsewhere.

    A script may hold the language it's most labelled with and those with words of their own: words mostly labelled so, which
    make up `own_share` of the label's words. Wrong labels have none, as theirs are the words of another language."""
    form = transducer().form
    units = []  # (script, label, words) of each text
    for label, text in rows:
        by: dict[str, list[str]] = defaultdict(list)
        for w, _, _, name in words_in(form(text)):
            if not name:
                by[script_of(w)].append(w)
        units += [(s, label, ws) for s, ws in by.items() if s != "other"]
    each: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    for s, label, ws in units:
        for w in ws:
            each[s][w][label] += 1
    langs = {}
    for s, words in each.items():
        common, own = Counter(), Counter()
        for c in words.values():
            n = sum(c.values())
            if n >= 5:
                common.update(c)
                label, k = c.most_common(1)[0]
                if k > n / 2:
                    own[label] += k
        total = common or Counter(x for c in words.values() for x in c)
        most = total.most_common(1)[0][0]
        langs[s] = sorted(x for x in total if x == most or own[x] > own_share * common[x])
    often = Counter(w for _, _, ws in units for w in ws)
    todo = [(s, of, [(label, [w for w in ws if often[w] > 1]) for t, label, ws in units if t == s]) for s, of in langs.items()]
    pieces = dict(zip(langs, each_of(partial(_pieces, vocabulary=vocabulary, rounds=rounds), todo)))
    return Model(langs, pieces)


def _without_habits(pieces: dict[bytes, tuple[float, ...]]) -> list[float]:
    """The same pieces' probabilities in a language in which all letters of the script are as likely: what tells letters apart, the last
    byte of a letter or an ASCII letter, shares what all of them have; pieces of several letters are gone."""
    last = lambda y: len(y) == 1 and (0x80 <= y[0] < 0xC0 or chr(y[0]).isalpha())
    rest = lambda y: y == b" " or (y[-1] >= 0x80 and not y.decode(errors="ignore").strip())
    of = [y for y in pieces if last(y)]
    share = sum(p for y, (p,) in pieces.items() if last(y) or not rest(y)) / max(1, len(of) if any(y[0] < 0x80 and pieces[y][0] > 2 * FLOOR for y in of) else 64)
    return [share if last(y) else p if rest(y) else FLOOR for y, (p,) in pieces.items()]


def _pieces(script: tuple[str, list[str], list[tuple[str, list[str]]]], vocabulary: list[bytes], rounds: int) -> dict[bytes, tuple[float, ...]]:
    """The piece probabilities of one script's languages, from (label, words) of its texts."""
    s, of, own = script
    known = {*vocabulary} | {bytes([k]) for k in range(256)}
    longest = max(map(len, known))
    now = [label if label in of else None for label, _ in own] if len(of) > 1 else [of[0]] * len(own)
    for r in range(rounds if len(of) > 1 else 1):
        counts: dict[str, Counter] = {x: Counter() for x in of}
        for label, (_, ws) in zip(now, own):
            if label:
                counts[label].update(ws)
        tables = {}
        for x in of:
            p: dict[bytes, float] = {}
            for w in counts[x]:
                text = (" " + w).encode()
                for i in range(len(text)):
                    for j in range(i + 1, min(len(text), i + longest) + 1):
                        if text[i:j] in known:
                            p[text[i:j]] = 1.0 / 5000 if j - i > 1 else 1.0 / 50000
            most = max(map(len, p), default=1)
            for _ in range(3):
                e: dict[bytes, float] = {}
                singles = {y: (v,) for y, v in p.items()}
                for w, c in counts[x].items():
                    _expected(w, c, p, e, most, singles)
                n = sum(e.values()) or 1.0
                p = {y: v / n for y, v in e.items() if v / n > FLOOR}
            tables[x] = p
        every = set().union(*tables.values()) | {bytes([k]) for k in range(256)}
        pieces = {y: tuple(tables[x].get(y, 0.0) + FLOOR for x in of) for y in every}
        if len(of) == 1:
            return {y: (p, q) for (y, (p,)), q in zip(pieces.items(), _without_habits(pieces))}
        if r + 1 < rounds:
            m = Model({s: of}, {s: pieces})
            for k, (label, ws) in enumerate(own):
                sums = [0.0] * len(of)
                for w in ws:
                    sums = [a + b for a, b in zip(sums, m.score(w, s))]
                if label in of:
                    sums[of.index(label)] += 5.0
                best = max(sums)
                now[k] = of[sums.index(best)] if sum(v > best - 5.0 for v in sums) == 1 else None
    return pieces


def segments(text: str, model: Model, least: int = 5) -> list[tuple[int, int, str, float, int, bool]]:
    """(start, end, language, confidence, words, holds a whole sentence) of the stretches of a text in plain form."""
    runs: list[tuple[str, list, list]] = []
    every = words_in(text)
    numbers = sentences(text, every)
    size, spoken_size = Counter(numbers), Counter(n for n, w in zip(numbers, every) if not w[3])
    for w, n in zip(every, numbers):
        s = script_of(w[0])
        if not model.langs.get(s):
            continue
        if runs and runs[-1][0] == s:
            runs[-1][1].append(w)
            runs[-1][2].append(n)
        else:
            runs.append((s, [w], [n]))

    def whole(ns: list[int]) -> list[int]:
        # A single word is a call or a name rather than a sentence.
        return [n for n, c in Counter(ns).items() if c == size[n] and spoken_size[n] > 1]

    out: list[list] = []
    for s, ws, ns in runs:
        of = model.langs[s]
        k = len(of)
        if k == 1:
            own, none = (sum(x) for x in zip(*(model.score(w, s) for w, *_ in ws)))
            out.append([ws[0][1], ws[-1][2], of[0], 1.0 / (1.0 + math.exp(max(-700.0, min(700.0, none - own)))), len(ws), bool(whole(ns))])
            continue
        zero = [0.0] * k
        scores = [zero if name else model.score(w, s) for w, _, _, name in ws]
        best, back = scores[0], []
        for i, x in enumerate(scores[1:]):
            cost = SWITCH if ns[i] == ns[i + 1] else SENTENCE_SWITCH
            top = max(range(k), key=best.__getitem__)
            come = [j if best[j] >= best[top] - cost else top for j in range(k)]
            best = [(best[j] if come[j] == j else best[top] - cost) + x[j] for j in range(k)]
            back.append(come)
        j = max(range(k), key=best.__getitem__)
        path = [j]
        for come in reversed(back):
            j = come[j]
            path.append(j)
        path.reverse()

        def clear(a: int, b: int, j: int) -> bool:
            """Whether the words from a to b hold a whole sentence that is clearly in language j."""
            for n in whole(ns[a:b]):
                sums = [sum(x) for x in zip(*(scores[q] for q in range(a, b) if ns[q] == n))]
                if all(sums[j] - v >= SWITCH for q, v in enumerate(sums) if q != j):
                    return True
            return False

        # Stretches too short to be more than borrowed words, unless they hold a sentence, go with the stretch before or after.
        cuts = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
        heard = [0]
        for w in ws:
            heard.append(heard[-1] + (not w[3]))
        parts = [[a, b, path[a]] for a, b in zip(cuts, cuts[1:])]
        while len(parts) > 1:
            short = [i for i, (a, b, j) in enumerate(parts) if heard[b] - heard[a] < least and not clear(a, b, j)]
            if not short:
                break
            i = min(short, key=lambda i: heard[parts[i][1]] - heard[parts[i][0]])
            a, b, _ = parts[i]
            q = i - 1 if i == len(parts) - 1 or (i and parts[i - 1][1] - parts[i - 1][0] >= parts[i + 1][1] - parts[i + 1][0]) else i + 1
            parts[q] = [min(a, parts[q][0]), max(b, parts[q][1]), parts[q][2]]
            del parts[i]
            first = min(q, i)
            for x in (first + 1, first):  # neighbours that now agree become one
                if 0 < x < len(parts) and parts[x][2] == parts[x - 1][2]:
                    parts[x - 1][1] = parts[x][1]
                    del parts[x]
        for a, b, _ in parts:
            sums = [sum(x) for x in zip(*scores[a:b])]
            top = max(sums)
            j = sums.index(top)
            out.append([ws[a][1], ws[b - 1][2], of[j], 1.0 / sum(math.exp(max(-700.0, v - top)) for v in sums), heard[b] - heard[a], clear(a, b, j)])
    joined: list[list] = []
    for x in out:
        if joined and joined[-1][2] == x[2]:
            joined[-1][1], joined[-1][3], joined[-1][4], joined[-1][5] = x[1], max(joined[-1][3], x[3]), joined[-1][4] + x[4], joined[-1][5] or x[5]
        else:
            joined.append(x)
    return [tuple(x) for x in joined]


def spoken(parts: list[tuple[int, int, str, float, int, bool]], least: int = 5) -> list[tuple[str, float]]:
    """The languages of a text: those with a whole sentence or a stretch of `least` words, else the one with most words."""
    words, sure, long = Counter(), {}, set()
    for _, _, lang, p, n, sentence in parts:
        words[lang] += n
        sure[lang] = max(sure.get(lang, 0.0), p)
        if sentence or n >= least:
            long.add(lang)
    if not words:
        return []
    if len(long) > 1:
        return sorted((x, sure[x]) for x in long)
    x = next(iter(long)) if long else max(words, key=lambda w: (words[w], sure[w]))
    return [(x, sure[x])]


def plain_code(label: str):
    """Column: the two-letter code of a label in whatever style; null for none of the languages known."""
    x = F.regexp_extract(F.lower(F.trim(F.col(label))), r"^([a-z]+)", 1)
    x = F.coalesce(F.create_map([F.lit(y) for p in CODES.items() for y in p])[x], x)
    return F.when(x.isin(*LANGUAGES), x)


def fit_on(texts: DataFrame, sample: int = 20_000, vocabulary: str | None = None) -> Model:
    """A model from (key, text, label) rows, of which about `sample`, chosen by a hash of their key, are used. The scripts are fitted to on
    the executors, each in a task. `vocabulary` is the path of a file of byte pieces; else it's looked for where the session says."""
    vocabulary = vocabulary or f"{tokenizers(texts.sparkSession)}/{VOCABULARY}"
    rows = texts.where(not_blank("text")).select("key", "text", plain_code("label").alias("label")).where("label is not null")
    n = rows.count()
    part = rows.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n))))
    model = fit([(r["label"], r["text"]) for r in part.select("label", "text").limit(2 * sample).collect()], read_vocabulary(vocabulary), each_of=on_executors(texts.sparkSession))
    check_broadcast(deep_size(model.pieces))
    return model


def _run(batches: Iterator[pa.RecordBatch], model: Model, least: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("language", pa.string()), ("confidence", pa.float64())]))
    part = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("language", pa.string()), ("confidence", pa.float64())]))
    for b in batches:
        found = [segments(lines_form(t), model, least) if t else [] for t in b.column(1).to_pylist()]
        langs = [[{"language": x, "confidence": p} for x, p in spoken(f, least)] for f in found]
        parts = [[{"start": x[0], "stop": x[1], "language": x[2], "confidence": x[3]} for x in f] for f in found]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(langs, kind), pa.array(parts, part)], names=["key", "label", "languages", "segments"])


def languages(texts: DataFrame, model: Model, least: int = 5) -> DataFrame:
    """(key, text, label) to (key, label, languages, segments). Segments count characters of the plain form."""
    schema = "key bigint, label string, languages array<struct<language string, confidence double>>, segments array<struct<start int, stop int, language string, confidence double>>"
    rows = texts.select("key", "text", plain_code("label").alias("label"))
    return rows.mapInArrow(partial(_run, model=model, least=least), schema)


def _results(s, d: str) -> DataFrame:
    return table(s, d, "pipeline_result").select(F.col("result_id").alias("key"), F.col("post_text").alias("text"), F.col("language").alias("label")).where("key is not null")


def p6_found(spark, sf_dir: str) -> DataFrame:
    t = _results(spark, sf_dir)
    found = languages(t, fit_on(t))
    case = (F.size("languages") > 1) | F.col("label").isNull() | (F.col("label") != F.col("languages")[0]["language"])
    return found.where((F.size("languages") > 0) & case).select(F.col("key").alias("result_id"), F.explode("languages.language").alias("language")).distinct()


def p6_segments(spark, sf_dir: str) -> DataFrame:
    t = _results(spark, sf_dir)
    found = languages(t, fit_on(t)).dropDuplicates(["key"])
    return found.select(F.col("key").alias("result_id"), F.posexplode("segments").alias("segment", "s")).select("result_id", "segment", "s.start", "s.stop", "s.language", F.round("s.confidence", 4).alias("confidence"))


QUERIES = {"p6_found": p6_found, "p6_segments": p6_segments}
