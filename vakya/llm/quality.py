"""Problem 10: per-document statistics that tell prose from lists, tables and junk.

Each line is read as prose, list item, table row or junk; a document is what more than half of it is, in the mean of its share of
lines and of characters. Repetition statistics (duplicate lines and paragraphs, the characters that the commonest pair of words and
repeated n-grams take up) and others that need the whole text (mis-decoded characters, scattered letters, mere tags) decide on
junk first, so boilerplate pasted over and over is told from prose. All of the text is read.

A null text gives null statistics and kind null, a blank one zeros and kind 'empty'; one row per doc_id (rows repeated under one id
count once, the least text should they differ).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vakya.llm.base import Runs, table, word_pattern

# Common function words of the corpus' languages.
COMMON = set(
    """the of and to in is was on for that it with as at by be this are from or an not has have but they we you he she
    में से की के का है पर और को ने यह था नहीं मध्ये आहे आणि हे ला चा होते
    lo ki ni ee ga nunchi mein se ka hai par aur ko ne yeh nahi
    ఈ కి లో నుంచి అని ఇది மற்றும் இந்த என்று இது ஒரு ಈ ಎಂದು ಮತ್ತು ಇದು ഈ എന്ന് ഇത് ഒരു এই ও থেকে করে না આ છે અને માં ના ਇਹ ਹੈ ਵਿੱਚ ਤੋਂ ਦੀ میں سے کی کے کا ہے پر اور""".split()
)
END = ".!?।۔…॥"
BULLET = re.compile(r"^\s*(?:[-*+•‣◦▪●○☐☑✓–—]\s+|\(?(?:\d{1,3}|[a-zA-Z]|[ivxlc]{1,5})[.)]\s+)")
SPEAKER = re.compile(r"^\s*(?:\[[^\]]{0,40}\]\s*|\d{1,2}[:/.]\d{2}\S*\s+(?:-\s*)?)?[\w.+-]{1,30}(?: [\w.+-]{1,20})?(?: wrote)?:(?=\s|$)")
STAMP = re.compile(r"^\s*(?:\[[^\]]{0,40}\d[^\]]{0,40}\]|\d{1,2}[:/.]\d{2}\S*)\s+\S")
GAP = re.compile(r"\s{2,}")
TAG = re.compile(r"(?<!\S)(?:[#@]\w|https?://|www\.)")
BLOB = re.compile(r"(?=\S*[a-z])(?=\S*[A-Z])(?=\S*[\d+/])[A-Za-z0-9+/=]{24,}")
VOWELLESS = re.compile(r"[b-df-hj-np-tv-xz]{3,}")
SYMBOL = re.compile(r"[#-&*+/<-@\[-`{-~]")
SENTENCE = re.compile(rf"[{END}](?=\s|$)")
MOJIBAKE = re.compile(r"[\x80-\xff]")


def cells(line: str) -> tuple[str, list[str]]:
    """The delimiter of a line and what it divides; ('', []) if none does."""
    s = line.strip()
    if "\t" in s:
        return "\t", s.split("\t")
    if s.count("|") >= 2 or " | " in s:
        return "|", [x for x in s.strip("|").split("|")]
    for d in (" · ", " » ", " › ", " > "):
        if d in s:
            return d, s.split(d)
    if len(x := GAP.split(s)) >= 3:
        return "  ", x
    for d in (";", ","):
        if len(x := s.rstrip(d).split(d)) >= 3:
            return d, x
    return "", []


def kind_of_line(line: str, shape: tuple[str, int], common: dict, word: Runs) -> str:
    """'prose', 'list', 'table', 'junk' or '' (says nothing). common: how many lines have a shape."""
    s = line.strip()
    words = word.findall(s)
    if SPEAKER.match(s) and (s.endswith(":") or STAMP.match(s) or len(words) > 4):
        return "" if s.endswith(":") else "prose"
    dense = s.replace(" ", "").replace("|", "")
    if len(SYMBOL.findall(dense)) > 0.3 * len(dense) and len(dense) >= 6 and not set(s) <= set("|-:+= "):
        return "junk"
    tokens = s.split()
    if len(max(tokens, key=len)) >= 24 and len("".join(BLOB.findall(s))) > 0.5 * len(s):
        return "junk"
    if len(tokens) > 2 and len(TAG.findall(s)) > 0.6 * len(tokens):
        return "junk"
    if len("".join(VOWELLESS.findall(s))) > 0.5 * len(dense):
        return "junk"
    d, n = shape
    if d and common[shape] >= 3 and n >= 3 and not (d in ",;" and n > 7 and not re.search(r"\d", s)):
        mean = len(words) / n
        if mean <= 5 and not (d in ", ;" and d != "  " and SENTENCE.search(s) and mean > 3):
            return "table"
    if BULLET.match(line):
        return "list" if len(words) <= 14 else "prose"
    if d in (",", ";") and n >= 6 and len(words) <= 3.6 * n and len(SENTENCE.findall(s)) <= n / 8:
        return "list"
    if d == "\t" or d == "|" or d == "  ":
        return "table" if len(words) <= 5 * n else "prose"
    if not words:
        return ""
    if len(words) >= 9 or (s[-1] in END and len(words) >= 3):
        return "prose"
    return "list"


#: In longer texts of any kind fewer words are new, so different words are counted in windows of so many.
WINDOW = 400


def windowed(words: list[str]) -> float:
    """The share of different words in a window, averaged over windows that cover the text."""
    starts = [*range(0, len(words) - WINDOW, WINDOW), len(words) - WINDOW]
    return sum(len(set(words[k : k + WINDOW])) for k in starts) / WINDOW / len(starts)


def statistics(text: str) -> tuple:
    word = word_pattern()
    words = word.findall(text.lower())
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "empty")
    dense = sum(map(len, text.split()))
    divisions = [*map(cells, lines)]
    shapes = [(d, len(c)) for d, c in divisions]
    common = Counter(shapes)
    by_line, by_char, chars = Counter(), Counter(), 0
    for x, shape in zip(lines, shapes):
        k = kind_of_line(x, shape, common, word)
        if k:
            by_line[k] += 1
            by_char[k] += len(x)
            chars += len(x)
    total = sum(by_line.values()) or 1
    share = {k: (by_line[k] / total + by_char[k] / max(1, chars)) / 2 for k in ("prose", "list", "table", "junk")}
    symbols = len(SYMBOL.findall(text)) / dense
    ends = sum(x.rstrip()[-1] in END for x in lines) / len(lines)
    dup_lines = 1 - len({x.strip() for x in lines}) / len(lines)
    paras = [p.strip() for p in text.split("\n\n") if p.strip()]
    dup_paras = 1 - len(set(paras)) / len(paras)
    size = sum(map(len, words)) or 1
    top, again = 0.0, 0.0
    if n >= 2:
        pairs = Counter(zip(words, words[1:]))
        (a, b), c = pairs.most_common(1)[0]
        top = min(1.0, c * (len(a) + len(b)) / size) if c > 1 else 0.0
        if n >= 5:
            ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
            grams = ids[:-4]
            for k in range(1, 5):
                grams = grams * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - 4 + k]
            _, which, times = np.unique(grams, return_inverse=True, return_counts=True)
            at = np.flatnonzero(times[which] > 1)
            if len(at):
                covered = np.zeros(n, bool)
                for k in range(5):
                    covered[at + k] = True
                again = int(np.fromiter(map(len, words), np.int64, n)[covered].sum()) / size
    tokens = text.split()
    scattered = sum(map((1).__eq__, map(len, tokens))) / len(tokens)
    (delimiter, _), often = common.most_common(1)[0]
    ruled = bool(delimiter) and often >= 3 and often >= 0.6 * len(lines)
    broken = 0.0 if text.isascii() else len(MOJIBAKE.findall(text)) / dense
    different = len(set(words)) / n if n else 0.0
    divided = [c for d, c in divisions if d in ("|", " · ", " » ", " › ", " > ")]
    flat = [x.strip().lower() for c in divided for x in c if x.strip()]
    menu = len(divided) > 0.5 * len(lines) and len(flat) >= 8 and len(set(flat)) < 0.5 * len(flat) and not any(re.search(r"\d", x) for x in flat)
    if (
        broken > 0.3
        or (scattered > 0.55 and dense >= 20 and not ruled)
        or (n >= 12 and again > 0.8 and different < 0.25)
        or (n >= 6 and (different if n <= WINDOW else windowed(words)) < 0.12)
        or (len(lines) >= 6 and dup_lines > 0.6)
        or (len(paras) >= 4 and dup_paras > 0.6)
        or (n >= 12 and top > 0.5)
        or (n >= 60 and again > 0.5 and dup_lines + dup_paras > 0.8)
        or menu
        or share["junk"] > 0.5
        or not words
    ):
        kind = "junk"
    else:
        best = max(("table", "list"), key=share.get)
        kind = best if share[best] > 0.5 else "prose"
        if kind == "prose" and share["table"] + share["list"] > 0.6 and share["prose"] < 0.4:
            kind = best
    return (n, size / n if n else 0.0, symbols, ends, sum(map(COMMON.__contains__, words)) / n if n else 0.0, dup_lines, dup_paras, top, again, share["list"], share["table"], kind)


NAMES = ["n_words", "mean_word_length", "symbol_ratio", "end_punctuation_share", "common_word_share", "duplicate_line_share", "duplicate_paragraph_share", "top_bigram_share", "repeated_ngram_share", "list_share", "table_share", "kind"]
SCHEMA = "doc_id bigint, n_words bigint, " + ", ".join(f"{n} double" for n in NAMES[1:-1]) + ", kind string"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] + [pa.float64()] * (len(NAMES) - 2) + [pa.string()]
    for b in batches:
        rows = [(None,) * len(NAMES) if t is None else statistics(t) for t in b.column(1).to_pylist()]
        cols = list(zip(*rows)) if rows else [()] * len(NAMES)
        yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", *NAMES])


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, text) to one row of statistics per doc_id, with the kind of text. The work is where the text is; only numbers move."""
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(_run, SCHEMA)
    return rows.groupBy("doc_id").agg(F.min(F.struct(*NAMES)).alias("s")).select("doc_id", "s.*")


def _in(s, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "text")


QUERIES = {
    "p10_found": lambda s, d: document_statistics(_in(s, d)).where(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind"),
    "p10_statistics": lambda s, d: document_statistics(_in(s, d)),
}
