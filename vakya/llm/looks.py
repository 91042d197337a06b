"""Problem 5: text that looks the same in one form.

A transducer over grapheme clusters rewrites each text in one pass, the longest cluster first. Its table is compiled before and
checked for conflicts: compatibility forms and combining sequences become the plain (composed) form, characters that don't show
are left out, look-alike letters of other alphabets become Latin ones, under accents too. So form(form(x)) = form(x).
Blanks of any kind count as one space; outer ones are dropped. Case and punctuation stay.

Nulls stay null, blank texts become ''. Neither is a case in `same_look_pairs`, as with keys that are null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vakya.llm.base import Runs, assigned, not_blank, table, written

# Letters that look like Latin ones, by alphabet.
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl үy"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ αa γy ιi κk νv οo ρp υu χx ϲc ϳj"
ARMENIAN = "ՍU ՏS ՕO հh ոn սu օo զq"
LOOKALIKES = {x[0]: x[1] for x in f"{CYRILLIC} {GREEK} {ARMENIAN}".split()}
# Ranges of characters that don't show (default ignorable code points).
UNSEEN = "00AD 034F 061C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0 FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF"


def unseen() -> set[int]:
    out = {p for p in range(0xA0) if unicodedata.category(chr(p)) == "Cc" and not chr(p).isspace()}
    for x in UNSEEN.split():
        a, _, b = x.partition("-")
        out |= {*range(int(a, 16), int(b or a, 16) + 1)}
    return out


def compositions() -> dict[str, tuple[str, str]]:
    """Each composed character of the standard that a letter and a mark come together in, with the two."""
    out = {}
    for p in assigned():
        d = unicodedata.decomposition(chr(p)).split()
        if len(d) == 2 and d[0][0] != "<" and unicodedata.is_normalized("NFC", chr(p)):
            out[chr(p)] = (chr(int(d[0], 16)), chr(int(d[1], 16)))
    return out


class Transducer(dict):
    """From cluster to plain form: a table compiled once a process from the rules, for single characters and for letters that meet
    a mark (of any width), whatever way the letter is written. Longer clusters, with several marks, are worked out when first met and kept.

    A cluster goes as far as characters can join: marks, vowels and finals of Hangul, half-width sound marks and what doesn't show.
    So the plain form of a text is that of its clusters, and compiling proves that each output stays as it is when read again."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.limit, self.skip = limit, unseen()
        self.to = str.maketrans({**{chr(p): None for p in self.skip}, **LOOKALIKES})
        kind, pairs = unicodedata.category, compositions()
        seconds = {b for _, b in pairs.values()} | {chr(p) for p in (*range(0x1160, 0x1176), *range(0x11A8, 0x11C3))}
        joins, ways = [], {}
        for p in assigned():
            if 0xD800 <= p < 0xE000:
                continue
            c = chr(p)
            apart = unicodedata.normalize("NFKD", c)
            if p in self.skip or kind(c)[0] == "M" or apart[0] in seconds:
                joins.append(p)
            if (x := self.plain(c)) != c:
                self._put(c, x)
            if len(apart.translate(self.to)) == 1:
                ways.setdefault(apart.translate(self.to), []).append(c)
        for a, b in pairs.values():
            for x in ways.get(unicodedata.normalize("NFKD", a).translate(self.to), ()):
                for y in ways.get(b, (b,)):
                    if (z := self.plain(x + y)) != x + y:
                        self._put(x + y, z)
        self.odd = Runs(sorted(ord(c) for c in self if len(c) == 1 and unicodedata.is_normalized("NFKC", c)), "[X]")
        self.cluster = Runs(joins, "[^X][X]*|[X]+")
        self.compiled = len(self)

    def plain(self, x: str) -> str:
        """The rules: apart into plain characters, unseen ones out, look-alikes to Latin, together again."""
        return unicodedata.normalize("NFC", unicodedata.normalize("NFKD", x).translate(self.to))

    def _put(self, cluster: str, out: str) -> None:
        """An entry; raises where it would contradict another or its output isn't plain itself."""
        if self.get(cluster, out) != out or self.plain(out) != out:
            raise ValueError(f"conflict at {cluster!r}")
        self[cluster] = out

    def __missing__(self, cluster: str) -> str:
        if len(self) >= self.compiled + self.limit:
            for k in [*self][self.compiled :]:
                del self[k]
        x = self[cluster] = cluster if len(cluster) == 1 else self.plain(cluster)
        return x

    def form(self, text: str) -> str:
        if not text.isascii() and (self.odd.of(text).search(text) or not unicodedata.is_normalized("NFKC", text)):
            text = self.cluster.of(text).sub(lambda m: self[m[0]], text)
        elif text.isascii() and self.odd.basic.search(text):
            text = text.translate(self.to)
        return " ".join(text.split())


_table: Transducer | None = None


def transducer() -> Transducer:
    global _table
    if _table is None:
        _table = Transducer()
    return _table


def plain_form(text: str) -> str:
    return transducer().form(text)


@F.pandas_udf(T.StringType())
def plain_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column function: the text in its one form."""
    form = transducer().form
    for s in batches:
        yield s.map(form, na_action="ignore")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    form, digest = transducer().form, xxhash.xxh3_128_digest
    for b in batches:
        texts = b.column(2).to_pylist()
        look = [digest(form(t)) for t in texts]
        raw = [digest(t) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(look, pa.binary()), pa.array(raw, pa.binary())], names=["src", "key", "look", "raw"])


def look_hashes(texts: DataFrame) -> DataFrame:
    """(src, key, text) to (src, key, look, raw): 128-bit hashes of the plain form and of the text, one row per key."""
    rows = texts.where(F.col("key").isNotNull() & not_blank("text")).select("src", "key", "text")
    return rows.mapInArrow(_digests, "src string, key bigint, look binary, raw binary").dropDuplicates(["src", "key", "raw"])


def same_look_classes(texts: DataFrame) -> DataFrame:
    """(src, key, text) to one row per key: class_key is the least key with the same plain form, n_texts its different texts."""
    h = written(look_hashes(texts))
    g = h.groupBy("src", "look").agg(F.min("key").alias("class_key"), F.count_distinct("raw").alias("n_texts"))
    return h.join(g, ["src", "look"]).select("src", "key", "class_key", "n_texts")


def same_look_pairs(texts: DataFrame) -> DataFrame:
    """(src, key, text) to (src, key_a, key_b): keys of different texts with the same plain form, the smaller first.

    Only forms with several texts go on; these are paired as texts first, each once, and then get their keys. So a text that a
    third of the rows share costs one aggregated row until the pairs asked for are written out."""
    h = written(look_hashes(texts))
    several = h.groupBy("src", "look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("src", "look")
    m = written(h.join(several, ["src", "look"], "left_semi"))
    a, b = (m.select("src", "look", F.col("raw").alias(f"raw_{x}")).distinct() for x in "ab")
    pairs = a.join(b, ["src", "look"]).where("raw_a < raw_b").drop("look")
    x, y = (m.select("src", F.col("raw").alias(f"raw_{x}"), F.col("key").alias(x)) for x in "ab")
    both = pairs.join(x, ["src", "raw_a"]).join(y, ["src", "raw_b"]).where("a <> b")
    return both.select("src", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def both_texts(spark, sf_dir: str, result_text: str) -> DataFrame:
    """Posts and one text of the results as (src, key, text)."""
    posts = table(spark, sf_dir, "dataset").select(F.lit("dataset").alias("src"), F.col("id").alias("key"), F.col("post_text").alias("text"))
    results = table(spark, sf_dir, "pipeline_result").select(F.lit("pipeline_result").alias("src"), F.col("result_id").alias("key"), F.col(result_text).alias("text"))
    return posts.unionAll(results)


def p5_found(spark, sf_dir: str) -> DataFrame:
    return same_look_pairs(both_texts(spark, sf_dir, "cleaned_text"))


def p5_forms(spark, sf_dir: str) -> DataFrame:
    """Every text in its one form."""
    t = both_texts(spark, sf_dir, "cleaned_text")
    return t.select("src", F.col("key").alias("row_id"), plain_text("text").alias("plain_text")).dropDuplicates(["src", "row_id"])


def p5_classes(spark, sf_dir: str) -> DataFrame:
    """One row per text: the least key that looks the same, and how many different texts do."""
    return same_look_classes(both_texts(spark, sf_dir, "cleaned_text"))


QUERIES = {"p5_found": p5_found, "p5_forms": p5_forms, "p5_classes": p5_classes}
