"""Problem 2: records that differ only in spacing, case, punctuation or field order.

The code points of a batch go through one table that maps skipped characters to 0 and the others to their folded form, into
polynomial hashes by two primes; the canonical strings are never made. A post of `name: value` fields gets the sum of its
distinct fields' hashes, so their order doesn't matter. Rows that meet in a hash are then compared with the group's
representative by two pointers that skip; the few that only collide are grouped again by a digest of their folded characters.
Where a name of several words begins can't always be told, so posts of fields meet by their plain sequence too, and groups that
share a post either way become one (contraction of the few edges between groups).

Null and blank texts and those without a letter, mark or digit are in no group; a repeated id counts once. A group of a third
of all rows is one aggregated row, and its rows are checked in as many tasks as AQE splits the join into.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vakya.llm.base import WORD_KINDS, Sieve, assigned, not_blank, release, table, written

PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 998_244_353)
_name = r"\p{L}[\p{L}\p{M}\p{N}_]*"
_open = r"""["'“”‘’*`]*"""
FIELD = regex.compile(rf"(?:(?:^|[\n\t|;,{{/•·▪◦●►]|\s[-–—*]\s)[^\p{{L}}\p{{M}}\p{{N}}]*({_name}(?: {_name}){{0,2}})|(?<![\p{{L}}\p{{M}}\p{{N}}#@/&]){_open}({_name})){_open}\s*[:=](?!/)")
START = regex.compile(rf"[^\p{{L}}\p{{M}}\p{{N}}]*{_name}(?: {_name}){{0,2}}{_open}\s*[:=](?!/)")


class Fold:
    """The skip-and-fold table."""

    def __init__(self) -> None:
        self.to, self.longer = np.zeros(0x110000, np.uint32), {}
        for p in assigned():
            c = chr(p)
            if unicodedata.category(c)[0] in WORD_KINDS:
                f = c.casefold()
                self.to[p] = ord(f[0])
                if len(f) > 1:
                    self.longer[p] = f
        self.has_longer = regex.compile("[" + "".join(map(chr, self.longer)) + "]")
        self.powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def power(self, k: int, n: int) -> np.ndarray:
        have = self.powers[k]
        if len(have) < n:
            x, out = int(have[-1]), have.tolist()
            for _ in range(max(n, 2 * len(have)) - len(have)):
                x = x * BASES[k] % PRIMES[k]
                out.append(x)
            self.powers[k] = have = np.array(out, np.uint64)
        return have

    def hashes(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A 62-bit hash and the number of characters that count, for each unit."""
        units = [u.translate(self.longer) if self.has_longer.search(u) else u for u in units]
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        v = self.to[codes]
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        before = np.concatenate(([0], np.cumsum(v > 0)))
        stop = before[ends]
        n = np.diff(stop, prepend=0)
        v = v[v > 0].astype(np.uint64)
        exponent = np.repeat(stop, n) - 1 - np.arange(len(v))
        out = np.zeros(len(units), np.uint64)
        for k, p in enumerate(PRIMES):
            terms = v * self.power(k, int(n.max(initial=0)) + 1)[exponent] % np.uint64(p)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))  # one signed or float part would make all of it float
            total = sums[np.concatenate(([0], stop))]
            out = out << np.uint64(31) | np.diff(total) % np.uint64(p)
        return out, n

    def same(self, a: str, b: str) -> bool:
        """Whether two texts hold the same characters, by two pointers that skip."""
        to, i, j = self.to, 0, 0
        if self.has_longer.search(a) or self.has_longer.search(b):
            a, b = a.translate(self.longer), b.translate(self.longer)
        x, y = to[np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist(), to[np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        while True:
            while i < len(x) and not x[i]:
                i += 1
            while j < len(y) and not y[j]:
                j += 1
            if i == len(x) or j == len(y):
                return i == len(x) and j == len(y)
            if x[i] != y[j]:
                return False
            i, j = i + 1, j + 1


_fold: Fold | None = None


def fold() -> Fold:
    global _fold
    if _fold is None:
        _fold = Fold()
    return _fold


def fields(text: str) -> list[tuple[str, str]] | None:
    """The fields of a post that consists of them, else None."""
    if (":" not in text and "=" not in text) or not START.match(text):
        return None
    found = [*FIELD.finditer(text)]
    if len(found) < 2:
        return None
    stops = [m.start() for m in found[1:]] + [len(text)]
    return [(m[1] or m[2], text[m.end() : stop]) for m, stop in zip(found, stops)]


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * np.uint64(0x9E3779B97F4A7C15) ^ (y + np.uint64(0x632BE59BD9B4E019))
    z = (z ^ z >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ z >> np.uint64(32)


def text_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each text, and how many characters of it count."""
    units, form = [], {}
    for i, t in enumerate(texts):
        if f := fields(t):
            form[i] = (len(units), len(f))
            units += [x for pair in f for x in pair]
        else:
            units.append(t)
    h, n = fold().hashes(units)
    start, at = np.zeros(len(texts), np.int64), 0
    for i in range(len(texts)):
        start[i] = at
        at += 2 * form[i][1] if i in form else 1
    out, size = h[start] if len(texts) else h, n[start] if len(texts) else n
    for i, (a, k) in form.items():
        pair = np.unique(_mix(h[a : a + 2 * k : 2], h[a + 1 : a + 2 * k : 2]))
        out[i], size[i] = np.uint64(int(pair.sum()) & (2**63 - 1) | 2**63), -len(pair)
    return out, size


def same_record(a: str, b: str) -> bool:
    """The exact comparison behind the hashes."""
    f, g, same = fields(a), fields(b), fold().same
    if not f or not g:
        return not f and not g and same(a, b)
    return all(any(same(n, m) and same(v, w) for m, w in g) for n, v in f) and all(any(same(n, m) and same(v, w) for n, v in f) for m, w in g)


def digest(text: str, plain: bool = False) -> bytes:
    """Of the characters that count; only for rows whose hash collides."""
    to = fold()

    def one(s: str) -> bytes:
        v = to.to[np.frombuffer(s.translate(to.longer).encode("utf-32-le", "surrogatepass"), np.uint32)]
        return xxhash.xxh3_128_digest(v[v > 0].tobytes())

    f = None if plain else fields(text)
    return xxhash.xxh3_128_digest(b"".join(sorted({one(n) + one(v) for n, v in f}))) if f else one(text)


#: Added to the size of a post of fields where its plain sequence is hashed.
PLAIN = 1 << 40


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        h, n = text_hashes(texts)
        form = np.flatnonzero(n < 0)
        g, m = fold().hashes([texts[i] for i in form]) if len(form) else (h[:0], n[:0])
        rows = pa.array(np.concatenate((np.flatnonzero(n), form)))
        h, n = np.concatenate((h[n != 0], g)), np.concatenate((n[n != 0], m + PLAIN)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), pa.array(h.view(np.int64)), pa.array(n)], names=["id", "tag", "hash", "size"])


@F.pandas_udf(T.BooleanType())
def _same(a: pd.Series, b: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([x == y or (fold().same if n >= PLAIN else same_record)(x, y) for x, y, n in zip(a, b, size)], dtype=bool)


@F.pandas_udf(T.BinaryType())
def _digest(a: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([digest(x, n >= PLAIN) for x, n in zip(a, size)], dtype=object)


def components(edges: DataFrame) -> DataFrame | None:
    """(a, b) to (node, least): every node that isn't the least of its component with that. Each round moves all ends to their least neighbours."""
    found = None
    while not (edges := written(edges.where("a <> b").distinct())).isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")))
        if found is None:
            found = least.select(F.col("a").alias("node"), F.col("to").alias("least"))
        else:
            found = written(found.join(least.withColumnRenamed("a", "least"), "least", "left").select("node", F.coalesce("to", "least").alias("least")))
        edges = edges.join(least.withColumnRenamed("to", "x"), "a").join(least.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return found and found.where("node <> least")


def format_copies(posts: DataFrame) -> DataFrame:
    """(id, text) to (keep_id, copy_id): the least id of each set of copies with each other id."""
    texts = posts.where(F.col("id").isNotNull() & not_blank("text")).select("id", "text", F.xxhash64("text").alias("tag"))
    rows = written(texts.mapInArrow(_hashed, "id bigint, tag bigint, hash bigint, size bigint"))
    heads = written(rows.groupBy("hash", "size").agg(F.min("id").alias("keep_id"), F.max("id").alias("last")).where("keep_id < last").drop("last"))
    recurring = Sieve(heads, "hash").pass_through(rows, "hash")  # most posts have no copy, and stop here
    met = written(recurring.join(heads, ["hash", "size"]).distinct())
    release(rows)
    members = written(Sieve(met, "id").pass_through(texts, "id").distinct().join(met, ["id", "tag"]))
    # The least id may be delivered twice with one text; one row of it stands for the group.
    head_text = members.where("id = keep_id").groupBy("hash", "size").agg(F.min("text").alias("head_text"))
    checked = members.where("id > keep_id").join(head_text, ["hash", "size"]).withColumn("same", _same("text", "head_text", "size"))
    good = checked.where("same").select("keep_id", F.col("id").alias("copy_id"), "size")
    odd = checked.where("not same").select("id", "hash", "size", _digest("text", "size").alias("digest"))
    odd_heads = odd.groupBy("hash", "size", "digest").agg(F.min("id").alias("keep_id"))
    again = odd.join(odd_heads, ["hash", "size", "digest"]).where("id > keep_id").select("keep_id", F.col("id").alias("copy_id"), "size")
    pairs = written(good.unionAll(again).select("keep_id", "copy_id", (F.col("size") >= PLAIN).alias("plain")).distinct())
    first, second = pairs.where("not plain").drop("plain"), pairs.where("plain").drop("plain")
    of = lambda name, to: first.select(F.col("copy_id").alias(name), F.col("keep_id").alias(to))
    ends = second.join(of("keep_id", "x"), "keep_id", "left").join(of("copy_id", "y"), "copy_id", "left")
    moved = components(ends.select(F.coalesce("x", "keep_id").alias("a"), F.coalesce("y", "copy_id").alias("b")))
    if moved is None:
        return first
    kept = first.join(moved.withColumnRenamed("node", "keep_id"), "keep_id", "left").select(F.coalesce("least", "keep_id").alias("keep_id"), "copy_id")
    return kept.unionAll(moved.select(F.col("least").alias("keep_id"), F.col("node").alias("copy_id"))).distinct()


def copy_counts(posts: DataFrame) -> DataFrame:
    """(id, text) to one row per record: keep_id and the number of its copies, itself included. Texts that are no cases have none."""
    pairs = format_copies(posts)
    n = pairs.groupBy("keep_id").agg((F.count("*") + 1).alias("n_copies"))
    ids = posts.where(F.col("id").isNotNull() & not_blank("text")).select("id").distinct()
    kept = ids.join(pairs.select(F.col("copy_id").alias("id")), "id", "left_anti").withColumnRenamed("id", "keep_id")
    return kept.join(n, "keep_id", "left").select("keep_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def _posts(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dataset").select("id", F.col("post_text").alias("text"))


QUERIES = {"p2_found": lambda s, d: format_copies(_posts(s, d)), "p2_records": lambda s, d: copy_counts(_posts(s, d))}
