"""What the operators of this subpackage share: reading, cutting lineage, word and code-point tables."""

from __future__ import annotations

import pickle
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vakya.sources.store import release, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


class Sieve:
    """A set of whole numbers as bits, some others passing with them: it lets rows go on to a join that could meet, and loses none.

    Its size follows the number of members up to `most` bits (32 MB), so what is broadcast is bounded; beyond, more others pass."""

    def __init__(self, members: DataFrame, column: str, most: int = 28) -> None:
        n = members.count()
        self.bits = 1 << min(most, max(16, (16 * n).bit_length()))
        at = F.pmod(F.col(column), F.lit(self.bits)) + 1  # positions count from 1
        rows = members.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        self.map = np.zeros(max(4096, self.bits // 8), np.uint8)
        for r in rows.toLocalIterator():
            self.map[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)

    def may_hold(self, x: np.ndarray) -> np.ndarray:
        at = x.astype(np.int64) & (self.bits - 1)
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def pass_through(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose column, without nulls, may be a member."""
        k = rows.columns.index(column)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(self.may_hold(b.column(k).to_numpy(zero_copy_only=False))))

        return rows.mapInArrow(run, rows.schema)


def not_blank(text: str):
    """Column condition: the text has a character other than blanks of any kind."""
    return F.col(text).isNotNull() & F.col(text).rlike(r"[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def ranges(points: Iterable[int]) -> str:
    """The body of a character class of the code points, which ascend."""
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}" + (f"-\\U{b:08x}" if b > a else "") for a, b in out)


def assigned() -> Iterable[int]:
    """Code points of the planes that hold letters, marks and symbols."""
    yield from range(0x20000 + 0xA6E0)
    yield from range(0x2A700, 0x323B0)
    yield from range(0xE0000, 0xE01F0)


#: First letters of the general categories that make up words: letters, combining marks, digits.
WORD_KINDS = "LMN"
#: Beyond the basic plane, letters, marks and digits lie in these ranges only (and seldom occur); pictographs lie outside.
BEYOND = re.compile("[\U00010000-\U0001efff\U0001f100-\U0001f10c\U0001fbf0-\U0001fbf9\U00020000-\U0010ffff]")


class Runs:
    """Finds runs of characters. Classes with ranges beyond the basic plane are slow, so they serve only the texts that need them."""

    def __init__(self, points: list[int], pattern: str) -> None:
        self.basic = re.compile(pattern.replace("X", ranges(p for p in points if p < 0x10000)))
        self.full = re.compile(pattern.replace("X", ranges(points)))

    def of(self, text: str) -> re.Pattern:
        return self.full if BEYOND.search(text) else self.basic

    def findall(self, text: str) -> list[str]:
        return self.of(text).findall(text)


_word: Runs | None = None


def word_pattern() -> Runs:
    """Maximal runs of letters, combining marks and digits. Built once per process."""
    global _word
    if _word is None:
        kind = unicodedata.category
        _word = Runs([p for p in assigned() if kind(chr(p))[0] in WORD_KINDS], "[X]+")
    return _word


def words_of(text: str) -> list[str]:
    return word_pattern().findall(text.lower())


def on_executors(spark: SparkSession):
    """A `map` whose calls run as tasks, one each; what they take and give is small (fits to bounded samples)."""

    def each(f, items):
        items = [*items]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(f(items[k]))], pa.binary())], names=["id", "out"])

        if not items:
            return []
        rows = spark.range(0, len(items), 1, len(items)).mapInArrow(run, "id bigint, out binary").collect()
        return [pickle.loads(bytes(r["out"])) for r in sorted(rows)]

    return each


def tokenizers(spark: SparkSession) -> str:
    """The folder of public tokenizers: `vakya.tokenizers` of the session."""
    return spark.conf.get("vakya.tokenizers", "/opt/tokenizers")


def check_broadcast(n_bytes: int, bound: int = 64 << 20) -> None:
    """Raise where data to be broadcast is larger than its bound."""
    if n_bytes > bound:
        raise ValueError(f"{n_bytes} bytes to broadcast exceed the bound of {bound}")


def deep_size(x: object) -> int:
    """Rough bytes of nested lists, dicts and strings."""
    if isinstance(x, dict):
        return sys.getsizeof(x) + sum(deep_size(k) + deep_size(v) for k, v in x.items())
    if isinstance(x, (list, tuple, set, frozenset)):
        return sys.getsizeof(x) + sum(map(deep_size, x))
    return sys.getsizeof(x)
