"""Scripts by code-point ranges: combining marks and signs of a block count for it, Latin counts letters only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vakya.functions.lexicons import BLOCKS, CODE_MIX, SCRIPT_LANG
from vakya.functions.rx import BLOCK_IN, LATIN_IN, WS_IN
from vakya.functions.text import col, lookup, squeezed

INDIC = [k for k in BLOCK_IN if k != "latin"]
NAMES = [*BLOCK_IN]
_kinds: np.ndarray | None = None


def _table() -> np.ndarray:
    """Of each code point the number of its script, from 1, 0 for none, and 16 more where it's a letter. Built once a process."""
    global _kinds
    if _kinds is None:
        _kinds = np.zeros(0x110000, np.uint8)
        for k, (a, b) in enumerate(BLOCKS.values(), 1):
            _kinds[int(a, 16) : int(b, 16) + 1] = k
        for p in range(0x110000):
            if not 0xD800 <= p < 0xE000 and chr(p).isalpha():
                _kinds[p] += 16
                if p < 0x250:
                    _kinds[p] = 16 + NAMES.index("latin") + 1
    return _kinds


FACTS = T.StructType([T.StructField(k, T.IntegerType()) for k in (*NAMES, "letters")] + [T.StructField(k, T.StringType()) for k in ("script", "single")] + [T.StructField(k, T.IntegerType()) for k in ("latin_letters", "indic_letters", "arabic_letters")])


@F.pandas_udf(FACTS)
def script_facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """All that is told of a text's scripts, in one pass over its characters: characters by script, letters, the dominant script and the
    dominant one of those that have but one language ('unknown' where there is none), letters by kind. Null stays null."""
    kinds, k = _table(), len(NAMES)
    own = np.array([n in SCRIPT_LANG for n in NAMES])
    names = np.array(["unknown", *NAMES], object)
    for s in batches:
        texts = s.fillna("").tolist()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        kind = kinds[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        row = np.repeat(np.arange(len(texts)), sizes)
        script, letter = kind & 15, kind > 15
        n = np.bincount(row * 16 + script, minlength=len(texts) * 16).reshape(-1, 16)[:, 1 : k + 1]
        letters = np.bincount((row * 16 + script)[letter], minlength=len(texts) * 16).reshape(-1, 16)
        first = np.full((len(texts), k), np.iinfo(np.int64).max)
        at = np.flatnonzero(script)
        cell, where = np.unique(row[at] * k + script[at] - 1, return_index=True)
        first.ravel()[cell] = at[where]
        # Most characters first, of equals the one seen first.
        lead = lambda among: np.where((n * among).max(axis=1, initial=0) > 0, np.where((n == (n * among).max(axis=1, keepdims=True)) & among, first, np.iinfo(np.int64).max).argmin(axis=1) + 1, 0)
        arabic, latin = NAMES.index("perso_arabic") + 1, NAMES.index("latin") + 1
        out = pd.DataFrame(n.astype(np.int32), columns=NAMES)
        out["letters"] = letters.sum(axis=1).astype(np.int32)
        out["script"], out["single"] = names[lead(np.ones(k, bool))], names[lead(own)]
        out["latin_letters"], out["arabic_letters"] = letters[:, latin].astype(np.int32), letters[:, arabic].astype(np.int32)
        out["indic_letters"] = (letters[:, 1:].sum(axis=1) - letters[:, latin]).astype(np.int32)
        if len(gone := np.flatnonzero(s.isna().to_numpy())):
            out = out.astype(object)
            out.iloc[gone] = None
        yield out


def facts(x: Column | str) -> Column:
    return script_facts(col(x))


def count_in(x: Column | str, inside: str) -> Column:
    """How many characters a class holds: what is left out without them, as whole runs go at once."""
    return F.length(col(x)) - F.length(F.regexp_replace(col(x), f"[{inside}]+", ""))


def script_counts(x: Column | str) -> Column:
    """A struct with the number of characters of each script."""
    return F.struct(*(facts(x)[k].alias(k) for k in NAMES))


def detect_script(x: Column | str) -> Column:
    """The dominant script, 'unknown' where there is none; null stays null."""
    return facts(x)["script"]


def is_latin(x: Column | str) -> Column:
    return detect_script(x) == "latin"


def _share(a: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(a / whole)


def latin_ratio(x: Column | str) -> Column:
    """Latin letters to all characters with a script; 0 where there are none."""
    f = facts(x)
    return _share(f["latin"], sum((f[k] for k in NAMES[1:]), f[NAMES[0]]))


def extract_latin(x: Column | str) -> Column:
    """Latin letters, blanks and other ASCII, single-spaced."""
    return squeezed(F.regexp_replace(col(x), rf"[^{LATIN_IN}{WS_IN}\x{{00}}-\x{{40}}\x{{5b}}-\x{{60}}\x{{7b}}-\x{{7f}}]", ""))


def unique_language(x: Column | str, least: float = CODE_MIX) -> Column:
    """The language of the most frequent script that has but one, if it has this share of all characters with a script."""
    f = facts(x)
    n = F.create_map(*[y for k in SCRIPT_LANG for y in (F.lit(k), f[k])])[f["single"]]
    return F.when(n / sum((f[k] for k in NAMES[1:]), f[NAMES[0]]) >= least, lookup(SCRIPT_LANG, f["single"]))


def script_mix(x: Column | str) -> Column:
    """The smaller of Latin and Indic letters as a share of both; 0 where there are none."""
    f = facts(x)
    return _share(F.least(f["latin_letters"], f["indic_letters"]), f["latin_letters"] + f["indic_letters"])


def arabic_ratio(x: Column | str) -> Column:
    """Arabic letters to all letters; 0 where there are none."""
    f = facts(x)
    return _share(f["arabic_letters"], f["letters"])
