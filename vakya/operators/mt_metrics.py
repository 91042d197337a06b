"""Translation metrics: corpus BLEU and chrF, agreement of two systems, means over translated rows.

The clipped n-gram matches of a row are counted where the row is (in Arrow batches: Spark's functions have no intersection of
multisets in linear time); a dozen numbers per row are then summed, so no n-gram is ever shuffled. Null texts count as ''."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vakya.functions.text import col, squeezed

BLEU_ORDER, CHRF_ORDER, BETA = 4, 6, 2


def _stats(h: list | str, r: list | str, order: int) -> list[int]:
    out = [len(h), len(r)]
    for n in range(1, order + 1):
        if isinstance(h, str):
            a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (h, r))
        else:
            a, b = (Counter(zip(*(x[k:] for k in range(n)))) for x in (h, r))
        out += [sum((a & b).values()), max(0, len(h) - n + 1), max(0, len(r) - n + 1)]
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def word_stats(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of two texts of tokens divided by blanks: lengths, then matches and totals of both for each order."""
    for h, r in batches:
        yield pd.Series([_stats((a or "").split(), (b or "").split(), BLEU_ORDER) for a, b in zip(h, r)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def char_stats(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for h, r in batches:
        yield pd.Series([_stats("".join((a or "").split()), "".join((b or "").split()), CHRF_ORDER) for a, b in zip(h, r)])


def tokens_13a(x: Column | str) -> Column:
    """Tokens as the standard corpus BLEU divides them, with spaces between."""
    t = col(x)
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pattern, to in ((r"([\{-~\[-` -&\(-\+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        t = F.regexp_replace(t, pattern, to)
    return squeezed(t)


def _sums(df: DataFrame, stats: Column, size: int, by: list[str]) -> DataFrame:
    s = df.select(*by, stats.alias("s"))
    return s.groupBy(*by).agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)))


def bleu(df: DataFrame, hyp: str, ref: str, by: list[str] | None = None, tokenize: bool = False) -> DataFrame:
    """(by..., bleu): up to 4-grams, brevity penalty, halving smoothing of orders without a match; in percent."""
    by = by or []
    h, r = ((tokens_13a(x) if tokenize else F.col(x)) for x in (hyp, ref))
    s = _sums(df, word_stats(h, r), 2 + 3 * BLEU_ORDER, by)
    match, total = ([F.col(f"s{2 + 3 * n + k}").cast("double") for n in range(BLEU_ORDER)] for k in (0, 1))
    logs, k = F.lit(0.0), F.lit(1.0)
    for m, t in zip(match, total):
        k = F.when(m == 0, k * 2).otherwise(k)
        logs = logs + F.ln(F.when(m == 0, F.try_divide(F.lit(100.0), k * t)).otherwise(100 * F.try_divide(m, t)))
    brevity = F.when(F.col("s0") < F.col("s1"), F.exp(1 - F.try_divide(F.col("s1"), F.col("s0")))).otherwise(F.lit(1.0))
    whole = (sum(match[1:], match[0]) > 0) & (total[-1] > 0)
    return s.select(*by, F.when(whole, brevity * F.exp(logs / BLEU_ORDER)).otherwise(F.lit(0.0)).alias("bleu"))


def chrf(df: DataFrame, hyp: str, ref: str, by: list[str] | None = None) -> DataFrame:
    """(by..., chrf): character n-grams up to 6 without blanks, recall weighing twice; in percent."""
    by = by or []
    s = _sums(df, char_stats(hyp, ref), 2 + 3 * CHRF_ORDER, by)
    p = r = F.lit(0.0)
    k = F.lit(0)
    for n in range(CHRF_ORDER):
        m, h, t = (F.col(f"s{2 + 3 * n + i}").cast("double") for i in range(3))
        both = (h > 0) & (t > 0)
        p, r, k = p + F.when(both, F.try_divide(m, h)).otherwise(0.0), r + F.when(both, F.try_divide(m, t)).otherwise(0.0), k + both.cast("int")
    p, r = F.try_divide(p, k), F.try_divide(r, k)
    f = F.coalesce(F.try_divide((1 + BETA**2) * p * r, BETA**2 * p + r), F.lit(0.0))
    return s.select(*by, (100 * f).alias("chrf"))


def either(*masks: Column | str) -> Column:
    """Whether any of the conditions holds; null is no."""
    return F.greatest(F.lit(False), *(F.coalesce(col(m), F.lit(False)) for m in masks))


def agreement(df: DataFrame, a: str, b: str, either: Column) -> DataFrame:
    """(bleu, chrf): the mean of both directions over the rows that either system translated."""
    both = F.array(*(F.struct(F.lit(d).alias("d"), F.col(x).alias("h"), F.col(y).alias("r")) for d, x, y in ((1, a, b), (2, b, a))))
    rows = df.where(either).select(F.inline(both))
    return bleu(rows, "h", "r", ["d"]).join(chrf(rows, "h", "r", ["d"]), "d").agg(F.avg("bleu").alias("bleu"), F.avg("chrf").alias("chrf"))


def evaluate_translation(df: DataFrame, hyp: str, ref: str, by: list[str], translated: str = "was_translated", time: str = "translation_time_ms", scorer=None) -> DataFrame:
    """(by..., n_translated, avg_time_ms, bleu, chrf, comet) over translated rows; scores over those with a reference.

    `scorer` is a column function of (hypothesis, reference) for a model's score, of which the mean is taken; else comet is null."""
    rows = df.where(F.col(translated))
    with_ref = rows.where(F.col(ref).isNotNull())
    out = rows.groupBy(*by).agg(F.count("*").alias("n_translated"), F.avg(time).alias("avg_time_ms"))
    out = out.join(bleu(with_ref, hyp, ref, by), by, "left").join(chrf(with_ref, hyp, ref, by), by, "left")
    if scorer is None:
        return out.withColumn("comet", F.lit(None).cast("double"))
    return out.join(with_ref.groupBy(*by).agg(F.avg(scorer(F.col(hyp), F.col(ref))).alias("comet")), by, "left")
