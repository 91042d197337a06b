"""Result flags and validity, and model scores in canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakya.functions.lexicons import LABELS, LOW_CONFIDENCE, SENTIMENT_TOKENS
from vakya.functions.text import col


def quality_flags() -> dict[str, Column]:
    """low_confidence and review_recommended of a result row, for withColumns. Null counts as false or ''."""
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    low = F.coalesce(F.col("confidence") < LOW_CONFIDENCE, F.lit(True))
    lang = F.coalesce("language", F.lit(""))
    review = low | lang.isin("unknown", "") | ((lang != "en") & ~no("was_translated")) | no("fallback_used") | no("translation_truncated") | no("sentiment_truncated")
    return {"low_confidence": low, "review_recommended": review}


def finite(x: Column | str) -> Column:
    x = col(x).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def is_valid_result() -> Column:
    """English text, a known sentiment, a confidence in [0, 1] and times that add up."""
    times = ("translation_time_ms", "sentiment_time_ms", "total_time_ms")
    ok = F.coalesce(F.trim("english_text") != "", F.lit(False)) & F.coalesce(F.col("sentiment").isin(*LABELS), F.lit(False))
    ok &= finite("confidence") & F.col("confidence").between(0, 1)
    for t in times:
        ok &= finite(t) & (F.col(t) >= 0)
    return ok & (F.abs(F.col("total_time_ms") - (F.col("translation_time_ms") + F.col("sentiment_time_ms"))) <= 0.01)


def safe_time(x: Column | str) -> Column:
    """A time for a failure record: 0 instead of what isn't finite or is negative."""
    return F.when(finite(x), F.greatest(F.lit(0.0), col(x).cast("double"))).otherwise(F.lit(0.0))


def failure_record() -> Column:
    """Of a row that is no valid result, the record of its failure; null for valid rows."""
    record = F.struct(
        "post_text", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("was_transliterated", F.lit(False)).alias("was_transliterated"), safe_time("total_time_ms").alias("deterministic_time_ms"),
        F.lit("InvalidPipelineResult").alias("reason"), safe_time("translation_time_ms").alias("translation_time_ms"),
    )
    return F.when(~F.coalesce(is_valid_result(), F.lit(False)), record)


def strict(df: DataFrame, failure: Column | str) -> DataFrame:
    """The rows, of which any failure fails the query."""
    return df.where(F.assert_true(col(failure).isNull(), F.concat(F.lit("the pipeline failed for a post: "), col(failure).cast("string"))).isNull())


def sentiment_truncated(n_tokens: Column | str, longest: int = SENTIMENT_TOKENS) -> Column:
    """Whether a text has more tokens than the sentiment model reads; false where they couldn't be counted."""
    return F.coalesce(col(n_tokens) > longest, F.lit(False))


def top_labels(scores: Column | str, k: int = 3) -> Column:
    """Of an array of (label, score) the k best, by score and then label."""
    x = F.transform(col(scores), lambda r: F.struct((-r["score"]).alias("s"), r["label"].alias("label"), r["score"].alias("score")))
    return F.transform(F.slice(F.array_sort(x), 1, k), lambda r: F.struct(r["label"].alias("label"), r["score"].alias("score")))


def label_mapping(names: dict[int, str]) -> dict[int, int]:
    """From a model's classes to canonical ids; raises for names it doesn't know."""
    if all(n.upper() == f"LABEL_{i}" for i, n in names.items()) and len(names) in (2, 3):
        return {i: (0, 2)[i] if len(names) == 2 else i for i in names}
    out = {}
    for i, n in names.items():
        hits = [k for k, label in enumerate(LABELS) if n.strip().lower()[:3] == label.lower()[:3]]
        if not hits:
            raise ValueError(f"unknown class {n!r}")
        out[i] = hits[0]
    return out


def canonical_probs(raw: Column | str, mapping: dict[int, int], scale: float = 2.0) -> Column:
    """An array of three shares. A model without a neutral class gets one from how undecided it is."""
    raw = col(raw)
    part = [sum((raw[i] for i, k in mapping.items() if k == j), start=F.lit(0.0)) for j in range(3)]
    if 1 not in mapping.values():
        part[1] = scale * F.least(part[0], part[2])
    total = part[0] + part[1] + part[2]
    return F.array(*(F.when(total > 0, p / total).otherwise(F.lit(0.0)) for p in part))


def top_label(probs: Column | str) -> Column:
    """The label with the highest share, the first of equals."""
    best = F.array_max(F.transform(col(probs), lambda v, k: F.struct(v.alias("v"), (-k).alias("k"))))
    return F.get(F.array(*map(F.lit, LABELS)), -best["k"])


def top_confidence(probs: Column | str) -> Column:
    return F.round(F.array_max(col(probs)), 4)
