"""Requests before any work is done: limits, waiting times, and what an error is answered with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakya.functions.lexicons import LONGEST_WAIT, MAX_TEXT_CHARS, MAX_TEXTS, MAX_TOTAL_CHARS, SHORTEST_WAIT
from vakya.functions.text import col

# The status of an answer by what went wrong, and whether it says when to try again.
STATUS = {"TooLarge": 413, "Invalid": 422, "GateFull": 429, "CircuitOpen": 503, "Timeout": 503, "TranslationFailed": 503, "FallbackFailed": 503}
RETRY = ("GateFull", "CircuitOpen")


def error(kind: Column | str, detail: Column, retry_after: Column | None = None) -> Column:
    """A struct (code, retry_after, detail); null where nothing went wrong. Kinds that aren't known are 500."""
    k = col(kind)
    code = F.coalesce(F.create_map([F.lit(x) for p in STATUS.items() for x in p])[k], F.lit(500))
    wait = F.when(k.isin(*RETRY), (F.lit(None) if retry_after is None else F.floor(retry_after)).cast("int"))
    return F.when(k.isNotNull(), F.struct(code.alias("code"), wait.alias("retry_after"), detail.alias("detail")))


def size_errors(texts: DataFrame, request: str, pos: str, text: str, most: int = MAX_TEXTS, longest: int = MAX_TEXT_CHARS, total: int = MAX_TOTAL_CHARS) -> DataFrame:
    """(request, n_texts, n_chars, longest, error) of rows of texts: too many of them, one too long (the first by `pos`), or too much
    in all, in this order. Only counts move, so a request of any size is judged where its rows are."""
    n = F.coalesce(F.length(text), F.lit(0))
    a = texts.groupBy(request).agg(F.count("*").alias("n_texts"), F.sum(n).alias("n_chars"), F.max(n).alias("longest"), F.min(F.when(n > longest, F.struct(F.col(pos).alias("pos"), n.alias("n")))).alias("first"))
    too_many, too_long, too_much = F.col("n_texts") > most, F.col("first").isNotNull(), F.col("n_chars") > total
    detail = (
        F.when(too_many, F.format_string(f"Too many texts: %d (limit {most}). Split the batch across several requests.", F.col("n_texts")))
        .when(too_long, F.format_string(f"texts[%d] is %d characters (limit {longest}).", F.col("first.pos"), F.col("first.n")))
        .otherwise(F.format_string(f"Request totals %d characters (limit {total}).", F.col("n_chars")))
    )
    kind = F.when(too_many | too_long | too_much, F.lit("TooLarge"))
    return a.select(request, "n_texts", "n_chars", "longest", error(kind, detail).alias("error"))


def waiting_time(seconds: Column | str) -> Column:
    """A timeout asked for, within bounds; null (none asked for) stays."""
    return F.when(col(seconds).isNotNull(), F.greatest(F.lit(SHORTEST_WAIT), F.least(F.lit(LONGEST_WAIT), col(seconds).cast("double"))))
