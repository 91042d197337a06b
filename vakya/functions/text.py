"""Cleaning, labels and small scalar functions. Nulls give what each docstring says; columns are never named by the functions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vakya.functions.lexicons import LABEL_FORMS, LABELS
from vakya.functions.rx import BLANK, LINK, NOT_BLANK, W_IN


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f) -> Column:
    """f of a value that is worked out once a row, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """The value of a small fixed table, null for other keys."""
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])[key]


@F.pandas_udf(T.StringType())
def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _in_python(f, x: Column, where: Column) -> Column:
    """f of the rows that need it: only their texts leave the JVM."""
    return F.coalesce(f(F.when(where, x)), x)


def unescaped(x: Column) -> Column:
    """Character references of HTML, all of them, become characters."""
    return _in_python(_unescape, x, F.contains(x, F.lit("&")))


def composed(x: Column) -> Column:
    """Normal form C, which Spark has no function for. Characters before the combining marks are in it always."""
    return _in_python(_compose, x, x.rlike(r"[^\x{00}-\x{2ff}]"))


def squeezed(x: Column | str) -> Column:
    """Runs of blanks of any kind become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(x), f"{BLANK}+", " "))


def clean_text(x: Column | str) -> Column:
    """References, tags, links and mentions go, hashtags lose their sign, emoji stay. Null gives ''."""
    t = unescaped(F.coalesce(col(x), F.lit("")))
    for pattern, to in (("<[^>]+>", " "), (LINK, " "), (f"@[{W_IN}]+", " "), (f"#([{W_IN}]+)", "$1")):
        t = F.regexp_replace(t, pattern, to)
    return squeezed(composed(t))


def normalize_label(x: Column | str, strict: bool = False) -> Column:
    """The label of a written form. Others are null or, if strict, fail the query."""
    out = lookup(LABEL_FORMS, F.lower(squeezed(x)))
    return F.when(out.isNotNull(), out).otherwise(F.raise_error(F.concat(F.lit("no sentiment label: "), F.coalesce(col(x), F.lit("null")))).cast("string")) if strict else out


def label_id(x: Column | str) -> Column:
    """0, 1, 2 in the order of labels; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LABELS)), col(x)), F.lit(0)).cast("int") - 1


def require_columns(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def preprocess(df: DataFrame, text: str = "post_text", label: str = "ground_truth_sentiment") -> DataFrame:
    """Adds clean_text and label; rows without text after cleaning are dropped."""
    require_columns(df, text, label)
    return df.withColumn("clean_text", clean_text(text)).withColumn("label", normalize_label(label)).where(F.length("clean_text") > 0)


def words(x: Column | str) -> Column:
    """What stands between blanks of any kind."""
    return F.regexp_extract_all(col(x), F.lit(f"{NOT_BLANK}+"), F.lit(0))


def clip(x: Column | str, limit: int = 4000) -> Column:
    """Long texts keep their first 70 % and last 30 % of the limit."""
    t, head, tail = col(x), int(limit * 0.7), int(limit * 0.3)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(head)), F.lit("\n...[truncated]...\n"), F.right(t, F.lit(tail))))


def first_words(x: Column | str, most: int = 8) -> Column:
    w = words(x)
    return F.when(F.size(w) > most, F.array_join(F.slice(w, 1, most), " ")).otherwise(squeezed_ends(x))


def squeezed_ends(x: Column | str) -> Column:
    return F.regexp_replace(col(x), f"^{BLANK}+|{BLANK}+$", "")


def sentences(x: Column | str) -> Column:
    """Parts of a text that end in a sentence sign; the whole where there are fewer than two."""
    t = squeezed_ends(F.coalesce(col(x), F.lit("")))
    parts = F.filter(F.transform(F.split(t, f"(?<=[.!?।]){BLANK}+"), squeezed_ends), lambda p: p != "")
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array(t))


def seconds_text(x: Column | str) -> Column:
    s = col(x)
    return F.when(s < 60, F.format_string("%.1fs", s)).otherwise(F.format_string("%dm %.1fs", F.floor(s / 60), s - 60 * F.floor(s / 60)))


def metric_text(x: Column | str, places: int = 4) -> Column:
    m = col(x).cast("double")
    return F.when(m.isNull() | F.isnan(m), F.lit("n/a")).otherwise(F.format_string(f"%.{places}f", m))


def n_links(x: Column | str) -> Column:
    return F.regexp_count(col(x), F.lit(LINK))


