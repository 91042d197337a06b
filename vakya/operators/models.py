"""Where models plug in. A model is a function from a list of texts (and a language) to a list of results; everything around it,
which rows reach it, what happens to those it fails on and to what it can't have meant, is here. Rows are filtered before a
model, never guarded inside an expression, as Spark evaluates a Python function for all rows of its input."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vakya.functions.annotate import canonical_probs, label_mapping
from vakya.functions.lexicons import NEGATION, NEGATIVE, POSITIVE
from vakya.functions.quality import _any, decoded, effective_polarity, english_cores, route, unusable_reason
from vakya.functions.roman import cue_count, cue_language, model_input, model_words, residual, roman_language, spellable, with_spellings
from vakya.functions.script import detect_script, is_latin, unique_language
from vakya.functions.text import let
from vakya.sources.store import written

FATAL = (MemoryError, TypeError, AttributeError, AssertionError)


def isolated(call: Callable[[list[str], str], list[str]], texts: list[str], lang: str) -> list[tuple[str | None, str | None]]:
    """(result, failure) of each text: a batch that fails is tried one by one. Errors of the program itself are raised."""
    try:
        out = call(texts, lang)
        if len(out) == len(texts):
            return [(x, None) for x in out]
    except FATAL:
        raise
    except Exception as e:  # noqa: BLE001
        if len(texts) == 1:
            return [(None, type(e).__name__)]
    else:
        if len(texts) == 1:
            return [(None, "WrongLength")]
    return [isolated(call, [t], lang)[0] for t in texts]


def mapped(df: DataFrame, text: str, lang: str, make: Callable[[], Callable[[list[str], str], list]], out: str, batch: int = 8, kind: str = "string") -> DataFrame:
    """Adds `out` (of the type `kind`: text, scores of classes, ranked labels), `failure` and `time_ms`, a row's share of its batch's time.
    `make` builds the model once per Python worker; batches hold one language."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` {kind}, failure string, time_ms double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            res: dict = {}
            for key, part in pdf.groupby(lang, dropna=False, sort=False):
                for k in range(0, len(part), batch):
                    p = part.iloc[k : k + batch]
                    began = time.perf_counter()
                    found = isolated(model, p[text].tolist(), key if isinstance(key, str) else "")
                    ms = (time.perf_counter() - began) * 1000 / len(p)
                    res.update((i, (*x, ms)) for i, x in zip(p.index, found))
            yield pdf.assign(**{c: [res[i][k] for i in pdf.index] for k, c in enumerate((out, "failure", "time_ms"))})

    return df.mapInPandas(run, schema)


def amortised(df: DataFrame, batch: list[str], batch_ms: str, name: str = "time_ms") -> DataFrame:
    """Adds each row's share of its batch's time. A batch is small by nature."""
    return df.withColumn(name, F.col(batch_ms) / F.count("*").over(W.partitionBy(*batch)))


def translated(df: DataFrame, text: str, lang: str, primary, secondary=None, cache: DataFrame | None = None, batch: int = 8) -> DataFrame:
    """Adds english_text, translation_backend, failure, translation_time_ms. English passes, other languages without a code too; each
    distinct text of a language is translated once, by the secondary model where the first one fails or can't have meant it (their
    times add up). The first one's results are written, so it runs once however often they're read. Rejected results never enter a
    cache: `cache` (lang, text, english_text) answers first, the rest is computed."""
    r = df.withColumn("_route", route(lang))
    todo = r.where("_route = 'translate'").select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).where("_text is not null").distinct()
    known, nothing = None, F.lit(None).cast("string")
    if cache is not None:
        known = cache.select(F.col("lang").alias("_lang"), F.col("text").alias("_text"), "english_text", F.lit("cache").alias("translation_backend"), nothing.alias("failure"), F.lit(0.0).alias("time_ms"))
        todo = todo.join(known.select("_lang", "_text"), ["_lang", "_text"], "left_anti")
    bad = F.col("failure").isNotNull() | unusable_reason("_text", "english_text").isNotNull()
    why = F.when(bad, F.coalesce("failure", F.lit("unusable")))
    first = mapped(todo, "_text", "_lang", primary, "english_text", batch).withColumn("english_text", decoded("english_text")).withColumn("translation_backend", F.lit("primary")).withColumn("failure", why)
    if secondary is None:
        done = first
    else:
        first = written(first)
        again = mapped(first.where("failure is not null").select("_lang", "_text", F.col("time_ms").alias("_before")), "_text", "_lang", secondary, "english_text", batch)
        again = again.withColumn("english_text", decoded("english_text")).withColumn("translation_backend", F.lit("secondary")).withColumn("failure", why).withColumn("time_ms", F.col("time_ms") + F.col("_before")).drop("_before")
        done = first.where("failure is null").unionByName(again)
    done = done.withColumn("english_text", F.when(F.col("failure").isNull(), F.col("english_text")))
    if known is not None:
        done = done.unionByName(known)
    out = r.join(done, (r[lang] == done["_lang"]) & (r[text] == done["_text"]) & (r["_route"] == "translate"), "left")
    other = F.col("_route") != "translate"
    out = out.withColumns({"english_text": F.when(other, F.col(text)).otherwise(F.col("english_text")), "translation_backend": F.when(other, F.col("_route")).otherwise(F.col("translation_backend")), "translation_time_ms": F.round(F.coalesce("time_ms", F.lit(0.0)), 3)})
    return out.drop("_lang", "_text", "_route", "time_ms")


def spelled_words(df: DataFrame, text: str, lang: str, make, batch: int = 64) -> DataFrame:
    """(word, lang, native): each distinct word left to a spelling model, seen by it once, in the form it wants; native is null where it failed."""
    w = df.select(F.explode(model_words(text, lang)).alias("word"), F.col(lang).alias("lang")).distinct().withColumn("_input", model_input("word", "lang"))
    return mapped(w, "_input", "lang", make, "native", batch).select("word", "lang", F.regexp_replace("native", " ", "").alias("native"))


def spelled(df: DataFrame, text: str, lang: str, make, out: str = "native_text") -> DataFrame:
    """Adds `out`: the text with its romanised words in native spelling, by rule or by a model, what stands around them kept. Null where
    there is nothing to spell (blank texts, English, other languages) and where the model failed on a word of the text.

    Each distinct text is spelled once; its words meet their spellings in a join, so no table of words is sent around."""
    texts = df.select(F.col(text).alias("_text"), F.col(lang).alias("_lang")).where(spellable("_text", "_lang")).distinct()
    native = spelled_words(texts, "_text", "_lang", make).select(F.col("word").alias("_word"), F.col("lang").alias("_lang"), "native")
    pairs = texts.select("_text", "_lang", F.explode(model_words("_text", "_lang")).alias("_word")).join(native, ["_word", "_lang"])
    own = pairs.groupBy("_text", "_lang").agg(F.map_from_entries(F.collect_list(F.struct("_word", "native"))).alias("_native"))  # the words of one text
    whole = texts.join(own, ["_text", "_lang"], "left").withColumn("_out", with_spellings("_text", "_lang", "_native")).drop("_native")
    r = df.join(whole, (df[text] == whole["_text"]) & (df[lang] == whole["_lang"]), "left")
    return r.withColumn(out, F.col("_out")).drop("_text", "_lang", "_out")


def class_scores(df: DataFrame, text: str, make, names: dict[int, str], out: str = "probs", batch: int = 16) -> DataFrame:
    """Adds `out`, a model's scores of a text's classes in canonical form, and sentiment_time_ms. Each distinct text is scored once; null
    texts, and those that the model fails on, have none."""
    texts = df.select(F.col(text).alias("_text")).where("_text is not null").distinct().withColumn("_lang", F.lit("en"))
    scored = mapped(texts, "_text", "_lang", make, "_raw", batch, "array<double>")
    scored = scored.select("_text", F.when(F.col("failure").isNull(), canonical_probs("_raw", label_mapping(names))).alias(out), F.round("time_ms", 3).alias("sentiment_time_ms"))
    return df.join(scored, df[text] == scored["_text"], "left").drop("_text")


RANKED = "array<struct<label:string,score:double>>"


def romanised(df: DataFrame, text: str, ranker, second, out: str = "roman", sure: float = 0.6) -> DataFrame:
    """Adds `out`, the language of Latin texts by models: one ranks labels of the text, and of what is left of it without English words
    where cues are in it; a second opinion is asked for where the first isn't sure or says English. Each distinct text is seen once."""
    t = df.select(F.col(text).alias("_text")).where("_text is not null and trim(_text) <> ''").distinct().withColumn("_lang", F.lit("")).withColumn("_rest", F.when(cue_count("_text") >= 1, residual("_text")))
    first = written(mapped(t, "_text", "_lang", ranker, "_ranked", 64, RANKED).drop("failure", "time_ms"))
    top = F.try_element_at("_ranked", F.lit(1))
    unsure = first.where(F.coalesce((top["score"] < sure) | (top["label"] == "eng_Latn"), F.lit(True))).select("_text", "_lang")
    other = mapped(unsure, "_text", "_lang", second, "_bert", 64).select("_text", "_bert")
    rests = mapped(first.where("_rest <> ''").select("_rest", "_lang").distinct(), "_rest", "_lang", ranker, "_rest_ranked", 64, RANKED).select("_rest", "_rest_ranked")
    all_ = first.join(other, "_text", "left").join(rests, "_rest", "left").select("_text", roman_language("_text", "_ranked", "_bert", "_rest_ranked").alias(out))
    return df.join(all_, df[text] == all_["_text"], "left").drop("_text")


def lexicon_probs(english: Column | str) -> Column:
    """A stand-in for a sentiment model: shares by polarity words and negation."""
    of = lambda t: effective_polarity(_any(t, POSITIVE), _any(t, NEGATIVE), _any(t, NEGATION))
    shares = lambda *x: F.array(*map(F.lit, x))
    by_word = lambda p: F.when(p == "pos", shares(0.05, 0.15, 0.80)).when(p == "neg", shares(0.80, 0.15, 0.05)).when(p == "mixed", shares(0.40, 0.20, 0.40)).otherwise(shares(0.10, 0.80, 0.10))
    return let(let(english_cores(english), of), by_word)


def script_language(text: Column | str) -> Column:
    """A stand-in for a language model: by script, English for Latin."""
    return F.coalesce(unique_language(text), F.when(detect_script(text) == "latin", "en").when(detect_script(text) == "devanagari", "hi"), F.lit("unknown"))


def roman_cues(text: Column | str) -> Column:
    """A stand-in for a model of romanised languages: the language that cue words tell; null where none does."""
    return cue_language(text)


def verified_english(text: Column | str, detect=script_language, roman=roman_cues) -> Column:
    """Whether a text is English by the detector and, in Latin letters, not a romanised language."""
    other = F.coalesce(roman(text) != "en", F.lit(False))
    return F.coalesce(detect(text) == "en", F.lit(False)) & ~(F.coalesce(is_latin(text), F.lit(False)) & other)
