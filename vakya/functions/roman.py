"""Romanised Indic words: cues of a language, words left alone, native spellings, and the decision on a text's language."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vakya.functions.lexicons import CUE_LANG, CUES, FLORES, LATIN_LABELS, PRESERVED, SOURCE_NEGATION, SOURCE_NEGATIVE, SOURCE_POSITIVE, TELUGU, URDU, URDU_KEPT
from vakya.functions.rx import CORES
from vakya.functions.script import extract_latin, is_latin, latin_ratio, unique_language
from vakya.functions.text import col, let, lookup, words

CORE = r"^([^A-Za-z]*)([A-Za-z]+)([^A-Za-z]*)$"


def collapsed(x: Column) -> Column:
    """Repeated letters once, in lower case."""
    return F.regexp_replace(F.lower(x), r"(.)\1+", "$1")


def _in(x: Column, of) -> Column:
    """Membership in a fixed set, which Spark hashes."""
    return x.isin(*of)


def _cue(x: Column) -> Column:
    """The language that a word tells, if any."""
    out = F
    for lang, ws in CUES.items():
        out = out.when(_in(x, ws), lang)
    return out


def is_preserved(x: Column) -> Column:
    """English words and short acronyms, which stay in Latin letters."""
    return x.rlike("^[A-Z]{2,6}$") | _in(F.lower(x), PRESERVED) | _in(collapsed(x), PRESERVED)


def cores(x: Column | str, signs: str = ".!,?;:", only=None) -> Column:
    """The Latin words of a text without what's around them, between blanks and these signs: one search of the text. With `only`, just
    those that are among these words in lower case, as they are or with repeated letters once."""
    pattern = CORES.replace("D", signs)
    if only:
        # Without repeated letters a word is that of any drawn-out form of it.
        forms = [w if re.search(r"(.)\1", w) else "".join(f"{c}+" for c in w) for w in only]
        pattern = pattern.replace("[A-Za-z]++", f"(?i:{'|'.join(forms)})(?![A-Za-z])")
    return F.regexp_extract_all(col(x), F.lit(pattern), F.lit(1))


def _key(c: Column, of) -> Column:
    """The word of the set that a core found by `only` is."""
    return F.when(_in(F.lower(c), of), F.lower(c)).otherwise(collapsed(c))


def cue_hits(x: Column | str) -> Column:
    """An array of (key, lang): cue words, looked up as written and with repeated letters once."""
    found = F.transform(F.filter(cores(x, only=CUE_LANG), lambda c: ~is_preserved(c)), lambda c: _key(c, CUE_LANG))
    return F.transform(found, lambda k: F.struct(k.alias("key"), _cue(k).alias("lang")))


def cue_count(x: Column | str) -> Column:
    return F.size(cue_hits(x))


def hits_language(hits: Column | str) -> Column:
    """The one language that all cues tell, else null."""
    return let(F.array_distinct(F.transform(col(hits), lambda h: h["lang"])), lambda langs: F.when(F.size(langs) == 1, langs[0]))


def cue_language(x: Column | str) -> Column:
    return hits_language(cue_hits(x))


def residual(x: Column | str) -> Column:
    """The Latin words of a text that aren't English words to be left alone."""
    return F.array_join(F.filter(cores(x), lambda c: ~is_preserved(c) & (F.length(c) > 1)), " ")


def polarity_tokens(x: Column | str) -> Column:
    """The English words of polarity or negation in a text, each once, sorted."""
    known = (*SOURCE_POSITIVE, *SOURCE_NEGATIVE, *SOURCE_NEGATION)
    return F.sort_array(F.array_distinct(F.transform(cores(x, ".", known), lambda c: _key(c, known))))


def _spelled(t: Column, lang: Column, other) -> Column:
    """One token: words with a native spelling get it, others that a model should spell go through `other`."""
    before, core, after = (F.regexp_extract(t, CORE, k) for k in (1, 2, 3))
    low, once = F.lower(core), collapsed(core)
    around = lambda x: F.concat(before, x, after)
    telugu = F.coalesce(lookup(TELUGU, low), lookup(TELUGU, once))
    return (
        F.when(~t.rlike(CORE) | F.concat(before, after).rlike(r"[\p{L}\p{N}]"), t)
        .when((lang == "ur") & lookup(URDU, low).isNotNull(), around(lookup(URDU, low)))
        .when((lang == "ur") & _in(low, URDU_KEPT), t)
        .when(is_preserved(core), t)
        .when((lang == "te") & telugu.isNotNull(), around(telugu))
        .otherwise(other(t, before, once, after))
    )


def spellable(x: Column | str, lang: Column | str) -> Column:
    return F.coalesce(col(lang).isin(*[k for k in FLORES if k != "en"]) & (F.trim(col(x)) != ""), F.lit(False))


def transliterate_rules(x: Column | str, lang: Column | str) -> Column:
    """Native spellings by rule; words for a model stay as they are. Null for blank texts and English or other languages."""
    t, lang = col(x), col(lang)
    out = F.array_join(F.transform(F.split(t, " "), lambda w: _spelled(w, lang, lambda w, *_: w)), " ")
    return F.when(spellable(t, lang), out)


def model_words(x: Column | str, lang: Column | str) -> Column:
    """The words left to a model, each once, so that a model sees each distinct word of a table once."""
    mark = F.lit("\x00")
    w = F.transform(F.split(col(x), " "), lambda w: _spelled(w, col(lang), lambda w, b, once, a: F.concat(mark, once)))
    return F.array_distinct(F.transform(F.filter(w, lambda t: t.startswith(mark)), lambda t: F.substring(t, 2, 2**30)))


def with_spellings(x: Column | str, lang: Column | str, native: Column | str) -> Column:
    """The text with its words spelled by rule and by a map from words to spellings; null if one of them has none."""
    words_ = F.transform(F.split(col(x), " "), lambda w: _spelled(w, col(lang), lambda w, b, once, a: F.concat(b, F.try_element_at(col(native), once), a)))
    return F.when(~F.exists(words_, lambda w: w.isNull()), F.array_join(words_, " "))


def model_input(word: Column | str, lang: Column | str) -> Column:
    return F.concat(F.lit("__"), col(lang), F.lit("__ "), F.array_join(F.split(F.lower(col(word)), ""), " "))


def needs_transliteration(x: Column | str, lang: Column | str) -> Column:
    return col(lang).isin(*[k for k in FLORES if k != "en"]) & (F.trim(col(x)) != "") & is_latin(x)


def refine_language(x: Column | str, lang: Column | str, better) -> Column:
    """A detected language, put right by scripts and by `better`: a function from the Latin text to a language or null."""
    t, lang = col(x), col(lang)
    unsure = lang.isin("en", "unknown")
    probe = F.when(is_latin(t), t).when(unsure & (latin_ratio(t) >= 0.15), extract_latin(t))

    def decide(v: Column) -> Column:
        return (
            F.when(unsure & v["unique"].isNotNull(), v["unique"])
            .when(F.coalesce(F.trim(v["probe"]), F.lit("")).eqNullSafe(F.lit("")) | v["new"].isNull(), lang)
            .when(~unsure & (v["new"] == "en"), lang)
            .otherwise(v["new"])
        )

    return let(F.struct(unique_language(t).alias("unique"), probe.alias("probe"), better(probe).alias("new")), decide)


def roman_language(x: Column | str, ranked: Column | str, bert: Column | str, rest: Column | str) -> Column:
    """The decision on a Latin text from scored labels.

    ranked: array of (label, score), best first; bert: a second opinion or null; rest: ranked labels of the residual."""
    t, ranked, bert, rest = col(x), col(ranked), col(bert), col(rest)
    mapped = lambda label: lookup(LATIN_LABELS, label)
    cues, cue = cue_count(t), cue_language(t)
    short = (cues == 0) & (F.size(words(residual(t))) <= 4)
    top, sure = F.try_element_at(ranked, F.lit(1)), F.coalesce(F.try_element_at(ranked, F.lit(1))["score"] >= 0.6, F.lit(False))
    first = F.when(sure, mapped(top["label"]))
    other = F.when(cues >= 1, F.try_element_at(F.filter(ranked, lambda r: (r["label"] != "eng_Latn") & (r["score"] >= 0.15) & mapped(r["label"]).isNotNull() & (mapped(r["label"]) != "en")), F.lit(1))["label"])
    r = F.try_element_at(rest, F.lit(1))
    by_rest = F.when((cues >= 1) & (residual(t) != "") & (r["score"] >= 0.25) & (r["label"] != "eng_Latn"), F.when(mapped(r["label"]).isNotNull(), F.coalesce(cue, mapped(r["label"]))).otherwise(cue))
    rescue = F.coalesce(mapped(other), by_rest)
    second = mapped(bert)
    return (
        F.when(F.trim(t) == "", F.lit(None).cast("string"))
        .when(first.isNotNull() & (first != "en") & ~short, F.coalesce(cue, first))
        .when(bert.isNotNull() & second.isNotNull() & (second != "en") & ~short, F.coalesce(cue, second))
        .when(bert.isNotNull() & (F.coalesce(second == "en", F.lit(False)) | short), F.coalesce(rescue, F.lit("en")))
        .when(sure & (first.isNull() | (first == "en")), F.coalesce(rescue, F.when(first == "en", F.lit("en"))))
        .when(sure, F.when(short, F.lit("en")).otherwise(first))
        .otherwise(rescue)
    )
