"""Whether a translation can be one, and how a translation is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vakya.functions.lexicons import FLORES, MAX_RATIO, NEGATION, NEGATIVE, POSITIVE, REPEAT_RATIO, SOURCE_NEGATION, SOURCE_NEGATIVE, SOURCE_POSITIVE
from vakya.functions.roman import polarity_tokens
from vakya.functions.script import arabic_ratio, count_in, facts
from vakya.functions.text import col, let, lookup, squeezed_ends, words


def english_cores(x: Column | str) -> Column:
    """English words in lower case; a contracted negation becomes 'not' and its stem."""
    raw = F.transform(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit("[A-Za-z]+(?:'[A-Za-z]+)?"), F.lit(0)), F.lower)
    stem = lambda w: F.left(w, F.length(w) - 3)
    apart = lambda w: F.when(~w.endswith("n't"), F.array(w)).when(stem(w) == "ca", F.array(F.lit("not"), F.lit("can"))).when(stem(w).isin("", "wo", "sha", "ai"), F.array(F.lit("not"))).otherwise(F.array(F.lit("not"), stem(w)))
    return F.flatten(F.transform(raw, apart))


def _any(x: Column, of) -> Column:
    return F.arrays_overlap(x, F.array(*map(F.lit, of)))


def effective_polarity(pos: Column, neg: Column, negated: Column) -> Column:
    return (
        F.when(pos & neg, "mixed")
        .when(negated & pos, "neg")
        .when(negated & neg, "pos")
        .when(negated, "negation_only")
        .when(pos, "pos")
        .when(neg, "neg")
        .otherwise("none")
    )


def polarity_preserved(source: Column | str, target: Column | str) -> Column:
    flags = lambda t, p, n, g: F.struct(effective_polarity(_any(t, p), _any(t, n), _any(t, g)).alias("of"), F.size(t).alias("n"), _any(t, NEGATION).alias("negated"))
    both = F.struct(
        let(polarity_tokens(source), lambda s: flags(s, SOURCE_POSITIVE, SOURCE_NEGATIVE, SOURCE_NEGATION)).alias("s"),
        let(english_cores(target), lambda t: flags(t, POSITIVE, NEGATIVE, NEGATION)).alias("t"),
    )

    def decide(v: Column) -> Column:
        of, to = v["s"]["of"], v["t"]["of"]
        return (
            F.when(v["s"]["n"] == 0, True)
            .when(of == "negation_only", v["t"]["negated"])
            .when(~of.isin("pos", "neg"), True)
            .when(to == "none", False)
            .otherwise(~(to.isin("pos", "neg") & (to != of)))
        )

    return let(both, decide)


def top_share(x: Column | str) -> Column:
    """The share of the commonest token, among eight tokens or more; else 0. Tokens are sorted, so equal ones are runs."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, w: Column) -> Column:
        run = F.when(w == a["last"], a["run"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    most = lambda w: F.aggregate(F.sort_array(w), start, step, lambda a: a["most"])
    return let(words(F.lower(col(x))), lambda w: F.when(F.size(w) >= 8, most(w) / F.size(w)).otherwise(F.lit(0.0)))


def repeats(x: Column | str, ratio: float = REPEAT_RATIO) -> Column:
    """Whether a token makes up this share of eight tokens or more. Sorted, equal tokens are a run; a run as long as asked for covers
    one of the places that far apart, so only the tokens there are counted."""

    def some(w: Column) -> Column:
        step = F.ceil(F.size(w) * ratio).cast("int")
        often = lambda k: F.size(F.filter(w, lambda v: v == F.try_element_at(w, step * k)))
        return (F.size(w) >= 8) & F.coalesce(F.greatest(F.lit(0), *map(often, range(1, int(1 / ratio) + 1))) >= F.size(w) * ratio, F.lit(False))

    return let(F.sort_array(words(F.lower(col(x)))), some)


def unusable_reason(source: Column | str, target: Column | str) -> Column:
    """Why a translation can't be one, by the first rule that says so; null if it can."""

    def decide(v: Column) -> Column:
        s, t, n = v["s"], v["t"], v["n"]
        return (
            F.when(t == "", "empty")
            .when(F.lower(s) == F.lower(t), "unchanged")
            .when(n == 0, "no letters")
            .when(count_in(t, "A-Za-z") / F.when(n > 0, n) < 0.6, "not latin")
            .when((v["sa"] >= 0.5) & (v["ta"] >= 0.2), "arabic left")
            .when(F.length(t) > F.greatest(F.lit(256), F.floor(F.length(s) * MAX_RATIO)), "too long")
            .when(repeats(t), "repeats")
            .when(~polarity_preserved(s, t), "polarity")
        )

    ends = lambda x: squeezed_ends(F.coalesce(col(x), F.lit("")))
    s, t = ends(source), ends(target)
    return let(F.struct(s.alias("s"), t.alias("t"), facts(t)["letters"].alias("n"), arabic_ratio(s).alias("sa"), arabic_ratio(t).alias("ta")), decide)


def route(lang: Column | str) -> Column:
    """How a text of a language is translated."""
    return F.when(col(lang) == "en", "bypass").when(col(lang).isin(*FLORES), "translate").otherwise("passthrough")


def flores_code(lang: Column | str) -> Column:
    return lookup(FLORES, col(lang))


def model_prompt(x: Column | str, lang: Column | str, family: str) -> Column:
    """The text as a family of models wants it: with tags of both languages, with the target's, or as it is (the tokenizer is told
    the language). Plain tags lead astray for Urdu, which needs the family's own preprocessing: there it's null, no prompt."""
    if family == "indictrans2":
        return F.when(col(lang) != "ur", F.concat_ws(" ", flores_code(lang), F.lit("eng_Latn"), col(x)))
    if family == "madlad":
        return F.concat(F.lit("<2en> "), col(x))
    if family == "nllb":
        return col(x)
    raise ValueError(f"no family of models {family!r}")


def decoded(x: Column | str) -> Column:
    """What a model wrote, without blanks around it."""
    return squeezed_ends(x)


def generation_budget(n_tokens: Column | str, longest: int = 256, ratio: float = 2.5, margin: int = 32) -> Column:
    if not ratio:
        return F.lit(longest)
    return F.greatest(F.lit(1), F.least(F.lit(longest), F.floor(col(n_tokens) * ratio).cast("int") + margin))
