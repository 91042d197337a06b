"""The engine's queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vakya.functions import annotate, intel, policy, quality, requests, roman, script, text
from vakya.functions.lexicons import ACTIONS, CATEGORIES, CUE_LANG, EVIDENCE, FLORES, INTENTS, LABEL_FORMS, LABELS, NEGATION, NEGATIVE, POSITIVE, PRESERVED, SCRIPT_LANG, SOURCE_NEGATION, SOURCE_NEGATIVE, SOURCE_POSITIVE, TELUGU, URDU, URDU_KEPT
from vakya.functions.rx import BLOCK_IN, LATIN_IN, URL, W_IN, WS, WS_IN, forward, media, quoted, spam
from vakya.operators import dedupe, gatelog, metrics, models, mt_metrics, reports, winners
from vakya.plans.pipeline import analyze
from vakya.sources import io, store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


# --- pieces of SQL ---------------------------------------------------------------------------------------------------------
def inlist(xs) -> str:
    return "(" + ", ".join(map(quoted, xs)) + ")"


def sqllist(xs) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]"


def case(pairs: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in pairs.items()) + " END"


def n_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(pattern)}))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {quoted(WS + '+')}, ' ', 'g'))"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, {quoted(f'^{WS}+|{WS}+$')}, '', 'g')"


def split_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {quoted(WS + '+')}), lambda w: w <> '')"


def once(x: str) -> str:
    """Repeated letters once: RE2 has no back references."""
    return f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i > 1 AND substr(lower({x}), i::INT, 1) = substr(lower({x}), i::INT - 1, 1) THEN '' ELSE substr(lower({x}), i::INT, 1) END), '')"


def clean_sql(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    for p, to in (("<[^>]+>", " "), (URL, " "), (f"@[{W_IN}]+", " "), (f"#([{W_IN}]+)", "\\1")):
        x = f"regexp_replace({x}, {quoted(p)}, {quoted(to)}, 'g')"
    return squeeze(f"nfc_normalize({x})")


LETTERS = r"\p{L}"
INDIC_IN = "".join(BLOCK_IN[k] for k in script.INDIC)
SCRIPT_SQL = "CASE WHEN greatest(" + ", ".join(f"c.{k}" for k in BLOCK_IN) + ") = 0 THEN 'unknown' ELSE (list_sort([" + ", ".join(f"(-c.{k}, length(regexp_extract(x, {quoted(f'^[^{r}]*')})), '{k}')" for k, r in BLOCK_IN.items()) + "])[1])[3] END"
COUNTS_SQL = "{" + ", ".join(f"'{k}': {n_of('x', f'[{r}]')}" for k, r in BLOCK_IN.items()) + "}"
UNIQUE_SQL = "list_sort([" + ", ".join(f"(-c.{k}, length(regexp_extract(x, {quoted(f'^[^{BLOCK_IN[k]}]*')})), '{v}')" for k, v in SCRIPT_LANG.items()) + "])[1]"
TOTAL_SQL = "(" + " + ".join(f"c.{k}" for k in BLOCK_IN) + ")"
POSTS_SQL = f"p AS (SELECT id, post_text AS x FROM dataset WHERE post_text IS NOT NULL), s AS (SELECT id, x, {COUNTS_SQL} AS c FROM p)"


def posts(s, d):
    return t(s, d, "dataset").where("post_text is not null").select("id", F.col("post_text").alias("x"))


# --- cleaning and labels -----------------------------------------------------------------------------------------------------
@query(f"SELECT id, {clean_sql('post_text')} AS clean_text FROM dataset WHERE post_text IS NOT NULL")
def clean_text(s, d):
    return posts(s, d).select("id", text.clean_text("x").alias("clean_text"))


@query(f"SELECT id, {case(LABEL_FORMS, 'lower(trim(ground_truth_sentiment))')} AS label, CASE {case(LABEL_FORMS, 'lower(trim(ground_truth_sentiment))')} WHEN 'Negative' THEN 0 WHEN 'Neutral' THEN 1 WHEN 'Positive' THEN 2 END AS label_id FROM dataset")
def label_normalize(s, d):
    return t(s, d, "dataset").select("id", text.normalize_label("ground_truth_sentiment").alias("label")).withColumn("label_id", text.label_id("label"))


@query(f"WITH a AS (SELECT id, {clean_sql('post_text')} AS clean_text, {case(LABEL_FORMS, 'lower(trim(ground_truth_sentiment))')} AS label FROM dataset WHERE post_text IS NOT NULL) SELECT label, count(*) AS n, sum(length(clean_text)) AS n_chars FROM a WHERE clean_text <> '' GROUP BY label")
def preprocess_counts(s, d):
    return text.preprocess(t(s, d, "dataset")).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("clean_text")).alias("n_chars"))


# --- scripts -------------------------------------------------------------------------------------------------------------------
@query(f"WITH {POSTS_SQL} SELECT id, " + ", ".join(f"c.{k} AS {k}" for k in BLOCK_IN) + " FROM s")
def script_profile(s, d):
    return posts(s, d).select("id", script.script_counts("x").alias("c")).select("id", "c.*")


@query(f"WITH {POSTS_SQL} SELECT id, {SCRIPT_SQL} AS script, CASE WHEN {TOTAL_SQL} = 0 THEN 0 ELSE round(c.latin / {TOTAL_SQL}, 6) END AS latin_ratio FROM s")
def detect_script(s, d):
    return posts(s, d).select("id", script.detect_script("x").alias("script"), F.round(script.latin_ratio("x"), 6).alias("latin_ratio"))


@query(f"WITH {POSTS_SQL}, u AS (SELECT *, {UNIQUE_SQL} AS top FROM s) SELECT id, CASE WHEN top[1] < 0 AND -top[1] / {TOTAL_SQL} >= 0.15 THEN top[3] END AS language FROM u")
def unique_script_lang(s, d):
    return posts(s, d).select("id", script.unique_language("x").alias("language"))


_extract_sql = squeeze(f"regexp_replace(x, {quoted(rf'[^{LATIN_IN}{WS_IN}\x{{00}}-\x{{40}}\x{{5b}}-\x{{60}}\x{{7b}}-\x{{7f}}]')}, '', 'g')")


@query(f"WITH {POSTS_SQL} SELECT id, {_extract_sql} AS latin_text FROM s")
def extract_latin(s, d):
    return posts(s, d).select("id", script.extract_latin("x").alias("latin_text"))


def _letters(x: str, lo: int, hi: int) -> str:
    return f"len(list_filter(regexp_extract_all({x}, '\\p{{L}}'), lambda l: unicode(l) BETWEEN {lo} AND {hi}))"


_indic_letters = "len(list_filter(regexp_extract_all(x, '\\p{L}'), lambda l: unicode(l) BETWEEN 2304 AND 2431 OR unicode(l) BETWEEN 2432 AND 2815 OR unicode(l) BETWEEN 2944 AND 3455 OR unicode(l) BETWEEN 1536 AND 1791))"


@query(f"WITH {POSTS_SQL}, l AS (SELECT id, {_letters('x', 65, 591)} AS a, {_indic_letters} AS b, {_letters('x', 1536, 1791)} AS r, {n_of('x', LETTERS)} AS n FROM s) SELECT id, CASE WHEN a + b = 0 THEN 0 ELSE round(least(a, b) / (a + b), 6) END AS script_mix, CASE WHEN n = 0 THEN 0 ELSE round(r / n, 6) END AS arabic_ratio FROM l")
def script_mix(s, d):
    return posts(s, d).select("id", F.round(script.script_mix("x"), 6).alias("script_mix"), F.round(script.arabic_ratio("x"), 6).alias("arabic_ratio"))


# --- romanised words -----------------------------------------------------------------------------------------------------------
CORE_SQL = quoted(roman.CORE)
TOKENS_SQL = f"list_filter({split_words(f"regexp_replace(x, '[.!,?;:]+', ' ', 'g')")}, lambda w: regexp_matches(w, {CORE_SQL}))"


def preserved_sql(c: str) -> str:
    return f"(regexp_matches({c}, '^[A-Z]{{2,6}}$') OR list_contains({sqllist(PRESERVED)}, lower({c})) OR list_contains({sqllist(PRESERVED)}, {once(c)}))"


CORES_SQL = f"w AS (SELECT id, x, row_number() OVER () AS r FROM p), k AS (SELECT r, id, unnest({TOKENS_SQL}) AS token, unnest(range(1, len({TOKENS_SQL}) + 1)) AS i FROM w), c AS (SELECT r, id, i, regexp_extract(token, {CORE_SQL}, 2) AS core FROM k), kept AS (SELECT r, id, i, core, {once('core')} AS one FROM c WHERE NOT {preserved_sql('core')}), h AS (SELECT r, i, CASE WHEN {case(CUE_LANG, 'lower(core)')} IS NOT NULL THEN lower(core) WHEN {case(CUE_LANG, 'one')} IS NOT NULL THEN one END AS key, coalesce({case(CUE_LANG, 'lower(core)')}, {case(CUE_LANG, 'one')}) AS lang FROM kept)"


@query(f"WITH p AS (SELECT id, post_text AS x FROM dataset WHERE post_text IS NOT NULL), {CORES_SQL}, g AS (SELECT r, count(lang) AS n_cues, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS language, string_agg(key, ' ' ORDER BY i) AS keys FROM h GROUP BY r) SELECT w.id, coalesce(n_cues, 0) AS n_cues, language, coalesce(keys, '') AS keys FROM w LEFT JOIN g USING (r)")
def cue_hits(s, d):
    hits = posts(s, d).select("id", roman.cue_hits("x").alias("hits"))
    return hits.select("id", F.size("hits").alias("n_cues"), roman.hits_language("hits").alias("language"), F.array_join(F.transform("hits", lambda h: h["key"]), " ").alias("keys"))


@query(f"WITH p AS (SELECT id, post_text AS x FROM dataset WHERE post_text IS NOT NULL), w AS (SELECT id, list_transform({TOKENS_SQL}, lambda q: regexp_extract(q, {CORE_SQL}, 2)) AS c FROM p) SELECT id, array_to_string(list_filter(c, lambda q: length(q) > 1 AND NOT {preserved_sql('q')}), ' ') AS residual FROM w")
def residual_tokens(s, d):
    return posts(s, d).select("id", roman.residual("x").alias("residual"))


@query(f"WITH p AS (SELECT DISTINCT post_text AS x FROM dataset WHERE post_text IS NOT NULL), k AS (SELECT unnest({TOKENS_SQL}) AS token FROM p), c AS (SELECT regexp_extract(token, {CORE_SQL}, 2) AS core FROM k) SELECT core, {once('core')} AS collapsed, {preserved_sql('core')} AS preserved, count(*) AS n FROM c GROUP BY core")
def preserve_tokens(s, d):
    w = posts(s, d).select("x").distinct().select(F.explode(roman.cores("x")).alias("core")).groupBy("core").agg(F.count("*").alias("n"))
    return w.select("core", roman.collapsed(F.col("core")).alias("collapsed"), roman.is_preserved(F.col("core")).alias("preserved"), "n")


_canned = "v AS (SELECT o.id, x, n_cues, cue, resid, len(string_split(resid, ' ')) AS n_resid, CASE o.id % 5 WHEN 0 THEN 'hi' WHEN 1 THEN 'en' WHEN 2 THEN 'te' END AS top, o.id % 5 <> 2 AND o.id % 5 <> 4 AS sure, CASE WHEN n_cues >= 1 THEN CASE o.id % 5 WHEN 0 THEN 'hi' WHEN 2 THEN 'te' END END AS other, CASE WHEN n_cues >= 1 AND resid <> '' AND o.id % 2 = 0 THEN coalesce(cue, 'hi') END AS by_rest, CASE o.id % 3 WHEN 1 THEN 'en' WHEN 2 THEN 'ta' END AS bert FROM o)"


@query(
    f"WITH p AS (SELECT id, post_text AS x FROM dataset WHERE post_text IS NOT NULL), {CORES_SQL}, g AS (SELECT r, count(lang) AS n_cues, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS cue FROM h GROUP BY r), e AS (SELECT r, string_agg(core, ' ' ORDER BY i) FILTER (length(core) > 1) AS resid FROM kept GROUP BY r), "
    f"o AS (SELECT w.id, x, coalesce(n_cues, 0) AS n_cues, cue, coalesce(resid, '') AS resid FROM w LEFT JOIN g USING (r) LEFT JOIN e USING (r)), {_canned}, "
    "z AS (SELECT *, CASE WHEN sure THEN top END AS first, coalesce(other, by_rest) AS rescue, n_cues = 0 AND CASE WHEN resid = '' THEN 0 ELSE n_resid END <= 4 AS short FROM v) "
    "SELECT id, CASE WHEN trim(x) = '' THEN NULL WHEN first <> 'en' AND NOT short THEN coalesce(cue, first) WHEN bert <> 'en' AND NOT short THEN coalesce(cue, bert) WHEN bert IS NOT NULL AND (bert = 'en' OR short) THEN coalesce(rescue, 'en') "
    "WHEN sure AND (first IS NULL OR first = 'en') THEN coalesce(rescue, CASE WHEN first = 'en' THEN 'en' END) WHEN sure THEN CASE WHEN short THEN 'en' ELSE first END ELSE rescue END AS language FROM z"
)
def roman_languages(s, d):
    """The decision on Latin texts from canned scores of every kind, by id."""
    of = lambda label, score: F.array(F.struct(F.lit(label).alias("label"), F.lit(score).alias("score")))
    k = F.col("id") % 5
    ranked = F.when(k == 0, of("hin_Latn", 0.9)).when(k == 1, of("eng_Latn", 0.8)).when(k == 2, of("tel_Latn", 0.4)).when(k == 3, of("snd_Latn", 0.7)).otherwise(F.array().cast("array<struct<label:string,score:double>>"))
    bert = F.when(F.col("id") % 3 == 1, "eng_Latn").when(F.col("id") % 3 == 2, "tam_Latn")
    rest = F.when(F.col("id") % 2 == 0, of("hin_Latn", 0.3)).otherwise(of("hin_Latn", 0.1))
    return posts(s, d).select("id", roman.roman_language("x", ranked, bert, rest).alias("language"))


_around = f"regexp_extract(w, {CORE_SQL}, 1) || {{}} || regexp_extract(w, {CORE_SQL}, 3)"
_core = f"regexp_extract(w, {CORE_SQL}, 2)"
_telugu = f"coalesce({case(TELUGU, f'lower({_core})')}, {case(TELUGU, once(_core))})"
_spelled_sql = (
    f"CASE WHEN NOT regexp_matches(w, {CORE_SQL}) OR regexp_matches(regexp_extract(w, {CORE_SQL}, 1) || regexp_extract(w, {CORE_SQL}, 3), '[\\p{{L}}\\p{{N}}]') THEN w "
    f"WHEN lang = 'ur' AND lower({_core}) IN {inlist(URDU)} THEN {_around.format(case(URDU, f'lower({_core})'))} WHEN lang = 'ur' AND lower({_core}) IN {inlist(URDU_KEPT)} THEN w "
    f"WHEN {preserved_sql(_core)} THEN w WHEN lang = 'te' AND {_telugu} IS NOT NULL THEN {_around.format(_telugu)} ELSE w END"
)


@query(f"WITH q AS (SELECT id, post_text AS x, CASE id % 3 WHEN 0 THEN 'te' WHEN 1 THEN 'ur' ELSE 'en' END AS lang, row_number() OVER () AS r FROM dataset WHERE post_text IS NOT NULL), k AS (SELECT r, lang, unnest(string_split(x, ' ')) AS w, unnest(range(1, len(string_split(x, ' ')) + 1)) AS i FROM q), o AS (SELECT r, string_agg({_spelled_sql}, ' ' ORDER BY i) AS spelled FROM k GROUP BY r) SELECT q.id, q.lang, CASE WHEN q.lang <> 'en' AND trim(x) <> '' THEN spelled END AS native_text FROM q JOIN o USING (r)")
def xlit_rules(s, d):
    lang = F.when(F.col("id") % 3 == 0, "te").when(F.col("id") % 3 == 1, "ur").otherwise("en")
    return posts(s, d).withColumn("lang", lang).select("id", "lang", roman.transliterate_rules("x", "lang").alias("native_text"))


# --- routing and the gate --------------------------------------------------------------------------------------------------------
@query(f"SELECT result_id, CASE WHEN language = 'en' THEN 'bypass' WHEN language IN {inlist(FLORES)} THEN 'translate' ELSE 'passthrough' END AS route, {case(FLORES, 'language')} AS flores, greatest(1, least(256, floor(length(post_text) * 2.5)::INT + 32)) AS budget FROM pipeline_result")
def route_translation(s, d):
    return t(s, d, "pipeline_result").select("result_id", quality.route("language").alias("route"), quality.flores_code("language").alias("flores"), quality.generation_budget(F.length("post_text")).alias("budget"))


_cut = f"string_split(regexp_replace({stripped('post_text')}, {quoted(f'([.!?।]){WS}+')}, '\\1' || chr(1), 'g'), chr(1))"


@query(f"SELECT id, len(list_filter({_cut}, lambda q: {stripped('q')} <> '')) AS n, CASE WHEN len(list_filter({_cut}, lambda q: {stripped('q')} <> '')) >= 2 THEN array_to_string(list_filter(list_transform({_cut}, lambda q: {stripped('q')}), lambda q: q <> ''), '|') ELSE {stripped('post_text')} END AS parts FROM dataset WHERE trim(post_text) <> ''")
def sentence_chunks(s, d):
    return posts(s, d).where("trim(x) <> ''").select("id", F.size(text.sentences("x")).alias("n"), F.array_join(text.sentences("x"), "|").alias("parts"))


_src_core = f"lower(regexp_extract(w, {CORE_SQL}, 2))"
_known_src = (*SOURCE_POSITIVE, *SOURCE_NEGATIVE, *SOURCE_NEGATION)
_src_tokens = f"list_filter(list_transform(list_filter({split_words("replace(src, '.', ' ')")}, lambda w: regexp_matches(w, {CORE_SQL})), lambda w: CASE WHEN {_src_core} IN {inlist(_known_src)} THEN {_src_core} WHEN {once(_src_core)} IN {inlist(_known_src)} THEN {once(_src_core)} END), lambda w: w IS NOT NULL)"
_raw = "list_transform(regexp_extract_all(coalesce(tgt, ''), '[A-Za-z]+(?:''[A-Za-z]+)?'), lambda w: lower(w))"
_tgt_cores = f"flatten(list_transform({_raw}, lambda w: CASE WHEN NOT ends_with(w, 'n''t') THEN [w] WHEN w = 'can''t' THEN ['not', 'can'] WHEN w IN ('n''t', 'won''t', 'shan''t', 'ain''t') THEN ['not'] ELSE ['not', left(w, length(w) - 3)] END))"


def eff(p: str, n: str, g: str) -> str:
    return f"CASE WHEN {p} AND {n} THEN 'mixed' WHEN {g} AND {p} THEN 'neg' WHEN {g} AND {n} THEN 'pos' WHEN {g} THEN 'negation_only' WHEN {p} THEN 'pos' WHEN {n} THEN 'neg' ELSE 'none' END"


def has(x: str, of) -> str:
    return f"list_has_any({x}, {sqllist(of)})"


POLARITY_CTE = f"q AS (SELECT *, {_src_tokens} AS st, {_tgt_cores} AS tt FROM pairs), e AS (SELECT *, {eff(has('st', SOURCE_POSITIVE), has('st', SOURCE_NEGATIVE), has('st', SOURCE_NEGATION))} AS se, {eff(has('tt', POSITIVE), has('tt', NEGATIVE), has('tt', NEGATION))} AS te FROM q), f AS (SELECT *, CASE WHEN len(st) = 0 THEN true WHEN se = 'negation_only' THEN {has('tt', NEGATION)} WHEN se NOT IN ('pos', 'neg') THEN true WHEN te = 'none' THEN false ELSE NOT (te IN ('pos', 'neg') AND te <> se) END AS preserved FROM e)"
#: Pairs in which every branch occurs: a word of polarity, chosen by id, is put into source and translation.
_vary_src, _vary_tgt = ("good", "not good", "bad", "", "not", "super work, not bad"), ("a good thing", "not good", "never bad", "plain", "can't", "worst")
PAIRS_SQL = f"pairs AS (SELECT result_id, {sqllist(_vary_src)}[result_id % 6 + 1] || ' ' || post_text AS src, {sqllist(_vary_tgt)}[result_id % 5 + 1] || ' ' || english_text AS tgt FROM pipeline_result WHERE post_text IS NOT NULL AND english_text IS NOT NULL)"


def _pairs(s, d):
    pick = lambda of, k: F.element_at(F.array(*map(F.lit, of)), (F.col("result_id") % k + 1).cast("int"))
    r = t(s, d, "pipeline_result").where("post_text is not null and english_text is not null")
    return r.select("result_id", F.concat(pick(_vary_src, 6), F.lit(" "), "post_text").alias("src"), F.concat(pick(_vary_tgt, 5), F.lit(" "), "english_text").alias("tgt"))


@query(f"WITH {PAIRS_SQL}, {POLARITY_CTE} SELECT result_id, preserved FROM f")
def polarity_preserved(s, d):
    return _pairs(s, d).select("result_id", quality.polarity_preserved("src", "tgt").alias("preserved"))


_ar = lambda x: f"CASE WHEN {n_of(x, LETTERS)} = 0 THEN 0 ELSE {_letters(x, 1536, 1791)} / {n_of(x, LETTERS)} END"
_top = f"CASE WHEN len({split_words('lower(tgt)')}) >= 8 THEN list_max(map_values(histo)) / len({split_words('lower(tgt)')}) ELSE 0 END"


_reason = f"CASE WHEN tgt = '' THEN 'empty' WHEN lower(src) = lower(tgt) THEN 'unchanged' WHEN {n_of('tgt', LETTERS)} = 0 THEN 'no letters' WHEN {n_of('tgt', '[A-Za-z]')} / {n_of('tgt', LETTERS)} < 0.6 THEN 'not latin' WHEN {_ar('src')} >= 0.5 AND {_ar('tgt')} >= 0.2 THEN 'arabic left' WHEN length(tgt) > greatest(256, floor(length(src) * 4.0)) THEN 'too long' WHEN {_top} >= 0.5 THEN 'repeats' WHEN NOT preserved THEN 'polarity' END"


def gated(raw: str, keys: str) -> str:
    """`raw` (keys, src, tgt) to `gated` (keys, tgt, reason): why each translation can't be one."""
    return f"{raw}, pairs AS (SELECT {keys}, {stripped('src')} AS src, {stripped('tgt')} AS tgt, list_aggregate({split_words('lower(tgt)')}, 'histogram') AS histo FROM raw), {POLARITY_CTE}, gated AS (SELECT {keys}, tgt, {_reason} AS reason FROM f)"


@query(f"WITH {gated(PAIRS_SQL.replace('pairs AS', 'raw AS'), 'result_id')} SELECT result_id, reason FROM gated")
def translation_usable(s, d):
    return _pairs(s, d).select("result_id", quality.unusable_reason("src", "tgt").alias("reason"))


@query(f"WITH r AS (SELECT result_id, post_text AS x, coalesce(language, 'unknown') AS lang FROM pipeline_result WHERE post_text IS NOT NULL), s AS (SELECT *, {COUNTS_SQL} AS c FROM r), u AS (SELECT *, {UNIQUE_SQL} AS top, {SCRIPT_SQL} AS script FROM s), v AS (SELECT *, CASE WHEN top[1] < 0 AND -top[1] / {TOTAL_SQL} >= 0.15 THEN top[3] END AS uniq, CASE WHEN script = 'latin' THEN x WHEN lang IN ('en', 'unknown') AND {TOTAL_SQL} > 0 AND c.latin / {TOTAL_SQL} >= 0.15 THEN {_extract_sql} END AS probe FROM u), n AS (SELECT *, CASE WHEN contains(lower(probe), 'firyadu') THEN 'te' WHEN contains(lower(probe), 'shikayat') THEN 'hi' WHEN trim(probe) <> '' THEN 'en' END AS better FROM v) SELECT result_id, CASE WHEN lang IN ('en', 'unknown') AND uniq IS NOT NULL THEN uniq WHEN probe IS NULL OR trim(probe) = '' OR better IS NULL THEN lang WHEN lang NOT IN ('en', 'unknown') AND better = 'en' THEN lang ELSE better END AS language FROM n")
def refine_language(s, d):
    better = lambda p: F.when(F.contains(F.lower(p), F.lit("firyadu")), "te").when(F.contains(F.lower(p), F.lit("shikayat")), "hi").when(F.trim(p) != "", "en")
    r = t(s, d, "pipeline_result").where("post_text is not null").withColumn("lang", F.coalesce("language", F.lit("unknown")))
    return r.select("result_id", roman.refine_language("post_text", "lang", better).alias("language"))


# --- scores and flags -----------------------------------------------------------------------------------------------------------
@query("WITH a AS (SELECT vec_id, abs(embedding[1])::DOUBLE AS n, abs(embedding[2])::DOUBLE AS p FROM embeddings), b AS (SELECT vec_id, n, 2 * least(n, p) AS u, p, n + 2 * least(n, p) + p AS s FROM a) SELECT vec_id, round(n / s, 6) AS negative, round(u / s, 6) AS neutral, round(p / s, 6) AS positive, CASE WHEN n >= u AND n >= p THEN 'Negative' WHEN u >= p THEN 'Neutral' ELSE 'Positive' END AS label, round(greatest(n, u, p) / s, 4) AS confidence FROM b")
def canonical_probs(s, d):
    e = t(s, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda x: F.abs(x).cast("double")).alias("raw"))
    e = e.select("vec_id", annotate.canonical_probs("raw", annotate.label_mapping({0: "NEG", 1: "POS"})).alias("p"))
    return e.select("vec_id", *(F.round(F.col("p")[k], 6).alias(x.lower()) for k, x in enumerate(LABELS)), annotate.top_label("p").alias("label"), annotate.top_confidence("p").alias("confidence"))


@query("SELECT result_id, coalesce(confidence < 0.6, true) AS low_confidence, coalesce(confidence < 0.6, true) OR coalesce(language, '') IN ('unknown', '') OR (language <> 'en' AND NOT coalesce(was_translated, false)) OR coalesce(fallback_used, false) OR coalesce(translation_truncated, false) OR coalesce(sentiment_truncated, false) AS review_recommended FROM pipeline_result")
def quality_flags(s, d):
    return t(s, d, "pipeline_result").withColumns(annotate.quality_flags()).select("result_id", "low_confidence", "review_recommended")


@query("SELECT result_id, coalesce(trim(english_text) <> '', false) AND coalesce(sentiment IN ('Negative', 'Neutral', 'Positive'), false) AND coalesce(confidence BETWEEN 0 AND 1, false) AND coalesce(translation_time_ms >= 0 AND sentiment_time_ms >= 0 AND total_time_ms >= 0, false) AND coalesce(abs(total_time_ms - (translation_time_ms + sentiment_time_ms)) <= 0.01, false) AS valid, greatest(0, coalesce(total_time_ms, 0)) AS safe_time FROM pipeline_result")
def validate_outcomes(s, d):
    return t(s, d, "pipeline_result").select("result_id", F.coalesce(annotate.is_valid_result(), F.lit(False)).alias("valid"), annotate.safe_time("total_time_ms").alias("safe_time"))


_w = split_words("coalesce(english_text, '')")
_p = "coalesce(post_text, '')"
_flags_sql = {
    "very_short": f"len({_w}) <= 3",
    "truncated": f"length({_p}) > 4000",
    "low_sentiment_confidence": "coalesce(confidence, 0) < 0.6",
    "code_mixed": f"CASE WHEN {_letters(_p, 65, 591)} + {_indic_letters.replace('(x,', f'({_p},')} = 0 THEN false ELSE least({_letters(_p, 65, 591)}, {_indic_letters.replace('(x,', f'({_p},')}) / ({_letters(_p, 65, 591)} + {_indic_letters.replace('(x,', f'({_p},')}) >= 0.15 END",
    "romanized_indic_transliterated": "coalesce(was_transliterated, false)",
    "ollama_pipeline_fallback": "coalesce(fallback_used, false)",
    "translation_truncated": "coalesce(translation_truncated, false)",
    "sentiment_truncated": "coalesce(sentiment_truncated, false)",
    "translation_unavailable": "coalesce(language, '') NOT IN ('en', '') AND NOT coalesce(was_translated, false)",
    "language_undetermined": "coalesce(language, '') = 'unknown'",
    "quoted_or_forwarded": f"regexp_matches({_p}, {quoted(forward)})",
    "possible_spam": f"regexp_matches({_p}, {quoted(spam)}) OR {n_of(_p, f'#[{W_IN}]+')} >= 8",
    "link_heavy": f"{n_of(_p, URL)} >= 3",
    "possible_ocr_noise": f"len({_w}) >= 6 AND len(list_filter({_w}, lambda q: length(q) = 1)) / greatest(len({_w}), 1) > 0.4",
}


@query("SELECT result_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _flags_sql.items()) + "], lambda q: q IS NOT NULL), '|') AS signals FROM pipeline_result")
def signals(s, d):
    return t(s, d, "pipeline_result").select("result_id", F.array_join(intel.signals(), "|").alias("signals"))


@query(f"SELECT result_id, CASE WHEN {stripped(_p)} = '' THEN 'blank' WHEN regexp_matches({stripped(_p)}, {quoted(media)}) THEN 'media' WHEN NOT regexp_matches(regexp_replace({_p}, {quoted(URL)}, ' ', 'g'), '[\\p{{L}}\\p{{N}}]') THEN 'no text' WHEN {stripped("coalesce(english_text, '')")} = '' THEN 'no translation' END AS why, CASE WHEN length({_p}) <= 200 THEN {_p} ELSE left({_p}, 140) || chr(10) || '...[truncated]...' || chr(10) || right({_p}, 60) END AS clipped FROM pipeline_result")
def contentless(s, d):
    return t(s, d, "pipeline_result").select("result_id", intel.contentless().alias("why"), text.clip(F.coalesce("post_text", F.lit("")), 200).alias("clipped"))


@query("SELECT intel_id, coalesce(" + case({x.lower(): x for x in CATEGORIES}, "lower(trim(category))") + ", 'Unknown') AS category, coalesce(" + case({x.lower(): x for x in ACTIONS}, "lower(trim(recommended_action))") + ", 'Human Review') AS action, coalesce(" + case({x.lower(): x for x in EVIDENCE}, "lower(trim(evidence_confidence))") + ", 'low') AS evidence, greatest(0, least(100, coalesce(risk_score, 0) * 3 - 40)) AS risk, CASE WHEN len(" + split_words("coalesce(summary, '')") + ") > 8 THEN array_to_string(list_slice(" + split_words("coalesce(summary, '')") + ", 1, 8), ' ') ELSE " + stripped("coalesce(summary, '')") + " END AS short FROM intelligence_result")
def llm_reply_clamp(s, d):
    r = t(s, d, "intelligence_result")
    risk = intel.risk((F.col("risk_score") * 3 - 40).cast("string"))
    return r.select("intel_id", intel.pick("category", CATEGORIES, "Unknown").alias("category"), intel.pick("recommended_action", ACTIONS, "Human Review").alias("action"), intel.pick("evidence_confidence", EVIDENCE, "low").alias("evidence"), risk.alias("risk"), text.first_words(F.coalesce("summary", F.lit(""))).alias("short"))


_js = lambda x: f"coalesce('\"' || replace(replace({x}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"', 'null')"


@query(f"WITH c AS (SELECT row_number() OVER () AS r, '{{\"definition\":' || {_js("coalesce(definition, '')")} || ',\"id\":' || {_js('category_id')} || ',\"keywords\":[' || array_to_string(list_transform(keywords, lambda k: {_js('k')}), ',') || '],\"severity\":' || {_js("coalesce(severity, '')")} || '}}' AS j FROM policy_category), o AS (SELECT string_agg(j, ',' ORDER BY r) AS js FROM c) SELECT 'sha256:' || sha256('{{\"categories\":[' || js || '],\"intent_mode\":\"enum\",\"unknown_label\":\"Unknown\"}}') AS fingerprint FROM o")
def policy_fingerprint(s, d):
    rows = t(s, d, "policy_category").toLocalIterator()  # a pack, in the order of its table
    pack = policy.parse_pack({"categories": [{"id": r["category_id"], "definition": r["definition"], "severity": r["severity"], "keywords": r["keywords"]} for r in rows]})
    return s.createDataFrame([(pack.fingerprint(),)], "fingerprint string")


_why_sql = f"CASE WHEN {stripped(_p)} = '' THEN 'blank' WHEN regexp_matches({stripped(_p)}, {quoted(media)}) THEN 'media' WHEN NOT regexp_matches(regexp_replace({_p}, {quoted(URL)}, ' ', 'g'), '[\\p{{L}}\\p{{N}}]') THEN 'no text' WHEN {stripped("coalesce(english_text, '')")} = '' THEN 'no translation' END"
_say_sql = lambda why, i: case({"blank": ("The post is empty or contains only whitespace; there is no content to assess.", "Ignore")[i], "media": ("The post is a media placeholder with no accompanying text. The attached media itself was not available for assessment.", "Human Review")[i], "no text": ("The post contains no textual content once links are removed (emoji, punctuation or URL only), so intent, category and contextual risk cannot be assessed from text.", "Ignore")[i], "no translation": ("The pipeline produced no English text for this post, so no assessment can be made from the translation.", "Human Review")[i]}, why)
#: Results, some without content: by result_id a text is left out, or a placeholder, a link or nothing translated.
_bare_sql = "bare AS (SELECT * REPLACE (CASE result_id % 11 WHEN 1 THEN '  ' WHEN 2 THEN '[photo omitted]' WHEN 3 THEN 'https://a.in/x !!' ELSE post_text END AS post_text, CASE WHEN result_id % 11 = 4 THEN ' ' ELSE english_text END AS english_text) FROM pipeline_result)"


def _bare(s, d):
    k = F.col("result_id") % 11
    r = t(s, d, "pipeline_result")
    return r.withColumn("post_text", F.when(k == 1, "  ").when(k == 2, "[photo omitted]").when(k == 3, "https://a.in/x !!").otherwise(F.col("post_text"))).withColumn("english_text", F.when(k == 4, " ").otherwise(F.col("english_text")))


_default_print = "'sha256:88b29680510e42c9bacb6d6c9c6799c7be0f693bfe2716461227476faaf6fd4b'"


@query(f"WITH {_bare_sql}, w AS (SELECT result_id, {_why_sql} AS why FROM bare) SELECT result_id, 'Unknown' AS category, 'Unknown' AS intent, 'Unknown' AS intent_label, 0 AS risk_score, {_say_sql('why', 0)} AS reasoning, 'No intelligence assessment could be produced for this post.' AS summary, {_say_sql('why', 1)} AS recommended_action, 'low' AS evidence_confidence, 'triage' AS source, {_default_print} AS policy_pack_fingerprint, 0 AS n_keywords FROM w WHERE why IS NOT NULL")
def triage_records(s, d):
    r = _bare(s, d).withColumn("record", intel.triage(intel.signals())).where("record is not null")
    return r.select("result_id", *(f"record.{c}" for c in ("category", "intent", "intent_label", "risk_score", "reasoning", "summary", "recommended_action", "evidence_confidence", "source", "policy_pack_fingerprint")), F.size("record.keyword_context").alias("n_keywords"))


_json = lambda pairs: "'{' || " + " || ',' || ".join(f"'\"{k}\": ' || {v}" for k, v in pairs.items()) + " || '}'"
_reply_parts = {
    "category": "'\"' || upper(coalesce(trim(category), 'x')) || '\"'",
    "intent": "'\"' || coalesce(intent, 'Nonsense') || '\"'",
    "risk_score": "CASE intel_id % 4 WHEN 0 THEN '72.5' WHEN 1 THEN '\"abc\"' WHEN 2 THEN '-3' ELSE '250' END",
    "reasoning": "CASE WHEN intel_id % 3 = 0 THEN '\" \"' ELSE '\"because\"' END",
    "summary": "CASE WHEN intel_id % 7 = 0 THEN '\"\"' ELSE '\"short\"' END",
    "recommended_action": "'\"' || coalesce(lower(recommended_action), 'none') || '\"'",
    "evidence_confidence": "'\"' || coalesce(evidence_confidence, 'sure') || '\"'",
    "keyword_context": "CASE WHEN intel_id % 2 = 0 THEN '[{\"keyword\": \"road\", \"matched\": true, \"contextually_relevant\": false, \"usage\": \"u\", \"reason\": \"r\"}]' ELSE '\"road\"' END",
}
#: A reply bare, fenced, in prose, as a list, or cut off, by id.
_reply_expr = f"CASE intel_id % 5 WHEN 0 THEN {_json(_reply_parts)} WHEN 1 THEN '```json' || chr(10) || {_json(_reply_parts)} || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || {_json(_reply_parts)} || ' done' WHEN 3 THEN '[1, 2]' ELSE '{{\"category\": ' END"
_i_known = "coalesce(" + case({x.lower(): x for x in INTENTS}, "lower(trim(coalesce(intent, '')))") + ", 'Unknown')"


@query(
    "SELECT intel_id, CASE WHEN intel_id % 5 >= 3 THEN 'error' ELSE 'provider' END AS source, CASE WHEN intel_id % 5 >= 3 THEN 'Unknown' ELSE coalesce(" + case({x.lower(): x for x in CATEGORIES}, "lower(trim(category))") + f", 'Unknown') END AS category, CASE WHEN intel_id % 5 >= 3 THEN 'Unknown' ELSE {_i_known} END AS intent, "
    "CASE WHEN intel_id % 5 >= 3 THEN 0 ELSE CASE intel_id % 4 WHEN 0 THEN 72 WHEN 3 THEN 100 ELSE 0 END END AS risk_score, CASE WHEN intel_id % 5 >= 3 THEN 'The intelligence provider could not be reached or returned an unusable response (' || CASE WHEN intel_id % 10 = 3 THEN 'TimeoutError' ELSE 'ValueError' END || '). The deterministic sentiment result is unaffected and remains valid.' WHEN intel_id % 3 = 0 THEN 'The model returned no reasoning for this assessment.' ELSE 'because' END AS reasoning, "
    "CASE WHEN intel_id % 5 >= 3 THEN 'No intelligence assessment could be produced for this post.' WHEN intel_id % 7 = 0 THEN 'No summary was produced for this post.' ELSE 'short' END AS summary, "
    "CASE WHEN intel_id % 5 >= 3 OR intel_id % 3 = 0 THEN 'Human Review' ELSE coalesce(" + case({x.lower(): x for x in ACTIONS}, "lower(recommended_action)") + ", 'Human Review') END AS recommended_action, CASE WHEN intel_id % 5 >= 3 THEN 'low' ELSE coalesce(" + case({x: x for x in EVIDENCE}, "lower(trim(evidence_confidence))") + ", 'low') END AS evidence_confidence, "
    "CASE WHEN intel_id % 5 < 3 AND intel_id % 2 = 0 THEN 1 ELSE 0 END AS n_keywords, round(latency_ms, 1) AS latency_ms, 'm' AS model FROM intelligence_result WHERE latency_ms IS NOT NULL"
)
def intelligence_records(s, d):
    """Assessments from canned replies of every kind, and from failures."""
    r = t(s, d, "intelligence_result").where("latency_ms is not null").withColumn("reply", F.expr(_reply_expr.replace("chr(10)", "'\n'")))
    r = r.withColumn("failure", F.when(F.col("intel_id") % 10 == 3, "TimeoutError")).withColumns({"post_text": F.lit("a post"), "english_text": F.lit("a post")})
    rec = r.select("intel_id", intel.assessment("reply", "failure", "latency_ms", F.lit("m")).alias("r"))
    return rec.select("intel_id", *(f"r.{c}" for c in ("source", "category", "intent", "risk_score", "reasoning", "summary", "recommended_action", "evidence_confidence")), F.size("r.keyword_context").alias("n_keywords"), "r.latency_ms", "r.model")


@query("SELECT count(*) AS n_posts, count(*) FILTER (NOT coalesce(list_contains(signals, 'duplicate_post'), false)) AS n_analyzed, count(*) FILTER (list_contains(signals, 'duplicate_post')) AS n_reused, count(*) FILTER (source = 'triage') AS n_triage, count(*) FILTER (source = 'error') AS n_errors FROM intelligence_result")
def outcome_counts(s, d):
    return intel.outcome_counts(t(s, d, "intelligence_result").withColumn("signals", F.coalesce("signals", F.array().cast("array<string>"))))


@query("SELECT result_id, left(original, 50) AS head, language, was_translated, backend, n_signals FROM (SELECT result_id, coalesce(post_text, '') AS original, language, coalesce(was_translated, false) AS was_translated, coalesce(nullif(translation_backend, ''), 'unknown') AS backend, len(list_filter([" + ", ".join(f"{c}" for c in _flags_sql.values()) + "], lambda q: q)) AS n_signals FROM pipeline_result)")
def model_payload(s, d):
    p = t(s, d, "pipeline_result").withColumn("signals", intel.signals()).select("result_id", intel.payload().alias("j"))
    got = F.from_json("j", "original_text string, language string, was_translated boolean, translation_backend string, signals array<string>")
    return p.select("result_id", got.alias("v")).select("result_id", F.left("v.original_text", F.lit(50)).alias("head"), "v.language", "v.was_translated", F.col("v.translation_backend").alias("backend"), F.size("v.signals").alias("n_signals"))


_bad_reply = "CASE failure_id % 4 WHEN 0 THEN '{\"english_text\": \" It is said here \", \"sentiment\": \"Neutral\", \"confidence\": 0.75}' WHEN 1 THEN '{\"english_text\": \"x\", \"sentiment\": \"Mixed\", \"confidence\": 0.75}' WHEN 2 THEN '{\"english_text\": \"x\", \"sentiment\": \"Neutral\"}' ELSE 'no' END"


@query("WITH f AS (SELECT failure_id, CASE failure_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'sentiment' WHEN 2 THEN 'keys' ELSE 'no object' END AS failure, round(translation_time_ms + 100, 3) AS total_time_ms, reason FROM pipeline_failure WHERE language = 'en') SELECT failure_id, failure, CASE WHEN failure IS NULL THEN 'It is said here' END AS english_text, CASE WHEN failure IS NULL THEN 'Neutral' END AS sentiment, CASE WHEN failure IS NULL THEN 0.75 END AS confidence, false AS was_translated, total_time_ms, 'ollama_fallback' AS translation_backend, reason AS fallback_reason, true AS review_recommended FROM f")
def fallback_records(s, d):
    f = t(s, d, "pipeline_failure").where("language = 'en'").withColumn("reply", F.expr(_bad_reply)).withColumn("fallback_ms", F.lit(100.0))
    return intel.resolved_failures(f).select("failure_id", "failure", "english_text", "sentiment", "confidence", "was_translated", "total_time_ms", "translation_backend", "fallback_reason", "review_recommended")


@query(f"WITH p AS (SELECT result_id AS id, english_text AS x FROM pipeline_result WHERE english_text IS NOT NULL), {CORES_SQL}, g AS (SELECT r, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS cue FROM h GROUP BY r), s AS (SELECT r, id, x, {COUNTS_SQL} AS c FROM w), u AS (SELECT r, id, {UNIQUE_SQL} AS top, {SCRIPT_SQL} AS script, c FROM s) SELECT id AS result_id, coalesce(script = 'latin' AND NOT (top[1] < 0 AND -top[1] / {TOTAL_SQL} >= 0.15), false) AND coalesce(cue = 'en', true) AS english FROM u LEFT JOIN g USING (r)")
def english_check(s, d):
    return t(s, d, "pipeline_result").where("english_text is not null").select("result_id", models.verified_english("english_text").alias("english"))


@query("WITH r AS (SELECT result_id, translation_time_ms, CASE result_id % 5 WHEN 0 THEN 'Mixed' ELSE sentiment END AS sentiment, post_text, language, was_transliterated, total_time_ms, english_text, confidence, sentiment_time_ms FROM pipeline_result), v AS (SELECT *, coalesce(trim(english_text) <> '' AND sentiment IN ('Negative', 'Neutral', 'Positive') AND confidence BETWEEN 0 AND 1 AND translation_time_ms >= 0 AND sentiment_time_ms >= 0 AND total_time_ms >= 0 AND abs(total_time_ms - (translation_time_ms + sentiment_time_ms)) <= 0.01, false) AS ok FROM r) SELECT result_id, coalesce(language, 'unknown') AS language, coalesce(was_transliterated, false) AS was_transliterated, greatest(0, coalesce(total_time_ms, 0)) AS deterministic_time_ms, 'InvalidPipelineResult' AS reason, greatest(0, coalesce(translation_time_ms, 0)) AS translation_time_ms FROM v WHERE NOT ok")
def failure_records(s, d):
    r = t(s, d, "pipeline_result").withColumn("sentiment", F.when(F.col("result_id") % 5 == 0, "Mixed").otherwise(F.col("sentiment")))
    return r.select("result_id", annotate.failure_record().alias("f")).where("f is not null").select("result_id", "f.language", "f.was_transliterated", "f.deterministic_time_ms", "f.reason", "f.translation_time_ms")


@query("SELECT r.result_id, CASE WHEN r.result_id % 3 = 0 THEN c.keywords END AS keywords FROM (SELECT DISTINCT result_id FROM pipeline_result) r LEFT JOIN (SELECT row_number() OVER (ORDER BY category_id) - 1 AS k, array_to_string(keywords, '|') AS keywords FROM policy_category) c ON c.k = r.result_id % 13")
def keyword_places(s, d):
    posts_ = t(s, d, "pipeline_result").select("result_id").distinct().withColumn("request", F.col("result_id") % 3).withColumn("pos", F.col("result_id") % 13)
    c = t(s, d, "policy_category").select(F.lit(0).cast("bigint").alias("request"), (F.row_number().over(Window.orderBy("category_id")) - 1).cast("bigint").alias("pos"), "keywords")  # thirteen rows
    return intel.keywords_by_place(posts_, c, "request").select("result_id", F.array_join("matched_keywords", "|").alias("keywords"))


@query("WITH r AS (SELECT DISTINCT result_id, language, total_time_ms FROM pipeline_result), b AS (SELECT *, (row_number() OVER (PARTITION BY language ORDER BY result_id) - 1) // 8 AS batch FROM r) SELECT result_id, round(sum(total_time_ms) OVER (PARTITION BY language, batch) / count(*) OVER (PARTITION BY language, batch), 7) AS time_ms FROM b")
def amortised_times(s, d):
    b = dedupe.batches(t(s, d, "pipeline_result").select("result_id", "language", "total_time_ms").distinct(), "result_id", 8, ["language"])
    ms = b.withColumn("ms", F.sum("total_time_ms").over(Window.partitionBy("language", "batch")))
    return models.amortised(ms, ["language", "batch"], "ms").select("result_id", F.round("time_ms", 7).alias("time_ms"))


@query("SELECT translation_backend AS model, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages FROM pipeline_result GROUP BY translation_backend")
def batch_languages(s, d):
    return metrics.languages_of(t(s, d, "pipeline_result"), "language", ["translation_backend"]).select(F.col("translation_backend").alias("model"), F.array_join("languages", ",").alias("languages"))


@query("WITH e AS (SELECT vec_id, unnest(['a', 'b', 'c', 'd', 'e']) AS label, unnest(embedding[1:5]) AS score FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k FROM e) SELECT vec_id, string_agg(label, '' ORDER BY k) AS best FROM r WHERE k <= 3 GROUP BY vec_id")
def best_labels(s, d):
    pairs = F.arrays_zip(F.array(*map(F.lit, "abcde")).alias("label"), F.slice("embedding", 1, 5).alias("score"))
    e = t(s, d, "embeddings").select("vec_id", F.transform(pairs, lambda p: F.struct(p["label"].alias("label"), p["score"].alias("score"))).alias("s"))
    return e.select("vec_id", F.array_join(F.transform(annotate.top_labels("s"), lambda r: r["label"]), "").alias("best"))


@query(f"SELECT doc_id, coalesce(len({split_words('text')}) + 2 > 128, false) AS sentiment_truncated FROM documents")
def sentiment_cut(s, d):
    return t(s, d, "documents").select("doc_id", annotate.sentiment_truncated(F.size(text.words("text")) + 2).alias("sentiment_truncated"))


_limits = (20, 600, 4000)


@query(f"WITH n AS (SELECT author_id, id, coalesce(length(post_text), 0) AS n FROM dataset), a AS (SELECT author_id, count(*) AS n_texts, sum(n) AS n_chars, max(n) AS longest, min(CASE WHEN n > {_limits[1]} THEN id END) AS pos FROM n GROUP BY author_id), l AS (SELECT a.*, (SELECT min(n.n) FROM n WHERE n.author_id = a.author_id AND n.id = a.pos AND n.n > {_limits[1]}) AS size FROM a) SELECT author_id, n_texts, n_chars, longest, CASE WHEN n_texts > {_limits[0]} OR pos IS NOT NULL OR n_chars > {_limits[2]} THEN 413 END AS code, CASE WHEN n_texts > {_limits[0]} THEN printf('Too many texts: %d (limit {_limits[0]}). Split the batch across several requests.', n_texts) WHEN pos IS NOT NULL THEN printf('texts[%d] is %d characters (limit {_limits[1]}).', pos, size) WHEN n_chars > {_limits[2]} THEN printf('Request totals %d characters (limit {_limits[2]}).', n_chars::BIGINT) END AS detail FROM l WHERE author_id IS NOT NULL")
def request_errors(s, d):
    e = requests.size_errors(t(s, d, "dataset").where("author_id is not null"), "author_id", "id", "post_text", *_limits)
    return e.select("author_id", "n_texts", "n_chars", "longest", "error.code", "error.detail")


@query("WITH k AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'GateFull' WHEN 1 THEN 'CircuitOpen' WHEN 2 THEN 'Invalid' WHEN 3 THEN 'Timeout' END AS kind, value * 700 AS wait FROM events) SELECT event_id, CASE kind WHEN 'GateFull' THEN 429 WHEN 'CircuitOpen' THEN 503 WHEN 'Invalid' THEN 422 WHEN 'Timeout' THEN 503 END AS code, CASE WHEN kind IN ('GateFull', 'CircuitOpen') THEN floor(wait)::INT END AS retry_after, round(greatest(5, least(600, wait)), 6) AS timeout_s FROM k")
def request_answers(s, d):
    k = F.col("event_id") % 5
    e = t(s, d, "events").withColumn("kind", F.when(k == 0, "GateFull").when(k == 1, "CircuitOpen").when(k == 2, "Invalid").when(k == 3, "Timeout")).withColumn("wait", F.col("value") * 700)
    e = e.withColumn("error", requests.error("kind", F.lit(""), F.col("wait")))
    return e.select("event_id", "error.code", "error.retry_after", F.round(requests.waiting_time("wait"), 6).alias("timeout_s"))


# --- joins and duplicates ---------------------------------------------------------------------------------------------------------
@query("SELECT id, platform, ingested_at FROM dataset QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1")
def first_deliveries(s, d):
    return dedupe.first_of(t(s, d, "dataset").select("id", "platform", "ingested_at"), ["id"], ["ingested_at"])


@query("WITH k AS (SELECT failure_id, post_text, language, was_transliterated, translation_time_ms FROM pipeline_failure), f AS (SELECT post_text, language, was_transliterated, arg_min(translation_time_ms, failure_id) AS base FROM k WHERE post_text IS NOT NULL AND language IS NOT NULL GROUP BY ALL) SELECT failure_id, round(translation_time_ms + 250, 3) AS spread_ms, round(round(translation_time_ms + 250, 3) + 12.5, 3) AS total_ms FROM k JOIN f USING (post_text, language, was_transliterated)")
def dedupe_failures(s, d):
    keys = ["post_text", "language", "was_transliterated"]
    f = t(s, d, "pipeline_failure").select("failure_id", *keys, "translation_time_ms")
    first = dedupe.first_of(f, keys, ["failure_id"])
    solved = first.select(*keys, F.col("translation_time_ms").alias("base_ms"), (F.col("translation_time_ms") + 250).alias("resolved_ms"), F.lit(12.5).alias("sentiment_ms"))
    return dedupe.spread_failures(f, solved, keys).select("failure_id", "spread_ms", "total_ms")


@query("WITH r AS (SELECT result_id, post_text, english_text, sentiment FROM pipeline_result GROUP BY ALL) SELECT result_id, result_id <> min(result_id) OVER (PARTITION BY post_text, english_text, sentiment) AS is_duplicate FROM r")
def dedupe_results(s, d):
    r = t(s, d, "pipeline_result").select("result_id", "post_text", "english_text", "sentiment").distinct()
    return dedupe.fan_out(r, ["post_text", "english_text", "sentiment"], "result_id", lambda x: x.withColumn("judged", F.lit(True))).select("result_id", "is_duplicate")


@query("SELECT DISTINCT language, post_text FROM pipeline_result r WHERE post_text IS NOT NULL AND language IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pipeline_failure f WHERE f.language = r.language AND f.post_text = r.post_text)")
def cache_misses(s, d):
    r = t(s, d, "pipeline_result").where("post_text is not null and language is not null")
    return dedupe.cache_misses(r, t(s, d, "pipeline_failure"), ["language", "post_text"])


@query("SELECT i.intel_id, c.severity, c.category_id IS NOT NULL AS in_pack FROM intelligence_result i LEFT JOIN policy_category c ON c.category_id = i.category")
def category_lookup(s, d):
    c = t(s, d, "policy_category").select("category_id", "severity")
    i = t(s, d, "intelligence_result").select("intel_id", "category")
    return i.join(c, i["category"] == c["category_id"], "left").select("intel_id", "severity", F.col("category_id").isNotNull().alias("in_pack"))


@query("SELECT count(*) AS n_texts, max(length(post_text)) AS longest, sum(length(post_text)) AS n_chars, min(CASE WHEN length(post_text) > 700 THEN id END) AS first_too_long FROM dataset")
def request_limits(s, d):
    n = F.length("post_text")
    return t(s, d, "dataset").agg(F.count("*").alias("n_texts"), F.max(n).alias("longest"), F.sum(n).alias("n_chars"), F.min(F.when(n > 700, F.col("id"))).alias("first_too_long"))


@query("SELECT result_id, language, (row_number() OVER (PARTITION BY language ORDER BY result_id) - 1) // 8 AS batch FROM (SELECT DISTINCT result_id, language FROM pipeline_result)")
def language_batches(s, d):
    return dedupe.batches(t(s, d, "pipeline_result").select("result_id", "language").distinct(), "result_id", 8, ["language"])


# --- evaluation ----------------------------------------------------------------------------------------------------------------------
_truth = case(LABEL_FORMS, "lower(trim(ground_truth_sentiment))")
EV = f"tr AS (SELECT id, {_truth} AS truth, reference_translation AS ref FROM dataset QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1), ev AS (SELECT r.result_id, tr.truth, r.sentiment AS pred, r.confidence, r.total_time_ms, r.translation_time_ms, r.language, r.translation_backend AS model, r.english_text AS hyp, tr.ref, r.was_translated FROM (SELECT * FROM pipeline_result QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY processed_at) = 1) r JOIN tr ON tr.id = r.post_id)"


def evaluated(s, d):
    tr = dedupe.first_of(t(s, d, "dataset").select("id", "ground_truth_sentiment", "reference_translation", "ingested_at"), ["id"], ["ingested_at"])
    tr = tr.select(F.col("id").alias("post_id"), text.normalize_label("ground_truth_sentiment").alias("truth"), F.col("reference_translation").alias("ref"))
    cols = ["result_id", "post_id", "sentiment", "confidence", "total_time_ms", "translation_time_ms", "language", "translation_backend", "english_text", "was_translated", "processed_at"]
    r = dedupe.first_of(t(s, d, "pipeline_result").select(*cols), ["result_id"], ["processed_at"])
    return r.join(tr, "post_id").withColumnsRenamed({"sentiment": "pred", "translation_backend": "model", "english_text": "hyp"})


CELLS = "cells AS (SELECT {by} a AS truth, b AS pred, count(*) FILTER (truth = a AND pred = b) AS n FROM ev, (VALUES ('Negative'), ('Neutral'), ('Positive')) x(a), (VALUES ('Negative'), ('Neutral'), ('Positive')) y(b) WHERE truth IN ('Negative', 'Neutral', 'Positive') AND pred IN ('Negative', 'Neutral', 'Positive') GROUP BY ALL)"
CLASSES = "cl AS (SELECT {by} l AS label, sum(n) FILTER (truth = l AND pred = l) AS tp, sum(n) FILTER (pred = l AND truth <> l) AS fp, sum(n) FILTER (truth = l AND pred <> l) AS fn FROM cells, (VALUES ('Negative'), ('Neutral'), ('Positive')) x(l) GROUP BY ALL), pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, tp + fn AS support FROM cl), pf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr)"
AVG = "av AS (SELECT {by} sum(support) AS n, CASE WHEN sum(support) > 0 THEN sum(tp) / sum(support) END AS acc, sum(p) / 3 AS pm, sum(r) / 3 AS rm, sum(f) / 3 AS fm, CASE WHEN sum(support) > 0 THEN sum(p * support) / sum(support) END AS pw, CASE WHEN sum(support) > 0 THEN sum(r * support) / sum(support) END AS rw, CASE WHEN sum(support) > 0 THEN sum(f * support) / sum(support) END AS fw FROM pf GROUP BY ALL)"


def ev(by: str = "", parts=(CELLS, CLASSES, AVG)) -> str:
    return f"WITH {EV}, " + ", ".join(p.format(by=by) for p in parts)


def rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query("SELECT language, count(*) AS n FROM pipeline_result GROUP BY language ORDER BY n DESC, language")
def lang_counts(s, d):
    return metrics.value_counts(t(s, d, "pipeline_result"), "language")


@query(f"WITH {EV} SELECT l AS label, i AS label_id, count(*) FILTER (truth = l) AS n FROM ev, (VALUES ('Negative', 0), ('Neutral', 1), ('Positive', 2)) x(l, i) GROUP BY ALL")
def class_counts(s, d):
    return metrics.class_counts(evaluated(s, d), "truth")


@query(ev(parts=(CELLS,)) + " SELECT * FROM cells")
def confusion_matrix(s, d):
    return metrics.confusion(evaluated(s, d), "truth", "pred")


@query(ev(parts=(CELLS,)) + " SELECT truth, pred, n, n > 0.55 * max(n) OVER () AS light_text FROM cells")
def confusion_heat_map(s, d):
    return reports.heat_map(metrics.confusion(evaluated(s, d), "truth", "pred"))


@query(ev() + " SELECT label AS name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM pf UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM av UNION ALL SELECT 'macro avg', round(pm, 6), round(rm, 6), round(fm, 6), n FROM av UNION ALL SELECT 'weighted avg', round(pw, 6), round(rw, 6), round(fw, 6), n FROM av")
def classification_report(s, d):
    return rounded(metrics.report(metrics.confusion(evaluated(s, d), "truth", "pred")), "precision", "recall", "f1")


_means = "me AS (SELECT model, avg(confidence) AS c, avg(total_time_ms) AS ms FROM ev WHERE truth IN ('Negative', 'Neutral', 'Positive') AND pred IN ('Negative', 'Neutral', 'Positive') GROUP BY model)"
_EVAL = ["n", "accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted", "avg_confidence", "avg_time_ms"]


def _models(s, d):
    return metrics.evaluate(evaluated(s, d), "truth", "pred", ["model"]).select("model", *_EVAL)


_models_sql = ev("model,") + f", {_means}, mo AS (SELECT model, n, acc AS accuracy, pm AS precision_macro, rm AS recall_macro, fm AS f1_macro, fw AS f1_weighted, c AS avg_confidence, ms AS avg_time_ms FROM av JOIN me USING (model))"


@query(_models_sql + " SELECT model, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _EVAL[1:]) + " FROM mo")
def evaluate_model(s, d):
    return rounded(_models(s, d), *_EVAL[1:])


@query(ev("language,") + " SELECT language, n AS n_posts, round(acc, 6) AS accuracy, round(fm, 6) AS f1_macro, round(fw, 6) AS f1_weighted FROM av WHERE language IS NOT NULL")
def language_breakdown(s, d):
    return rounded(metrics.breakdown(evaluated(s, d).where("language is not null"), "truth", "pred", "language"), "accuracy", "f1_macro", "f1_weighted")


@query(ev("language,", (CELLS,)) + " SELECT * FROM cells WHERE language IS NOT NULL")
def language_confusion(s, d):
    return metrics.confusion(evaluated(s, d).where("language is not null"), "truth", "pred", ["language"])


PROBS = "lo AS (SELECT truth, k, CASE WHEN pred = k THEN confidence ELSE (1 - confidence) / 2 END AS s FROM ev, (VALUES ('Negative'), ('Neutral'), ('Positive')) x(k) WHERE truth IN ('Negative', 'Neutral', 'Positive') AND confidence IS NOT NULL)"


def _scored(s, d):
    p = F.array(*(F.when(F.col("pred") == x, F.col("confidence")).otherwise((1 - F.col("confidence")) / 2) for x in LABELS))
    return evaluated(s, d).where("confidence is not null").withColumn("probs", p)


_pair_auc = "SELECT {by} sum(p * (cn + n / 2)) / sum(p) / sum(n) AS auc FROM (SELECT {by} p, n, sum(n) OVER ({part} ORDER BY s) - n AS cn FROM g) {group}"


@query(f"WITH {EV}, {PROBS}, g AS (SELECT k, s, count(*) FILTER (truth = k) AS p, count(*) FILTER (truth <> k) AS n FROM lo GROUP BY ALL), a AS ({_pair_auc.format(by='k,', part='PARTITION BY k', group='GROUP BY k')}) SELECT round(avg(auc), 6) AS roc_auc FROM a")
def roc_auc_ovr(s, d):
    return rounded(metrics.roc_auc(_scored(s, d), "truth", "probs"), "roc_auc")


_micro = f"WITH {EV}, {PROBS}, g AS (SELECT s, count(*) FILTER (truth = k) AS p, count(*) FILTER (truth <> k) AS n FROM lo GROUP BY ALL)"


@query(_micro + " " + f"SELECT round(auc, 6) AS auc FROM ({_pair_auc.format(by='', part='', group='')})")
def micro_roc_auc(s, d):
    return rounded(metrics.micro_auc(_scored(s, d), "truth", "probs"), "auc")


@query(_micro + " SELECT round(s, 6) AS s, round((sum(n) OVER (ORDER BY s DESC)) / sum(n) OVER (), 6) AS fpr, round((sum(p) OVER (ORDER BY s DESC)) / sum(p) OVER (), 6) AS tpr FROM g")
def micro_roc_curve(s, d):
    return rounded(metrics.roc_curve(_scored(s, d), "truth", "probs"), "s", "fpr", "tpr")


# --- translation quality ---------------------------------------------------------------------------------------------------------------
def bleu_sql(h: str, r: str, rows: str, by: str = "") -> str:
    words = lambda x: split_words(f"coalesce({x}, '')")
    side = lambda x, a, b: f"SELECT q, {by} n, array_to_string({x}[i:i + n - 1], ' ') AS g, {a} AS hc, {b} AS rc FROM tk, range(1, 5) t1(n), range(1, len({x}) - n + 2) t2(i)"
    key = by or ""
    return (
        f"tk AS (SELECT row_number() OVER () AS q, {by} {words(h)} AS h, {words(r)} AS r FROM {rows}), gr AS ({side('h', 1, 0)} UNION ALL {side('r', 0, 1)}), "
        f"mm AS (SELECT q, {by} n, g, sum(hc) AS hc, sum(rc) AS rc FROM gr GROUP BY ALL), oo AS (SELECT {by} n, sum(least(hc, rc)) AS m, sum(hc) AS t FROM mm GROUP BY ALL), "
        f"ln AS (SELECT {by} sum(len(h)) AS hl, sum(len(r)) AS rl FROM tk GROUP BY ALL), "
        f"bl AS (SELECT {key} CASE WHEN any_value(hl) < any_value(rl) THEN exp(1 - any_value(rl) / any_value(hl)) ELSE 1 END * exp(avg(ln(100 * m / t))) AS bleu FROM oo {'JOIN ln USING (' + by.strip(', ') + ')' if by else 'CROSS JOIN ln'} {'GROUP BY ' + by.strip(', ') if by else ''})"
    )


_mt_rows = "mt AS (SELECT * FROM ev WHERE was_translated AND ref IS NOT NULL)"


@query(f"WITH {EV}, {_mt_rows}, {bleu_sql('hyp', 'ref', 'mt')} SELECT round(bleu, 6) AS bleu FROM bl")
def corpus_bleu(s, d):
    return rounded(mt_metrics.bleu(evaluated(s, d).where("was_translated and ref is not null"), "hyp", "ref"), "bleu")


def chrf_sql(h: str, r: str, rows: str, by: str = "") -> str:
    chars = lambda x: f"regexp_replace(coalesce({x}, ''), {quoted(WS)}, '', 'g')"
    side = lambda x, a, b: f"SELECT q, {by} n, substr({x}, i::INT, n::INT) AS g, {a} AS hc, {b} AS rc FROM ck, range(1, 7) t1(n), range(1, length({x}) - n + 2) t2(i)"
    return (
        f"ck AS (SELECT row_number() OVER () AS q, {by} {chars(h)} AS h, {chars(r)} AS r FROM {rows}), cg AS ({side('h', 1, 0)} UNION ALL {side('r', 0, 1)}), cm AS (SELECT q, {by} n, g, sum(hc) AS hc, sum(rc) AS rc FROM cg GROUP BY ALL), "
        f"co AS (SELECT {by} n, sum(least(hc, rc)) AS m, sum(hc) AS t, sum(rc) AS u FROM cm GROUP BY ALL), cp AS (SELECT {by} avg(m / t) AS p, avg(m / u) AS r FROM co WHERE t > 0 AND u > 0 GROUP BY ALL), cf AS (SELECT {by} 100 * 5 * p * r / (4 * p + r) AS chrf FROM cp)"
    )


@query(f"WITH {EV}, {_mt_rows}, {chrf_sql('hyp', 'ref', 'mt')} SELECT round(chrf, 6) AS chrf FROM cf")
def corpus_chrf(s, d):
    return rounded(mt_metrics.chrf(evaluated(s, d).where("was_translated and ref is not null"), "hyp", "ref"), "chrf")


@query(f"WITH {EV}, {_mt_rows}, {bleu_sql('hyp', 'ref', 'mt', 'model,')}, n AS (SELECT model, count(*) AS n_translated, avg(translation_time_ms) AS ms FROM ev WHERE was_translated GROUP BY model) SELECT n.model, n_translated, round(ms, 6) AS avg_time_ms, round(bleu, 6) AS bleu FROM n LEFT JOIN bl ON bl.model = n.model")
def translation_metrics(s, d):
    return rounded(mt_metrics.evaluate_translation(evaluated(s, d), "hyp", "ref", ["model"]).select("model", "n_translated", "avg_time_ms", "bleu"), "avg_time_ms", "bleu")


_both_ways = "ag AS (SELECT d, CASE d WHEN 1 THEN hyp ELSE ref END AS h0, CASE d WHEN 1 THEN ref ELSE hyp END AS r0 FROM ev, (VALUES (1), (2)) x(d) WHERE ref IS NOT NULL AND was_translated)"


@query(f"WITH {EV}, {_both_ways}, {bleu_sql('h0', 'r0', 'ag', 'd,')}, {chrf_sql('h0', 'r0', 'ag', 'd,')} SELECT round(avg(bleu), 6) AS bleu, (SELECT round(avg(chrf), 6) FROM cf) AS chrf FROM bl")
def agreement(s, d):
    return rounded(mt_metrics.agreement(evaluated(s, d).where("ref is not null"), "hyp", "ref", F.col("was_translated")), "bleu", "chrf")


def tokens_sql(x: str) -> str:
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    x = f"(' ' || {x} || ' ')"
    for p, to in ((r"([\{-~\[-` -&\(-\+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, {quoted(p)}, {quoted(to)}, 'g')"
    return x


@query(f"WITH {EV}, {_mt_rows}, m13 AS (SELECT model, {tokens_sql('hyp')} AS h0, {tokens_sql('ref')} AS r0 FROM mt), {bleu_sql('h0', 'r0', 'm13', 'model,')} SELECT model, round(bleu, 6) AS bleu FROM bl")
def bleu_13a(s, d):
    return rounded(mt_metrics.bleu(evaluated(s, d).where("was_translated and ref is not null"), "hyp", "ref", ["model"], tokenize=True), "bleu")


# --- winners, reports ---------------------------------------------------------------------------------------------------------------------
@query(_models_sql + " SELECT model, round(f1_macro, 4) AS f1_macro, round(accuracy, 4) AS accuracy FROM mo ORDER BY round(f1_macro, 4) DESC, round(accuracy, 4) DESC, round(avg_time_ms, 4), model LIMIT 1")
def winner_sentiment(s, d):
    return rounded(winners.winner(_models(s, d), "model").select("model", "f1_macro", "accuracy"), "f1_macro", "accuracy", places=4)


@query(f"WITH {EV}, {_mt_rows}, {bleu_sql('hyp', 'ref', 'mt', 'model,')}, {chrf_sql('hyp', 'ref', 'mt', 'model,')}, n AS (SELECT model, count(*) AS n_translated, avg(translation_time_ms) AS ms FROM ev WHERE was_translated GROUP BY model) SELECT n.model, n_translated, round(ms, 6) AS avg_time_ms, round(bleu, 6) AS bleu, round(chrf, 6) AS chrf FROM n JOIN bl ON bl.model = n.model JOIN cf ON cf.model = n.model ORDER BY round(chrf, 4) DESC, round(bleu, 4) DESC, round(ms, 4), n.model LIMIT 1")
def winner_translation(s, d):
    m = mt_metrics.evaluate_translation(evaluated(s, d), "hyp", "ref", ["model"])
    return rounded(winners.winner(m.where("bleu is not null"), "model", winners.TRANSLATION).drop("comet"), "avg_time_ms", "bleu", "chrf")


@query(_models_sql + ", un AS (SELECT model, unnest(['accuracy', 'f1_macro', 'f1_weighted']) AS metric, unnest([accuracy, f1_macro, f1_weighted]) AS value FROM mo) SELECT metric, model, round(value, 6) AS value FROM un")
def metrics_unpivot(s, d):
    return rounded(reports.unpivoted(_models(s, d), "model", ["accuracy", "f1_macro", "f1_weighted"]), "value")


@query(_models_sql + ", un AS (SELECT model, unnest(['accuracy', 'f1_macro']) AS metric, unnest([accuracy, f1_macro]) AS value FROM mo) SELECT metric, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN printf('%.4f', value) END) AS {m}" for m in ("indictrans2", "nllb")) + " FROM un GROUP BY metric")
def metric_table(s, d):
    return reports.metric_table(_models(s, d), "model", ["accuracy", "f1_macro"], ["indictrans2", "nllb"])


#: What a model weighs can't be known from the tables; its name's length stands for it.
def _weighed(s, d):
    none = F.lit(None).cast("double")
    return _models(s, d).withColumns({"roc_auc": none, "total_time_s": F.col("avg_time_ms") * F.col("n") / 1000, "model_size_mb": F.length("model") * 1.25, "gpu_peak_mb": none, "is_binary": F.col("model") == "nllb"})


_rows_sql = "unnest(['Accuracy', 'Precision (macro)', 'Recall (macro)', 'F1 (macro)', 'F1 (weighted)', 'ROC-AUC', 'Avg confidence', 'Avg inference time (ms/post)', 'Total inference time (s)', 'Model size (MB)', 'GPU peak memory (MB)', 'Binary model (Neutral approximated)']) AS metric, unnest([printf('%.4f', accuracy), printf('%.4f', precision_macro), printf('%.4f', recall_macro), printf('%.4f', f1_macro), printf('%.4f', f1_weighted), 'n/a', printf('%.4f', avg_confidence), printf('%.2f', avg_time_ms), printf('%.2f', avg_time_ms * n / 1000), printf('%.1f', length(model) * 1.25), 'n/a', CASE WHEN model = 'nllb' THEN 'True' ELSE 'False' END]) AS v, unnest(range(12)) AS place"


@query(_models_sql + f", lo AS (SELECT model, {_rows_sql} FROM mo) SELECT place, metric, max(v) FILTER (model = 'indictrans2') AS indictrans2, max(v) FILTER (model = 'nllb') AS nllb FROM lo GROUP BY place, metric")
def comparison_table(s, d):
    return reports.formatted_table(_weighed(s, d), "model", reports.SENTIMENT_ROWS, ["indictrans2", "nllb"])


@query(_models_sql + " SELECT unnest(['model_size_mb', 'gpu_peak_mb']) AS metric, model, unnest([length(model) * 1.25, 0]) AS value FROM mo")
def memory_bars(s, d):
    return reports.memory_bars(_weighed(s, d), "model")


_lang_model = ev("language, model,") + ", lm AS (SELECT language, model, fm AS f1_macro FROM av WHERE language IS NOT NULL)"


def _by_language(s, d):
    return metrics.breakdown(evaluated(s, d).where("language is not null"), "truth", "pred", "language", ["model"])


@query(_lang_model + " SELECT language, " + ", ".join(f"coalesce(round(max(CASE WHEN model = '{m}' THEN f1_macro END), 6), 0) AS {m}" for m in ("indictrans2", "nllb")) + " FROM lm GROUP BY language")
def language_pivot(s, d):
    return rounded(reports.pivoted(_by_language(s, d), "language", "model", "f1_macro", ["indictrans2", "nllb"], 0.0), "indictrans2", "nllb")


@query(_lang_model + " SELECT a.language FROM lm a JOIN lm b USING (language) WHERE a.model = 'indictrans2' AND b.model = 'nllb' AND a.f1_macro > b.f1_macro")
def better_languages(s, d):
    return reports.better_rows(_by_language(s, d), "language", "model", "f1_macro", "indictrans2", "nllb")


@query(f"WITH {EV} SELECT 'truth' AS series, l AS category, count(*) FILTER (truth = l) AS value FROM ev, (VALUES ('Negative'), ('Neutral'), ('Positive')) x(l) GROUP BY ALL UNION ALL SELECT 'prediction', l, count(*) FILTER (pred = l) FROM ev, (VALUES ('Negative'), ('Neutral'), ('Positive')) x(l) GROUP BY ALL")
def prediction_distribution(s, d):
    e = evaluated(s, d)
    one = lambda c, name: metrics.class_counts(e, c).select(F.lit(name).alias("series"), F.col("label").alias("category"), F.col("n").alias("value"))
    return one("truth", "truth").unionByName(one("pred", "prediction"))


@query(f"WITH {EV} SELECT model, CASE WHEN avg(total_time_ms) / 10 < 60 THEN printf('%.1fs', avg(total_time_ms) / 10) ELSE printf('%dm %.1fs', floor(avg(total_time_ms) / 600)::INT, avg(total_time_ms) / 10 - 60 * floor(avg(total_time_ms) / 600)) END AS time FROM ev GROUP BY model")
def readable_times(s, d):
    return evaluated(s, d).groupBy("model").agg((F.avg("total_time_ms") / 10).alias("x")).select("model", text.seconds_text("x").alias("time"))


# --- call log --------------------------------------------------------------------------------------------------------------------------------
@query("WITH l AS (SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50), a AS (SELECT user_id, list_sort(list(value)) AS v FROM l GROUP BY user_id) SELECT user_id, len(v) AS n, round(v[len(v) // 2 + 1], 1) AS p50, round(v[least(len(v) - 1, floor(0.95 * (len(v) - 1)))::INT + 1], 1) AS p95 FROM a")
def latency_quantiles(s, d):
    return metrics.nearest_rank(t(s, d, "events"), "value", ["ts", "event_id"], ["user_id"])


@query("WITH e AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events) SELECT event_id, CASE WHEN failed THEN sum(failed::INT) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS run FROM e")
def failure_runs(s, d):
    e = t(s, d, "events").withColumn("failed", F.col("event_type") == "error")
    return gatelog.failure_runs(e, ["user_id"], ["ts", "event_id"], "failed").select("event_id", "run")


@query("WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + value * 600 + 1 AS b FROM events) SELECT x.event_id, count(y.event_id) AS open_calls FROM e x LEFT JOIN e y ON y.user_id = x.user_id AND y.a < x.a AND y.b > x.a GROUP BY x.event_id")
def gate_admission_bound(s, d):
    e = t(s, d, "events").select("event_id", "user_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("a"))
    e = e.withColumn("b", F.col("a") + F.col("value") * 600 + 1)
    return gatelog.overlap_bound(e, ["user_id"], "a", "b").select("event_id", "open_calls")


@query()
def gate_replay(s, d):
    e = t(s, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("a"), "value", (F.col("event_type") == "error").alias("failed"))
    e = e.withColumn("b", F.col("a") + F.col("value"))
    return gatelog.replay(e, "user_id", "a", "b", "failed").select("event_id", "decision")


# --- whole pipelines ---------------------------------------------------------------------------------------------------------------------------
_flag_cte = f"a AS (SELECT doc_id, lang, {clean_sql('text')} AS tgt FROM documents WHERE text IS NOT NULL), b AS (SELECT *, {_tgt_cores} AS tt FROM a WHERE tgt <> ''), e AS (SELECT *, {eff(has('tt', POSITIVE), has('tt', NEGATIVE), has('tt', NEGATION))} AS pol FROM b), f AS (SELECT lang, CASE WHEN lang = 'en' THEN 'bypass' WHEN lang IN {inlist(FLORES)} THEN 'translate' ELSE 'passthrough' END AS route, CASE WHEN pol = 'pos' THEN 'Positive' WHEN pol IN ('neg', 'mixed') THEN 'Negative' ELSE 'Neutral' END AS sentiment, CASE WHEN pol = 'mixed' THEN 0.4 ELSE 0.8 END AS confidence FROM e)"


@query(f"WITH {_flag_cte} SELECT lang, route, sentiment, count(*) AS n_posts, count(*) FILTER (confidence < 0.6 OR coalesce(lang, '') IN ('', 'unknown') OR lang <> 'en') AS n_review, round(avg(confidence), 6) AS avg_confidence FROM f GROUP BY ALL")
def flagship(s, d):
    """Clean documents, route them, score them with the lexicon, flag them, and count by language, route and sentiment."""
    t0 = t(s, d, "documents").where("text is not null").select("lang", text.clean_text("text").alias("clean")).where(F.length("clean") > 0)
    t0 = t0.withColumn("route", quality.route("lang")).withColumn("probs", models.lexicon_probs("clean"))
    t0 = t0.withColumns({"sentiment": annotate.top_label("probs"), "confidence": annotate.top_confidence("probs"), "language": F.col("lang"), **{c: F.lit(False) for c in ("was_translated", "fallback_used", "translation_truncated", "sentiment_truncated")}})
    t0 = t0.withColumns(annotate.quality_flags())
    return t0.groupBy("lang", "route", "sentiment").agg(F.count("*").alias("n_posts"), F.count_if("review_recommended").alias("n_review"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


_language_cte = (
    f"a AS (SELECT id, row_number() OVER () AS rr, {clean_sql('post_text')} AS x FROM dataset WHERE post_text IS NOT NULL), s AS (SELECT *, {COUNTS_SQL} AS c FROM a WHERE x <> ''), u AS (SELECT *, {UNIQUE_SQL} AS top, {SCRIPT_SQL} AS script FROM s), "
    f"v AS (SELECT *, CASE WHEN top[1] < 0 AND -top[1] / {TOTAL_SQL} >= 0.15 THEN top[3] END AS uniq FROM u), g AS (SELECT *, coalesce(uniq, CASE script WHEN 'latin' THEN 'en' WHEN 'devanagari' THEN 'hi' END, 'unknown') AS lang FROM v), "
    f"q AS (SELECT *, CASE WHEN script = 'latin' THEN x WHEN lang IN ('en', 'unknown') AND {TOTAL_SQL} > 0 AND c.latin / {TOTAL_SQL} >= 0.15 THEN {_extract_sql} END AS probe FROM g), p AS (SELECT rr AS id, probe AS x FROM q WHERE probe IS NOT NULL), {CORES_SQL}, "
    "cu AS (SELECT w.id AS rr, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS cue FROM h JOIN w USING (r) GROUP BY w.id), "
    "la AS (SELECT q.*, q.x AS tgt, CASE WHEN lang IN ('en', 'unknown') AND uniq IS NOT NULL THEN uniq WHEN cue IS NULL OR (lang NOT IN ('en', 'unknown') AND cue = 'en') THEN lang ELSE cue END AS language FROM q LEFT JOIN cu USING (rr)), "
    f"co AS (SELECT id, language, {_tgt_cores} AS tt FROM la), po AS (SELECT id, language, {eff(has('tt', POSITIVE), has('tt', NEGATIVE), has('tt', NEGATION))} AS pol FROM co), "
    "fi AS (SELECT id, language, CASE WHEN pol = 'pos' THEN 'Positive' WHEN pol IN ('neg', 'mixed') THEN 'Negative' ELSE 'Neutral' END AS sentiment, CASE WHEN pol = 'mixed' THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM po)"
)


@query(f"WITH {_language_cte} SELECT id, language, sentiment, confidence, confidence < 0.6 OR language <> 'en' AS review_recommended FROM fi")
def analyze_posts(s, d):
    return analyze(t(s, d, "dataset").select("id", "post_text")).select("id", "language", "sentiment", "confidence", "review_recommended")


def _upper(texts: list[str], lang: str) -> list[str]:
    """A stand-in for a translation model that rejects some texts."""
    return ["" if len(x) % 7 == 0 else f"translated from {lang}: {x.encode().hex()[:40]} text" for x in texts]


def _words(texts: list[str], lang: str) -> list[str]:
    return [f"second try from {lang}" for _ in texts]


_first_try = "CASE WHEN length(post_text) % 7 = 0 THEN '' ELSE 'translated from ' || language || ': ' || left(lower(hex(encode(post_text))), 40) || ' text' END"
_tries = f"todo AS (SELECT DISTINCT language, post_text FROM pipeline_result WHERE post_text IS NOT NULL AND language <> 'en' AND language IN {inlist(FLORES)}), raw AS (SELECT language, post_text, 1 AS k, post_text AS src, {_first_try} AS tgt FROM todo UNION ALL SELECT language, post_text, 2, post_text, 'second try from ' || language FROM todo)"


@query(
    f"WITH {gated(_tries, 'language, post_text, k')}, w AS (SELECT language, post_text, max(CASE WHEN k = 1 AND reason IS NULL THEN tgt END) AS one, max(CASE WHEN k = 2 AND reason IS NULL THEN tgt END) AS two FROM gated GROUP BY ALL) "
    "SELECT r.result_id, CASE WHEN r.language = 'en' THEN 'bypass' WHEN r.language IS NULL OR r.language NOT IN " + inlist(FLORES) + " THEN 'passthrough' WHEN r.post_text IS NULL THEN NULL WHEN one IS NOT NULL THEN 'primary' ELSE 'secondary' END AS translation_backend, "
    "CASE WHEN r.language = 'en' OR r.language IS NULL OR r.language NOT IN " + inlist(FLORES) + " THEN r.post_text ELSE coalesce(one, two) END AS english_text, CASE WHEN w.language IS NOT NULL AND one IS NULL AND two IS NULL THEN 'unusable' END AS failure FROM pipeline_result r LEFT JOIN w ON w.language = r.language AND w.post_text = r.post_text"
)
def translation_cascade(s, d):
    r = t(s, d, "pipeline_result").select("result_id", "language", "post_text")
    return models.translated(r, "post_text", "language", lambda: _upper, lambda: _words).select("result_id", "translation_backend", "english_text", "failure")


@query(f"WITH {_language_cte} SELECT id, language, sentiment FROM fi")
def stream_analyze(s, d):
    """The posts analysed as a stream, worked off and read back."""
    import os

    from vakya.streaming.analyze import analyzed_stream, run_available

    at = store.new_folder(s)
    src = t(s, d, "dataset").select("id", "post_text")
    path = f"{d}/dataset.parquet"
    pattern = path if os.path.isdir(path) else f"{d}/dataset*.parquet"
    schema = t(s, d, "dataset").schema
    from pyspark.sql import types as T

    only = T.StructType([f for f in schema.fields if f.name in src.columns])
    run_available(analyzed_stream(s, pattern, only.simpleString()[7:-1].replace(":", " ").replace(",", ", ")).select("id", "language", "sentiment"), f"{at}/out", f"{at}/checkpoint")
    return s.read.schema("id bigint, language string, sentiment string").parquet(f"{at}/out")


@query()
def seeded_sample(s, d):
    return io.seeded_sample(t(s, d, "dataset").select("id", "platform"), 500, "id")
