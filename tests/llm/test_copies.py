"""Problems 2, 5 and 7 against brute force and on edge cases."""

import itertools
import unicodedata

import duckdb
import pytest

pytest.importorskip("vakya.llm")
from vakya.llm import formatdup, looks, neardup  # noqa: E402
from vakya.llm.base import words_of  # noqa: E402

DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def posts():
    return duckdb.sql(f"select distinct id, post_text from '{DIR}/dataset.parquet' where trim(post_text) <> ''").fetchall()


def key(text):
    f = formatdup.fields(text)
    fold = lambda s: "".join(c for c in s if unicodedata.category(c)[0] in "LMN").casefold()
    return frozenset((fold(n), fold(v)) for n, v in f) if f else fold(text)


def test_format_copies_match_brute_force(spark):
    groups = {}
    for i, t in posts():
        groups.setdefault(key(t), []).append(i)
    want = sorted((min(g), i) for k, g in groups.items() if k for i in g if i != min(g))
    assert rows(formatdup.QUERIES["p2_found"](spark, DIR)) == want and want


def test_format_copies_edge_cases(spark):
    data = [
        (1, "Ward: 9; Ref: 1/2"), (2, '{"ref": "12", "WARD": "9"}'), (3, "ward: 9 ref: 1-2\nref: 12"), (4, "a b, C!"), (5, "A​B c"), (4, "a b, C!"),
        (6, None), (7, ""), (8, "  "), (9, "🙏"), (10, "🙏🙏"), (11, "x" * 200_000), (12, "X" * 200_000 + "."), (13, "STRASSE"), (14, "straße"), (None, "abc"), (15, "Ward 9 Ref 12"),
    ]
    df = spark.createDataFrame(data, "id bigint, text string").selectExpr("id", "text", "1 as hash", "2 as keep_id")
    assert rows(formatdup.format_copies(df)) == [(1, 2), (1, 3), (4, 5), (11, 12), (13, 14)]
    assert rows(formatdup.copy_counts(df)) == [(1, 3), (4, 2), (9, 1), (10, 1), (11, 2), (13, 2), (15, 1)]
    assert rows(formatdup.format_copies(df.limit(0))) == []


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    import numpy as np

    texts = ["ab", "cd", "A b", "c-D"]
    monkeypatch.setattr(formatdup, "text_hashes", lambda t: (np.ones(len(t), np.uint64), np.ones(len(t), np.int64)))
    assert formatdup.same_record(texts[0], texts[2]) and not formatdup.same_record(texts[0], texts[1])
    assert formatdup.digest(texts[1]) == formatdup.digest(texts[3]) != formatdup.digest(texts[0])


def test_plain_form():
    f = looks.plain_form
    assert f("Ｆｕｌｌ ﬁne …") == "Full fine ..."
    assert f("café   x​﻿ ") == "café x"
    assert f("М­оsсow") == "Moscow"
    assert f("е́") == "é" and f("e‍́") == "é"
    assert f("हिन्दी") == "हिन्दी" and f("") == ""
    assert f("ﾊﾟﾋﾟ") == "パピ" and f("ㄱㅏ") == "가" and f("ёж") == f("ëж") == f("ёж")
    for c in "ﬁéО​ก्ो":
        assert f(f(c)) == f(c)


def test_same_looks_match_brute_force(spark):
    want = set()
    for src, rs in (("dataset", posts()), ("pipeline_result", duckdb.sql(f"select distinct result_id, cleaned_text from '{DIR}/pipeline_result.parquet' where trim(cleaned_text) <> ''").fetchall())):
        by = {}
        for i, t in rs:
            by.setdefault(looks.plain_form(t), []).append((i, t))
        for g in by.values():
            want |= {(src, *sorted((a, b))) for (a, t), (b, u) in itertools.combinations(g, 2) if t != u}
    assert rows(looks.p5_found(spark, DIR)) == sorted(want)


def test_same_looks_edge_cases(spark):
    data = [("s", 1, "a b"), ("s", 2, "a b "), ("s", 2, "a b "), ("s", 3, "a b"), ("t", 4, "a  b"), ("s", 5, None), ("s", 6, " "), ("s", None, "a  b")]
    df = spark.createDataFrame(data, "src string, key bigint, text string").selectExpr("*", "1 as look")
    assert rows(looks.same_look_pairs(df)) == [("s", 1, 2), ("s", 2, 3)]
    assert rows(looks.same_look_classes(df)) == [("s", 1, 1, 2), ("s", 2, 1, 2), ("s", 3, 1, 2), ("t", 4, 4, 1)]
    assert rows(looks.same_look_pairs(df.limit(0))) == []


def brute(data, t=0.8, least=10):
    bags = [(i, w, set(w)) for i, w in ((i, words_of(looks.plain_form(x))) for i, x in data) if len(set(w)) >= least]
    return sorted({tuple(sorted((i, j))) for (i, v, a), (j, w, b) in itertools.combinations(bags, 2) if i != j and v != w and len(a & b) >= t * len(a | b) - 1e-9})


def test_near_pairs_match_brute_force(spark):
    assert rows(neardup.QUERIES["p7_found"](spark, DIR)) == brute(posts())


def test_near_pairs_with_hot_words_and_blocks(spark):
    import random

    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(26)]
    data = [(i, " ".join(r.sample(vocabulary, r.randint(9, 20)))) for i in range(300)]
    data += [(300 + i, "same text of ten different words that many authors have posted") for i in range(100)]
    data += [(400, "many authors have posted same text of ten different words that"), (401, None), (402, ""), (None, data[0][1]), (0, data[0][1])]
    df = spark.createDataFrame(data, "id bigint, text string").selectExpr("id", "text", "0L as word")
    want = brute([(i, t) for i, t in data if i is not None and t])
    assert len(want) > 100
    assert rows(neardup.near_pairs(df, block=16, cells=64)) == want
    assert rows(neardup.near_pairs(df.limit(0))) == []
