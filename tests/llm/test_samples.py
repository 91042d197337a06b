"""Problems 3 and 9: quotas and mixes."""

import math
import random

import pytest

pytest.importorskip("vakya.llm")
from vakya.llm import base, mixing, quota  # noqa: E402

DIR = "/root/testdata/sf0.01"
TARGETS = "platform string, topic string, ground_truth_sentiment string, target_permille int, min_rows int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_controlled_rounding_keeps_margins():
    r = random.Random(3)
    for _ in range(30):
        cells = {(f"r{i}", f"c{j}"): r.choice([0, r.random() * 5, r.randint(0, 3)]) for i in range(r.randint(1, 5)) for j in range(r.randint(1, 6))}
        got = quota.controlled_rounding(cells)
        around = lambda x, n: math.floor(x + 1e-9) <= n <= math.ceil(x - 1e-9)
        assert all(around(x, got[k]) for k, x in cells.items()) and around(sum(cells.values()), sum(got.values()))
        for side in (0, 1):
            for v in {k[side] for k in cells}:
                assert around(sum(x for k, x in cells.items() if k[side] == v), sum(n for k, n in got.items() if k[side] == v))


def test_minima_are_bounds_of_the_flow():
    r = random.Random(5)
    for _ in range(60):
        cells = {(f"r{i}", f"c{j}"): r.random() * 4 for i in range(r.randint(2, 4)) for j in range(r.randint(2, 5))}
        least = {k: r.randint(1, 3) for k in cells if r.random() < 0.25}
        got = quota.controlled_rounding(cells, least)
        for k, x in cells.items():
            assert max(math.floor(x), least.get(k, 0)) <= got[k] <= max(math.ceil(x), least.get(k, 0))
        for side in (0, 1):
            for v in {k[side] for k in cells}:
                assert math.floor(sum(x for k, x in cells.items() if k[side] == v)) <= sum(n for k, n in got.items() if k[side] == v)
    # Of a row of 2 with a minimum of 1 in each of four cells all margins must give way by 2; with room they don't.
    tight = quota.controlled_rounding({("r", c): 0.5 for c in "abcd"}, {("r", c): 1 for c in "abcd"})
    assert tight == {("r", c): 1 for c in "abcd"}
    room = quota.controlled_rounding({(r, c): 1.5 for r in "xy" for c in "ab"}, {("x", "a"): 2})
    assert room["x", "a"] == 2 and sum(room.values()) == 6 and sum(n for (r, _), n in room.items() if r == "x") == 3 == sum(n for (_, c), n in room.items() if c == "a")


def test_rounding_of_a_hundred_thousand_cells():
    r = random.Random(9)
    cells = {(i, j): r.random() * 2 for i in range(400) for j in range(260)}
    got = quota.controlled_rounding(cells)
    assert all(math.floor(x) <= got[k] <= math.ceil(x) for k, x in cells.items()) and abs(sum(got.values()) - sum(cells.values())) < 1


def test_margins_are_reported(spark):
    targets = spark.createDataFrame([("X", "a", "Negative", 10, 5), ("X", "b", "Negative", 10, 5), ("Y", "a", "Negative", 980, 0)], TARGETS)
    posts = spark.createDataFrame([(i, "x" if i < 500 else "y", "ab"[i % 2], "neg") for i in range(1000)], "id bigint, platform string, topic string, ground_truth_sentiment string")
    got = {tuple(r)[:2]: (r["quota"], r["exceeded"]) for r in quota.quota_margins(posts, targets).collect()}
    assert got["platform", "x"] == (10, True) and got["platform", "y"] == (98, False)


def test_sample_takes_its_quotas(spark):
    report = {tuple(r)[:3]: r for r in quota.quota_report(*_in(spark)).collect()}
    sample = quota.quota_sample(*_in(spark))
    got = {tuple(r)[:3]: r["n"] for r in sample.groupBy(*quota.KEYS).agg({"id": "count"}).withColumnRenamed("count(id)", "n").collect()}
    assert got == {k: r["taken"] for k, r in report.items() if r["taken"]}
    assert sample.select("id").distinct().count() == sample.count()
    assert rows(sample) == rows(quota.quota_sample(*_in(spark))) != rows(quota.quota_sample(*_in(spark), seed=7))
    assert sum(r["quota"] for r in report.values()) >= 400 and all(r["quota"] >= r["min_rows"] for r in report.values())


def _in(spark):
    return spark.read.parquet(f"{DIR}/dataset.parquet"), spark.read.parquet(f"{DIR}/sample_targets.parquet")


def test_quota_edge_cases(spark):
    targets = spark.createDataFrame([("X", "Roads", "Negative", 500, 1), ("X", "Roads", "Positive", 500, 3)], TARGETS)
    data = [(i, " x", "ROADS ", "neg") for i in range(20)] + [(i, "X", "roads", "POS") for i in range(20, 22)] + [(22, None, "roads", "pos"), (23, "x", None, "pos"), (24, "x", "roads", None), (None, "x", "roads", "pos"), (0, "X", "Roads", "negative")]
    posts = spark.createDataFrame(data, "id bigint, platform string, topic string, ground_truth_sentiment string").selectExpr("*", "1 as cell", "2 as available", "3 as prefix")
    report = {r["ground_truth_sentiment"]: r for r in quota.quota_report(posts, targets).collect()}
    assert (report["Negative"]["available"], report["Positive"]["available"]) == (20, 2)
    assert not report["Negative"]["short"] and report["Positive"]["short"] and report["Positive"]["needed"] == 3
    assert len(rows(quota.quota_sample(posts, targets))) == sum(r["taken"] for r in report.values())
    assert rows(quota.quota_sample(posts.limit(0), targets)) == [] and rows(quota.quota_report(posts, targets.limit(0))) == []


def _docs(spark):
    data = [(i, "a", "w " * (10 + i % 7)) for i in range(300)] + [(i, "b", "w " * 12) for i in range(300, 340)] + [(i, "c", "w " * 30) for i in range(340, 500)]
    data += [(500, "a", None), (501, "a", ""), (502, None, "w " * 5), (None, "a", "w"), (0, "a", "w " * 10)]
    return spark.createDataFrame(data, "doc_id bigint, source string, text string").selectExpr("*", "1 as size", "2 as pass", "3 as slot")


def test_mix_holds_its_shares(spark):
    docs = _docs(spark)
    targets = spark.createDataFrame([("a", 400, 1), ("b", 300, 3), ("c", 250, 1), ("d", 50, 2)], "source string, target_permille int, max_repeats int")
    r = {x["source"]: x for x in mixing.mix_report(docs, targets, block=64).collect()}
    total = sum(10 + i % 7 for i in range(300)) + 40 * 12 + 160 * 30 + 5
    assert [r[k]["short"] for k in "abcd"] == [False, False, False, True] and math.isclose(r["a"]["needed"], total * 0.2)
    for k in "abc":
        assert r[k]["held"] == math.ceil(r[k]["needed"])
    m = mixing.mix(docs, targets, block=64)
    got = m.orderBy("slot", "place").collect()
    pieces, of = {}, {}
    for x in got:
        pieces.setdefault((x["doc_id"], x["pass"]), []).append((x["first_token"], x["n_tokens"]))
        of.setdefault((x["slot"], x["source"]), []).append(x["n_tokens"])
        assert x["source"] in "abc" and 0 < x["n_tokens"] <= 64
    uses = {}
    for i, _ in pieces:
        uses[i] = uses.get(i, 0) + 1
    for p in pieces.values():  # the pieces of one use join without gap or overlap
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:]))
    for k in "abc":  # blocks are of equal tokens but for the last
        sizes = sorted(sum(v) for (_, source), v in of.items() if source == k)
        assert sizes[1:] == [64] * (len(sizes) - 1)
    assert max(n for i, n in uses.items() if i < 300) == 1 and max(n for i, n in uses.items() if 300 <= i < 340) <= 3
    half = got[: len(got) // 2]  # any stretch has about the target shares
    whole = sum(x["n_tokens"] for x in half)
    for k in "abc":
        assert abs(sum(x["n_tokens"] for x in half if x["source"] == k) / whole - r[k]["held"] / sum(r[j]["held"] for j in "abc")) < 0.06
    assert rows(m) == rows(mixing.mix(docs.repartition(7), targets, block=64))


def test_any_number_of_sources_and_documents_longer_than_a_block(spark):
    docs = spark.createDataFrame([(i, f"s{i}", "w " * (1 + i % 3)) for i in range(12_000)] + [(12_000, "long", "w " * 5000)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([(f"s{i}", 0 if i else 1, 1) for i in range(12_000)] + [("long", 100, 1)], "source string, target_permille int, max_repeats int")
    got = mixing.mix(docs, targets, block=256).where("source = 'long'").orderBy("place").collect()
    need = -(-100 * (sum(1 + i % 3 for i in range(12_000)) + 5000) // 2000)
    assert sum(x["n_tokens"] for x in got) == need and len(got) == -(-need // 256) and [x["first_token"] for x in got] == [x["place"] for x in got]


def test_mix_edge_cases(spark):
    docs = _docs(spark)
    targets = spark.createDataFrame([("a", 1000, 0), ("z", 0, 1)], "source string, target_permille int, max_repeats int")
    assert rows(mixing.mix_report(docs, targets).select("source", "short", "held")) == [("a", True, 0), ("z", False, 0)]
    assert rows(mixing.mix(docs, targets)) == [] and rows(mixing.mix_report(docs, targets.limit(0))) == []
    assert rows(mixing.mix_report(docs.limit(0), targets).select("source", "short")) == [("a", False), ("z", False)]


def test_sizes_in_tokens(spark):
    df = spark.createDataFrame([(1, "a", "hello world"), (2, "a", None), (3, "a", "<|endoftext|>")], "doc_id bigint, source string, text string")
    got = dict(rows(mixing.sized(df, f"{base.tokenizers(spark)}/{mixing.TOKENIZER}").select("doc_id", "size")))
    assert got[1] == 2 and got[2] == 0 and got[3] > 1
